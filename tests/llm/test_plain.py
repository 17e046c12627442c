"""Plain versions: each learner and packer against a slow, direct statement of its rule."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspan.llm import lm, packing, quality, registry, rules, toxicity, urls

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- 2


def test_ftrl_matches_updates_one_by_one():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"{'bad' if k % 2 else 'good'}{v}" for v in rng.integers(0, 9, rng.integers(0, 30))) for k in range(60)])
    y = np.arange(60) % 2
    model = quality.train_ftrl(texts, y, np.array([30, 30]), epochs=2)
    z, n, zb, nb, b = Counter(), Counter(), 0.0, 0.0, 0.0
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rows = []
    for t in texts.to_pylist():
        data = np.frombuffer(t.encode(), np.uint8)
        idx, counts, _ = quality.gram_features(data, np.array([0, len(data)]))
        rows.append({int(i): c * 8.0 / max(1, counts[0]) for i, c in Counter(idx.ravel().tolist()).items()})
    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(60):
            w = {i: weight(i) for i in rows[r]}
            p = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in rows[r].items()) + b)))
            for i, v in rows[r].items():
                g = (p - y[r]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            g = p - y[r]
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
    assert max(abs(model["w"][i] - weight(i)) for i in z) < 1e-5 and np.count_nonzero(model["w"]) <= len(z)
    assert math.isclose(model["b"], b, abs_tol=1e-9)
    score = quality.score_array(texts, model)
    for r in range(60):
        dot = sum(weight(i) * v for i, v in rows[r].items()) + b
        assert math.isclose(score[r], 1 / (1 + math.exp(-dot)), abs_tol=1e-5)


# ---------------------------------------------------------------- 3


def test_crf_fit_climbs_the_likelihood_of_all_labellings():
    rng = np.random.default_rng(8)
    per_row = np.array([3, 1, 4, 2])
    x = rng.integers(0, 2, (10, rules.N_FEATURES)).astype(float)
    gold = (x[:, 3] > 0).astype(np.int64)

    def log_likelihood(model):
        total, at = 0.0, 0
        for n in per_row:
            emit = x[at : at + n] @ model["w"]
            value = lambda s: sum(emit[k, s[k]] for k in range(n)) + sum(model["t"][s[k], s[k + 1]] for k in range(n - 1))  # noqa: B023, E731
            every = [value([c >> k & 1 for k in range(n)]) for c in range(1 << n)]
            total += value(gold[at : at + n]) - math.log(sum(math.exp(v) for v in every))
            at += n
        return total / len(x)

    start = rules.NO_MODEL
    one = rules.fit_crf(x, gold, per_row, rounds=1, rate=1e-3, l2=0.0)
    # the first Adagrad step has the gradient's signs: compare with differences of the plain likelihood
    for key, at in (("w", (3, 0)), ("w", (3, 1)), ("w", (0, 1)), ("t", (0, 1)), ("t", (1, 1))):
        up, down = ({k: v.copy() for k, v in start.items()} for _ in range(2))
        up[key][at] += 1e-4
        down[key][at] -= 1e-4
        slope = (log_likelihood(up) - log_likelihood(down)) / 2e-4
        assert abs(slope) < 1e-6 or np.sign(one[key][at]) == np.sign(slope)
    fitted = rules.fit_crf(x, gold, per_row)
    assert log_likelihood(fitted) > log_likelihood(start) + 0.3
    assert rules.viterbi(x, per_row, fitted).tolist() == gold.tolist()


def test_rules_kept_follows_the_decoded_labels(spark):
    model = {"w": np.zeros((rules.N_FEATURES, 2)), "t": np.zeros((2, 2))}
    model["w"][2, 1] = 1.0  # lines of one to three words are boilerplate
    line = " ".join(f"w{k}" for k in range(25))
    texts = [line, f"{line}\na b\nc", "\n".join(["a b c"] * 20 + [line[:40]]), "a b", None, "\n".join([line, *[f"x{k} y{k} z{k}" for k in range(9)]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.checked(df, model).collect():
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (r.text or "").split("\n")]
        content = sum(n for n in counts if n > 3)
        assert r.content_words == content and r.n_words == sum(counts)
        assert r.kept == (not r.base_failed and content >= 0.5 * sum(counts))


# ---------------------------------------------------------------- 5


def test_lm_score_matches_a_plain_model(spark):
    """Counts in dictionaries, quantised by the same levels, shares by the same rule; the filter's
    rare false hits are all that may differ."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for r in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for i in train for w in tokens[i])
    two = Counter(p for i in train for p in zip([None, *tokens[i]], tokens[i]))
    n, v = sum(one.values()), len(one)
    starts = [1]
    while starts[-1] < 1e15:
        starts.append(max(starts[-1] + 1, int(starts[-1] * lm.RATIO)))
    level = lambda c: int(np.searchsorted(starts, c, "right"))

    def parts(h, w):
        low = lambda c: starts[level(c) - 1] if c else 0
        p = (low(one[w]) + 0.1) / (n + 0.1 * (v + 1))
        up = max(starts[level(one[h])] - 1, 1) if one[h] else 1
        both = low(two[h, w]) if one[h] and one[w] else 0
        return p, min(both, up), up, level(one[h])

    codes = Counter(parts(h, w) for i in train for h, w in zip([None, *tokens[i]], tokens[i]))
    shares = [0.3] * (len(starts) + 1)
    for _ in range(8):
        mine, here = [0.0] * len(shares), [0] * len(shares)
        for (p, both, up, at), many in codes.items():
            inside = max(both - 1, 0) / max(up - 1, 1)
            mine[at] += many * shares[at] * inside / (shares[at] * inside + (1 - shares[at]) * p)
            here[at] += many
        seen = [k for k in range(len(shares)) if here[k]]
        new = [min(0.95, max(0.01, (a + 1) / (b + 10))) for a, b in zip(mine, here)]
        shares = np.interp(range(len(shares)), seen, [new[k] for k in seen]).tolist()
    shares[0] = 0.0
    got = {r.doc_id: r.score for r in lm.scored(docs).collect()}
    want = {}
    for i, w in tokens.items():
        each = [parts(h, x) for h, x in zip([None, *w], w)]
        want[i] = sum(math.log10(shares[at] * both / up + (1 - shares[at]) * p) for p, both, up, at in each)
    off = [abs(got[i] - want[i]) / len(tokens[i]) for i in tokens]
    assert max(off) < 0.25 and np.mean(off) < 0.01
    assert math.isclose(sum(got.values()), sum(want.values()), rel_tol=2e-3)
    # a distribution is short of 1 by its rounding alone, and never above it
    for h in (None, *[w for w, _ in one.most_common(40)][1::13]):
        total = sum(s * both / up + (1 - s) * p for p, both, up, at in (parts(h, w) for w in one) for s in [shares[at]])
        assert 1 / lm.RATIO**2 < total <= 1


# ---------------------------------------------------------------- 7


def plain_best_fit(lengths, caps, cost):
    """Every bin looked at for every piece."""
    bins = []  # [capacity, used, pieces]
    for k, n in enumerate(lengths):
        open_ = [b for b in bins if b[0] - b[1] >= n]
        if open_:
            b = min(open_, key=lambda b: b[0] - b[1])
        else:
            best = []
            for c in caps:
                if c >= n:
                    later = sum(m for m in lengths[k + 1 :] if m <= c - n)
                    fill = n + min(c - n, later)
                    best.append((cost(min(x for x in caps if x >= fill)) / fill, c))
            b = [min(best)[1], 0, []]
            bins.append(b)
        b[1] += n
        b[2].append(k)
    return sorted((min(c for c in caps if c >= used), used) for _, used, _ in bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_matches_plain_version(seed):
    rng = np.random.default_rng(seed)
    caps = (64, 128, 512) if seed % 2 else (100, 300)
    lengths = np.sort(rng.integers(1, caps[-1] + 1, 120))[::-1] if seed < 3 else np.sort(rng.geometric(0.05, 200).clip(1, caps[-1]))[::-1]
    bins, offsets, final = packing.best_fit(lengths, caps)
    used = np.bincount(bins, lengths).astype(int)
    assert sorted(zip(final.tolist(), used.tolist(), strict=True)) == plain_best_fit(lengths.tolist(), caps, packing.size_cost)
    for b in range(len(final)):
        inside = np.flatnonzero(bins == b)
        assert offsets[inside].tolist() == [int(lengths[inside[:k]].sum()) for k in range(len(inside))]


def test_packing_rejects_negative_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack_lengths(spark.createDataFrame([(1, 5), (2, -3)], "doc_id long, length long"))
    text = spark.createDataFrame([("b", 5, 1), ("a", 600, 2), (None, None, 3)], "doc_id string, length long, bin_id int")
    assert {(r.doc_id, r.piece, r.length) for r in packing.pack_lengths(text, capacities=(512,)).collect()} == {("b", 0, 5), ("a", 0, 512), ("a", 1, 88), (None, 0, 0)}


# ---------------------------------------------------------------- 8


def test_beta_chance_matches_its_series(spark):
    cases = [(a, b, x) for a in (0.05, 0.7, 1.0, 3.2, 40.0, 900.5) for b in (0.05, 1.0, 2.5, 60.0, 700.0) for x in (0.2, 0.5, 0.8)]
    for x in (0.2, 0.5, 0.8):
        mine = [(float(a), float(b)) for a, b, at in cases if at == x]
        got = spark.createDataFrame(mine, "a double, b double").select("a", "b", urls.beta_above(F.col("a"), F.col("b"), x).alias("p")).collect()
        for r in got:
            turned = x > r.a / (r.a + r.b)  # the series of the smaller tail, whose terms soon fall
            p, q, at = (r.b, r.a, 1 - x) if turned else (r.a, r.b, x)
            total = term = 1.0
            for k in range(200_000):  # all terms are positive
                term *= (p + q + k) / (p + 1 + k) * at
                total += term
                if term < 1e-18 * total:
                    break
            front = math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(at) + q * math.log1p(-at)
            tail = math.exp(front + math.log(total)) / p
            below = 1 - tail if turned else tail
            assert math.isclose(r.p, 1 - below, abs_tol=1e-8), (r.a, r.b, x, r.p, below)


def test_domains_and_suffixes(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk:8080": ("shop.co.uk", "co.uk"),
             "u@www.site.org:1": ("site.org", "org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urls.domain_and_suffix(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_hosts_under_one_two_label_suffix_do_not_lend_each_other_names(spark):
    rows = [(k, "a.bad.co.uk", 1) for k in range(60)] + [(100 + k, f"h{k}.fine.co.uk", 0) for k in range(60)] + [(200, "new.bad.co.uk", None), (201, "new.fine.co.uk", None)]
    found = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "id long, host string, bad int")).collect()}
    assert found["a.bad.co.uk"].bad_chance > 0.99 and found["h3.fine.co.uk"].bad_chance < 0.2
    assert found["new.bad.co.uk"].bad_share > found["new.fine.co.uk"].bad_share + 0.2


# ---------------------------------------------------------------- 10


def test_first_tree_takes_the_best_splits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = ((x[:, 1] >= 3) & (x[:, 0] < 2)).astype(float)
    model = toxicity.fit_trees(x, y, trees=1, depth=2)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def best(rows):
        found = (0.0, 0, np.inf)
        for f in range(3):
            for cut in range(1, 6):
                left, right = rows & (x[:, f] < cut), rows & (x[:, f] >= cut)
                if h[left].sum() < 0.5 or h[right].sum() < 0.5:
                    continue
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                gain = part(left) + part(right) - part(rows)
                if gain > found[0] + 1e-9:
                    found = (gain, f, cut)
        return found[1:]

    same = lambda f, cut, want: f == want[0] and (cut == want[1] or (want[1] - 1 < cut <= want[1]))
    every = np.ones(len(y), bool)
    top = best(every)
    assert same(model["feature"][0, 0], model["cut"][0, 0], top)
    for side, rows in enumerate((x[:, top[0]] < top[1], x[:, top[0]] >= top[1])):
        want = best(rows)
        assert want[1] == np.inf or same(model["feature"][0, 1 + side], model["cut"][0, 1 + side], want)


def test_boosting_lowers_the_loss_and_calibration_is_isotonic():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * x[:, 2]))).astype(float)
    loss = []
    for n in (1, 10, 60):
        m = toxicity.tree_margin(x, toxicity.fit_trees(x, y, trees=n))
        loss.append(np.mean(np.log1p(np.exp(-(2 * y - 1) * m))))
    assert loss[0] > loss[1] > loss[2]
    margin, w = rng.integers(0, 12, 80).astype(float), rng.random(80) + 0.1
    t = (rng.random(80) < margin / 12).astype(float)
    knots, value = toxicity.isotonic(margin, t, w)
    assert (np.diff(value) > 0).all()
    # the least-squares rising fit by the max-min formula
    levels = np.unique(margin)
    mean = lambda i, j: np.average(t[(margin >= levels[i]) & (margin <= levels[j])], weights=w[(margin >= levels[i]) & (margin <= levels[j])])
    for k, m in enumerate(levels):
        want = max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1))
        assert math.isclose(value[np.searchsorted(knots, m)], want, abs_tol=1e-9)


# ---------------------------------------------------------------- all

COLUMNS = {
    "op2_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_quality_rules": {"doc_id": "bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), "base_failed": "boolean", "kept": "boolean"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op12_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op13_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
}


@pytest.mark.parametrize("name", registry.queries())
def test_every_query_returns_its_contract(spark, name):
    out = registry.queries()[name](spark, SF)
    assert {k: dict(out.dtypes).get(k) for k in COLUMNS.get(name, {})} == COLUMNS.get(name, {})
    rows = out.collect()
    if name not in ("op6_ann", "op7_pack", "op11_topk", "op13_whitening"):
        table, key = ("pages", "page_id") if name == "op8_url_filter" else ("documents", "doc_id")
        assert Counter(r[key] for r in rows) == Counter(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if "held_out" in out.columns:
        n, rest = {"op2_quality_classifier": (5, 0), "op5_lm_score": (10, 0), "op10_toxicity": (4, 2)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
    if "predicted" in out.columns:
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
