"""The operators on small fixtures: plain versions, round trips, odd rows."""

import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from seqspan.llm import ann, jaccard, linededup, lm, mixing, packing, quality, registry, rules, simhash, toxicity, urls
from seqspan.llm.common import row_name

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long_ = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [
        (1, "a b c d e f g h\nsecond line of text here", "en", "s1", 1), (1, "a b c d e f g h\nsecond line of text here", "en", "s1", 1),
        (2, None, None, None, None), (None, "no id at all", "en", None, 3), (3, "", "en", "s2", 0), (4, " \n\t ", "en", "s2", 4),
        (5, long_, "en", "s1", len(long_)), (6, long_, "en", "s1", len(long_)), (7, "a b c d e f g h\nsecond line of text here", "fr", "s3", 1),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---------------------------------------------------------------- 1


def plain_line_dedup(rows, least):
    """Every run of lines of ``least`` words or more that a document of a smaller id holds is cut."""
    lines = {i: [(k, w) for k, x in enumerate(t.split("\n")) if (w := tuple(words(lower(x))))] for i, t in rows}
    first, spans = {}, {}
    for i in sorted(lines):
        spans[i] = []
        for a in range(len(lines[i])):
            total = 0
            for e in range(a, min(a + least, len(lines[i]))):  # longer runs are made up of such ones
                total += len(lines[i][e][1])
                if total >= least:
                    run = tuple(w for _, w in lines[i][a : e + 1])
                    first.setdefault(run, i)
                    spans[i].append((lines[i][a][0], lines[i][e][0], run))
    return {i: {k for a, e, run in spans[i] if first[run] < i for k in range(a, e + 1)} for i in lines}


def test_line_dedup_matches_plain_version(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_line_dedup(rows, 20)
    assert sum(map(len, want.values())) > 50
    for rare in (1, 8):
        out = linededup.dedup_lines(docs, rare_docs=rare).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.deleted_lines == sorted(want[r.doc_id])
            assert r.text == "\n".join(x for k, x in enumerate(dict(rows)[r.doc_id].split("\n")) if k not in want[r.doc_id])


def test_line_dedup_cuts_a_passage_from_later_documents_only(spark):
    passage = "\n".join(f"{' '.join(f'p{k}{j}' for j in range(9))}" for k in range(7))
    rows = [(k, f"own start {k} of text\n{passage}\n\nown end {k}", None, None, 0) for k in range(30)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert out[0] == rows[0][1]
    assert all(out[k] == f"own start {k} of text\n\nown end {k}" for k in range(1, 30))


def test_line_dedup_cuts_frequent_passages_whose_lines_stand_singly_before(spark):
    one = [" ".join(f"p{k}x{j}" for j in range(18)) for k in range(3)]
    rows = [(k + 1, f"start {k}\n{one[k]}\nend {k}", None, None, 0) for k in range(3)]
    rows += [(k, "\n".join([f"own start {k}", *one, f"own end {k}"]), None, None, 0) for k in range(10, 31)]
    out = {r.doc_id: r.deleted_lines for r in linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert all(out[k] == [] for k in (1, 2, 3, 10)) and all(out[k] == [1, 2, 3] for k in range(11, 31))


def test_line_dedup_tells_moved_lines_apart(spark):
    one, two = ("\n".join(" ".join(f"{p}{k}x{j}" for j in range(11)) for k in range(2)) for p in "pq")
    rows = [(1, f"{one}\nmiddle of it\n{two}"), (2, f"{two}\nelse\n{one}"), (3, f"new\n{one}\nmiddle\n{two}\n\nend\n{one}")]
    out = {r.doc_id: (r.deleted_lines, r.moved_lines) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == ([], []) and out[2][0] == [0, 1, 3, 4] and len(out[2][1]) == 2
    assert out[3] == ([1, 2, 4, 5, 8, 9], [])  # document 2 holds the last two in this order


def test_line_dedup_ids_of_another_type(spark):
    text = "\n".join(" ".join(f"p{k}x{j}" for j in range(11)) for k in range(2))
    df = spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")
    assert {(r.doc_id, len(r.deleted_lines)) for r in linededup.dedup_lines(df).collect()} == {("a", 0), ("b", 2), (None, 0)}


def test_line_dedup_odd_rows(odd, none):
    out = linededup.dedup_lines(odd.withColumns({k: F.lit("old") for k in ("n_lines", "d", "h", "id", "a")}), min_block_words=5).collect()
    by = [(r.doc_id, r.text, r.n_lines) for r in out]
    assert len(out) == 9 and by.count((1, "a b c d e f g h\nsecond line of text here", 2)) == 2
    assert (7, "", 2) in by and (6, "", 1) in by and (2, None, 0) in by and (None, "no id at all", 1) in by and (4, " \n\t ", 2) in by
    assert linededup.dedup_lines(none).count() == 0


# ---------------------------------------------------------------- 2, 10, 3


@pytest.mark.parametrize(("module", "label", "n", "rest"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, module, label, n, rest):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = module.scored(docs.select("doc_id", "text"), module.fit(docs, labels)).select("doc_id", "score", "predicted")
    held = [r for r in out.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % n == rest]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)
    right = Counter((r[label], r.predicted) for r in held)
    assert (right[0, 0] + right[1, 1]) / len(held) > 0.97
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.9 and right[0, 1] / (right[0, 0] + right[0, 1]) < 0.08


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_odd_rows(spark, module, docs, labels, odd, none):
    model = module.fit(docs, labels)
    out = module.scored(odd.withColumn("score", F.lit("old")), model)
    assert out.columns == [*odd.columns, "score", "predicted"] and out.count() == 9
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert module.scored(none, model).count() == 0
    for some in (labels.limit(0), labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})):
        assert {r.score for r in module.scored(odd, module.fit(odd, some)).collect()} == {0.5}


def test_rules_keep_clean_and_drop_bad(spark, docs, labels, odd, none):
    big, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = rules.checked(big, rules.fit(big, marks)).join(marks, "doc_id").where(~F.col("base_failed"))
    share = {r.quality: r.s for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1
    got = rules.checked(odd.withColumn("kept", F.lit(3)), rules.NO_MODEL)
    assert got.count() == 9 and [r.kept for r in got.where("doc_id = 2").collect()] == [False]
    assert rules.checked(none, rules.fit(none, labels.limit(0))).count() == 0


# ---------------------------------------------------------------- 4


def plain_fingerprint(t, width, seed=42):
    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + width]).encode(), seed) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    up = {i: i for i in range(len(ids))}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [least.get(top(i)) for i in range(len(ids))]


@pytest.mark.parametrize("tile", [2, 4096])
def test_near_duplicates_match_all_pairs(spark, docs, odd, tile):
    extra = []
    base = words(docs.where("doc_id = 1").first().text)
    for k in range(25):
        changed = list(base)
        changed[(7 * k) % len(base)] = f"new{k}"
        extra.append((1000 + k, " ".join(changed), None, None, 0))
    every = docs.unionByName(spark.createDataFrame(extra, DOC)).unionByName(odd.where("doc_id is null or doc_id > 1").withColumn("doc_id", F.col("doc_id") + 5000))
    rows = every.collect()
    fps = [plain_fingerprint(r.text, 3) for r in rows]
    comp = plain_components([r.doc_id for r in rows], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    want = Counter((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True))
    got = simhash.near_duplicates(every, tile_rows=tile).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_wide_links_and_one_kept(spark, none):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    rows = []
    for g in range(12):
        base = words(text(300))
        rows.append((100 * g, " ".join(base), None, "s", 0))
        for k in range(1, 4):
            other = list(base)
            for at in rng.integers(0, 300, 3):
                other[at] = f"edit{at}"
            rows.append((100 * g + k, " ".join(other), None, "s", 0))
    rows += [(9000 + k, text(200), None, "s", 0) for k in range(40)] + [(100, rows[4][1], None, "s", 0)]
    df = spark.createDataFrame(rows, DOC)
    kept = {r.doc_id for r in simhash.keep_one(df, width=5, max_bits=10, blocks=12, check_bits=21).collect()}
    assert {9000 + k for k in range(40)} <= kept and {100 * g for g in range(12)} <= kept
    assert len(kept) <= 40 + 12 + 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("tile", [500, 1 << 19])
def test_near_dedup_stage_matches_brute_force_jaccard(spark, odd, tile):
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for k, edits in enumerate([e for e in (3, 4, 5, 6, 7, 8, 9, 10, 12) for _ in range(40)]):
        base = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        other = list(base)
        for at in rng.choice(300, edits, replace=False):
            other[at] = f"edit{at}"
        rows += [(2 * k, " ".join(base), None, "s", 0), (2 * k + 1, " ".join(other), None, "s", 0)]
    for i, t, *_ in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    close = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(len(rows) // 2)]
    assert all(sum(a <= j < a + 0.05 for j in close) > 20 for a in (0.7, 0.75, 0.8, 0.85))
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, DOC), tile_shingles=tile).collect()}
    assert kept == {2 * k for k in range(len(close))} | {2 * k + 1 for k, j in enumerate(close) if j < 0.8}
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, DOC), SF).collect()} == kept
    assert len(jaccard.keep_one(odd).collect()) == len(simhash.keep_one(odd, width=5).collect())
    assert jaccard.keep_one(odd.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [500, 3000, 1 << 19])
def test_near_dedup_of_stars_and_chains_matches_brute_force(spark, tile):
    """A tight family, chains whose ends are unlike, and outliers below the limit."""
    rng = np.random.default_rng(11)
    texts = []
    for family in range(3):
        base = [f"f{family}x{x}" for x in rng.integers(0, 5000, 200)]
        for k in range(40):
            edited = list(base)
            for at in rng.choice(200, k % 9, replace=False):
                edited[at] = f"star{k}x{at}"
            texts.append(edited)
        for k in range(30):  # each a few words off its predecessor
            base = list(base)
            for at in rng.choice(200, 3, replace=False):
                base[at] = f"chain{k}x{at}"
            texts.append(base)
    order = rng.permutation(len(texts)).tolist()
    sets = {i: {tuple(texts[k][j : j + 5]) for j in range(196)} for i, k in enumerate(order)}
    least = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 1000 >= 800 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(least[a], least[b]), min(least[a], least[b])
                least = {i: new if v == old else v for i, v in least.items()}
    df = spark.createDataFrame([(i, " ".join(texts[k]), None, "s", 0) for i, k in enumerate(order)], DOC)
    assert 3 <= len(set(least.values())) < len(texts) // 2
    assert {r.doc_id for r in jaccard.keep_one(df, tile_shingles=tile).collect()} == set(least.values())


def test_table_links_equal_plain_fingerprints(spark, tmp_path):
    """Bits, keys and links of the near-dedup stage against a plain model, in tiles too."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 4, 5, 300, 700)]
    near = [np.concatenate([base[4][: 300 - k], rng.integers(0, 2**64, k, dtype=np.uint64)]) for k in range(0, 60, 2)]
    sets = [np.unique(x) for x in [*base, *near]]
    h, counts = np.concatenate(sets), np.array([len(x) for x in sets])
    out, many = jaccard.words_of_prints(h, counts)
    prints = np.split(out, np.cumsum(many)[:-1])
    salts = jaccard.mix(np.arange(1, 100, dtype=np.uint64) * simhash._LANES)
    for x, words_ in zip(sets, prints, strict=True):
        assert len(words_) == 34 + 32 * (len(x) < 8)
        for k in (0, 1, 2, 33, len(words_) - 1):
            mixed = [int(v) for v in jaccard.mix(x ^ salts[k])]
            assert int(words_[k]) == sum(1 << 8 * (bit % 8) + bit // 8 for bit in range(64) if 2 * sum(v >> bit & 1 for v in mixed) > len(x))
    want, n = {k: k for k in range(len(sets))}, len(sets)
    for a in range(n):
        for b in range(a):
            apart = sum(int(x ^ y).bit_count() for x, y in zip(prints[a][:2], prints[b][:2], strict=True))
            same = [any((int(x ^ y) >> s) & 0x7FFF == 0 for s in (0, 16, 32, 48)) for x, y in zip(prints[a][2:], prints[b][2:], strict=False)]
            if any(same[:32]) and apart <= 38 or any(same[32:]) and apart <= 42:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {i: new if v == old else v for i, v in want.items()}
    df = spark.createDataFrame([(k, p.view(np.int64).tolist()) for k, p in enumerate(prints)], "node long, words array<long>")
    for tile in (3, 4096):
        (folder := tmp_path / str(tile)).mkdir()
        links = simhash.table_links(df, str(folder), tile).collect()
        got = {k: k for k in range(n)}
        for r in links:
            old, new = max(got[r.a], got[r.b]), min(got[r.a], got[r.b])
            got = {i: new if v == old else v for i, v in got.items()}
        assert got == want and 1 < len(set(got.values())) < n


@pytest.mark.parametrize("tile", [100, 4096])
def test_table_links_grow_with_a_group_not_its_pairs(spark, tmp_path, tile):
    """One family of near copies, in which nearly all pairs share a key, and two loners."""
    rng = np.random.default_rng(8)
    n, bits = 1500, rng.random((1500, 34, 64)) < 0.04
    bits[-2:] = rng.random((2, 34, 64)) < 0.5
    words_ = np.packbits(bits, axis=2, bitorder="little").view(np.int64)[:, :, 0]
    df = spark.createDataFrame([(k, w.tolist()) for k, w in enumerate(words_)], "node long, words array<long>")
    links = simhash.table_links(df, str(tmp_path), tile).collect()
    assert len(links) == len({frozenset((r.a, r.b)) for r in links}) < 25 * n
    of = np.arange(n)
    for r in links:
        of[of == of[r.a]] = of[r.b]
    assert len(set(of[:-2].tolist())) == 1 and len(set(of.tolist())) == 3


def test_rows_are_told_apart_by_id_and_text_whatever_is_null(spark):
    """A hash of columns skips nulls: the id of one row may be the text of another."""
    rows = [(None, "5 a b"), ("5 a b", None), ("5 a b", "5 a b"), (None, None), (None, "5 a b")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert df.select(row_name(F.col("doc_id"), F.col("text")).alias("k")).distinct().count() == 4
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(df).collect()]
    assert sorted(kept, key=repr) == [("5 a b", "5 a b"), ("5 a b", None)]
    # one row of each class stays: a null text is an empty one, unlike the others
    apart = df.where("doc_id is null or text is null").where("not (doc_id is null and text is null)")
    assert {(r.doc_id, r.text) for r in jaccard.keep_one(apart).collect()} == {(None, "5 a b"), ("5 a b", None)}
    assert {(r.doc_id, r.text) for r in simhash.keep_one(apart).collect()} == {(None, "5 a b"), ("5 a b", None)}
    got = sorted(((r.doc_id, r.n_tokens) for r in lm.scored(df).collect()), key=repr)
    assert got == [("5 a b", 1), ("5 a b", 4), (None, 1), (None, 4), (None, 4)]
    cut = linededup.dedup_lines(df, min_block_words=3).collect()
    assert len(cut) == 5 and all(r.deleted_lines == [] for r in cut)


@pytest.mark.parametrize("run", [simhash.near_duplicates, lm.scored, packing.pack])
def test_extra_columns_with_clashing_names(spark, docs, run):
    some = docs.select("doc_id", "text").limit(60)
    names = ("id", "key", "node", "fp", "root", "least", "component_id", "dk", "dk2", "train", "n_tokens", "score", "piece", "bin", "size", "shard", "n", "p", "_jk")
    plain, clash = run(some), run(some.withColumns({x: F.lit("old") for x in names}))
    key = lambda r: repr(r)
    shown = [c for c in plain.columns if c in clash.columns and c in ("doc_id", "fingerprint", "n_tokens", "score", "base_score", "bin_id", "start", "length")]
    assert len(shown) >= 2
    assert sorted(map(key, plain.select(shown).collect())) == sorted(map(key, clash.select(shown).collect()))


# ---------------------------------------------------------------- 5


def test_lm_base_is_exact_and_the_model_sums_to_one(spark, docs, odd, none):
    rows = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    got = lm.scored(rows).collect()
    plain = rows.collect()
    counts = Counter(x for r in plain if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 for x in [*words(lower(r.text)), None])
    many, kinds = sum(counts.values()), len(counts)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert len(got) == len(plain)
    for r in plain:
        w = [*words(lower(r.text)), None]
        g = by[r.doc_id, len(w)]
        assert (g.n_known, g.train_tokens) == (sum(counts[x] > 0 for x in w), many)
        assert math.isclose(g.base_score, sum(math.log10((counts[x] + 0.1) / (many + 0.1 * (kinds + 1))) for x in w), rel_tol=1e-9)
        assert math.isfinite(g.score) and g.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.05 * sum(r.n_tokens for r in held)
    assert lm.scored(none).count() == 0


def test_lm_distribution(spark):
    rng = np.random.default_rng(2)
    texts = [(k, " ".join(f"x{v}" for v in rng.zipf(1.5, 80) % 40), None, None, 0) for k in range(60)]
    keyed = spark.createDataFrame(texts, DOC).select("text", F.xxhash64("doc_id").alias("dk"), F.lit(True).alias("train"))
    model, _ = lm.train(keyed)
    vocabulary = sorted({w for _, t, *_ in texts for w in words(t)})
    import pyarrow as pa

    from seqspan.llm.common import text_slices

    for first in ("x1", "x2", "x30"):
        total = 0.0
        _, _, data, offs = next(text_slices(pa.array([first, *[f"{first} {w}" for w in vocabulary]])))
        p, both, up, context = model.parts(*lm.tokens_of(data, offs))
        s = model.shares[context]
        each = s * both / up + (1 - s) * p
        # rows are: first, end; then first, word, end
        total = each[1] + each[3::3].sum()
        assert 0.65 < total <= 1.02
    from collections import Counter as C

    seen = C(w for _, t, *_ in texts for w in words(t))
    _, _, data, offs = next(text_slices(pa.array(vocabulary)))
    levels = model.levels(lm.tokens_of(data, offs)[0][::2], 1, 60)
    right = np.searchsorted(lm._UNI, [seen[w] for w in vocabulary], "right")
    assert (levels >= right).all()  # never too low
    assert (levels == right).mean() > 0.95 and (levels - right).max() <= 1  # ten probes err one time in 1000


def test_lm_filter_grows_with_its_entries(spark):
    """Its regions stay a table, filled to a half at most, with the same few false hits at any size."""
    for n in (2_000, 40_000):
        keyed = spark.range(n).select(F.concat(F.lit("w"), "id").alias("text"), F.xxhash64("id").alias("dk"), F.lit(True).alias("train"))
        model, _ = lm.train(keyed)
        regions = [np.unpackbits(np.frombuffer(r.payload, np.uint8)) for r in model.regions.collect()]
        assert sum(len(x) for x in regions) >= n * model.probes / np.log(2)
        assert all(x.mean() < 0.55 for x in regions) and model.probes == 10
        absent = lm.mix(np.arange(20_000, dtype=np.uint64) + np.uint64(1 << 40))
        assert (model.levels(absent, 1, 60) > 0).mean() < 0.004


def test_lm_shares_come_from_every_training_text(spark):
    """Long texts only, and one corpus in many texts or few: the same shares."""
    rng = np.random.default_rng(4)
    chain = [f"c{k % 50} d{k % 50}" for k in rng.integers(0, 50, 40_000)]
    found = []
    for size in (4_000, 400):
        rows = [(" ".join(chain[k : k + size]),) for k in range(0, len(chain), size)]
        keyed = spark.createDataFrame(rows, "text string").select("text", F.xxhash64("text").alias("dk"), F.lit(True).alias("train"))
        found.append(lm.train(keyed)[0])
    top = [m.levels(lm.span_hashes(np.frombuffer(b"c7", np.uint8), np.array([0]), np.array([2])), 1, 100)[0] for m in found]
    assert top[0] == top[1] and all(m.shares[top[0]] > 0.9 for m in found)
    assert all(m.shares[0] == 0 for m in found) and np.allclose(found[0].shares[top[0]], found[1].shares[top[0]], atol=0.01)


def test_lm_levels_are_exact_in_a_sparse_filter(spark):
    rng = np.random.default_rng(2)
    texts = [(k, " ".join(f"x{v}" for v in rng.zipf(1.5, 80) % 40), None, None, 0) for k in range(60)]
    model, _ = lm.train(spark.createDataFrame(texts, DOC).select("text", F.xxhash64("doc_id").alias("dk"), F.lit(True).alias("train")))
    seen = Counter(w for _, t, *_ in texts for w in words(t))
    for w, n in seen.items():
        raw = np.frombuffer(w.encode(), np.uint8)
        level = model.levels(lm.span_hashes(raw, np.array([0]), np.array([len(raw)])), 1, 100)[0]
        assert lm._UNI[level - 1] <= n < lm._UNI[level]


def test_lm_credits_bigrams_seen_once(spark):
    train = " ".join(f"once{k}" for k in range(400))
    rest = " ".join(f"once{(7 * k) % 400}" for k in range(400))
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    filler = [(k, " ".join(f"a{(k * j) % 97} b{(k * j) % 97}" for j in range(60))) for k in range(400) if zlib.crc32(str(k).encode()) % 10]
    rows = [(ids[0], train), (ids[1], rest), (filler[0][0], train), *filler[1:]]
    out = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[ids[0]].held_out and out[ids[1]].held_out
    assert math.isclose(out[ids[0]].base_score, out[ids[1]].base_score, rel_tol=1e-9)
    assert out[ids[0]].score > out[ids[1]].score + 100


def test_lm_hashes_travel_as_steps():
    """A distinct bigram of a chunk takes less than its 48 bits, and no hash is changed."""
    rng = np.random.default_rng(6)
    tokens = np.append(lm.mix(rng.integers(0, 5_000, 200_000).astype(np.uint64)), lm.mix(np.array([lm._END])))
    chunk = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([lm._packed(tokens, np.array([len(tokens)]), np.array([True]), np.array([7]))], pa.binary())], names=["p", "payload"])
    rows = [r for batch in lm._dealt(4)(iter([chunk])) for r in batch.to_pylist()]
    pairs = len(np.unique(lm.pair_hash(lm.contexts_of(tokens, np.array([len(tokens)])), tokens)))
    assert pairs > 190_000 and sum(len(r["payload"]) for r in rows if r["kind"] == 1) < 5.2 * pairs
    for h in (tokens, np.array([0, 0, 1, 1 << 32, (1 << 64) - 1], np.uint64), np.array([1 << 63], np.uint64)):
        assert (lm._summed(*lm._deltas(np.sort(h))) == np.sort(h)).all()
    for segments in (1, 4, 2048):
        name = lm._named(np.sort(tokens), segments)
        assert (name < 1 << 48).all() and len(set(zip(np.sort(tokens) >> np.uint64(53), name))) == len(np.unique(tokens))


def test_lm_frees_the_disk_of_finished_steps(spark, docs):
    """Shuffles that have been read, and texts that are in chunks, do not lie there to the end."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    lying = lambda: {f: f.stat().st_size for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    files, folders = lying(), set(shared.iterdir())
    _, chunks = lm.train(docs.select("text", F.xxhash64("doc_id").alias("dk"), F.lit(True).alias("train")))
    (folder,) = set(shared.iterdir()) - folders
    assert {x.name for x in folder.iterdir()} == {"segments", "chunks"}
    stored = sum(x.stat().st_size for x in (folder / "chunks").iterdir())
    for _ in range(50):  # executors remove them a little later
        left = sum(n for f, n in lying().items() if f not in files)
        if left < stored / 2:
            break
        time.sleep(0.1)
    assert left < stored / 2 and chunks.count() > 0


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("cell_rows", [60, 8192])
def test_neighbours_recall_and_exact_scores(spark, cell_rows):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    out = ann.neighbours(spark.createDataFrame(rows), query=F.col("vec_id") % 20 == 0, leaf=16, cell_rows=cell_rows, sample_rows=300)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = total = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in mine)
        found, total = found + len(set(best) & {v for _, v, _ in mine}), total + 10
    assert found / total >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df.withColumn("rank", F.lit(1))).collect() if r.vec_id is not None)
    assert [x[:3] for x in out if x[1] == 1] == [(0, 1, 0), (0, 1, 0)]
    assert {x[2] for x in out} == {0, 1, 2} and len(out) == 6
    assert ann.neighbours(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


def test_packing_round_trip(spark, docs, odd, none):
    for df, shard in ((docs, 64), (odd, 16384)):
        caps = (64, 128, 512)
        out = packing.pack(df, capacities=caps, shard_pieces=shard).collect()
        sizes = Counter((r.doc_id, len(words(r.text))) for r in df.collect())
        total = Counter()
        bins = {}
        for r in out:
            total[r.doc_id] += r.length
            assert r.start == r.piece * 512 and (r.length == 0) == (r.bin_id is None)
            if r.bin_id is not None:
                bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.length))
        want = Counter()
        for (i, n), k in sizes.items():
            want[i] += n * k
        assert +total == +want and {r.doc_id for r in out} == {r.doc_id for r in df.collect()}
        assert len({b for b, _ in bins}) == len(bins)
        for (_, cap), parts in bins.items():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            used = sum(n for _, n in parts)
            assert used <= cap and cap == min(c for c in caps if c >= used)
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacities=())


# ---------------------------------------------------------------- 8, 9


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((tuple(dict(zip(names, r, strict=True))[k] for k in sorted(names)) for r in got.fetchall()), key=repr)


def in_spark(df):
    return sorted((tuple(r[k] for k in sorted(df.columns)) for r in df.collect()), key=repr)


def test_urls_match_their_sql(spark, tmp_path):
    hosts = ["a.example.com", "B.Example.COM", "x.example.net", "net", "y.org", "org", "bad.host.io", "good.host.io", ""]
    paths = ["/", "", "/en/1", "/de/2?q=/fr/", "/fr/3#x", "?a", "#b", "/en", "/fr/"]
    urls_ = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://Y://z", "http://a.example.com/en/1"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls_)] + [(None, "http://y.org/", None)], "page_id long, url string, html string")
    marks = spark.createDataFrame([(k, int("bad" not in (u or "")), None if k % 7 else 1) for k, u in enumerate(urls_)] + [(0, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for name, df in (("pages", pages), ("labels", marks)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = in_spark(urls.op8_url_filter(spark, str(tmp_path)))
    assert got == in_duckdb(urls.ORACLE_SQL, pages=pages, labels=marks)
    verdicts = {r.url: r.verdict for r in pages.join(urls.op8_url_filter(spark, str(tmp_path)), "page_id").collect()}
    assert verdicts["http://bad.host.io/"] == "block" and verdicts["http://good.host.io/"] == "allow"
    assert verdicts["http://x.example.net/en/1"] == "allow" and verdicts["http://x.example.net/"] == "block" and verdicts["http://a.example.com/de/2?q=/fr/"] == "block"
    kept = urls.judge(pages.withColumn("host", F.lit("old")), marks.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("int").alias("bad")))
    assert kept.count() == len(urls_) + 1 and kept.limit(0).count() == 0


def test_mix_matches_its_sql(spark, docs, odd, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(k), " ".join(["w"] * int(n)), None, s, 0) for k, (n, s) in enumerate(zip(rng.integers(0, 60, 600), rng.choice(["a", "b", "Z", "é", None], 600, p=[0.6, 0.2, 0.1, 0.05, 0.05]), strict=True))]
    for name, df in (("docs", docs), ("odd", odd), ("skewed", spark.createDataFrame(rows, DOC)), ("none", odd.limit(0)), ("words", odd.withColumn("text", F.lit("")))):
        path = tmp_path / name
        df.write.parquet(str(path / "documents.parquet"))
        out = mixing.op9_mix(spark, str(path))
        assert in_spark(out) == in_duckdb(mixing.ORACLE_SQL, documents=df)
        got = mixing.mix(df).collect()
        copies = Counter(r.doc_id for r in mixing.mixed_documents(df.withColumns({k: F.lit(1) for k in ("passes", "upto", "size", "h")})).collect())
        assert +copies == +Counter({r: n for r, n in _copies(got).items()})
        by = {}
        for r in got:
            assert r.taken <= 3 * r.size
            t = by.setdefault(r.source, [0, r.target, 0])
            t[0] += r.taken
            t[2] = max(t[2], r.size)
        if name == "skewed":
            assert all(abs(a - b) <= c for a, b, c in by.values())


def _copies(rows):
    out = Counter()
    for r in rows:
        if r.size:
            out[r.doc_id] += r.taken // r.size
    return out


# ---------------------------------------------------------------- all


def test_queries_are_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.oracle_sql()) == {"op8_url_filter", "op9_mix", "op11_topk", "op12_fill_in_middle"}


def test_pipeline(spark, labels):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)
    df, seen = docs.unionByName(copy), []
    ids = lambda x: {r[0] for r in x.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF).persist()
        if name == "line_dedup":
            assert ids(out) == ids(df)
        elif name == "near_dedup":
            assert not {i for i in ids(out) if i >= 100_000} and ids(out) <= ids(df)
        elif name == "packing":
            assert ids(out) == ids(df)
        if name != "packing":
            assert out.columns == df.columns
        df = out
        seen.append(name)
    assert seen == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
