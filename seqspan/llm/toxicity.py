"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

Words are reduced to their cores first (case, look-alike digits and inserted symbols undone).
Lexicons: a short fixed list, and words and word beginnings learned from the labelled sample
by log odds.  To keep learned lexicons honest, a fold's features use lexicons of the other
folds; the trees learn on some folds and the calibration on the rest.

Nulls and empty texts have all densities 0 and are scored like any text.  Without labelled
rows of both classes the score is the smoothed share of label 1.  Columns named like the
results are replaced.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import LOWER, crc_remainder, distinct_sorted, fresh, give_back, row_sums, span_hashes, text_buffers, text_slices, words_of
from seqspan.llm.quality import collapsed
from seqspan.llm.sampling import labelled_sample

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "vermin")
SECOND_PERSON = ("you", "your", "youre", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "vous", "votre", "usted", "ustedes", "tus")
_NEAR = 5
_PREFIX = (6, 9)
_CORE = LOWER.copy()
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _CORE[_a] = _b
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _LETTER | _UPPER
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hash_list(words: tuple[str, ...]) -> np.ndarray:
    data, offs = text_buffers(pa.array(words))
    return np.sort(span_hashes(data, offs[:-1], offs[1:]))


_SEED, _YOU = _hash_list(INSULTS), _hash_list(SECOND_PERSON)


def _weights_of(hashes: np.ndarray, table: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Weight (or 1) of each hash in a sorted table, else 0; a bitmap settles most misses."""
    out = np.zeros(len(hashes))
    if not len(table):
        return out
    maybe = np.zeros(1 << 16, bool)
    maybe[(table >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
    hit = table[place] == hashes[at]
    out[at[hit]] = 1.0 if weights is None else weights[place[hit]]
    return out


def _cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of word cores and of their beginnings (0 where a core is too short)."""
    core = _CORE[data]
    kept, s, e = collapsed(core, starts, ends, _LETTER[core])
    out = [np.where(e > s, span_hashes(kept, s, e), np.uint64(0))]
    for k in _PREFIX:
        out.append(np.where(e - s >= k, span_hashes(kept, s, np.minimum(e, s + k)) ^ np.uint64(k), np.uint64(0)))
    return out


def features(data: np.ndarray, offs: np.ndarray, lexicon: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of densities per text."""
    starts, ends, counts = words_of(data, offs)
    n = np.maximum(1, counts)
    hashes = _cores(data, starts, ends)
    seed = _weights_of(hashes[0], _SEED)
    learned = [_weights_of(h, *lex) for h, lex in zip(hashes, lexicon, strict=True)]
    hit = (seed > 0) | (learned[0] > 0)
    you = _weights_of(hashes[0], _YOU) > 0
    # words since / until the nearest second person, within the text
    run = np.concatenate([[0], np.cumsum(you)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(you))
    low, high = np.repeat(edge[:-1], counts), np.repeat(edge[1:], counts)
    near = run[np.minimum(high, at + _NEAR + 1)] - run[np.maximum(low, at - _NEAR)] > 0
    chars = np.maximum(1, np.diff(offs))
    count = lambda mask: row_sums(mask.astype(np.int64), np.diff(offs))
    alpha, upper, digit = _ALPHA[data], _UPPER[data], _DIGIT[data]
    in_word = np.concatenate([[0], np.cumsum(alpha)])
    letters = in_word[ends] - in_word[starts]
    big = np.concatenate([[0], np.cumsum(upper)])
    shouted = (big[ends] - big[starts] == letters) & (letters >= 2)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = alpha[:-2] & ~alpha[1:-1] & alpha[2:] & (data[1:-1] > 32)
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & alpha[2:]
    # neighbours in another text do not count
    first = offs[:-1][offs[:-1] < len(data)]
    inner[first] = inner[first - 1] = same[first] = same[np.minimum(first + 1, len(data) - 1)] = False
    odd = np.concatenate([[0], np.cumsum(inner)])
    cols = [
        row_sums(seed, counts) / n, row_sums(learned[0], counts) / n, np.log1p(row_sums((learned[0] > 0).astype(float), counts)),
        row_sums(learned[1], counts) / n, row_sums(learned[2], counts) / n, np.log1p(row_sums((learned[2] > 0).astype(float), counts)),
        np.log1p(row_sums(seed, counts)), row_sums((hit & near).astype(float), counts) / n, row_sums(you.astype(float), counts) / n,
        count(upper) / np.maximum(1, count(alpha)), row_sums(shouted.astype(float), counts) / n,
        count(data == 33) / chars, count(data == 63) / chars, (chars - count(alpha) - count(digit) - count(data <= 32)) / chars,
        row_sums((odd[ends] > odd[starts]).astype(float), counts) / n, count(same) / chars, np.log1p(counts),
    ]
    return np.stack(cols, 1)


def learn_lexicon(texts: pa.Array, y: np.ndarray, *, least_docs: int = 3, least_odds: float = 2.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For cores and each beginning: sorted hashes and log odds of those that mark label 1."""
    seen: list[list[list[np.ndarray]]] = [[[], []] for _ in range(1 + len(_PREFIX))]
    for i, _, data, offs in text_slices(texts):
        starts, ends, counts = words_of(data, offs)
        edge = np.concatenate([[0], np.cumsum(counts)])
        for f, h in enumerate(_cores(data, starts, ends)):
            for k in range(len(counts)):
                seen[f][int(y[i + k])].append(distinct_sorted(h[edge[k] : edge[k + 1]])[0])
    many = np.bincount(y, minlength=2)
    out = []
    for clean, toxic in seen:
        t, tc = distinct_sorted(np.concatenate(toxic) if toxic else np.zeros(0, np.uint64))
        c, cc = distinct_sorted(np.concatenate(clean) if clean else np.zeros(0, np.uint64))
        at = np.minimum(np.searchsorted(c, t), max(0, len(c) - 1))
        other = np.where(c[at] == t, cc[at], 0) if len(c) else np.zeros(len(t))
        odds = np.log((tc + 0.5) / (many[1] + 1)) - np.log((other + 0.5) / (many[0] + 1))
        keep = (tc >= least_docs) & (odds >= least_odds) & (t != 0)
        out.append((t[keep], odds[keep]))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0) -> dict:
    """Histogram boosting of the logistic loss; every tree is complete, of fixed depth."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, splits = np.zeros(len(y), np.int64), []
        for d in range(depth):
            width = 1 << d
            best = np.full(width, 1e-9)
            choice = [(0, np.inf)] * width
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = node * (len(c) + 1) + binned[:, f], width * (len(c) + 1)
                gs = np.bincount(key, g, size).reshape(width, -1)
                hs = np.bincount(key, h, size).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                k = gain.argmax(1)
                for q in range(width):
                    if gain[q, k[q]] > best[q]:
                        best[q], choice[q] = gain[q, k[q]], (f, float(c[k[q]]))
            splits += choice
            f = np.array([q[0] for q in choice])[node]
            node = 2 * node + (x[np.arange(len(y)), f] >= np.array([q[1] for q in choice])[node])
        leaves = 1 << depth
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value = -rate * gs / (hs + l2)
        margin += value[node]
        made.append(([q[0] for q in splits], [q[1] for q in splits], value))
    return {"base": base, "depth": depth, "feature": np.array([m[0] for m in made]), "cut": np.array([m[1] for m in made]), "value": np.array([m[2] for m in made])}


def tree_margin(x: np.ndarray, model: dict) -> np.ndarray:
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for d in range(model["depth"]):
            k = (1 << d) - 1 + node
            node = 2 * node + (x[rows, feature[k]] >= cut[k])
        out += value[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), both rising."""
    levels, at = np.unique(margin, return_inverse=True)  # rows of one margin are one point
    stack: list[list[float]] = []  # weighted sum, weight, last margin
    for m, s, w in zip(levels, np.bincount(at, y * weight), np.bincount(at, weight), strict=True):
        stack.append([s, w, m])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s2, w2, m2 = stack.pop()
            stack[-1] = [stack[-1][0] + s2, stack[-1][1] + w2, m2]
    return np.array([q[2] for q in stack]), np.array([q[0] / q[1] for q in stack])


def train(texts: pa.Array, y: np.ndarray, totals: np.ndarray, *, folds: int = 4) -> dict:
    prior = float((totals[1] + 1) / (totals.sum() + 2))
    n_class = np.bincount(y, minlength=2)
    if min(n_class) < 2 * folds:
        return {"prior": prior}
    fold = np.empty(len(y), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange(n_class[c]) % folds
    x = np.empty((len(y), 17))
    for f in range(folds):
        lexicon = learn_lexicon(texts.filter(pa.array(fold != f)), y[fold != f])
        at = np.flatnonzero(fold == f)
        x[at] = np.concatenate([features(d, o, lexicon) for _, _, d, o in text_slices(texts.take(pa.array(at)))])
    held = fold == folds - 1
    trees = fit_trees(x[~held], y[~held])
    weight = (totals / n_class)[y]
    knots = isotonic(tree_margin(x[held], trees), y[held].astype(float), weight[held])
    return {"prior": prior, "trees": trees, "lexicon": learn_lexicon(texts, y), "knots": knots}


def score_array(array: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(array), model["prior"])
    if "trees" not in model:
        return out
    for i, j, data, offs in text_slices(array):
        margin = tree_margin(features(data, offs, model["lexicon"]), model["trees"])
        out[i:j] = np.interp(margin, *model["knots"])
    return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from labelled rows with crc32(id) mod 4 other than 2; at most ``per_class`` a class."""
    sample = labelled_sample(docs, labels, label, crc_remainder(id_col, 4) != 2, id_col=id_col, text_col=text_col, per_class=per_class)
    return train(*sample)


def scored(docs: DataFrame, model: dict, *, text_col: str = "text", flag_above: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (likelihood of label 1) and ``predicted`` (score >= flag_above)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array(score_array(array, sent.value))
            give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = fresh(docs, ["score", "predicted"]).withColumn("score", F.arrow_udf(run, T.DoubleType())(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= flag_above).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc_remainder("doc_id", 4) == 2).alias("held_out")
    return scored(docs, model).select("doc_id", held, "score", "predicted")
