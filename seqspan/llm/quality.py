"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are hashed 1- and 2-grams of three word streams: lower-cased words, word shapes
(letters, digits and each symbol as classes, runs collapsed) and repetition marks (whether a
word equals the one or two before it).  A feature's value is its share of the words, so long
and short texts compare; a score is one sparse dot product.

Nulls and empty texts have no features: they get the model's intercept.  Without labelled
rows of both classes the score is the smoothed share of label 1.  Columns named like the
results are replaced.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import LOWER, crc_remainder, fresh, give_back, mix, pair_hash, row_sums, span_hashes, text_slices, words_of
from seqspan.llm.sampling import labelled_sample

DIM_BITS = 18
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray):
    """The kept bytes of ``data`` and where each span lies in them."""
    at = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], at[starts], at[ends]


def gram_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words (6 rows: one per family), row words, words per row."""
    starts, ends, counts = words_of(data, offs)
    word = span_hashes(LOWER[data], starts, ends)
    shape_bytes = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape_bytes[1:] != shape_bytes[:-1]
    keep[starts] = True
    shape = span_hashes(*collapsed(shape_bytes, starts, ends, keep))
    first = np.zeros(len(word), bool)
    edge = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first[edge[counts > 0]] = True

    def previous(x: np.ndarray, of_first: int) -> np.ndarray:
        y = np.empty_like(x)
        y[:1] = of_first
        y[1:] = x[:-1]
        y[first] = of_first
        return y

    w1 = previous(word, 1)
    w2 = previous(w1, 2)
    again = (word == w1).astype(np.uint64) + 2 * (word == w2).astype(np.uint64)
    families = [
        word, pair_hash(w1, word), shape, pair_hash(previous(shape, 1), shape),
        mix(again + np.uint64(77)), pair_hash(previous(again, 9), again),
    ]
    idx = [(mix(h + np.uint64(k * 0x51ED27)) >> np.uint64(64 - DIM_BITS)).astype(np.int32) for k, h in enumerate(families)]
    return np.stack(idx) if len(word) else np.zeros((6, 0), np.int32), counts, starts


def train_ftrl(texts: pa.Array, y: np.ndarray, totals: np.ndarray, *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
               l1: float = 0.02, l2: float = 0.1, scale: float = 8.0) -> dict:
    """Per-coordinate FTRL-proximal updates, one document at a time; the intercept is set
    back from the sample's class shares to those of all labelled rows."""
    n_class = np.bincount(y, minlength=2)
    prior = float((totals[1] + 1) / (totals.sum() + 2))
    model = {"w": np.zeros(1 << DIM_BITS, np.float32), "b": float(np.log(prior / (1 - prior))), "scale": scale}
    if min(n_class) == 0:
        return model
    rows = []
    for _, _, data, offs in text_slices(texts):
        idx, counts, _ = gram_features(data, offs)
        edge = np.concatenate([[0], np.cumsum(counts)])
        for k in range(len(counts)):
            own, c = np.unique(idx[:, edge[k] : edge[k + 1]].ravel(), return_counts=True)
            rows.append((own, (c * (scale / max(1, counts[k]))).astype(np.float64)))
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    zb = nb = b = 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, v = rows[r]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ v + b, -35, 35)))
            g = (p - y[r]) * v
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
            gb = p - y[r]
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    shift = np.log(totals[1] / totals[0]) - np.log(n_class[1] / n_class[0])
    return model | {"w": w.astype(np.float32), "b": float(b + shift)}


def score_array(array: pa.Array, model: dict) -> np.ndarray:
    out = np.empty(len(array))
    w = model["w"]
    for i, j, data, offs in text_slices(array):
        idx, counts, _ = gram_features(data, offs)
        dots = row_sums(w[idx].sum(0, dtype=np.float64), counts)
        out[i:j] = model["b"] + dots * model["scale"] / np.maximum(1, counts)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from labelled rows with crc32(id) mod 5 other than 0; at most ``per_class`` a class."""
    sample = labelled_sample(docs, labels, label, crc_remainder(id_col, 5) != 0, id_col=id_col, text_col=text_col, per_class=per_class)
    return train_ftrl(*sample)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """The likelihood of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**DIM_BITS floats: a fixed size

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array(score_array(array, sent.value))
            give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.DoubleType())(F.col(text_col))


def scored(docs: DataFrame, model: dict, *, text_col: str = "text", keep_above: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (likelihood of label 1) and ``predicted`` (score >= keep_above)."""
    out = fresh(docs, ["score", "predicted"]).withColumn("score", score(docs, model, text_col))
    return out.withColumn("predicted", (F.col("score") >= keep_above).cast("int"))


def accepted(docs: DataFrame, model: dict, *, text_col: str = "text", keep_above: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``scored`` gives predicted 1; no column is added or replaced."""
    return docs.where(score(docs, model, text_col) >= keep_above)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc_remainder("doc_id", 5) == 0).alias("held_out")
    return scored(docs, model).select("doc_id", held, "score", "predicted")
