"""Bounded, deterministic samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None = None, *, id_col: str = "doc_id",
    text_col: str = "text", per_class: int = 2000, max_bytes: int = 1 << 18, class_bytes: int = 1 << 26,
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, 0/1 labels and class totals (of all allowed labelled ids) of a sample.

    At most ``per_class`` ids a class, those of the smallest xxhash64, and of their texts in
    that order as many as fit ``class_bytes``: at most 128 MB reach the driver by default.
    Texts above ``max_bytes`` are not used for fitting (they are scored whole like all
    others).  Ids labelled twice count once, with the larger label; null ids and labels are
    left out."""
    y = F.col(label).cast("int")
    rows = labels.where(F.col(id_col).isNotNull() & y.isin(0, 1))
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(y).alias("_y"))
    totals = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    picked = [rows.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # 2 * per_class ids: a bound that holds at any size
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    texts = texts.where(F.octet_length("_t") <= max_bytes).join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    rising = W.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(W.unboundedPreceding, 0)  # per_class rows at most
    texts = texts.withColumn("_upto", F.sum(F.octet_length("_t")).over(rising)).where(F.col("_upto") <= class_bytes)
    got = texts.select("_id", "_y", "_t").toArrow().sort_by("_id")
    array = got.column("_t").combine_chunks()
    array = array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    return array, got.column("_y").to_numpy().astype(np.int64), np.array([totals.get(0, 0), totals.get(1, 0)], np.int64)
