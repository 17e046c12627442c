"""The index on disk: one Parquet table each, with a checked format version."""

from __future__ import annotations

from pyspark.sql import SparkSession

from seqspan.config import FORMAT_VERSION
from seqspan.operators.hierarchy import SequenceIndex


def save(index: SequenceIndex, path: str) -> None:
    """Members are laid out by leaf, so that a leaf's rows share files and row groups."""
    for name in SequenceIndex.TABLES:
        table = getattr(index, name)
        if name == "members":
            table = table.repartitionByRange("leaf_id").sortWithinPartitions("leaf_id", "member_ordinal")
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> SequenceIndex:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in SequenceIndex.TABLES}
    rows = tables["meta"].collect()
    if len(rows) != 1:
        raise ValueError(f"not an index: {path}")
    meta = rows[0]
    if meta.format_version != FORMAT_VERSION:
        raise ValueError(f"index format {meta.format_version} is not supported; {FORMAT_VERSION} is")
    members = tables.pop("members")
    return SequenceIndex(**tables, leaves=members, window=meta.window, stride=meta.stride, max_tolerance=meta.max_tolerance, windows=meta.reference_window_count)
