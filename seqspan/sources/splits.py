"""Text files as rows that know their split: numbered without moving a text.

A row's number is the rows of all splits before its own plus its place in the split.  Splits
are summed up once, one small row each, in order of file names and offsets; the text then
streams past that table, which is broadcast up to ``BROADCAST`` splits (some 30 TB of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.operators.scan import prefix_sums
from seqspan.operators.tables import kept

BROADCAST = 1 << 18
TAKEN = 1000  # rows that may come to the driver when only the first are asked for
_ROW = "value string, file string, block long, place long"


def files_of(spark: SparkSession, path: str) -> list[str]:
    return sorted(spark.read.text(path).inputFiles())


def scanned(spark: SparkSession, path: str, sep: str = "\n", first: int = 0) -> DataFrame:
    """value, file, block (offset of the split in it), place (rises within the split).

    With ``first`` (at most ``TAKEN``) only so many rows in order: files one after the other,
    their splits in growing batches until there are enough, so what is read does not depend on
    the size of the files."""
    if not first:
        rows = spark.read.option("lineSep", sep).text(path)
        return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    taken: list[tuple] = []
    for file in files_of(spark, path):
        some = spark.read.option("lineSep", sep).text(file).take(first - len(taken))
        taken += [(r.value, file, 0, k) for k, r in enumerate(some)]
        if len(taken) >= first:
            break
    return spark.createDataFrame(taken, _ROW)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line with anything on it; later files and splits are read only if those before
    have none."""
    for file in files_of(spark, path):
        some = spark.read.text(file).where("value <> ''").take(1)
        if some:
            return some[0].value
    return None


def split_table(rows: DataFrame, folder: str, name: str, **more: Column) -> DataFrame:
    """``(file, block, at, rows, start, ...)``, stored, one row a split: place of its first row,
    number of rows, rows in all splits before, and the aggregates in ``more``."""
    sizes = rows.groupBy("file", "block").agg(F.min("place").alias("at"), F.count("*").alias("rows"), *[c.alias(k) for k, c in more.items()])
    return kept(prefix_sums(kept(sizes, folder, f"{name}_splits"), ["file", "block"], "rows", "start", folder), folder, f"{name}_starts")


def joined(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with what ``splits(file, block, ...)`` has.  The rows stay where they are; beyond
    ``BROADCAST`` splits each split goes to one task, in order."""
    if splits.count() <= BROADCAST:
        return rows.join(F.broadcast(splits), ["file", "block"])
    return rows.join(splits, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "place")


def numbered(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with n (0, 1, ...), opens (whether the row is its file's first) and the splits' columns."""
    n = F.col("start") + F.col("place") - F.col("at")
    return joined(rows, splits).withColumns({"n": n, "opens": (F.col("block") == 0) & (F.col("place") == F.col("at"))})
