"""Sinks for hits and reads: ordered part files.

Rows are dealt by ranges of their order and every task writes its range, so the part files
one after the other, in order of their names, are the whole file.  One commit makes them
visible together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.operators.tables import kept, work_folder

TSV_COLUMNS = ("query", "contig", "start", "distance", "strand", "sequence_id")
HEADER = "\t".join(TSV_COLUMNS)


def _in_order(rows: DataFrame, line: Column, path: str, *order: Column) -> None:
    """Lines of ``rows``, stored once (a range needs two looks at them), in order."""
    keys = [f"k{i}" for i in range(len(order))]
    lines = kept(rows.select(line.alias("value"), *[c.alias(k) for c, k in zip(order, keys, strict=True)]), work_folder(rows.sparkSession), "lines")
    lines.orderBy(*keys).select("value").write.mode("overwrite").text(path)


def write_tsv(hits: DataFrame, path: str) -> None:
    """Tab-separated in read and hit order; the header is the first line of the first part.  An
    unwritable path raises."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in TSV_COLUMNS])
    head = hits.sparkSession.createDataFrame([(HEADER, -1)], "value string, body int")
    body = hits.select(line.alias("value"), F.lit(0).alias("body"), "ordinal", "sequence_id", F.when(F.col("strand") == "+", 0).otherwise(1).alias("reverse"), "distance")
    rows = body.unionByName(head, allowMissingColumns=True)
    _in_order(rows, F.col("value"), path, *[F.col(c) for c in ("body", "ordinal", "sequence_id", "reverse", "distance")])


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tsv`` wrote, in no order."""
    kinds = ("string", "string", "long", "int", "string", "long")
    cells = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value") != HEADER).select(*[cells[k].cast(kind).alias(c) for k, (c, kind) in enumerate(zip(TSV_COLUMNS, kinds, strict=True))])


def write_fasta(reads: DataFrame, path: str) -> None:
    """``reads(ordinal, name, seq)`` as two-line records in order."""
    _in_order(reads, F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")), path, F.col("ordinal"))


def write_fastq(reads: DataFrame, path: str) -> None:
    """The same as four-line records; every quality is ``I``."""
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    _in_order(reads, record, path, F.col("ordinal"))


def discard(hits: DataFrame) -> None:
    """Compute everything, keep nothing."""
    hits.write.mode("overwrite").format("noop").save()
