"""Sequence corpora over the driver's tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.config import BuildConfig
from seqspan.functions.sequences import clean, contig_name
from seqspan.operators.hierarchy import SequenceIndex, build_from_windows
from seqspan.operators.windows import windows
from seqspan.sources.fasta import contig_windows

WINDOW, STRIDE, TOLERANCE = 50, 50, 5
PASSAGE_STRIDE, PASSAGE_READS, CLOSE = 5, 10, 2
PART_CONFIG = BuildConfig(radii=(7, 5, 3), beacon_ratios=(0.4, 0.5, 0.6), max_tolerance=1)
PASSAGE_CONFIG = BuildConfig(radii=(14, 9, 5), beacon_ratios=(0.1, 0.1, 0.1), max_tolerance=CLOSE)
#: the command line's defaults
DEFAULT_WINDOW, DEFAULT_READS = 150, 10
DEFAULT_CONFIG = BuildConfig(radii=(60, 35, 15), beacon_ratios=(0.1, 0.1, 0.1), max_tolerance=5)
TO_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def bases(text: Column) -> Column:
    """ASCII letters of a text, folded onto four bases."""
    letters = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.translate(letters, string.ascii_uppercase, TO_BASES)


def document_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as a contig, in order of doc_id; the name is its header's first word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    header = F.concat_ws(" ", F.concat(F.lit("doc_"), F.col("doc_id")), "source", "lang")
    return docs.select(F.col("doc_id").alias("contig_ordinal"), contig_name(header).alias("name"), bases(F.col("text")).alias("bases"))


def document_windows(spark: SparkSession, sf_dir: str, limit: int = 0) -> DataFrame:
    return windows(contig_windows(document_contigs(spark, sf_dir), WINDOW, STRIDE, limit), WINDOW, STRIDE)


def benchmark_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage cut into reads of window length, one base dropped from each."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", bases(F.col("text")).alias("b"))
    cut = items.where(F.length("b") >= WINDOW).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.length("b") / WINDOW).cast("int") - 1)))
    seq = F.substring("b", F.col("k") * WINDOW + 1, F.lit(WINDOW))
    at = (F.col("item_id") % WINDOW).cast("int")
    seq = F.concat(F.substring(seq, F.lit(1), at), F.substring(seq, at + 2, F.lit(WINDOW)))
    return cut.select((F.col("item_id") * 1000 + F.col("k")).alias("ordinal"), F.concat(F.lit("b"), "item_id", F.lit("_"), "k").alias("name"), seq.alias("seq"))


def part_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name as a window."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("sequence_id"), F.concat(F.lit("part_"), "p_partkey").alias("contig"), F.lit(0).cast("long").alias("start"), clean(F.col("p_name")).alias("seq"))


def part_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name without the base at its least id modulo its length."""
    names = part_windows(spark, sf_dir).groupBy("seq").agg(F.min("sequence_id").alias("ordinal"))
    at = F.when(F.length("seq") > 0, F.col("ordinal") % F.length("seq")).otherwise(0).cast("int")
    cut = F.concat(F.substring("seq", F.lit(1), at), F.substring("seq", at + 2, F.length("seq")))
    return names.select("ordinal", F.concat(F.lit("r"), "ordinal").alias("name"), cut.alias("seq"))


def passage_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole benchmark passage as a contig."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("contig_ordinal"), F.concat(F.lit("item_"), "item_id").alias("name"), bases(F.col("text")).alias("bases"))


def passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every benchmark passage."""
    return windows(contig_windows(passage_contigs(spark, sf_dir), WINDOW, PASSAGE_STRIDE), WINDOW, PASSAGE_STRIDE)


def passage_reads(spark: SparkSession, sf_dir: str, window: int = WINDOW, stride: int = PASSAGE_READS) -> DataFrame:
    """Windows of the passages (by default every second one): one base dropped, the last one
    exchanged."""
    every = windows(contig_windows(passage_contigs(spark, sf_dir), window, stride), window, stride)
    at = (F.col("sequence_id") % (window - 1)).cast("int")
    last = F.translate(F.substring("seq", window, 1), "ACGT", "CATG")
    seq = F.concat(F.substring("seq", F.lit(1), at), F.substring("seq", at + 2, window - 2 - at), last)
    return every.select(F.col("sequence_id").alias("ordinal"), F.concat(F.lit("p"), "sequence_id").alias("name"), seq.alias("seq"))


_BUILT: dict[tuple, SequenceIndex] = {}


def _built(spark: SparkSession, path: str, build: Callable[[], SequenceIndex], name: str = "") -> SequenceIndex:
    """An index is built once per application, name and state of its table (bytes and time of
    change)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (name, spark.sparkContext.applicationId, path, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def part_index(spark: SparkSession, sf_dir: str) -> SequenceIndex:
    """The three-level index of all part names."""
    return _built(spark, f"{sf_dir}/part.parquet", lambda: build_from_windows(part_windows(spark, sf_dir), 0, 1, PART_CONFIG))


def build_passages(spark: SparkSession, sf_dir: str) -> SequenceIndex:
    return build_from_windows(passage_windows(spark, sf_dir), WINDOW, PASSAGE_STRIDE, PASSAGE_CONFIG)


def passage_index(spark: SparkSession, sf_dir: str) -> SequenceIndex:
    """The three-level index of all windows of the passages."""
    return _built(spark, f"{sf_dir}/benchmark.parquet", lambda: build_passages(spark, sf_dir))


def default_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of 150 of every benchmark passage."""
    return windows(contig_windows(passage_contigs(spark, sf_dir), DEFAULT_WINDOW, 1), DEFAULT_WINDOW, 1)


def default_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_reads(spark, sf_dir, DEFAULT_WINDOW, DEFAULT_READS)


def default_index(spark: SparkSession, sf_dir: str) -> SequenceIndex:
    """The index of these windows with the command line's defaults."""
    return _built(spark, f"{sf_dir}/benchmark.parquet", lambda: build_from_windows(default_windows(spark, sf_dir), DEFAULT_WINDOW, 1, DEFAULT_CONFIG), "default")
