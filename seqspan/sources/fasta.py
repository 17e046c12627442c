"""FASTA and FASTQ files as DataFrames.

A FASTA record is one row from the start (``lineSep`` of newline and ``>``), FASTQ lines are put
together inside their split, so files are split and read in parallel and whole records are
never moved.  Only what a split's edge cuts apart, and records without a name, are shuffled.
Order comes from file names, the split's offset and the row's place in the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspan.functions.sequences import clean, contig_name, window_count
from seqspan.operators.scan import prefix_sums
from seqspan.operators.tables import kept, work_folder
from seqspan.sources.splits import TAKEN, first_line, numbered, scanned, split_table


def _header_and_bases(value: Column) -> tuple[Column, Column]:
    at = F.instr(value, "\n")
    header = F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value)
    return header, F.when(at > 0, F.substring(value, at + 1, F.length(value))).otherwise("")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``(contig_ordinal, name, bases)`` of a reference FASTA, or of a folder of them.

    Names end at the first space or tab.  A record without a name, and bases before the first
    header, belong to the next named record; with none after them they are lost."""
    rows = _numbered(_ordered(spark, path, "\n>"))
    first_has_header = ~F.col("opens") | F.col("value").startswith(">")
    value = F.when(F.col("opens") & F.col("value").startswith(">"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    header, bases = _header_and_bases(value)
    parts = rows.select(
        "n", F.when(first_has_header, contig_name(header)).otherwise("").alias("name"),
        clean(F.when(first_has_header, bases).otherwise(F.col("value"))).alias("bases"),
    )
    named = F.col("name") != ""
    slim = parts.select("n", named.cast("long").alias("named"))
    group = F.coalesce(F.sum("named").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = parts.join(slim.select("n", group.alias("g")), "n")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("n", "bases"))), lambda x: x["bases"])
    out = grouped.groupBy("g").agg(F.array_join(pieces, "").alias("bases"), F.max("name").alias("name"), F.max(named).alias("kept"))
    return out.where("kept").select(F.col("g").alias("contig_ordinal"), "name", "bases")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``(contig_ordinal, name, bases)`` of a reference FASTA, or of a folder of them.

    Names end at the first space or tab.  A record without a name, and bases before the first
    header, belong to the next named record; with none after them they are lost.  Splits in
    which this happens are put together by a shuffle, all others stream through."""
    rows, folder = scanned(spark, path, "\n>"), work_folder(spark)
    plain_name = contig_name(_header_and_bases(F.col("value"))[0])
    open_name = F.when(F.col("value").startswith(">"), contig_name(_header_and_bases(F.substring("value", 2, 1 << 30))[0])).otherwise("")
    flags = F.struct((open_name == "").alias("open"), (plain_name == "").alias("plain"), F.col("value").startswith(">").alias("headed"))
    splits = split_table(rows, folder, "contigs", nameless=F.count_if(plain_name == ""), head=F.min_by(flags, "place"), tail=F.max_by(plain_name == "", "place"))
    # a file's first row has a header only if it begins with one
    begins = F.col("block") == 0
    fix = F.when(begins, F.col("head.open").cast("int") - F.col("head.plain").cast("int")).otherwise(0)
    tail = F.when(begins & (F.col("rows") == 1), F.col("head.open")).otherwise(F.col("tail"))
    splits = kept(splits.select("file", "block", "at", "rows", "start", (F.col("nameless") + fix).alias("nameless"), tail.alias("waits")), folder, "contig_names")
    splits = prefix_sums(splits, ["file", "block"], "nameless", "nameless_before", folder)
    before = splits.select((F.col("start") + F.col("rows")).alias("start"), F.col("waits").alias("awaited"))
    splits = splits.join(before, "start", "left").withColumn("odd", (F.col("nameless") > 0) | F.coalesce("awaited", F.lit(False)))
    splits = kept(splits.select("file", "block", "at", "start", "nameless_before", "odd"), folder, "contig_splits")

    def parts(odd: bool) -> DataFrame:
        some = numbered(rows, splits.where(F.col("odd") == odd))
        headed = ~F.col("opens") | F.col("value").startswith(">")
        value = F.when(F.col("opens") & headed, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
        header, bases = _header_and_bases(value)
        name = F.when(headed, contig_name(header)).otherwise("")
        return some.select("n", "file", "block", "start", "nameless_before", name.alias("name"), clean(F.when(headed, bases).otherwise(F.col("value"))).alias("bases"))

    whole = parts(False).select((F.col("n") - F.col("nameless_before")).alias("contig_ordinal"), "name", "bases")
    if not splits.where("odd").head(1):
        return whole
    odd = kept(parts(True), folder, "odd_contigs")
    named = (F.col("name") != "").cast("long")
    here = F.coalesce(F.sum(named).over(W.partitionBy("file", "block").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = odd.select("n", (F.col("start") - F.col("nameless_before") + here).alias("contig_ordinal")).join(odd.select("n", "name", "bases"), "n")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("n", "bases"))), lambda x: x["bases"])
    out = grouped.groupBy("contig_ordinal").agg(F.max("name").alias("name"), F.array_join(pieces, "").alias("bases"))
    return whole.unionByName(out.where("name <> ''"))


def contig_windows(contigs: DataFrame, window: int, stride: int = 1, limit: int = 0) -> DataFrame:
    """Adds window_count and first_sequence_id; ``limit`` (0: none) clips the last contig and
    drops those after it."""
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    folder = work_folder(contigs.sparkSession)
    slim = kept(contigs.select("contig_ordinal", window_count(F.length("bases"), window, stride).alias("window_count")), folder, "counts")
    slim = prefix_sums(slim, ["contig_ordinal"], "window_count", "first_sequence_id", folder)
    if limit:
        slim = slim.where(F.col("first_sequence_id") < limit)
        slim = slim.withColumn("window_count", F.least("window_count", F.lit(limit) - F.col("first_sequence_id")))
    return contigs.drop("window_count", "first_sequence_id").join(slim, "contig_ordinal")


def from_sequences(spark: SparkSession, sequences: list[str]) -> tuple[DataFrame, int, int]:
    """Equal-length sequences as contigs ``sequence_<id>`` of one window each: contigs, window,
    stride."""
    if not sequences or not sequences[0] or len({len(s) for s in sequences}) != 1:
        raise ValueError("sequences must be present, not empty and equally long")
    rows = [(k, f"sequence_{k}", s) for k, s in enumerate(sequences)]
    contigs = spark.createDataFrame(rows, "contig_ordinal long, name string, bases string")
    width = len(sequences[0])
    return contigs.withColumn("bases", clean(F.col("bases"))), width, width


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (n, value) in order, split after split -> records (ordinal, k null, h, s, plus) whose
    four lines lie in one split, and the other lines (ordinal, k, h)."""
    held: pa.Table | None = None
    names = ["ordinal", "k", "h", "s", "plus"]

    def done(n: np.ndarray, value: pa.ChunkedArray, last: bool) -> tuple[pa.RecordBatch, int]:
        """What can be said of these lines, and how many of them wait for more."""
        at = np.flatnonzero((n % 4 == 0) & (np.arange(len(n)) + 3 < len(n)))
        at = at[n[np.minimum(at + 3, len(n) - 1)] == n[at] + 3]  # no edge of a split between
        whole = np.zeros(len(n), bool)
        for k in range(4):
            whole[at + k] = True
        end = len(n)
        if not last:
            tail = int((n[-1] + 1) % 4)
            while tail and (len(n) < tail or n[-tail] != n[-1] - tail + 1):
                tail -= 1  # these lines begin in another split
            end -= tail
        rest = np.flatnonzero(~whole[:end])
        lines = [value.take(pa.array(at + k)).combine_chunks() for k in range(3)]
        none = pa.nulls(len(rest), pa.string())
        some = value.take(pa.array(rest)).combine_chunks()
        cols = [
            pa.array(np.concatenate([n[at] // 4, n[rest] // 4])), pa.concat_arrays([pa.nulls(len(at), pa.int32()), pa.array((n[rest] % 4).astype(np.int32))]),
            pa.concat_arrays([lines[0], some]), pa.concat_arrays([lines[1], none]), pa.concat_arrays([lines[2], none]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names), len(n) - end

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        out, waits = done(now.column(0).to_numpy(), now.column(1), False)
        held = now.slice(now.num_rows - waits) if waits else None
        yield out
    if held is not None:
        yield done(held.column(0).to_numpy(), held.column(1), True)[0]


def _fastq(rows: DataFrame, path: str, limit: int) -> DataFrame:
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    full = F.min(F.when(F.col("value") != "", F.col("place")))
    splits = split_table(rows, folder, "lines", full=full)
    first = splits.agg(F.min(F.col("start") + F.col("full") - F.col("at"))).first()[0]
    lines = numbered(rows, splits).where(F.col("n") >= first).select((F.col("n") - first).alias("n"), "value")
    if limit:
        lines = lines.where(F.col("n") < 4 * limit)
    found = kept(lines.mapInArrow(_records, "ordinal long, k int, h string, s string, plus string"), folder, "records")
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("h"))).alias(("h", "s", "plus")[k])
    cut = found.where("k is not null").groupBy("ordinal").agg(line(0), line(1), line(2), F.count("*").alias("lines"))
    records = found.where("k is null").select("ordinal", "h", "s", "plus", F.lit(4).cast("long").alias("lines")).unionByName(cut)
    bad_header = ~F.coalesce(F.col("h").startswith("@"), F.lit(False))
    cut_short = (F.col("lines") < 4) | ~F.coalesce(F.col("plus").startswith("+"), F.lit(False))
    wrong = records.where(bad_header | cut_short).agg(F.min(F.struct("ordinal", bad_header.alias("header"))).alias("x")).first().x
    if wrong is not None:
        raise ValueError(f"invalid FASTQ header in: {path}" if wrong.header else f"truncated FASTQ record in: {path}")
    return records.select("ordinal", F.substring("h", 2, 1 << 30).alias("name"), clean(F.col("s")).alias("seq"))


def read_reads(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``(ordinal, name, seq)`` of a FASTA or FASTQ file; the whole header is the name.

    FASTQ records are four lines; a record cut short, a third line without ``+`` or a header
    without ``@`` raises ValueError (records after ``limit`` are not looked at).  The format is
    told by the first line.  A limit whose rows are at most ``TAKEN`` ends the reading: nothing
    is read but the splits that hold it."""
    begins = first_line(spark, path)
    if begins is None:
        raise ValueError(f"query file is empty: {path}")
    if begins.startswith(">"):
        few = limit + 1 if limit and limit < TAKEN else 0  # one more: what stands before the first header
        rows, folder = scanned(spark, path, "\n>", few), work_folder(spark)
        stray = F.min_by((~F.col("value").startswith(">")).cast("long"), "place")
        splits = split_table(rows, folder, "reads", stray=F.when(F.col("block") == 0, stray).otherwise(0))
        splits = prefix_sums(splits, ["file", "block"], "stray", "strays", folder)  # blank lines before a file's first header
        found = numbered(rows, kept(splits, folder, "read_splits")).where(~F.col("opens") | F.col("value").startswith(">"))
        value = F.when(F.col("opens"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
        header, bases = _header_and_bases(value)
        out = found.select((F.col("n") - F.col("strays") - F.col("stray")).alias("ordinal"), header.alias("name"), clean(bases).alias("seq"))
        return out.where(F.col("ordinal") < limit) if limit else out
    if not begins.startswith("@"):
        raise ValueError(f"query file is neither FASTA nor FASTQ: {path}")
    few = _leading_blanks(spark, path) + 4 * limit if limit and 4 * limit <= TAKEN else 0
    return _fastq(scanned(spark, path, first=few if few <= TAKEN else 0), path, limit)


def _leading_blanks(spark: SparkSession, path: str) -> int:
    """Blank lines before the first one that is not; ``TAKEN`` where 64 lines do not tell."""
    few = scanned(spark, path, first=64).orderBy("file", "place").collect()
    return next((k for k, r in enumerate(few) if r.value), TAKEN)
