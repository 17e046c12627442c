"""Seeds of a reference kept on disk: later searches read no reference, only what they meet.

Blocks of ``block`` letters are taken from every ``step``-th place of a contig.  A window of
any start holds t + 1 such blocks side by side, as long as
``step - 1 + (t + 1) * block <= window`` and ``block`` is a multiple of ``step``; t edits leave
one of them unchanged, moved by t places at most.  So one row for ``step`` letters finds every
hit at stride 1: a read's pieces of ``block`` letters are joined with the rows, the windows
around those met are cut out of stored pieces of the contigs, and only these are compared.

The rows are not shuffled: each task sorts those of its pieces by hash and writes them into
directories by ranges of the hash, so a block that stands everywhere lies in as many files as
pieces were read by tasks.  A read side that Spark broadcasts
prunes directories; a larger one is shuffled by hash, where adaptive execution splits hot
blocks.  ``meta`` is written last: a broken build is refused.

Contigs shorter than a window hold none.  Reads shorter than a block, or null, have no hit
within the tolerance (a window within t edits of a read leaves a whole block in it).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.operators.search import LONGEST, hits_of, strands

VERSION = 1
HASH = 48  # bits of a hash, written as steps of 4 bytes or less; what meets by chance is compared anyway


@dataclass
class SeedTable:
    """``blocks(bucket, h, first_sequence_id, place)`` and ``pieces`` of contigs, overlapping by a
    window on both sides."""

    blocks: DataFrame
    pieces: DataFrame
    window: int
    tolerance: int
    step: int
    block: int
    piece: int
    buckets: int


def layout(window: int, tolerance: int, step: int | None = None) -> tuple[int, int]:
    """``(step, block)``: the longest block for a step; by default the widest step that costs a
    block at most an eighth of its letters."""
    longest = window // (tolerance + 1)
    if longest < 1:
        raise ValueError("a window must be longer than the tolerance")
    block = lambda s: s * ((window - s + 1) // (s * (tolerance + 1)))
    if step is None:
        step = max(s for s in range(1, longest + 1) if 8 * block(s) >= 7 * longest)
    if step < 1 or block(step) < 1:
        raise ValueError(f"no block fits a step of {step}")
    return step, block(step)


def _hash(block: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - HASH)


def _bucket(h: Column, buckets: int) -> Column:
    return F.shiftright(h * buckets, HASH).cast("int")


def _cut(raw: str, wide: str, start: Column, n: int) -> Column:
    return F.coalesce(F.substring(raw, start.cast("int"), F.lit(n)), F.substring(wide, start.cast("int"), F.lit(n)).cast("binary"))


def save(contigs: DataFrame, path: str, window: int, tolerance: int, step: int | None = None, buckets: int = 64, piece: int | None = None) -> None:
    """Write the table of ``contigs`` (see sources.fasta.contig_windows; stride 1) to ``path``."""
    step, block = layout(window, tolerance, step)
    piece = piece or max(1 << 12, 8 * window)
    piece = -(-piece // step) * step  # pieces begin where blocks do
    some = contigs.where("window_count > 0").select("name", "bases", "first_sequence_id", "window_count", F.length("bases").cast("long").alias("size"))
    plain = F.octet_length("bases") == F.char_length("bases")  # bytes are not walked from the beginning
    some = some.select("*", F.when(plain, F.col("bases").cast("binary")).alias("raw"), F.when(~plain, F.col("bases")).alias("wide")).drop("bases")
    some = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long"))).alias("from"))
    left = F.greatest(F.col("from") - window, F.lit(0))
    cut = [F.substring(c, (left + 1).cast("int"), F.lit(piece + 2 * window)).alias(c) for c in ("raw", "wide")]
    pieces = some.select("first_sequence_id", "from", "name", "window_count", "size", left.alias("left"), *cut)
    pieces.write.mode("overwrite").parquet(f"{path}/pieces")
    kept = contigs.sparkSession.read.schema(pieces.schema).parquet(f"{path}/pieces")
    last = F.least(F.col("from") + piece, F.col("size") - block + 1) - 1  # of the places where a block begins
    at = kept.where(last >= F.col("from")).select("*", F.explode(F.sequence(F.col("from"), last, F.lit(step).cast("long"))).alias("place"))
    h = _hash(_cut("raw", "wide", F.col("place") - F.col("left") + 1, block))
    rows = at.select(h.alias("h"), "first_sequence_id", "place").withColumn("bucket", _bucket(F.col("h"), buckets))
    order = ("bucket", "h", "first_sequence_id", "place")
    steps = {"parquet.writer.version": "v2", "parquet.enable.dictionary#h": "false"}  # sorted numbers as differences
    rows.sortWithinPartitions(*order).write.mode("overwrite").options(**steps).partitionBy("bucket").parquet(f"{path}/blocks")
    meta = [(VERSION, window, tolerance, step, block, piece, buckets)]
    names = "version int, window int, tolerance long, step int, block int, piece int, buckets int"
    contigs.sparkSession.createDataFrame(meta, names).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> SeedTable:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta.version != VERSION:
        raise ValueError(f"not a seed table of version {VERSION}: {path}")
    blocks = spark.read.schema("h long, first_sequence_id long, place long, bucket int").parquet(f"{path}/blocks")
    return SeedTable(blocks, spark.read.parquet(f"{path}/pieces"), meta.window, meta.tolerance, meta.step, meta.block, meta.piece, meta.buckets)


def candidates(texts: DataFrame, table: SeedTable, tolerance: int) -> DataFrame:
    """``(seq, first_sequence_id, start)`` of ``texts(seq)``: windows that share a block with a read."""
    places = F.sequence(F.lit(0), F.length("seq") - table.block)
    asked = texts.where(F.length("seq") >= table.block).select("seq", F.explode(places).alias("at"))
    h = _hash(F.substring("seq", F.col("at") + 1, F.lit(table.block)).cast("binary"))
    asked = asked.select("seq", "at", h.alias("h")).withColumn("bucket", _bucket(F.col("h"), table.buckets))
    met = table.blocks.join(asked, ["bucket", "h"]).select("seq", "first_sequence_id", "place", "at")
    moves = F.sequence(F.lit(-tolerance), F.lit(tolerance))
    moved = met.select("seq", "first_sequence_id", "place", F.explode(F.transform(moves, lambda m: F.col("place") - F.col("at") + m)).alias("start"))
    inside = (F.col("start") >= 0) & F.col("place").between(F.col("start"), F.col("start") + table.window - table.block)
    return moved.where(inside).select("seq", "first_sequence_id", "start").distinct()


def search(reads: DataFrame, table: SeedTable, tolerance: int | None = None, both_strands: bool = False) -> DataFrame:
    """Hits of ``reads(ordinal, name, seq)`` among all windows at stride 1, as ``search.brute_force``
    over them, within ``tolerance`` (by default, and at most, the table's)."""
    tolerance = table.tolerance if tolerance is None else tolerance
    if not 0 <= tolerance <= table.tolerance:
        raise ValueError(f"the tolerance is above that of the table, {table.tolerance}")
    asked = strands(reads, both_strands)
    found = candidates(asked.select("seq").distinct(), table, tolerance)
    found = found.withColumn("from", F.floor(F.col("start") / table.piece) * table.piece)
    met = found.join(table.pieces, ["first_sequence_id", "from"]).where("start < window_count")
    text = _cut("raw", "wide", F.col("start") - F.col("left") + 1, table.window).cast("string")
    near = met.withColumn("distance", F.levenshtein("seq", text, min(tolerance, LONGEST))).where("distance >= 0")
    placed = near.select("seq", F.col("name").alias("contig"), "start", "distance", (F.col("first_sequence_id") + F.col("start")).alias("sequence_id"))
    return hits_of(asked.join(placed, "seq"))
