"""Deterministic test reads from windows of a reference.

Random choices are hashes of the read's number and the edit step, so any engine can redo
them and any partitioning gives the same reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(ordinal: Column, salt: int, below: Column | int) -> Column:
    """A number in [0, below) from the read's number: a multiplicative congruence that plain
    integer SQL can repeat."""
    mixed = (ordinal * 1103515245 + salt * 12345 + 67890) % 2147483647
    return ((mixed * 48271) % 2147483647) % (F.lit(below) if isinstance(below, int) else below)


def _edit(seq: Column, step: int, ordinal: Column) -> tuple[Column, Column]:
    """Edit ``step``: substitution, insertion, deletion in turn; the new sequence and a log."""
    n = F.length(seq)
    base = lambda k: F.substring(F.lit("ACGT"), (k + 1).cast("int"), F.lit(1))
    room = n + 1 if step % 3 == 1 else F.greatest(n, F.lit(1))
    at = draw(ordinal, 2 * step + 1, room).cast("int")
    head = F.substring(seq, F.lit(1), at)
    if step % 3 == 1:
        return F.concat(head, base(draw(ordinal, 2 * step + 2, 4)), F.substring(seq, at + 1, n)), F.concat(F.lit("I"), at)
    tail = F.substring(seq, at + 2, n)
    if step % 3 == 2:
        return F.concat(head, tail), F.concat(F.lit("D"), at)
    # the base 1 to 3 places on in ACGT; for any other letter one of them
    old = F.position(F.substring(seq, at + 1, F.lit(1)), F.lit("ACGT"))
    new = (old + draw(ordinal, 2 * step + 2, 3)) % 4
    return F.concat(head, base(new), tail), F.concat(F.lit("S"), at)


def generate_reads(windows: DataFrame, count: int = 1000, window: int = 150, reference_windows: int = 10000, max_edits: int = 5,
                   mode: str = "ordered", no_hit_every: int = 10) -> DataFrame:
    """``(ordinal, name, seq)``: read i from window i mod available with i mod (max_edits + 1)
    edits; every ``no_hit_every``-th is random.  ``repeated`` takes the middle window without
    edits; ``shuffled`` deals the same reads new places.  ``windows(sequence_id, seq)`` has ids
    from 0 at stride 1."""
    if mode not in ("ordered", "shuffled", "repeated"):
        raise ValueError(f"unknown mode: {mode}")
    spark: SparkSession = windows.sparkSession
    source = windows.where(F.col("sequence_id") < reference_windows).select(F.col("sequence_id").alias("start"), "seq")
    available = source.count()
    i = F.col("ordinal")
    reads = spark.range(count).withColumnRenamed("id", "ordinal")
    random = (i % no_hit_every == no_hit_every - 1) if no_hit_every else F.lit(False)
    start = F.lit(min(available - 1, available // 2)).cast("long") if mode == "repeated" else i % available
    edits = F.lit(0) if mode == "repeated" else (i % (max_edits + 1)).cast("int")
    joined = reads.withColumns({"start": start, "edits": edits, "random": random}).join(source, "start")
    joined = joined.withColumn("log", F.array().cast("array<string>"))
    for step in range(max_edits):  # one projection a step: the sequence is read several times
        seq, op = _edit(F.col("seq"), step, i)
        more = F.col("edits") > step
        joined = joined.select(
            "ordinal", "start", "edits", "random", F.when(more, seq).otherwise(F.col("seq")).alias("seq"),
            F.when(more, F.concat("log", F.array(op))).otherwise(F.col("log")).alias("log"),
        )
    noise = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.substring(F.lit("ACGT"), (draw(i * 1009 + k, 7, 4) + 1).cast("int"), F.lit(1))), "")
    ops = F.when(F.size("log") == 0, "none").otherwise(F.array_join("log", ","))
    name = F.concat(F.lit("q"), i, F.when(F.col("random"), F.lit("_random_nohit")).otherwise(F.concat(F.lit("_source"), F.col("start"), F.lit("_steps"), F.col("edits"), F.lit("_"), ops)))
    out = joined.select("ordinal", name.alias("name"), F.when(F.col("random"), noise).otherwise(F.col("seq")).alias("seq"))
    if mode == "shuffled":
        out = out.withColumn("ordinal", F.row_number().over(W.orderBy(draw(F.col("ordinal"), 3, 1 << 30), "ordinal")).cast("long") - 1)
    return out
