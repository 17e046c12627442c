"""Windows over contigs, and ids back to coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
FEW = 1 << 16  # contigs that may be broadcast


def windows(contigs: DataFrame, window: int, stride: int = 1, spread: bool = False) -> DataFrame:
    """``(sequence_id, contig, start, seq)``; needs window_count and first_sequence_id.
    Windows never cross contigs and there is no partial one at the end.

    A contig is cut into pieces of about ``PIECE`` characters first, and texts whose every
    character is a byte are cut as bytes, which does not walk them from the beginning: work
    grows with the length.  ``spread`` deals the pieces to all tasks, for few long contigs."""
    each = max(1, PIECE // stride)  # windows of a piece
    text, plain = F.col("bases"), F.octet_length("bases") == F.char_length("bases")
    some = contigs.where("window_count > 0").select(
        "name", "first_sequence_id", "window_count", F.when(plain, text.cast("binary")).alias("raw"), F.when(~plain, text).alias("wide"))
    some = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("window_count") - 1, F.lit(each).cast("long"))).alias("first"))
    some = some.withColumn("n", F.least(F.lit(each).cast("long"), F.col("window_count") - F.col("first")))
    at, length = (F.col("first") * stride + 1).cast("int"), ((F.col("n") - 1) * stride + window).cast("int")
    pieces = some.select(
        "name", (F.col("first_sequence_id") + F.col("first")).alias("id"), (F.col("first") * stride).alias("from"), "n",
        F.substring("raw", at, length).alias("raw"), F.substring("wide", at, length).alias("wide"),
    )
    if spread:
        pieces = pieces.repartition("id")
    one = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    at = (F.col("k") * stride + 1).cast("int")
    seq = F.coalesce(F.substring("raw", at, F.lit(window)).cast("string"), F.substring("wide", at, F.lit(window)))
    return one.select((F.col("id") + F.col("k")).alias("sequence_id"), F.col("name").alias("contig"), (F.col("from") + F.col("k") * stride).alias("start"), seq.alias("seq"))


def locations(ids: DataFrame, contigs: DataFrame, stride: int) -> DataFrame:
    """Adds contig and start to ``ids(sequence_id, ...)`` by the range its contig owns.

    Ids meet contigs by equal blocks of ids.  A block is as wide as the mean contig, so that
    contigs and blocks together make at most twice as many rows as there are contigs.  Beyond
    ``FEW`` contigs both sides are shuffled by block: a broadcast would pass the driver."""
    c = contigs.where("window_count > 0").select("name", "first_sequence_id", "window_count")
    mean, many = c.agg(F.avg("window_count"), F.count("*")).first()
    width = max(1, int(mean or 1))
    block = lambda x: F.floor(x / width)
    last = F.col("first_sequence_id") + F.col("window_count") - 1
    c = c.withColumn("_block", F.explode(F.sequence(block(F.col("first_sequence_id")), block(last))))
    c = c.hint("merge") if many > FEW else c
    owns = (F.col("sequence_id") >= F.col("first_sequence_id")) & (F.col("sequence_id") <= last)
    start = (F.col("sequence_id") - F.col("first_sequence_id")) * stride
    met = ids.withColumn("_block", block(F.col("sequence_id"))).join(c, "_block").where(owns)
    return met.withColumns({"contig": F.col("name"), "start": start}).drop("_block", "name", "first_sequence_id", "window_count")
