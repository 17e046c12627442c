"""Windows at stride 1 near a read, without making the windows.

t edits leave one of t + 1 segments of a window unchanged in the read, moved by t places at
most.  The reads' segments become seeds, (hash, place of the segment in its window); contigs
stream past them position by position, and only where a seed is met the window around it is
cut out and compared.  A window is a row only once it is a candidate.

The seeds are broadcast, some 15 of a read at tolerance 2: up to ``SEEDS`` of them.  For
more reads the windows are made and joined by their segments (``search.by_segments``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspan.operators.search import by_segments, hits_of, segments, strands
from seqspan.operators.tables import kept, work_folder
from seqspan.operators.windows import PIECE, windows

SEEDS = 1 << 20


def seeds_of(reads: DataFrame, window: int, tolerance: int) -> DataFrame:
    """``(h, a, seq)`` of ``reads(seq)``: hash of each piece of a read that may be segment of a
    window, and the segment's place in the window."""
    cuts = [
        F.struct(F.lit(a).alias("a"), F.lit(n).alias("n"), F.substring("seq", a + move + 1, n).alias("x"))
        for a, n in segments(window, tolerance) for move in range(-tolerance, tolerance + 1) if a + move >= 0
    ]
    each = reads.select("seq", F.explode(F.array_distinct(F.array(*cuts))).alias("c")).select("seq", "c.*").where(F.length("x") == F.col("n"))
    return each.select(F.xxhash64("n", F.col("x").cast("binary")).alias("h"), "a", "seq").distinct()


def seed_hits(reads: DataFrame, contigs: DataFrame, window: int, tolerance: int, both_strands: bool = False) -> DataFrame:
    """Hits among all windows at stride 1 of ``contigs`` (see sources.fasta.contig_windows)."""
    asked = strands(reads, both_strands)
    if window <= tolerance:
        return by_segments(reads, windows(contigs, window), window, tolerance, both_strands)
    seeds = kept(seeds_of(asked.select("seq").distinct(), window, tolerance), work_folder(reads.sparkSession), "seeds")
    if seeds.count() > SEEDS:
        return by_segments(reads, windows(contigs, window), window, tolerance, both_strands, repeats=False)
    # pieces overlap by a window on both sides, so that a candidate lies in the piece of its seed
    some = contigs.where("window_count > 0").select("name", "bases", "first_sequence_id", "window_count", F.length("bases").alias("size"))
    some = some.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(PIECE))).alias("from"))
    left = F.greatest(F.col("from") - window, F.lit(0))
    pieces = some.select("name", "first_sequence_id", "window_count", "from", left.alias("left"), F.least(F.lit(PIECE), F.col("size") - F.col("from")).alias("n"), F.substring("bases", left + 1, F.lit(PIECE + 2 * window)).alias("text"))
    plain = F.octet_length("text") == F.char_length("text")
    pieces = pieces.select("*", F.when(plain, F.col("text").cast("binary")).alias("raw"), F.when(~plain, F.col("text")).alias("wide")).drop("text")
    lengths = sorted({n for _, n in segments(window, tolerance)})
    at = pieces.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    place = F.col("from") - F.col("left") + F.col("p") + 1
    cut = lambda start, n: F.coalesce(F.substring("raw", start, F.lit(n)), F.substring("wide", start, F.lit(n)).cast("binary"))
    keys = F.array(*[F.xxhash64(F.lit(n), cut(place, n)) for n in lengths])
    met = at.select("*", F.explode(keys).alias("h")).join(F.broadcast(seeds), "h")
    start = F.col("from") + F.col("p") - F.col("a")
    met = met.withColumn("start", start.cast("long")).where("start >= 0 and start < window_count")
    near = met.select("name", "first_sequence_id", "start", "seq", cut((F.col("start") - F.col("left") + 1).cast("int"), window).cast("string").alias("s"))
    near = near.withColumn("distance", F.levenshtein("seq", "s", tolerance)).where("distance >= 0").drop("s").distinct()
    placed = near.select("seq", F.col("name").alias("contig"), "start", "distance", (F.col("first_sequence_id") + F.col("start")).alias("sequence_id"))
    return hits_of(asked.join(placed, "seq"))
