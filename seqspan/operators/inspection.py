"""What an index holds, and reports of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspan.functions.sequences import floor_percentiles
from seqspan.operators.hierarchy import SequenceIndex


def summary(index: SequenceIndex) -> DataFrame:
    """``(metric, value)`` rows: format, window, stride, T, windows, memberships, radius and
    worlds of each layer, beacons and beacon distances."""
    meta = index.meta.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(c).cast("long").alias("value"))
        for name, c in (("format_version", "format_version"), ("window", "window"), ("stride", "stride"), ("T", "max_tolerance"), ("windows", "reference_window_count"))
    ])).alias("x")).select("x.*")
    layers = index.layers.select(F.explode(F.array(
        F.struct(F.concat(F.lit("radius_"), F.col("layer")).alias("metric"), F.col("selection_radius").cast("long").alias("value")),
        F.struct(F.concat(F.lit("worlds_"), F.col("layer")).alias("metric"), F.col("node_count").alias("value")),
    )).alias("x")).select("x.*")
    count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    out = meta.unionByName(layers)
    for df, name in ((index.members, "leaf_memberships"), (index.beacons, "beacons"), (index.beacon_distances, "beacon_distances")):
        out = out.unionByName(count(df, name))
    return out


def size_in_memory(index: SequenceIndex) -> DataFrame:
    """One row, index_bytes: about what the index would take in memory.  65 bytes a node and its
    center, per leaf membership an id and the window, beacons and their distances."""
    long = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    n = index.nodes.agg((65 * F.count("*") + long(F.sum(F.octet_length("center_seq")))).alias("n"))
    m = index.members.agg((8 * F.count("*") + long(F.sum(F.octet_length("seq")))).alias("m"))
    b, d = index.beacons.agg((8 * F.count("*")).alias("b")), index.beacon_distances.agg((4 * F.count("*")).alias("d"))
    return n.crossJoin(m).crossJoin(b).crossJoin(d).select((F.col("n") + F.col("m") + F.col("b") + F.col("d")).alias("index_bytes"))  # one row each


def latency_report(latencies: DataFrame, column: str = "latency_ns") -> DataFrame:
    """queries, mean and floor-placed p50, p95, p99 in microseconds."""
    places = floor_percentiles(latencies, column, {"p50_us": 0.50, "p95_us": 0.95, "p99_us": 0.99})
    whole = latencies.agg(F.count(column).alias("queries"), (F.avg(column) / 1000).alias("mean_latency_us"))
    return whole.crossJoin(places.select(*[(F.col(c) / 1000).alias(c) for c in places.columns]))
