"""Latencies of single reads, measured in the tasks that search their leaves."""

import numpy as np

from seqspan.config import BuildConfig, QueryConfig
from seqspan.operators import hierarchy, inspection, search


def test_a_slow_read_shows_in_the_percentiles(spark):
    """One read meets a leaf of 4,000 unlike windows, the others leaves of one window."""
    rng = np.random.default_rng(5)
    near = ["A" * 12 + "".join(rng.choice(list("ACGT"), 8)) for _ in range(4000)]
    lone = ["C" * 20, "G" * 20, "T" * 20]
    rows = [(k, "c", k, s) for k, s in enumerate(near + lone)]
    every = spark.createDataFrame(rows, "sequence_id long, contig string, start long, seq string")
    index = hierarchy.build_from_windows(every, 20, 1, BuildConfig((11, 10, 9), (0.1, 0.1, 0.1), 2))
    reads = spark.createDataFrame([(k, f"r{k}", s) for k, s in enumerate([near[0], *lone * 5])], "ordinal long, name string, seq string")
    found = search.latencies(reads, index, QueryConfig(2)).cache()
    rows = {r.ordinal: r for r in found.collect()}
    assert sorted(rows) == list(range(16)) and len({r.routing_ns for r in rows.values()}) == 1
    assert all(r.latency_ns == r.routing_ns + r.leaf_ns and r.leaf_ns > 0 for r in rows.values())
    assert rows[0].leaf_ns > 3 * np.median([r.leaf_ns for k, r in rows.items() if k])
    report = inspection.latency_report(found, "leaf_ns").first()
    assert report.queries == 16 and report.p50_us < report.mean_latency_us
    assert search.latencies(reads.limit(0), index).count() == 0
