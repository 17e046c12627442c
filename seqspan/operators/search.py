"""Similarity search: brute force, routed through the hierarchy, or by shared segments.

All three return ``hits(ordinal, query, contig, start, distance, strand, sequence_id)``.
Routed and brute-force answers agree when every radius exceeds twice the tolerance; the
segment join is exact always.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspan.config import QueryConfig
from seqspan.functions.sequences import reverse_complement, strand, triangle_bound
from seqspan.operators.hierarchy import SequenceIndex
from seqspan.operators.tables import kept, work_folder
from seqspan.operators.tiles import all_distances, nearest_within, pairs_within, row_times

LONGEST = 2**31 - 1  # letters of a text, and so a distance, at most
HIT_COLUMNS = ("ordinal", "query", "contig", "start", "distance", "strand", "sequence_id")


def strands(reads: DataFrame, both: bool) -> DataFrame:
    """``reads(ordinal, name, seq)`` with reverse; a palindrome stands on both strands."""
    one = reads.select("ordinal", "name", "seq", F.lit(False).alias("reverse"))
    if not both:
        return one
    return one.unionByName(reads.select("ordinal", "name", reverse_complement(F.col("seq")).alias("seq"), F.lit(True).alias("reverse")))


def hits_of(found: DataFrame) -> DataFrame:
    return found.select(
        "ordinal", F.col("name").alias("query"), "contig", "start", F.col("distance").cast("int").alias("distance"),
        strand(F.col("reverse")).alias("strand"), "sequence_id",
    )


def ordered_hits(hits: DataFrame) -> DataFrame:
    """Read order; within a read by id, forward before reverse, then distance."""
    return hits.orderBy("ordinal", "sequence_id", F.when(F.col("strand") == "+", 0).otherwise(1), "distance")


def brute_force(reads: DataFrame, windows: DataFrame, tolerance: int, both_strands: bool = False) -> DataFrame:
    """All pairs within the tolerance: the stated query set against all windows, in blocks.
    Equal windows are compared once."""
    texts, tolerance = windows.select(F.col("seq").alias("s")).distinct(), min(tolerance, LONGEST)
    asked = strands(reads, both_strands)
    near = asked.crossJoin(texts).withColumn("distance", F.levenshtein("seq", "s", tolerance)).where("distance >= 0")
    return hits_of(near.drop("seq").join(windows.select(F.col("seq").alias("s"), "sequence_id", "contig", "start"), "s"))


def segments(length: int, tolerance: int) -> list[tuple[int, int]]:
    """(start, length) of tolerance + 1 pieces of a window, as even as can be."""
    n = tolerance + 1
    edge = [length * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def by_segments(reads: DataFrame, windows: DataFrame, window: int, tolerance: int, both_strands: bool = False, repeats: bool = True) -> DataFrame:
    """Pigeonhole join: t edits leave one of t + 1 segments of the window unchanged in the
    read, moved by t places at most.  For windows of t bases or fewer a segment would be
    empty; then every pair is compared.

    ``repeats``: windows that repeat are looked up once (one more shuffle of the windows);
    without it they stream past the reads' segments, which suits windows at stride 1."""
    if window <= tolerance:
        return brute_force(reads, windows, tolerance, both_strands)
    every = windows.select(F.col("seq").alias("s"), "sequence_id", "contig", "start")
    texts = every.select("s").distinct() if repeats else every
    asked = strands(reads, both_strands)
    pairs = segment_pairs(asked.select("seq").distinct(), texts, window, tolerance)
    if repeats:
        near = pairs.distinct().withColumn("distance", F.levenshtein("seq", "s", tolerance)).where("distance >= 0")
        placed = near.join(every, "s").drop("s")
    else:
        placed = pairs.withColumn("distance", F.levenshtein("seq", "s", tolerance)).where("distance >= 0").drop("s").distinct()
    return hits_of(asked.join(placed, "seq"))


def segment_pairs(distinct: DataFrame, texts: DataFrame, window: int, tolerance: int) -> DataFrame:
    """Rows of ``texts(s, ...)``, all as long as the window, and of ``distinct(seq)`` that share a segment,
    once for each that they share."""
    parts = segments(window, tolerance)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("s", a + 1, n).alias("x")) for k, (a, n) in enumerate(parts)])
    left = texts.select("*", F.explode(keys).alias("key")).select(*texts.columns, "key.*")
    cuts = [
        F.struct(F.lit(k).alias("k"), F.substring("seq", a + move + 1, n).alias("x"))
        for k, (a, n) in enumerate(parts) for move in range(-tolerance, tolerance + 1) if a + move >= 0
    ]
    right = distinct.select("seq", F.explode(F.array_distinct(F.array(*cuts))).alias("key")).select("seq", "key.*")
    length = F.element_at(F.array(*[F.lit(n) for _, n in parts]), F.col("k") + 1)
    right = right.where(F.length("x") == length)  # cut short at the read's end
    return left.join(right, ["k", "x"]).drop("k", "x")


def near_texts(distinct: DataFrame, texts: DataFrame, window: int, tolerance: int) -> DataFrame:
    """``(seq, s, distance)``: all pairs of ``distinct(seq)`` and ``texts(s)`` within the tolerance.  Texts as long
    as the window meet by segments, where these are not empty; all others are compared with every row."""
    tolerance, alike = min(tolerance, LONGEST), F.char_length("s") == window
    if window <= tolerance:
        pairs = distinct.crossJoin(texts)
    else:
        pairs = segment_pairs(distinct, texts.where(alike), window, tolerance).distinct().unionByName(distinct.crossJoin(texts.where(~alike)))
    return pairs.select("seq", "s", F.levenshtein("seq", "s", tolerance).alias("distance")).where("distance >= 0")


def asked_id() -> Column:
    """One number for a read and strand."""
    return (F.col("ordinal") * 2 + F.col("reverse").cast("int")).alias("id")


def route_level(asked: DataFrame, nodes: DataFrame, folder: str, name: str, beacons: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """``asked(ordinal, reverse, name, seq, parent)``, stored, moved to the nearest child of each
    parent; ties go to the smallest node id.

    With ``beacons`` and their distance ``table`` only the first child and the beacons are
    compared at once; another child only if its triangle bound does not exceed the nearest
    of these, and then no further than this limit.  Without them every child is compared."""
    children = nodes.where("parent_id is not null").select(F.col("parent_id").alias("parent"), "child_ordinal", F.col("node_id").alias("id"), F.col("center_seq").alias("s"))
    many = asked.select("parent", asked_id(), F.col("seq").alias("s"))
    best = lambda df: df.where("least is not null").select("parent", "id", F.col("near")[0].alias("best"))
    if beacons is None:
        found = best(nearest_within(many, children))
    else:
        children = children.join(beacons.withColumnRenamed("parent_id", "parent"), ["parent", "child_ordinal"], "left")
        at_once = F.col("beacon_index").isNotNull() | (F.col("child_ordinal") == 0)
        first = nearest_within(many, children.where(at_once), 1 << 29)
        # the first child is the first beacon, where there are any; beacons rise with node ids
        in_order = F.transform(F.array_sort(F.transform("near", lambda x: F.struct(x["other"], x["d"]))), lambda x: x["d"])
        first = kept(first.select("parent", "id", F.col("near")[0].alias("best"), F.col("least").alias("most"), in_order.alias("bounds")), folder, f"{name}_first")
        known = F.transform(F.array_sort(F.collect_list(F.struct("beacon_index", "distance"))), lambda x: x["distance"])
        known = table.withColumnRenamed("parent_id", "parent").groupBy("parent", "child_ordinal").agg(known.alias("bounds"))
        rest = children.where(~at_once).join(known, ["parent", "child_ordinal"], "left")
        other = best(nearest_within(first.join(many, ["parent", "id"]), rest))
        found = first.select("parent", "id", "best").unionByName(other).groupBy("parent", "id").agg(F.min("best").alias("best"))
    met = asked.withColumn("id", asked_id()).join(found, ["parent", "id"])
    return met.select("ordinal", "reverse", "name", "seq", F.col("best.other").alias("parent"))


def routed_leaves(reads: DataFrame, index: SequenceIndex, both_strands: bool = False, route: str = "multilateration") -> list[DataFrame]:
    """``(ordinal, reverse, name, seq, parent)`` before each level and at the leaf worlds; every
    level is stored, so none is computed again by the next."""
    folder = work_folder(reads.sparkSession)
    asked = [kept(strands(reads, both_strands).withColumn("parent", F.lit(0).cast("long")), folder, "asked")]
    for layer in range(3):
        nodes = index.nodes.where(F.col("layer") == layer)
        known = (None, None) if route == "scan" else (index.beacons, index.beacon_distances)
        asked.append(kept(route_level(asked[-1], nodes, folder, f"level{layer}", *known), folder, f"asked{layer}"))
    return asked


def routed(reads: DataFrame, index: SequenceIndex, config: QueryConfig = QueryConfig()) -> DataFrame:
    """Hits among the members of the leaf world that each read and strand is routed to; both
    route modes lead to the same one."""
    found = routed_texts(reads, index, config)
    return hits_of(found.join(index.members.select(F.col("leaf_id").alias("parent"), F.col("seq").alias("s"), "sequence_id", "contig", "start"), ["parent", "s"]))


def routed_texts(reads: DataFrame, index: SequenceIndex, config: QueryConfig) -> DataFrame:
    """``(parent, s, ordinal, name, reverse, distance)``, stored: each read and strand with the texts near it
    in its leaf world.  Members that are equal are compared once."""
    folder = work_folder(reads.sparkSession)
    leaves = routed_leaves(reads, index, config.both_strands, config.route)[-1]
    asked, members = leaf_sides(leaves, index, config.within(index.max_tolerance))
    texts = kept(members.groupBy("parent", "s").agg(F.min("id").alias("id")), folder, "leaf_texts")
    near = pairs_within(asked, texts).select("parent", "id", F.col("other").alias("text"), F.col("d").alias("distance"))
    near = near.join(texts.withColumnRenamed("id", "text"), ["parent", "text"]).join(leaves.select("parent", asked_id(), "ordinal", "name", "reverse"), ["parent", "id"])
    return kept(near.select("parent", "s", "ordinal", "name", "reverse", "distance"), folder, "near_texts")


def leaf_sides(leaves: DataFrame, index: SequenceIndex, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """Reads at their leaf worlds, and the members of these."""
    members = index.members.select(F.col("leaf_id").alias("parent"), F.col("sequence_id").alias("id"), F.col("seq").alias("s"))
    return leaves.select("parent", asked_id(), F.col("seq").alias("s"), F.lit(tolerance).alias("most")), members


def latencies(reads: DataFrame, index: SequenceIndex, config: QueryConfig = QueryConfig()) -> DataFrame:
    """``(ordinal, routing_ns, leaf_ns, latency_ns)`` of every read, both strands together.  All reads
    are routed at once, so routing is a read's share of that; its leaves are searched read by
    read and timed in the tasks that do so."""
    t = config.within(index.max_tolerance)
    started = time.monotonic()
    leaves = routed_leaves(reads, index, config.both_strands, config.route)[-1]
    spent = (time.monotonic() - started) * 1e9
    times = kept(row_times(*leaf_sides(leaves, index, t)), work_folder(reads.sparkSession), "row_times")  # measured once
    each = times.groupBy(F.floor(F.col("id") / 2).alias("ordinal")).agg(F.sum("ns").alias("leaf_ns"))
    many = reads.agg(F.count("*").alias("n")).first().n
    share = F.lit(spent / max(many, 1))
    found = reads.select("ordinal").join(each, "ordinal", "left").withColumns({"routing_ns": share, "leaf_ns": F.coalesce("leaf_ns", F.lit(0))})
    return found.select("ordinal", "routing_ns", "leaf_ns", (F.col("routing_ns") + F.col("leaf_ns")).alias("latency_ns"))


def verify(reads: DataFrame, index: SequenceIndex, windows: DataFrame, config: QueryConfig = QueryConfig(), limit: int = 100) -> DataFrame:
    """Routed hits of the first ``limit`` reads against all windows within the tolerance.  One row: expected and
    observed hits, false negatives and positives; a hit of another distance, or of a window whose text is
    another in the index, counts on both sides.

    Both sides are pairs of a read and a text.  Copies are counted: those of a text among the windows, in
    a leaf world, and in both."""
    some = reads.orderBy("ordinal").limit(limit) if limit else reads
    folder = work_folder(reads.sparkSession)
    asked = strands(some, config.both_strands)
    texts = kept(windows.groupBy(F.col("seq").alias("s")).agg(F.count("*").alias("expected")), folder, "texts")
    near = near_texts(asked.select("seq").distinct(), texts.select("s"), index.window, config.within(index.max_tolerance))
    near = asked.select("ordinal", "reverse", "seq").join(near, "seq").drop("seq")
    expected = near.join(texts, "s").withColumn("distance", F.col("distance").cast("int"))
    seen = routed_texts(some, index, config)
    reached = seen.select("parent", "s").distinct()
    members = index.members.select(F.col("leaf_id").alias("parent"), F.col("seq").alias("s"), "sequence_id").join(reached, ["parent", "s"])
    same = windows.select(F.col("seq").alias("s"), "sequence_id", F.lit(1).alias("same"))
    sizes = members.join(same, ["s", "sequence_id"], "left").groupBy("parent", "s").agg(F.count("*").alias("observed"), F.count("same").alias("both"))
    observed = seen.join(sizes, ["parent", "s"]).select("ordinal", "reverse", "s", F.col("distance").cast("int").alias("distance"), "observed", "both")
    met = expected.join(observed, ["ordinal", "reverse", "s", "distance"], "full_outer")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    none = lambda c: F.coalesce(c, F.lit(0))
    both = F.when(F.col("expected").isNotNull(), none("both")).otherwise(0)
    return met.agg(
        total("expected").alias("expected_hits"), total("observed").alias("observed_hits"),
        total(none("expected") - both).alias("false_negatives"), total(none("observed") - both).alias("false_positives"),
    )


def route_counts(asked_at: list[DataFrame], index: SequenceIndex, config: QueryConfig = QueryConfig()) -> DataFrame:
    """``asked_at`` as from ``routed_leaves``.  Per read and strand and layer, without a path cache: children, distances computed and
    children pruned.  The first child and the beacons are always computed; of the rest, in
    order of triangle bound and id, a child is pruned if its bound cannot beat the best."""
    out = None
    for layer, asked in enumerate(asked_at[:3]):
        nodes = index.nodes.where(F.col("layer") == layer)
        children = nodes.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("node_id").alias("id"), "child_ordinal", F.col("center_seq").alias("s"))
        near = all_distances(asked.select("parent", asked_id(), F.col("seq").alias("s")), children).withColumnRenamed("other", "node_id")
        near = near.join(children.select("parent", F.col("id").alias("node_id"), "child_ordinal"), ["parent", "node_id"])
        near = near.select("parent", F.floor(F.col("id") / 2).alias("ordinal"), (F.col("id") % 2 == 1).alias("reverse"), "node_id", "child_ordinal", "d")
        beacons = index.beacons.withColumnRenamed("parent_id", "parent")
        near = near.join(beacons, ["parent", "child_ordinal"], "left").select("ordinal", "reverse", "parent", "child_ordinal", "node_id", "d", "beacon_index")
        first = F.col("beacon_index").isNotNull() | (F.col("child_ordinal") == 0)
        key = ["ordinal", "reverse", "parent"]
        to_beacon = near.where(F.col("beacon_index").isNotNull()).select(*key, "beacon_index", F.col("d").alias("to_beacon"))
        table = index.beacon_distances.withColumnRenamed("parent_id", "parent")
        bound = near.where(~first).select(*key, "child_ordinal").join(to_beacon, key).join(table, ["parent", "child_ordinal", "beacon_index"])
        bound = bound.groupBy(*key, "child_ordinal").agg(triangle_bound(F.col("to_beacon"), F.col("distance")).alias("lower"))
        placed = near.join(bound, [*key, "child_ordinal"], "left").withColumn("lower", F.when(first, -1).otherwise(F.coalesce("lower", F.lit(0))))
        before = W.partitionBy(*key).orderBy("lower", "node_id").rowsBetween(W.unboundedPreceding, -1)
        start = F.min(F.when(first, F.struct("d", "node_id"))).over(W.partitionBy(*key))
        best = F.least(F.coalesce(F.min(F.struct("d", "node_id")).over(before), start), start)
        placed = placed.withColumn("best", best)
        cut = ~first & ((F.col("lower") > F.col("best.d")) | ((F.col("lower") == F.col("best.d")) & (F.col("node_id") >= F.col("best.node_id"))))
        if config.route == "scan":
            cut = F.lit(False)
        counts = placed.withColumn("cut", cut).groupBy("ordinal", "reverse").agg(F.count("*").alias("children"), F.count_if("cut").alias("pruned"))
        counts = counts.select("ordinal", "reverse", F.lit(layer).alias("layer"), "children", (F.col("children") - F.col("pruned")).alias("edits"), "pruned")
        out = counts if out is None else out.unionByName(counts)
    return out


def query_stats(reads: DataFrame, index: SequenceIndex, config: QueryConfig = QueryConfig()) -> DataFrame:
    """One row: totals over all reads and strands, cache off."""
    asked_at = routed_leaves(reads, index, config.both_strands, config.route)
    counts = route_counts(asked_at, index, config)
    sizes = index.nodes.select(F.col("node_id").alias("parent"), "member_count")
    leaves = asked_at[-1].join(sizes, "parent")
    per_layer = [F.sum(F.when(F.col("layer") == k, F.col(c))).alias(f"{c}_{k}") for c in ("edits", "pruned") for k in range(3)]
    route = counts.agg(*per_layer, F.sum("edits").alias("routing_edit_calls"))
    leaf = leaves.agg(F.sum("member_count").alias("leaf_members"), F.sum("member_count").alias("exact_verifications"))
    both = route.join(leaf)
    return both.withColumn("total_edit_calls", F.col("routing_edit_calls") + F.col("exact_verifications"))
