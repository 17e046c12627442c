"""Greedy centers: by ascending id, a member becomes a center iff no earlier center of its
parent lies within the radius.

Equal to the greedy maximal independent set of the graph of near members, it is found a prefix
at a time (after Blelloch, Fineman and Shun, "Greedy sequential maximal independent set and
matching are parallel on average", 2012).  A round takes a head of every parent, the undecided
members up to some id; its near pairs are found in tiles, and a pass over them in order of id
settles the head.  Then all other undecided members near a new center are dropped, in tiles
too.  What a round leaves lies beyond every center found so far, so no round looks back, and
heads double: rounds grow with the logarithm of the centers.  A head only stops doubling
while its near pairs are more than ``pairs``.  Equal sequences are settled together, which
does not change the centers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspan.operators.scan import ranks
from seqspan.operators.tables import kept
from seqspan.operators.tiles import least_within, pairs_within

SAMPLE = 1 << 16  # ids of a parent from which its head is cut


def head_of(left: DataFrame, head: int) -> DataFrame:
    """About the first ``head`` members of every parent, up to an id: exactly these up to
    ``SAMPLE`` members, else a share of them estimated on as many."""
    sizes = left.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > head)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(float(SAMPLE) * (1 << 40)) / F.col("n")
    some = left.join(sizes, "parent").where((F.col("n") <= SAMPLE) | share)
    ids = some.groupBy("parent").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("n").alias("n"))  # about SAMPLE ids
    place = F.greatest(F.ceil(F.lit(float(head)) * F.size("ids") / F.col("n")), F.lit(1)).cast("int")
    cuts = ids.select("parent", F.element_at("ids", F.least(place, F.size("ids"))).alias("cut"))
    return left.join(cuts, "parent", "left").where(F.col("cut").isNull() | (F.col("id") <= F.col("cut"))).drop("cut")


def _not_centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (parent, id, other), other < id, sorted by parent and id -> members that a
    center of their parent is near."""
    parent, member, near = None, None, False
    out: set[int] = set()
    for batch in batches:
        found = []
        for p, i, other in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if p != parent:
                parent, member, out = p, None, set()
            if i != member:
                member, near = i, False
            if not near and other not in out:  # all smaller ids are settled
                near = True
                out.add(i)
                found.append((p, i))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["parent", "id"])


def settled(first: DataFrame, radius: int, folder: str | None, name: str) -> tuple[DataFrame, DataFrame]:
    """The rule over a stored head ``first(parent, id, s)`` -> its centers, and its near pairs,
    stored where a folder is given."""
    near = pairs_within(first.withColumn("most", F.lit(radius)), first, before=True).select("parent", "id", "other")
    near = kept(near, folder, f"{name}_near") if folder else near
    in_order = near.repartition("parent").sortWithinPartitions("parent", "id", "other")
    return first.join(in_order.mapInArrow(_not_centers, "parent long, id long"), ["parent", "id"], "left_anti"), near


def choose_centers(members: DataFrame, radius: int, folder: str, name: str, head: int = 2048, pairs: int = 1 << 22) -> DataFrame:
    """``members(parent, id, s)`` -> ``(parent, child_ordinal, center_id, center_s, place)``, the
    place (from 0) among the centers of all parents in order of parent and ordinal."""
    left = kept(members.groupBy("parent", "s").agg(F.min("id").alias("id")).select("parent", "id", "s"), folder, f"{name}_distinct")
    rounds = []
    while most := left.groupBy("parent").count().agg(F.max("count")).first()[0]:
        k = len(rounds)
        first = left if most <= head else kept(head_of(left, head), folder, f"{name}_first{k}")
        new, near = settled(first, radius, None if most <= head else folder, f"{name}{k}")
        rounds.append(kept(new, folder, f"{name}_new{k}"))
        if most <= head:
            break
        rest = kept(left.join(first.select("parent", "id"), ["parent", "id"], "left_anti"), folder, f"{name}_rest{k}")
        gone = least_within(rest.withColumn("most", F.lit(radius)), rounds[-1])
        left = kept(rest.join(gone.select("parent", "id"), ["parent", "id"], "left_anti"), folder, f"{name}_left{k}")
        if 2 * near.count() <= pairs:
            head *= 2
    centers = left if not rounds else rounds[0]
    for new in rounds[1:]:
        centers = centers.unionByName(new)
    return kept(ranked(centers, folder, name), folder, f"{name}_centers")


def ranked(centers: DataFrame, folder: str, name: str) -> DataFrame:
    placed = ranks(centers, "parent", "id", f"{name}_ordinal", folder, f"{name}_place")
    ordinal, place = F.col(f"{name}_ordinal").alias("child_ordinal"), F.col(f"{name}_place").alias("place")
    return placed.select("parent", ordinal, F.col("id").alias("center_id"), F.col("s").alias("center_s"), place)


def copies(members: DataFrame) -> Column:
    """Members that a row stands for: ``n``, or one."""
    return F.col("n") if "n" in members.columns else F.lit(1)


def center_edit_calls(members: DataFrame, centers: DataFrame, radius: int) -> DataFrame:
    """``(parent, calls)``: distances the sequential rule computes.  The k-th center is tried
    against k centers, another member against those up to the first within the radius."""
    own = centers.select("parent", F.col("center_id").alias("id"), F.lit(True).alias("own"))
    texts = members.join(own, ["parent", "id"], "left").groupBy("parent", "s").agg((F.sum(copies(members)) - F.count("own")).alias("n"), F.min("id").alias("id"))
    texts = texts.where("n > 0").withColumn("most", F.lit(radius))
    near = least_within(texts, centers.select("parent", F.col("child_ordinal").alias("id"), F.col("center_s").alias("s")))
    calls = near.join(texts.select("parent", "id", "n"), ["parent", "id"]).select("parent", ((F.col("other") + 1) * F.col("n")).alias("calls"))
    every = calls.unionByName(centers.select("parent", F.col("child_ordinal").alias("calls")))
    return every.groupBy("parent").agg(F.sum("calls").alias("calls"))
