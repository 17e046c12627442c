"""Connected components of a link table by alternating large-star and small-star rounds.

Links stay distributed in every round; only two numbers a round reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspan.llm.common import dropped, spread_join, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round over ``edges(u, v)``, u > v.  Every node passes its smallest neighbour on."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = spread_join(near, least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, folder: str, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` long -> ``(node, root)``, root = smallest node of the component.

    Null ends and self links are ignored; a node without links has no row; an empty link
    table gives an empty result.  Raises if it has not converged after ``max_rounds``."""
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = stored(edges, folder, f"{name}_0")

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen, last = digest(edges), f"{name}_0"
    for k in range(1, max_rounds + 1):
        if not seen[0]:
            break
        half = stored(_star(edges, False), folder, f"{name}_{k}l")
        edges = stored(_star(half, True), folder, f"{name}_{k}")
        dropped(half, folder, f"{name}_{k}l")
        dropped(half, folder, last)
        last = f"{name}_{k}"
        now = digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
