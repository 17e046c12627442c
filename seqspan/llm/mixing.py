"""Mixing sources to target weights by hash thresholds.

Tokens are summed by source and hash bucket; a source's budget falls into one bucket, only
that bucket is summed again by the next bits of the hash, and the last level compares single
hash values.  Documents at or below the threshold are taken: nothing is sorted or collected.

Each source gets ``floor(target / size)`` whole passes and the rest by threshold, so no
document is taken more than ``max_passes`` times and a source misses its target by at most
half of one document (rows with equal id and source move together).

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id
hashes as the empty text.  Size-0 documents and sources take 0.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspan.llm.common import columns_of, spare, stored, work_dir

WORD = r"[^\x20\x09-\x0D]+"
_LEVEL = 12  # bits of one bucket level, of 60 hash bits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of an id's text (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3) -> DataFrame:
    """``sizes(source, size)`` -> one row per source: source_size, target.

    Weights go round over the sources in code-point order, null last.  Water level: in order
    of cap / weight the first source whose share of what is left fits under its cap sets the
    level of all after it; those before it stop at their caps."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, cap = W.partitionBy(F.lit(1)), F.col("source_size") * max_passes
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long")
    ordered = by_source.withColumn("weight", weight).withColumn("cap", cap)
    rising = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    levelled = ordered.select("*", F.row_number().over(rising).alias("at"), (left / weights_left).alias("level"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first = levelled.withColumn("k", F.min(F.when(fits, F.col("at"))).over(every))
    level = F.max(F.when(F.col("at") == F.col("k"), F.col("level"))).over(every)
    target = F.when(F.col("at") < F.coalesce("k", F.lit(1 << 30)), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return first.select("source", "source_size", target.alias("target"))


def _boundary(parts: DataFrame, by: str) -> DataFrame:
    """parts(source, budget, below, <by>, size) -> per source the first part that reaches the
    budget: source, budget, below (tokens under it), at (its <by>), own (its tokens)."""
    run = W.partitionBy("source").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    reach = parts.withColumn("reach", F.col("below") + F.sum("size").over(run)).where("reach >= budget")
    least = F.min(F.struct(F.col(by).alias("at"), (F.col("reach") - F.col("size")).alias("below"), F.col("size").alias("own")))
    return reach.groupBy("source", "budget").agg(least.alias("x")).select("source", "budget", "x.*")


def thresholds(sizes: DataFrame, folder: str, weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3) -> DataFrame:
    """``sizes(source, size, h)`` -> source, source_size, target, passes, upto: a document is
    taken ``passes`` times, and once more if ``h <= upto``."""
    coarse = sizes.withColumn("b", F.shiftright("h", 60 - _LEVEL)).groupBy("source", "b").agg(F.sum("size").alias("size"))
    coarse = stored(coarse, folder, "histogram")
    passes = F.least(F.lit(max_passes), F.floor(F.col("target") / F.col("source_size"))).cast("long")
    plan = source_targets(coarse, weights, max_passes).withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(0))
    plan = stored(plan.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), folder, "plan")
    open_ = plan.where("budget > 0").select(F.col("source").alias("s"), "budget")
    parts = coarse.join(open_, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("below", F.lit(0).cast("long"))
    edge = _boundary(parts, "b")
    for level in (1, 2):
        edge = stored(edge, folder, f"edge{level}")
        shift = 60 - _LEVEL * level
        inside = sizes.join(
            edge.select(F.col("source").alias("s"), "budget", "below", "at"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("at")),
        )
        finer = F.col("h") if level == 2 else F.shiftright("h", shift - _LEVEL)
        edge = _boundary(inside.groupBy("source", "budget", "below", finer.alias("b")).agg(F.sum("size").alias("size")), "b")
    taken = F.when(F.col("below") + F.col("own") - F.col("budget") < F.col("budget") - F.col("below"), F.col("at")).otherwise(F.col("at") - 1)
    cut = edge.select(F.col("source").alias("s"), taken.alias("upto"))
    joined = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(joined.select("source", "source_size", "target", "passes", F.coalesce("upto", F.lit(-1)).alias("upto")), folder, "cut")


def _marked(rows: DataFrame, cut: DataFrame) -> DataFrame:
    at = cut.withColumnRenamed("source", "_s")
    joined = rows.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    copies = F.col("passes") + (F.col("h") <= F.col("upto")).cast("long")
    return joined.withColumn("taken", F.col("size") * copies)


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken."""
    folder = work_dir(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), unit_hash(F.col(id_col)).alias("h"))
    sizes = stored(slim, folder, "sizes")
    out = _marked(sizes, thresholds(sizes, folder, weights, max_passes))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only."""
    folder = work_dir(docs.sparkSession)
    size, h = word_count(F.col(text_col)), unit_hash(F.col(id_col))
    sizes = stored(docs.select(F.col(source_col).alias("source"), size.alias("size"), h.alias("h")), folder, "sizes")
    at = spare(docs, "at")
    cut = thresholds(sizes, folder, weights, max_passes).select(F.struct("source", "passes", "upto").alias(at))
    joined = docs.join(cut, F.col(source_col).eqNullSafe(F.col(at)["source"]))
    copies = F.when(size > 0, F.col(at)["passes"] + (h <= F.col(at)["upto"]).cast("long")).otherwise(0)
    again = F.explode(F.array_repeat(F.lit(1), copies.cast("int")))
    return joined.select("*", again.alias(spare(joined, "copy"))).select(*columns_of(docs))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: the same thresholds by a sort and running sums
ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             3 * source_size AS cap FROM b),
l AS (SELECT *, row_number() OVER r AS pos,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
k AS (SELECT min(pos) AS k FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size,
             CASE WHEN pos < k.k THEN cap::DOUBLE ELSE (SELECT level FROM l, k WHERE pos = k.k) * weight END AS target
      FROM l, k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS passes FROM t),
g AS (SELECT s.source, s.h, p.target - p.passes * p.source_size AS budget, sum(s.size)::BIGINT AS own
      FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source GROUP BY ALL),
c AS (SELECT *, (sum(own) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING))::BIGINT AS reach FROM g),
e AS (SELECT source, arg_min(CASE WHEN reach - budget < budget - (reach - own) THEN h ELSE h - 1 END, h) AS upto
      FROM c WHERE budget > 0 AND reach >= budget GROUP BY source)
SELECT s.doc_id, s.size, p.source_size, p.target,
       s.size * (p.passes + CASE WHEN s.h <= coalesce(e.upto, -1) THEN 1 ELSE 0 END) AS taken
FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON s.source IS NOT DISTINCT FROM e.source
"""
