"""Prefix sums over a whole table, without a task that sees all of it.

Rows are dealt by ranges of their order; each range is summed up where it lies, the sums of
the ranges, one number a partition, are added up on the driver, and every row adds the sum of
the ranges before to that of the rows before it in its own range."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspan.operators.tables import kept


def prefix_sums_of(rows: DataFrame, order: list[str], values: dict[str, str | None], folder: str) -> DataFrame:
    """``rows`` and a long column for each name in ``values``: the sum of its value (None: the
    count) over all rows before in ``order``, which must tell rows apart.  ``rows`` are read
    twice: give a stored table, and a slim one."""
    names = list(values)
    sizes = {f"_size_{n}": (F.lit(1) if v is None else F.col(v)).cast("long") for n, v in values.items()}
    dealt = rows.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **sizes})
    dealt = kept(dealt, folder, f"{names[0]}_ranges")
    totals = sorted(dealt.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sizes]).collect())  # one row a partition
    starts = zip(*[accumulate((r[s] or 0 for r in totals), initial=0) for s in sizes], strict=True)
    table = [(r["_part"], *start) for r, start in zip(totals, starts, strict=False)]
    table = rows.sparkSession.createDataFrame(table, "_part int, " + ", ".join(f"_start_{n} long" for n in names))
    before = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumns({f"_before_{n}": F.coalesce(F.sum(f"_size_{n}").over(before), F.lit(0)) for n in names}).join(F.broadcast(table), "_part")
    placed = placed.withColumns({n: (F.col(f"_start_{n}") + F.col(f"_before_{n}")).cast("long") for n in names})
    return placed.drop("_part", *[f"_{kind}_{n}" for kind in ("size", "before", "start") for n in names])


def prefix_sums(rows: DataFrame, order: list[str], value: str | None, name: str, folder: str) -> DataFrame:
    """One of ``prefix_sums_of``."""
    return prefix_sums_of(rows, order, {name: value}, folder)


def ranks(rows: DataFrame, group: str, order: str, name: str, folder: str, overall: str | None = None) -> DataFrame:
    """``rows`` and ``name``: their place (from 0) among those of their ``group``; with
    ``overall`` also that among all rows, in order of group and place."""
    at = overall or f"{name}_at"
    placed = prefix_sums(rows, [group, order], None, at, folder)
    first = placed.groupBy(group).agg(F.min(at).alias("_first"))
    return placed.join(first, group).withColumn(name, F.col(at) - F.col("_first")).drop("_first", *([] if overall else [at]))


BLOCK = 16  # bits of ids that are ordered by one task


def places(rows: DataFrame, group: str, by: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` and ``name``: their place (from 0) in their ``group`` in order of ``by``, a long, and
    ``order``, which tell rows apart.  A group is ordered by blocks of ``by``, each of which adds
    the rows in the blocks before it, so no task orders a whole group.  ``rows`` are read twice."""
    cut = rows.withColumn("_block", F.shiftright(by, BLOCK))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = cut.groupBy(group, "_block").agg(F.count("*").alias("_n")).select(group, "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(group, "_block").orderBy(by, *order)) - 1
    placed = cut.withColumn(name, own).join(starts, [group, "_block"])
    return placed.withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_block", "_start")
