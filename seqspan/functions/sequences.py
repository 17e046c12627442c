"""Column functions over sequences: cleaning, strands, distances, bounds, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(raw: Column) -> Column:
    """Whitespace dropped, upper-cased; every other byte is a literal base."""
    return F.upper(F.regexp_replace(raw, "[ \\t\\n\\x0B\\f\\r]", ""))


def reverse_complement(seq: Column) -> Column:
    """A-T and C-G swapped, order reversed; other letters stay as they are."""
    return F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA")


def contig_name(header: Column) -> Column:
    """A contig header up to its first space or tab."""
    return F.regexp_extract(header, "^([^ \t]*)", 1)


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """The edit distance if it is at most ``limit``, else -1; a negative limit is none."""
    return F.levenshtein(a, b) if limit < 0 else F.levenshtein(a, b, limit)


def window_count(length: Column, window: int, stride: int) -> Column:
    return F.when(length >= window, F.floor((length - window) / stride) + 1).otherwise(0).cast("long")


def beacon_count(ratio: float, centers: Column) -> Column:
    """ceil(ratio * centers) in double arithmetic."""
    return F.ceil(F.lit(float(ratio)).cast("double") * centers).cast("long")


def beacon_ordinal(index: Column, centers: Column, beacons: Column) -> Column:
    return F.floor(index * centers / beacons).cast("long")


def triangle_bound(query_to_beacon: Column, center_to_beacon: Column) -> Column:
    """Aggregate over a center's beacons: a lower bound of its distance to the query."""
    return F.max(F.abs(query_to_beacon - center_to_beacon))


def pruning_ratio(pruned: Column, pairs: Column) -> Column:
    return F.when(pairs == 0, F.lit(0.0)).otherwise(pruned / pairs)


def strand(reverse: Column) -> Column:
    return F.when(reverse, "-").otherwise("+")


BUCKETS = 4096


def _order(x: Column) -> Column:
    """Where a value stands beyond all finite ones: -1, 0 (finite), 1, and nan last."""
    far = F.abs(x) == float("inf")
    return F.when(F.isnan(x), 2).when(far & (x > 0), 1).when(far, -1).otherwise(0)


def floor_percentiles(values: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """One row: for each name the value at 0-based place floor(p * (n - 1)) in sorted order.

    Histograms are refined to the place: values between a fraction's two bounds are counted in
    ``BUCKETS`` equal steps, the bucket that holds the place gives the next bounds (its least
    and greatest value), until both are one value.  A round moves counts only, at most
    ``BUCKETS`` a fraction and task; rounds are about the digits that tell values apart."""
    kind = values.schema[column].dataType
    some = values.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), _order(F.col(column).cast("double")).alias("o"))
    groups = {r.o: r for r in some.groupBy("o").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}  # four rows at most
    total = sum(r.n for r in groups.values())
    found, open_ = {}, {}
    for name, p in fractions.items():
        place = int(float(p) * (total - 1)) if total else 0
        for o in sorted(groups):
            if place < groups[o].n:
                low, high = groups[o].low, groups[o].high
                (found if o or low == high else open_)[name] = low if o or low == high else (low, high, place)
                break
            place -= groups[o].n
    exact = isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)
    number = (lambda c: c.cast("double") / 2) if exact else (lambda c: c.cast("decimal(38,6)"))  # halves: no difference overflows
    while open_:
        names = list(open_)
        targets = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(open_[x][0]).cast(kind).alias("low"), F.lit(open_[x][1]).cast(kind).alias("high")) for k, x in enumerate(names)])
        asked = some.where("o = 0").select("x", F.explode(targets).alias("a")).select("x", "a.*").where("x between low and high")
        share = (number(F.col("x")) - number(F.col("low"))).cast("double") / (number(F.col("high")) - number(F.col("low"))).cast("double")
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = asked.groupBy("t", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for k, name in enumerate(names):
            place = open_[name][2]
            for r in sorted((r for r in counts if r.t == k), key=lambda r: r.b):
                if place < r.n:
                    break
                place -= r.n
            open_[name] = (r.low, r.high, place)
            if r.low == r.high:
                found[name] = open_.pop(name)[0]
    fields = T.StructType([T.StructField(name, kind) for name in fractions])
    return values.sparkSession.createDataFrame([tuple(found.get(name) for name in fractions)], fields)
