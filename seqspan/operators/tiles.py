"""Comparing all of two tables within a parent, in tiles.

The rows of a parent are cut into chunks on both sides; a tile is two chunks, compared inside
one task by a batched kernel.  So no pair of texts is ever a row: only what a tile finds
leaves it.  Chunks are dealt by hash; a parent of any size (the root holds everything)
spreads over as many tasks as it has tiles, and a task holds one tile.

``many(parent, id, s[, most][, bounds])`` and ``few(parent, id, s[, bounds])``: ids are unique
within a parent, ``most`` is a row's own limit (null: none), ``bounds`` are distances to the
same beacons on both sides: a pair whose triangle bound is beyond the row's limit is not
compared.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspan.functions.kernel import FAR, letters, pairs_of, tile_distances
from seqspan.operators.tables import partitions_of

SIDE = 8192  # rows of a chunk of ``many``: enough to keep numpy calls few
LEAST, MOST = 1 << 15, 1 << 22  # pairs of a tile
_SMALL = 1 << 14  # pairs of a tile that waits for others
_COLUMNS = ("parent", "salt", "block", "kind", "id", "s", "most", "bounds")


def _dealt(many: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of both sides, once for each tile they are in."""
    parts = partitions_of(many.sparkSession)
    both = many.select("parent", F.lit(1).alias("n"), F.lit(0).alias("m")).union(few.select("parent", F.lit(0), F.lit(1)))
    sizes = both.groupBy("parent").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0 and m > 0")
    pairs = F.col("n") * F.col("m")
    area = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), pairs / (4 * parts)))
    wide = F.greatest(F.lit(8), F.floor(area / F.least("n", F.lit(SIDE))))
    sizes = sizes.select("parent", F.ceil(F.col("n") / SIDE).cast("int").alias("salts"), F.ceil(F.col("m") / wide).cast("int").alias("blocks"))
    own = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def side(df: DataFrame, kind: int, salt: Column, block: Column) -> DataFrame:
        most = F.least(F.col("most"), F.lit(int(FAR))).cast("int") if "most" in df.columns else F.lit(None).cast("int")
        bounds = F.col("bounds").cast("array<int>") if "bounds" in df.columns else F.lit(None).cast("array<int>")
        placed = df.select("parent", "id", "s", most.alias("most"), bounds.alias("bounds")).join(sizes, "parent")
        return placed.withColumns({"salt": salt}).withColumns({"block": block, "kind": F.lit(kind)}).select(*_COLUMNS)

    both = side(few, 0, every("salts"), own("blocks")).unionByName(side(many, 1, own("salts"), every("blocks")))
    return both.repartition(2 * parts, "parent", "salt", "block").sortWithinPartitions("parent", "salt", "block", "kind")


def _bounds(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; no columns where they are null."""
    return np.zeros((len(column), 0), np.int16) if column.null_count else column.flatten().to_numpy().reshape(len(column), -1).astype(np.int16)


def _allowed(many: pa.RecordBatch, few: pa.RecordBatch, limit: np.ndarray | None) -> np.ndarray | None:
    """Which pairs the triangle bounds leave (None: all); distances of texts above 32,767
    letters do not fit and leave all."""
    x, y = _bounds(many.column("bounds")), _bounds(few.column("bounds"))
    if limit is None or not x.shape[1] or not y.shape[1]:
        return None
    out = np.ones((len(x), len(y)), bool)
    most = limit.astype(np.int16)[:, None]
    step = max(1, (1 << 16) // len(y))  # rows whose numbers stay in the cache
    for i in range(0, len(x), step):
        worst = np.zeros((min(step, len(x) - i), len(y)), np.int16)
        for k in range(x.shape[1]):
            apart = x[i : i + step, k, None] - y[None, :, k]
            np.maximum(worst, np.abs(apart, out=apart), out=worst)
        out[i : i + step] = worst <= most[i : i + step]
    return out


Tile = tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray | None, np.ndarray | None]  # many, few, limits, allowed pairs


def _tile(few: list[pa.RecordBatch], many: list[pa.RecordBatch]) -> Tile:
    a, b = (pa.Table.from_batches(x).combine_chunks().to_batches()[0] if len(x) > 1 else x[0] for x in (many, few))
    most = a.column("most")
    limit = None if most.null_count == len(most) else most.fill_null(int(FAR)).to_numpy()
    small = limit is not None and limit.max(initial=0) < 1 << 15
    return a, b, limit, _allowed(a, b, limit) if small else None


def _small_tiles(tiles: list[Tile]) -> Iterator[np.ndarray]:
    """Distances of many small tiles, all their pairs side by side."""
    xs, ys, limits, shapes, n, m = [], [], [], [], 0, 0
    for a, b, limit, allowed in tiles:
        x, y = np.nonzero(np.ones((a.num_rows, b.num_rows), bool) if allowed is None else allowed)
        shapes.append((a.num_rows, b.num_rows, x, y))
        limits.append(np.full(len(x), FAR, np.int32) if limit is None else limit[x])
        xs.append(x + n)
        ys.append(y + m)
        n, m = n + a.num_rows, m + b.num_rows
    left, right = (letters(pa.concat_arrays([t[k].column("s") for t in tiles])) for k in (0, 1))
    found, at = pairs_of(left, right, np.concatenate(xs), np.concatenate(ys), np.concatenate(limits)), 0
    for rows, columns, x, y in shapes:
        d = np.full((rows, columns), FAR, np.int32)
        d[x, y] = found[at : at + len(x)]
        at += len(x)
        yield d


def _run(slack: int | None, found: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], pa.RecordBatch]):
    def done(tile: Tile, d: np.ndarray) -> pa.RecordBatch:
        a, b, _, allowed = tile
        return found(a.column("parent")[0].as_py(), a.column("id").to_numpy(), b.column("id").to_numpy(), d, allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, few, many, waiting, pairs = None, [], [], [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            """A large tile is compared at once, small ones wait for each other."""
            nonlocal pairs
            if few and many:
                tile = _tile(few, many)
                size = tile[0].num_rows * tile[1].num_rows
                if size > _SMALL:
                    a, b, limit, allowed = tile
                    yield done(tile, tile_distances(letters(a.column("s")), letters(b.column("s")), limit, slack, allowed))
                else:
                    waiting.append(tile)
                    pairs += size

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            if waiting:
                out = [done(tile, d) for tile, d in zip(waiting, _small_tiles(waiting), strict=True)]
                waiting.clear()
                pairs = 0
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]])) if len(keys) else []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if tuple(keys[i, :3]) != now:
                    yield from ended()
                    if pairs > 2 * _SMALL:
                        yield from flushed()
                    now, few, many = tuple(keys[i, :3]), [], []
                (many if keys[i, 3] else few).append(batch.slice(i, j - i))
        yield from ended()
        yield from flushed()

    return run


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def pairs_within(many: DataFrame, few: DataFrame, before: bool = False) -> DataFrame:
    """``(parent, id, other, d)``: pairs within the limit of ``many``'s row; with ``before`` only
    those whose other id is smaller."""

    def found(parent, ids, others, d, allowed):
        near = d < FAR
        if before:
            near &= others[None, :] < ids[:, None]
        x, y = np.nonzero(near)
        return _rows(["parent", "id", "other", "d"], np.full(len(x), parent, np.int64), ids[x], others[y], d[x, y])

    return _dealt(many, few).mapInArrow(_run(None, found), "parent long, id long, other long, d int")


def least_within(many: DataFrame, few: DataFrame) -> DataFrame:
    """``(parent, id, other)``: the smallest id of ``few`` within the limit; no row if none is."""

    def found(parent, ids, others, d, allowed):
        least = np.where(d < FAR, others[None, :], np.iinfo(np.int64).max).min(1)
        some = np.flatnonzero((d < FAR).any(1))
        return _rows(["parent", "id", "other"], np.full(len(some), parent, np.int64), ids[some], least[some])

    tiles = _dealt(many, few).mapInArrow(_run(None, found), "parent long, id long, other long")
    return tiles.groupBy("parent", "id").agg(F.min("other").alias("other"))


def nearest_within(many: DataFrame, few: DataFrame, slack: int = 0) -> DataFrame:
    """``(parent, id, least, near, calls)``: each row's least distance, its near ``(d, other)`` at
    most ``slack`` beyond that, in order, and how many pairs the triangle bounds left.  A row
    with none within its limit has a null ``least`` and an empty list."""

    slack = min(slack, int(FAR) // 2)  # no two distances are further apart

    def found(parent, ids, others, d, allowed):
        least = d.min(1)
        near = (d < FAR) & (d <= least[:, None] + slack)
        x, y = np.nonzero(near)
        edge = pa.array(np.concatenate([[0], np.cumsum(near.sum(1))]), pa.int32())
        items = pa.StructArray.from_arrays([pa.array(d[x, y]), pa.array(others[y])], names=["d", "other"])
        calls = np.full(len(ids), len(others), np.int64) if allowed is None else allowed.sum(1)
        return _rows(["parent", "id", "least", "near", "calls"], np.full(len(ids), parent, np.int64), ids, pa.array(least, mask=least >= FAR), pa.ListArray.from_arrays(edge, items), calls)

    tiles = _dealt(many, few).mapInArrow(_run(slack, found), "parent long, id long, least int, near array<struct<d: int, other: long>>, calls long")
    whole = tiles.groupBy("parent", "id").agg(F.min("least").alias("least"), F.flatten(F.collect_list("near")).alias("near"), F.sum("calls").alias("calls"))
    inside = F.filter("near", lambda x: x["d"] <= F.col("least") + slack)
    return whole.select("parent", "id", "least", F.array_sort(F.coalesce(inside, F.array().cast("array<struct<d: int, other: long>>"))).alias("near"), "calls")


def all_distances(many: DataFrame, few: DataFrame) -> DataFrame:
    """``(parent, id, other, d)`` of every pair."""
    return pairs_within(many.drop("most", "bounds"), few.drop("bounds"))


def row_times(many: DataFrame, few: DataFrame) -> DataFrame:
    """``(parent, id, ns)``: how long each row of ``many`` (with ``most``) takes by itself against all of
    ``few``, measured in the tasks and summed over its tiles.  A tile is a group of bounded size."""

    def timed(tile: pa.Table) -> pa.Table:
        kind = tile["kind"].to_numpy()
        rows, others = (tile.filter(pa.array(kind == k)).combine_chunks() for k in (1, 0))
        spent = []
        if len(rows) and len(others):
            right, limit = letters(others["s"].combine_chunks()), rows["most"].to_numpy()
            texts = rows["s"].combine_chunks()
            for k in range(len(rows)):
                started = time.perf_counter_ns()
                tile_distances(letters(texts.slice(k, 1)), right, limit[k : k + 1])
                spent.append(time.perf_counter_ns() - started)
        return pa.table({"parent": rows["parent"][: len(spent)], "id": rows["id"][: len(spent)], "ns": pa.array(spent, pa.int64())})

    tiles = _dealt(many, few).groupBy("parent", "salt", "block").applyInArrow(timed, "parent long, id long, ns long")
    return tiles.groupBy("parent", "id").agg(F.sum("ns").alias("ns"))
