"""Approximate nearest neighbours: stable projections to a few dimensions under a kd-tree.

Vectors are projected by a Gaussian matrix.  The top of one kd-tree for all rows is fitted on
a bounded sample (``sample_rows`` of the smallest hash); it cuts the rows, all of which are
indexed, into cells of about ``cell_rows``, and a cell that holds more (copies cannot be cut
apart) into shards.  A query first visits the cells nearest to it, then, in one more round,
every other cell that its stopping test leaves open.  Within a shard the tree goes on down to
leaves, which are verified in rising projected distance by true distance.

The ratio of squared projected to squared true distance is chi-square with ``dims`` degrees
of freedom: the search stops once a point nearer than the k-th found would lie beyond the
next leaf or cell with probability 1 - ``stop`` at most.  A task holds one shard; queries
stream past it.

Nulls: vectors that are null, zero, empty, or hold null or non-finite components take no
part; a null id is no query but a candidate (last among ties).  Ids are integers.  Vectors of
other lengths than the query's are no candidates.  A repeated row is a candidate of its
copies, not of itself.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import stored, work_dir

DIMS = 8


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def chi_square_below(x: np.ndarray, dims: int) -> np.ndarray:
    """Cumulative chi-square for an even number of degrees of freedom."""
    half = np.asarray(x) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, dims // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def kd_leaves(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers, lower and upper corner of each leaf; cells are halved at the median of
    their widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        p = points[rows]
        side = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, side], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves, np.stack([points[r].min(0) for r in leaves]), np.stack([points[r].max(0) for r in leaves])


class Shard:
    """Rows of one shard under a kd-tree."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, rids: np.ndarray, dims: int, leaf: int):
        leaves, self.low, self.high = kd_leaves(data @ matrix_of(data.shape[1], dims), leaf)
        flat = np.concatenate(leaves)
        self.edge = np.concatenate([[0], np.cumsum([len(r) for r in leaves])])
        self.rows, self.ids, self.rids, self.dims = data[flat], ids[flat], rids[flat], dims

    def nearest(self, q: np.ndarray, p: np.ndarray, own: int, k: int, stop: float, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances, at most k, nearest first, none beyond ``kth`` (squared)."""
        bound = box_distance(self.low, self.high, p)
        best_d, best_at = np.zeros(0), np.zeros(0, np.int64)
        for x in np.argsort(bound, kind="stable"):
            limit = min(kth, best_d[-1]) if len(best_d) == k else kth
            if chi_square_below(bound[x] / max(limit, 1e-300), self.dims) >= stop:
                break
            a, b = self.edge[x], self.edge[x + 1]
            diff = self.rows[a:b] - q
            d = (diff * diff).sum(1)
            near = (d <= limit) & (self.rids[a:b] != own)
            if near.any():
                d, at = np.concatenate([best_d, d[near]]), np.concatenate([best_at, np.arange(a, b)[near]])
                keep = np.lexsort((self.ids[at], d))[:k]
                best_d, best_at = d[keep], at[keep]
        return best_at, best_d


def matrix_of(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((width, dims))


def box_distance(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    return (gap * gap).sum(1)


class TreeTop:
    """Median cuts of a sample's projections into at most ``cells`` cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # side, cut, child below, child from the cut on (~cell)
        self.cells = 0
        self.root = self._grow(points, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        side = int(np.argmax(points.max(0) - points.min(0))) if len(points) else 0
        cut = float(np.median(points[:, side])) if len(points) else 0.0
        below = points[:, side] < cut if len(points) else np.zeros(0, bool)
        if cells < 2 or not below.any():
            self.cells += 1
            return ~(self.cells - 1)
        at = len(self.nodes)
        self.nodes.append((side, cut, 0, 0))
        left = self._grow(points[below], cells // 2)
        self.nodes[at] = (side, cut, left, self._grow(points[~below], cells - cells // 2))
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            side, cut, left, right = self.nodes[node]
            below = points[rows, side] < cut
            todo += [(left, rows[below]), (right, rows[~below])]
        return out


_BIG = np.iinfo(np.int64).max
_OUT = "q long, query_id long, vec_id long, score double"


def _vectors(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _placed(trees: dict[int, TreeTop], dims: int):
    """Rows (rid, id, v, asks, dim) -> with cell and projection p; all rows of a run share dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("dim").to_numpy()
            for d in np.unique(width).tolist():
                some = batch.filter(pa.array(width == d))
                p = _vectors(some.column("v"), some.num_rows) @ matrix_of(d, dims)
                cell = trees[d].cell_of(p) if d in trees else np.zeros(len(p), np.int32)
                points = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * dims), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell), points], names=[*some.schema.names, "cell", "p"])

    return run


def _visits(boxes: Broadcast, first: int, stop: float, dims: int, again: bool):
    """Queries (q, query_id, v, p, dim, kth) -> (dim, cell, shard, ...) of the cells to visit: the
    ``first`` nearest, or (again) the others that the test leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, cells, shards = batch.to_pydict(), [], [], []
            for k, (d, p, kth) in enumerate(zip(rows["dim"], rows["p"], rows["kth"], strict=True)):
                cell, many, low, high = boxes.value[d]
                bound = box_distance(low, high, np.array(p))
                order = np.argsort(bound, kind="stable")
                order = order[first:] if again else order[:first]
                if again:
                    order = order[chi_square_below(bound[order] / max(kth, 1e-300), dims) < stop]
                for c in order.tolist():
                    at += [k] * int(many[c])
                    cells += [int(cell[c])] * int(many[c])
                    shards += range(int(many[c]))
            for i in range(0, len(at), 4096):
                some = batch.take(pa.array(at[i : i + 4096], pa.int64()))
                cols = [some.column("dim"), pa.array(cells[i : i + 4096], pa.int32()), pa.array(shards[i : i + 4096], pa.int32()), some.column("q"), some.column("query_id"), some.column("v"), some.column("kth")]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "cell", "shard", "rid", "id", "v", "kth"])

    return run


def _search(k: int, stop: float, dims: int, leaf: int):
    """Rows (dim, cell, shard, kind, rid, id, v, kth) sorted by these: a shard's rows (kind 0),
    then the queries that visit it, which stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]])) if len(keys) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part, key = batch.slice(a, b - a), tuple(keys[a, :3])
                if key != now:
                    now, held, shard = key, [], None
                ids, rids = part.column("id").fill_null(_BIG).to_numpy(), part.column("rid").to_numpy()
                v = _vectors(part.column("v"), len(ids))
                if keys[a, 3] == 0:
                    held.append((v, ids, rids))
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), dims, leaf), []
                out = [(np.zeros(0, np.int64), np.zeros(0))]
                for q, p, own, kth in zip(v, v @ matrix_of(v.shape[1], dims), rids, part.column("kth").to_numpy(), strict=True):
                    out.append(shard.nearest(q, p, own, k, stop, kth))
                n = [len(at) for at, _ in out[1:]]
                at, d = (np.concatenate(x) for x in zip(*out, strict=True))
                vec = shard.ids[at]
                cols = [pa.array(np.repeat(rids, n)), pa.array(np.repeat(ids, n)), pa.array(vec, mask=vec == _BIG), pa.array(np.sqrt(d))]
                yield pa.RecordBatch.from_arrays(cols, names=["q", "query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = 10, stop: float = 0.97,
               dims: int = DIMS, leaf: int = 128, cell_rows: int = 8192, max_cells: int = 1 << 14, first_cells: int = 2, sample_rows: int = 1 << 15) -> DataFrame:
    """``query`` marks the rows that ask; every other usable row answers.  Returns query_id,
    rank, vec_id, score (Euclidean distance)."""
    if dims < 2 or dims % 2:
        raise ValueError("dims must be even")
    spark = vectors.sparkSession
    folder = work_dir(spark)
    asks = (F.col(id_col) % 100 == 0) if query is None else query
    rows = vectors.where(usable(F.col(vector_col))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
        (F.coalesce(asks, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks"), F.size(vector_col).alias("dim"),
    )
    rows = stored(rows, folder, "rows")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("rid")).limit(sample_rows).select("dim", "v").toArrow()
    trees, width = {}, sample.column("dim").to_numpy()
    for d in np.unique(width).tolist():
        some = sample.filter(pa.array(width == d))
        cells = min(max_cells, -(-total * some.num_rows // (max(1, len(width)) * cell_rows)))
        trees[d] = TreeTop(_vectors(some.column("v"), some.num_rows) @ matrix_of(d, dims), cells)
    placed_type = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    placed = stored(rows.mapInArrow(_placed(trees, dims), placed_type), folder, "placed")
    corners = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    cells = stored(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("shards"), *corners), folder, "cells")
    table = cells.orderBy("dim", "cell").toArrow()  # max_cells rows, and one for each length the sample missed
    width, boxes = table.column("dim").to_numpy(), {}
    for d in np.unique(width).tolist():
        some = table.filter(pa.array(width == d))
        low, high = (np.stack([some.column(f"{name}{i}").to_numpy() for i in range(dims)], 1) for name in ("low", "high"))
        boxes[d] = (some.column("cell").to_numpy(), some.column("shards").to_numpy(), low, high)
    sent = spark.sparkContext.broadcast(boxes)
    parts = max(1, min(1 << 14, sum(int(b[1].sum()) for b in boxes.values())))
    data = placed.join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).select(
        "dim", "cell", F.pmod(F.xxhash64("rid"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "rid", "id", "v", F.lit(0.0).alias("kth"))
    order = F.row_number().over(W.partitionBy("q").orderBy("score", F.col("vec_id").asc_nulls_last()))

    def visited(queries: DataFrame, again: bool) -> DataFrame:
        visits = queries.mapInArrow(_visits(sent, first_cells, stop, dims, again), "dim int, cell int, shard int, rid long, id long, v array<double>, kth double")
        both = data.unionByName(visits.withColumn("kind", F.lit(1)))
        keys = ["dim", "cell", "shard"]
        return both.repartition(parts, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(_search(k, stop, dims, leaf), _OUT)

    queries = placed.where("asks").select(F.col("rid").alias("q"), F.col("id").alias("query_id"), "v", "p", "dim")
    near = visited(queries.withColumn("kth", F.lit(float("inf"))), False).withColumn("rank", order).where(F.col("rank") <= k)
    near = stored(near, folder, "near")
    reach = near.groupBy("q").agg(F.when(F.count("*") >= k, F.pow(F.max("score"), 2) * (1 + 1e-12)).alias("reach"))
    later = queries.join(reach, "q", "left").withColumn("kth", F.coalesce("reach", F.lit(float("inf")))).drop("reach")
    found = near.drop("rank").unionByName(visited(later.select("q", "query_id", "v", "p", "dim", "kth"), True))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
