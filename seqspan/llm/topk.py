"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merge.

Components become whole numbers, floor(``scale`` * x).  Rows are dealt evenly over shards of
about ``shard_rows`` by a hash of their row number, so copies do not gather in one; a task
holds one shard, sorted by id, and blocks of queries stream past it.  Every block and every
``tile`` rows of the shard make one matrix product, of which each query's k best are selected
at once: score and place in the shard are packed into one number, so ties go to the smaller
id.  Lists of different shards are merged as a tree: ``fan`` lists of a query at a time, level
by level, until one is left.

Products run in double precision where every sum stays below 2**53 (then they are exact), else
in 64-bit integers; sums are taken to fit a long.  Queries times shards travel, each as
small integers: the query set is stated, the work is queries times rows by nature.

Nulls: vectors that are null or hold null or non-finite components take no part; zero vectors
do.  A null id is no query but a candidate (last among ties).  Vectors of other lengths than the
query's are no candidates.  A repeated row is a candidate of its copies, not of itself.  Empty
table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.llm.common import give_back, stored, work_dir

_BIG = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min
_EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(each, F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of longs."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def best_of(packed: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, unordered (all, if fewer)."""
    return packed if packed.shape[1] <= k else np.partition(packed, packed.shape[1] - k, axis=1)[:, -k:]


class Shard:
    """Rows of one shard in order of id (nulls last)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, rids: np.ndarray, tile: int):
        order = np.lexsort((rids, ids))
        self.rows, self.ids, self.rids, self.tile = rows[order], ids[order], rids[order], tile
        self.by_rid = np.argsort(self.rids)
        self.most = float(np.abs(self.rows.astype(np.float64)).max(initial=0))

    def places_of(self, rids: np.ndarray) -> np.ndarray:
        """Place of each row number in the shard, -1 where it is not here."""
        at = np.searchsorted(self.rids, rids, sorter=self.by_rid)
        at = self.by_rid[np.minimum(at, len(self.rids) - 1)]
        return np.where(self.rids[at] == rids, at, -1)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and scores of each query's k best."""
        n, reach = len(self.rows), max(1, queries.shape[1]) * self.most * float(np.abs(queries.astype(np.float64)).max(initial=0))
        as_float = reach * 2 < _EXACT
        packs = (reach + 1) * (n + 1) * 2 < float(1 << 62)
        left = queries.astype(np.float64) if as_float else queries
        mine = self.places_of(own)
        best = np.zeros((len(queries), 0), np.int64 if packs else object)
        for a in range(0, n, self.tile):
            some = self.rows[a : a + self.tile]
            scores = left @ (some.astype(np.float64) if as_float else some).T
            at = n - 1 - np.arange(a, a + len(some))  # among equal scores the first row counts most
            packed = scores.astype(np.int64) * n + at if packs else scores.astype(np.int64).astype(object) * n + at
            here = np.flatnonzero((mine >= a) & (mine < a + len(some)))
            packed[here, mine[here] - a] = _NONE if packs else -(1 << 140)
            best = best_of(np.concatenate([best, best_of(packed, k)], axis=1), k)
        absent = best <= (_NONE if packs else -(1 << 139))
        best = np.where(absent, 0, best)
        return np.where(absent, -1, n - 1 - best % n).astype(np.int64), (best // n).astype(np.int64)


def _tiles(k: int, block: int, tile: int):
    """Rows (dim, shard, kind, rid, id, x) sorted by these: a shard's rows (kind 0), then the
    queries -> (q, query_id, shard, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]])) if len(keys) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part, key = batch.slice(a, b - a), tuple(keys[a, :2])
                if key != now:
                    now, held, shard = key, [], None
                    give_back()
                x, ids, rids = vectors_of(part.column("x")), part.column("id").fill_null(_BIG).to_numpy(), part.column("rid").to_numpy()
                if keys[a, 2] == 0:
                    held.append((x, ids, rids))
                    continue
                if shard is None:
                    if not held:  # a shard may be empty
                        continue
                    shard, held = Shard(*(np.concatenate(y) for y in zip(*held, strict=True)), tile), []
                for i in range(0, len(x), block):
                    at, score = shard.top(x[i : i + block], rids[i : i + block], k)
                    some = at >= 0
                    row = np.nonzero(some)[0] + i
                    vec = shard.ids[at[some]]
                    cols = [pa.array(rids[row]), pa.array(ids[row]), pa.array(np.full(len(row), key[1], np.int64)), pa.array(vec, mask=vec == _BIG), pa.array(score[some])]
                    yield pa.RecordBatch.from_arrays(cols, names=["q", "query_id", "shard", "vec_id", "score"])

    return run


def merged(lists: DataFrame, k: int, shards: int, fan: int) -> DataFrame:
    """``lists(q, query_id, shard, vec_id, score)``, at most k rows of a query and shard -> ``(q,
    query_id, top)``: the k best of each query, ``fan`` lists merged into one at each level."""
    ranked = F.struct((-F.col("score")).alias("least"), F.col("vec_id").isNull().alias("no_id"), "vec_id")
    lists = lists.groupBy("q", "query_id", F.floor(F.col("shard") / fan).alias("node")).agg(F.collect_list(ranked).alias("top"))
    best = lambda x: F.slice(F.array_sort(x), 1, k)
    lists, nodes = lists.withColumn("top", best(F.col("top"))), -(-shards // fan)
    while nodes > 1:
        lists = lists.groupBy("q", "query_id", F.floor(F.col("node") / fan).alias("node")).agg(best(F.flatten(F.collect_list("top"))).alias("top"))
        nodes = -(-nodes // fan)
    return lists.select("q", "query_id", "top")


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = 5, scale: int = 256,
    shard_rows: int = 1 << 16, block: int = 256, tile: int = 4096, fan: int = 16,
) -> DataFrame:
    """``query`` marks the rows that ask (by default ids divisible by 50); every other usable row
    answers.  Returns query_id, rank, vec_id, score of the k largest inner products."""
    if k < 1 or fan < 2 or min(shard_rows, block, tile) < 1:
        raise ValueError("k, shard_rows, block and tile must be positive, fan at least 2")
    folder = work_dir(vectors.sparkSession)
    id_, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").cast("array<double>")
    asks = (id_ % 50 == 0) if query is None else query
    rows = vectors.where(finite(vector)).select(
        F.monotonically_increasing_id().alias("rid"), id_.cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x * scale)).alias("x"),
        (F.coalesce(asks, F.lit(False)) & id_.isNotNull()).alias("asks"), F.size(vector).alias("dim"),
    )
    rows = stored(rows, folder, "rows")
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sizes = stored(sizes, folder, "sizes")
    most, total = sizes.agg(F.coalesce(F.max("shards"), F.lit(1)), F.coalesce(F.sum("shards"), F.lit(1))).first()
    sized = rows.join(F.broadcast(sizes) if sizes.count() <= 1 << 12 else sizes, "dim")
    data = sized.select("dim", F.pmod(F.xxhash64("rid"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "rid", "id", "x")
    asked = sized.where("asks").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "rid", "id", "x")
    both = data.unionByName(asked).repartition(max(1, min(1 << 15, int(total))), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    lists = both.mapInArrow(_tiles(k, block, tile), "q long, query_id long, shard long, vec_id long, score long")
    top = merged(lists, k, int(most), fan).select("query_id", F.posexplode("top").alias("at", "x"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.least")).alias("score"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_SQL = """WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.rid AS q, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY q ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
