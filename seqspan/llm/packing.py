"""Best-fit packing into bins of several permitted sizes.

Longer texts are cut into pieces of the largest size.  Pieces are dealt evenly to shards;
in a shard they go, longest first, into the open bin with the least room that takes them.
If none does, a bin of the size with the least expected cost per token opens: the cost of the
size that the bin could be cut down to over the tokens that could fill it, given the pieces
still to come.  At the end each bin is cut down to the smallest size that holds its contents.

Nulls: a null text (or length) is empty; texts without words get one row of length 0 and no
bin; a null id is kept as it is; ids are of any type that sorts.  Repeated rows are packed as often as they stand, ties in
length go by id (null first) and piece.  Columns beside id and text (or length) are not
read.  Empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import stored, work_dir
from seqspan.llm.mixing import word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def size_cost(capacity: int, overhead: float = 64.0, quadratic: float = 1 / 65536) -> float:
    """Cost of one sequence: its slots, a fixed overhead, and attention's square term."""
    return capacity + overhead + quadratic * capacity * capacity


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 64.0, quadratic: float = 1 / 65536):
    """Pieces (longest first, all within the largest size) -> bin and offset of each piece,
    and the final size of each bin."""
    caps = list(capacities)
    cost = [size_cost(c, overhead, quadratic) for c in caps]
    todo = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # tokens from piece k on
    down = -lengths
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []  # distinct rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    opened: list[int] = []
    for k, n in enumerate(lengths.tolist()):
        i = bisect_left(room, n)
        if i < len(room):
            r = room[i]
            stack = by_room[r]
            b = stack.pop()
            if not stack:
                del by_room[r], room[i]
        else:
            best, pick = np.inf, 0
            for c in caps:
                if c >= n:
                    # tokens of later pieces that are short enough for what is left
                    first = max(k + 1, int(np.searchsorted(down, -(c - n), "left")))
                    fill = n + min(c - n, int(todo[first]))
                    per_token = cost[bisect_left(caps, fill)] / fill
                    if per_token < best:
                        best, pick = per_token, c
            b, r = len(used), pick
            used.append(0)
            opened.append(pick)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        if r > n:
            left = r - n
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    final = np.array([caps[bisect_left(caps, u)] for u in used], np.int64)
    return bins, offsets, final


def pack_lengths(lengths: DataFrame, *, id_col: str = "doc_id", length_col: str = "length", capacities: tuple[int, ...] = CAPACITIES,
                 overhead: float = 64.0, quadratic: float = 1 / 65536, shard_pieces: int = 16384) -> DataFrame:
    """``(id, length)`` -> id, piece, start, length, bin_id, capacity, offset."""
    caps = tuple(sorted(set(capacities)))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    spark, top = lengths.sparkSession, caps[-1]
    size = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    rows = lengths.select(F.col(id_col).alias("id"), size.alias("n"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top), F.lit(1)) - 1)))
    start = F.col("piece") * top
    pieces = pieces.select("id", "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).alias("length"))
    pieces = stored(pieces, work_dir(spark), "pieces")
    many, least = pieces.agg(F.count("*"), F.min("length")).first()
    if many and least < 0:
        raise ValueError("a length is negative")
    shards = max(1, -(-many // shard_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None  # about shard_pieces rows
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        n = table.column("length").to_numpy()
        some = n > 0
        b, o, final = best_fit(n[some], caps, overhead, quadratic)
        k = len(n) - len(b)  # rows without words are last
        base = TaskContext.get().partitionId() << 32
        for name, v in (("bin_id", base + b), ("capacity", final[b] if len(b) else b), ("offset", o)):
            table = table.append_column(name, pa.array(np.concatenate([v, np.zeros(k, np.int64)]), pa.int64(), mask=~some))
        yield from table.to_batches(max_chunksize=20_000)

    added = [T.StructField(c, T.LongType()) for c in ("bin_id", "capacity", "offset")]
    return pieces.repartition(shards).mapInArrow(run, T.StructType([*pieces.schema.fields, *added])).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Packs whole texts, measured in words."""
    return pack_lengths(docs.select(F.col(id_col), word_count(F.col(text_col)).alias("length")), id_col=id_col, **options)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
