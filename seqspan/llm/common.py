"""Shared pieces of the text operators: byte-level words over Arrow buffers, 64-bit
hashes, tables kept in the shared folder, and joins that survive hot keys.

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes; all separators are ASCII, so bytes and
code points cut alike.  A null text counts as an empty one everywhere in this package.
"""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of text handled at once; only a single longer text makes a larger slice
SLICE_BYTES = 1 << 20
_HASH_SPAN = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = np.cumprod(np.full(_HASH_SPAN + 1, _P, np.uint64))
_POWERS_INV = np.cumprod(np.full(_HASH_SPAN + 1, _P_INV, np.uint64))  # an empty span may start at a window's end


# ---------------------------------------------------------------- shared folder


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes when the application ends.

    Only where that setting is absent and all runs in one process (tests) a local folder is
    set; a cluster without it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="seqspan-")
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/seqspan-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: its lineage is
    cut, lost executors cost a reread, and later joins shuffle it afresh (so adaptive
    execution can split hot keys)."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``stored``, then the shuffle files behind it go.  Executors remove those of a finished step
    when the driver's JVM collects its garbage, which by itself may come many steps later.  What
    has just run is still referred to for a moment, so a second collection follows."""
    out = stored(df, folder, name)
    for pause in (0.5, 0):
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(pause)
    return out


def dropped(df: DataFrame, folder: str, name: str) -> None:
    """Remove a stored table that no later step reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_MASK = 0x5DEECE66D


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text.  Spark's hash skips nulls, so whether each is
    null enters too; of 2e10 rows none is expected to share both hashes with another (6e-19)."""
    parts = (id_.isNull(), id_, text.isNull(), text)
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def row_name(id_: Column, text: Column) -> Column:
    """Both hashes of ``row_key`` as 16 bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in row_key(id_, text)]))


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join on long keys where a key of ``left`` may hold a third of all rows.

    Both sides join on the first key XOR a constant: this hides any partitioning that an
    aggregate left behind, so both inputs get a plain shuffle that AQE may split."""
    first, *more = [key] if isinstance(key, str) else key
    k = F.col(first).cast("long").bitwiseXOR(F.lit(_MASK))
    a = left.withColumn("_jk", k)
    b = right.withColumn("_jk", k).drop(first)
    return a.join(b, ["_jk", *more], how).drop("_jk")


def crc_remainder(column: str, n: int) -> Column:
    """crc32(id as text) mod n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_remainder_of(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def fresh(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (the operator's win)."""
    low = {x.lower() for x in names}
    return df.select(*[c for c, name in zip(columns_of(df), df.columns, strict=True) if name.lower() not in low])


def columns_of(df: DataFrame) -> list[Column]:
    """All columns; their names may hold dots and backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- words


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if (libc := ctypes.CDLL(None)) and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string array, without copying where it has no nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    width = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    offs = np.frombuffer(offsets, width)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def text_slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offs = text_buffers(array)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    w = IS_WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial prefix sums modulo 2**64, then a finaliser.
    Spans are in ascending order; work goes in windows of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _HASH_SPAN, "right"))
        if j <= i:  # one span above the window: fold it piece by piece
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for p in range(base, int(ends[i]), _HASH_SPAN):
                    part = data[p : min(p + _HASH_SPAN, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                    h = mix(np.array([h]))[0] + np.sum(part * _POWERS[: len(part)], dtype=np.uint64)
                out[i] = h
            i += 1
            continue
        top = int(ends[j - 1])
        prefix = np.zeros(top - base + 1, np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * _POWERS[: top - base], out=prefix[1:])
        s = starts[i:j] - base
        out[i:j] = (prefix[ends[i:j] - base] - prefix[s]) * _POWERS_INV[s]
        i = j
    return mix(out)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two hash arrays."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(29))) * np.uint64(0x165667B19E3779F9))


def distinct_sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs (sort-based)."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.concatenate([first, [len(x)]]))


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of ``values`` of the given lengths (0 for an empty run)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]
