"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole block keys, Hamming check.

Fingerprints that differ in at most ``max_bits`` bits agree in at least
``blocks - max_bits`` of ``blocks`` bit blocks, so they share one of the keys made of that
many blocks.  Distinct fingerprints meet per key; a key's group reports its links, or a
spanning forest of them where they are many, so output stays linear.  A group above
``tile_rows`` is cut into tiles (every two chunks of it meet in one), so no task holds more
than two chunks and no link is lost.

With wide limits chance links would grow with the square of the corpus.  ``check_bits`` then
asks for a second, independent fingerprint: a link needs at most ``max_bits`` in the first
and at most ``check_bits`` in both together.

Limits too wide for a pigeonhole guarantee (0.15 of the bits) take ``table_links``: a long
fingerprint from one pass over the shingle hashes, keys that are blocks of it, and the Hamming
distance of two more words as the check.

Nulls: a null text is empty; a null id keeps its row and its links, but is never a
component's id (null if no document of the component has one).  No words: fingerprint zero.
Repeated rows and equal texts share a fingerprint.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import mix, row_name, spare, spread_join, stored, text_buffers, work_dir
from seqspan.llm.components import connected_components

_CHUNK = 1 << 15
_LANES = np.uint64(0x0101010101010101)

#: ``table_links``: words of the check, words of four key blocks each, bits of a block; sets of
#: fewer than ``SHORT`` shingles have as many key words again
CHECK_WORDS, KEY_WORDS, BLOCK, SHORT = 2, 32, 15, 8
#: key words whose tables give the links that make the first classes
FIRST_WORDS = 4
#: bits of the check that may differ: in the common tables, in those of short sets
CHECK_BITS = (38, 42)


def _counts(hashes: list[int]) -> np.ndarray:
    h = np.array(hashes, np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, width: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """Fingerprints of one text: a bit is 1 if it is set in over half the shingle hashes."""
    words = text.lower().split()  # bytes: only A-Z change, and the six ASCII separators cut
    n = max(1, len(words) - width + 1)
    if not words:
        return [0] * len(seeds)
    joined = b" ".join(words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    hash64, last = xxhash.xxh64_intdigest, min(width, len(words))
    totals = np.zeros((len(seeds), 64), np.int64)
    for i in range(0, n, _CHUNK):
        j = min(n, i + _CHUNK)
        shingles = [joined[a : b - 1] for a, b in zip(at[i:j], at[i + last : j + last], strict=True)]
        for k, seed in enumerate(seeds):
            totals[k] += _counts([hash64(s, seed) for s in shingles])
    return [int(sum(1 << k for k in np.flatnonzero(2 * t > n).tolist())) for t in totals]


def fingerprints(text: Column, width: int = 3, seeds: tuple[int, ...] = (42,)) -> Column:
    """Fingerprints of each text as longs (the unsigned values' two's complement)."""
    names = [f"fp{k or ''}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            data, offs = text_buffers(array)
            raw = memoryview(data)
            out = [fingerprint(bytes(raw[a:b]), width, seeds) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            table = np.array(out, np.uint64).reshape(-1, len(seeds)).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.StructType([T.StructField(x, T.LongType()) for x in names]))(text)


def _block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """One long for each choice of ``blocks - max_bits`` blocks: the fingerprint under that
    choice's mask, hashed together with the choice's number."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << edge[b + 1]) - (1 << edge[b])) for b in kept) for kept in combinations(range(blocks), blocks - max_bits)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in masks])
    return F.transform(signed, lambda m: F.xxhash64(m, fp.bitwiseAND(m)))


def near_pairs(fps: np.ndarray, max_bits: int, check_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links among ``fps`` (n, words): all of them, or if they are more than
    four a row a spanning forest found breadth-first."""
    n = len(fps)

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        first = np.bitwise_count(x[..., 0] ^ y[..., 0])
        near = first <= max_bits
        if fps.shape[1] > 1:
            near &= first.astype(np.int64) + np.bitwise_count(x[..., 1] ^ y[..., 1]) <= check_bits
        return near

    a, b, many = [], [], 0
    step = max(1, (1 << 20) // max(1, n))
    for i in range(0, n - 1, step):
        near = close(fps[i : i + step, None], fps[None, i:])
        x, y = np.nonzero(np.triu(near, 1))
        many += len(x)
        if many > 4 * n:
            break
        a.append(x + i)
        b.append(y + i)
    else:
        none = np.zeros(0, np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    a, b, left = [], [], np.arange(n)
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = close(fps[left], fps[queue.pop()])
            if near.any():
                found = left[near]
                left = left[~near]
                queue += found.tolist()
                a.append(found)
                b.append(np.full(len(found), root))
    return np.concatenate(a), np.concatenate(b)


def _linked(max_bits: int, check_bits: int):
    """Batches (key, tile, node, fp...) sorted by key and tile -> links; the last group waits
    for the next batch."""

    def links(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
        fps = rows[:, 1:].view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(np.diff(edge) > 1).tolist():
            p, q = near_pairs(fps[edge[i] : edge[i + 1]], max_bits, check_bits)
            a.append(rows[p + edge[i], 0])
            b.append(rows[q + edge[i], 0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            out = links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            k, r = np.stack(cols[:2], 1), np.stack(cols[2:], 1)
            if held and (held[-1][0][-1] != k[0]).any():
                yield flush()
            cut = len(k) - int(np.argmin((k == k[-1]).all(1)[::-1])) if (k[0] != k[-1]).any() else 0
            if cut:
                held.append((k[:cut], r[:cut]))
                yield flush()
            held.append((k[cut:], r[cut:]))
        if held:
            yield flush()

    return run


def fingerprint_links(fps: DataFrame, folder: str, max_bits: int = 3, blocks: int = 6, check_bits: int = 0, tile_rows: int = 4096) -> DataFrame:
    """``fps(node, fp[, fp1])`` distinct longs -> ``(a, b)``: links between nodes with the same
    components as all pairs of fingerprints within the limits."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("0 <= max_bits < blocks <= 64 is needed")
    keyed = fps.select(F.explode(_block_keys(F.col("fp"), blocks, max_bits)).alias("key"), *fps.columns)
    large = keyed.groupBy("key").count().where(F.col("count") > tile_rows)
    large = stored(large.select("key", F.ceil(F.col("count") / tile_rows).cast("int").alias("chunks")), folder, "large")
    met = spread_join(keyed, large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # a tile is an unordered pair of chunks; with one chunk there is the tile 0 alone
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: (F.least(own, other).cast("long") * F.col("chunks") + F.greatest(own, other)),
    )
    dealt = met.withColumn("tile", F.explode(tiles)).select("key", "tile", *fps.columns)
    dealt = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(_linked(max_bits, check_bits), "a long, b long").distinct()


def long_fingerprints(h: np.ndarray, counts: np.ndarray, words: range) -> np.ndarray:
    """The named words of the fingerprint of each row of ``counts`` shingle hashes: a bit is 1 if
    it is set in over half of the hashes, which are mixed anew for every word (bit 8 b + j of the
    hashes is bit 8 j + b of the word)."""
    out = np.zeros((len(counts), len(words)), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    many = counts[some]
    pieces = -(-many // 255)  # a byte lane counts to 255
    edge = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(edge, pieces)
    starts = np.repeat((np.cumsum(counts) - counts)[some], pieces) + 255 * nth
    salts = mix(np.arange(1, words.stop + 1, dtype=np.uint64) * _LANES)
    for at, word in enumerate(words):
        x, bits = mix(h ^ salts[word]), np.zeros(len(some), np.uint64)
        for j in range(8):
            lanes = np.add.reduceat((x >> np.uint64(j)) & _LANES, starts)
            totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), edge, axis=0, dtype=np.int64)
            bits |= np.packbits(2 * totals > many[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * j)
        out[some, at] = bits
    return out


def _table_keys(words: Column, start: int = 0, stop: int | None = None) -> Column:
    """One long for each block of the key words from ``start`` on: the table's number and the block."""
    keys = F.slice(words, CHECK_WORDS + 1 + start, F.lit(stop - start) if stop else F.size(words) - CHECK_WORDS - start)
    block = lambda w, i, j: (((i + start) * 4 + j).cast("long") * (1 << 16)) + F.shiftrightunsigned(w, 16 * j).bitwiseAND(F.lit((1 << BLOCK) - 1))
    return F.flatten(F.transform(keys, lambda w, i: F.array(*[block(w, i, j) for j in range(4)])))


def _near_in_tables():
    """Batches (key, node, class, check words) sorted by key -> links between unlike classes, one
    for each two of them; small groups are compared at once, row by row with the next, second
    next and so on."""

    def links(keys: np.ndarray, nodes: np.ndarray, classes: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(edge)
        limits = np.where((keys & 0xFFFFFFFF) >> 16 < 4 * KEY_WORDS, *CHECK_BITS)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(sizes > 16).tolist():
            if (classes[edge[i] : edge[i + 1]] == classes[edge[i]]).all():
                continue
            p, q = near_pairs(check[edge[i] : edge[i + 1]], 64, int(limits[edge[i]]))
            a.append(p + edge[i])
            b.append(q + edge[i])
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 16), sizes))
        for step in range(1, 16):
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            apart = np.bitwise_count(check[at] ^ check[at + step]).sum(1, dtype=np.int64)
            near = at[apart <= limits[at]]
            a.append(near)
            b.append(near + step)
        x, y = np.concatenate(a), np.concatenate(b)
        swap = classes[x] > classes[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        x, y = x[classes[x] != classes[y]], y[classes[x] != classes[y]]
        order = np.lexsort((classes[y], classes[x]))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (classes[x][1:] != classes[x][:-1]) | (classes[y][1:] != classes[y][:-1])
        x, y = x[new], y[new]
        return pa.RecordBatch.from_arrays([pa.array(z) for z in (nodes[x], nodes[y], classes[x], classes[y])], names=["a", "b", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            return links(rows[:, 0], rows[:, 1], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            if held and held[-1][0, 0] != rows[0, 0]:
                yield flush()
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                held.append(rows[:cut])
                yield flush()
            held.append(rows[cut:])
        if held:
            yield flush()

    return run


def table_links(prints: DataFrame, folder: str, tile_rows: int = 4096) -> DataFrame:
    """``prints(node, words)`` of distinct nodes -> ``(a, b)``: links with the same components as
    all pairs that share a key and whose check words are near.

    The first tables give links (of a key that many hold, a spanning forest) and from them
    classes; every other table then adds one link for each two classes that it joins.  So links
    are linear in a group: each table alone would span a group of copies anew.

    Keys held by over ``tile_rows`` nodes are cut into chunks, in the first step each by itself, in
    the second in tiles (every two chunks meet in one); how many chunks they need is estimated
    on one node of 16, every node takes part."""
    check = [f"c{k}" for k in range(CHECK_WORDS)]
    checks = [F.col("words")[k].alias(c) for k, c in enumerate(check)]
    some = prints.where(F.pmod(F.xxhash64("node"), F.lit(16)) == 0)
    large = some.select(F.explode(_table_keys(F.col("words"))).alias("key")).groupBy("key").agg((F.count("*") * 16).alias("many"))
    large = stored(large.where(F.col("many") > tile_rows).select("key", F.ceil(F.col("many") / tile_rows).alias("chunks")), folder, "large")
    any_large = bool(large.head(1))
    own, chunks = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")), F.col("chunks")
    others = F.sequence(F.lit(0).cast("long"), chunks - 1)
    tiles = F.transform(F.filter(others, lambda x: (x != own) | (chunks == 1)), lambda x: F.least(own, x) * chunks + F.greatest(own, x))

    def keyed(rows: DataFrame, *words: int) -> DataFrame:
        return rows.select(F.explode(_table_keys(F.col("words"), *words)).alias("key"), "node", "class", *checks)

    def sized(rows: DataFrame) -> DataFrame:
        return spread_join(rows, large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))

    def cut(rows: DataFrame, place: Column) -> DataFrame:
        return rows.withColumn("place", place).select((F.col("key") + F.col("place") * (1 << 32)).alias("key"), "node", "class", *check)

    def found(rows: DataFrame, name: str) -> DataFrame:
        near = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_near_in_tables(), "a long, b long, ca long, cb long")
        return stored(near.dropDuplicates(["ca", "cb"]).select("a", "b"), folder, name)

    first = keyed(prints.withColumn("class", F.col("node")), 0, FIRST_WORDS)
    first = found(cut(sized(first), own) if any_large else first, "first_links")
    classes = connected_components(first, folder, "first").withColumnRenamed("root", "class")
    classed = spread_join(prints, classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rest = keyed(classed, FIRST_WORDS)
    if any_large:  # the first tables too, for pairs in unlike chunks
        rest = cut(sized(rest).union(sized(keyed(classed, 0, FIRST_WORDS)).where("chunks > 1")), F.explode(tiles))
    return first.union(found(rest, "rest_links"))


def class_roots(nodes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """``nodes(node, ...)`` with ``root``: the same for all nodes that links ``(a, b)`` connect."""
    roots = connected_components(links, folder)
    # a node without links is its own root
    labelled = nodes.join(roots.withColumnRenamed("node", "n"), nodes.node == F.col("n"), "left").drop("n")
    return stored(labelled.withColumn("root", F.coalesce("root", "node")), folder, "labelled")


def fingerprint_table(docs: DataFrame, folder: str, id_col: str, text_col: str, width: int, check_bits: int) -> DataFrame:
    """``(id, key, node, fp[, fp1])``: node names the fingerprint, key the id and text of a row."""
    print_ = fingerprints(F.col(text_col), width, (42, 43) if check_bits else (42,))
    slim = docs.select(F.col(id_col).alias("id"), row_name(F.col(id_col), F.col(text_col)).alias("key"), print_.alias("p")).select("id", "key", "p.*")
    words = [c for c in slim.columns if c not in ("id", "key")]
    return stored(slim.withColumn("node", F.xxhash64(*words) if check_bits else F.col("fp")), folder, "fp")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, blocks: int = 6,
    check_bits: int = 0, tile_rows: int = 4096,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (hex) and ``component_id`` (the smallest
    id reachable over links).  Ids are of any type that sorts.  Other columns are not read."""
    folder = work_dir(docs.sparkSession)
    slim = fingerprint_table(docs, folder, id_col, text_col, width, check_bits)
    words = [c for c in slim.columns if c.startswith("fp")]
    least = stored(slim.groupBy("node", *words).agg(F.min("id").alias("least")), folder, "least")
    links = fingerprint_links(least.select("node", *words), folder, max_bits, blocks, check_bits, tile_rows)
    labelled = class_roots(least.select("node", "least"), links, folder)
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(spread_join(labelled, smallest, "root").select("node", "component_id"), folder, "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return spread_join(slim, classes, "node").select(F.col("id").alias(id_col), hexed, "component_id")


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, blocks: int = 6,
    check_bits: int = 0, tile_rows: int = 4096,
) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, that with the
    smallest id (a row without an id only where no row has one)."""
    folder = work_dir(docs.sparkSession)
    slim = fingerprint_table(docs, folder, id_col, text_col, width, check_bits)
    nodes = slim.select("node", *[c for c in slim.columns if c.startswith("fp")]).distinct()
    links = fingerprint_links(nodes, folder, max_bits, blocks, check_bits, tile_rows)
    return first_of_class(docs, slim, links, folder, id_col, text_col)


def first_of_class(docs: DataFrame, rows: DataFrame, links: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each class of ``rows(id, key, node)`` under ``links``.  Rows of one
    id and text are one document; which of them stays is open.  Rows of one id with unlike
    texts are documents of their own."""
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("best"))
    labelled = class_roots(stored(best, folder, "best"), links, folder)
    key = spare(docs, "key")
    kept = labelled.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias(key))
    # equal rows meet in partial aggregates first, so that no key is a hot one in the join
    one_each = docs.withColumn(key, row_name(F.col(id_col), F.col(text_col))).dropDuplicates([key])
    return one_each.join(kept, key, "left_semi").drop(key)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
