"""Near-duplicates by the Jaccard similarity of word shingles, verified on whole sets.

Candidates come from SimHash (``simhash.table_links``): fingerprints of the shingle sets, 128
keys that are blocks of 15 bits, and a Hamming limit of 38 on 128 further bits; components of
these candidates are the groups to verify (``table_links`` gives links that are linear in a group
and have these components, not all candidates).  At a similarity of 0.8 a bit differs with chance
0.15 at most, so a pair shares no key with chance 1.2e-5 and exceeds the limit with 9e-6 (and
then it is still found if a chain of candidates joins it).  Sets of 4 and 5 shingles differ in
0.19 of the bits: below 8 shingles there are 128 keys more, with a limit of 42.
Within a group similarities are counted on the shingle sets (64-bit hashes), so no link below
``least`` is made.  Members are compared one by one with a hub of their group, then with
linked candidates.  Members that stay unlinked are compared with their whole group: groups
above ``tile_shingles`` are cut into tiles (an unlinked chunk meets every chunk in one), so no
task holds more than two chunks and no pair that could join classes is left out.

Words are those of ``simhash``; a text of fewer than ``width`` words is one shingle.  Nulls,
ids, repeated rows and empty texts (all alike) are as there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import LOWER, give_back, mix, row_name, span_hashes, spread_join, stored, text_slices, words_of, work_dir
from seqspan.llm.components import connected_components
from seqspan.llm.simhash import CHECK_WORDS, KEY_WORDS, SHORT, first_of_class, long_fingerprints, table_links

_B = np.uint64(0xA0761D6478BD642F)
SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("grams", T.BinaryType())])


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes row after row, and their number in each row."""
    low = LOWER[data]
    starts, ends, counts = words_of(low, offs)
    word = span_hashes(low, starts, ends)
    past = np.repeat(np.cumsum(counts), counts)  # end of the row of each word
    at = np.arange(len(word))
    first = past - np.repeat(counts, counts)
    h = np.zeros(len(word), np.uint64)
    for k in range(width):
        here = at + k < past
        h[here] = mix(h[here] * _B + word[at[here] + k])
    kept = (at + width <= past) | (at == first)
    row, h = np.repeat(np.arange(len(counts)), counts)[kept], h[kept]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(counts))


def words_of_prints(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the long fingerprints row after row, and their number in each row."""
    common = CHECK_WORDS + KEY_WORDS
    many = np.where(counts < SHORT, common + KEY_WORDS, common)
    edge = np.cumsum(many) - many
    out = np.zeros(many.sum(), np.uint64)
    out[edge[:, None] + np.arange(common)] = long_fingerprints(h, counts, range(common))
    short = counts < SHORT
    more = long_fingerprints(h[np.repeat(short, counts)], counts[short], range(common, common + KEY_WORDS))
    out[edge[short][:, None] + common + np.arange(KEY_WORDS)] = more
    return out, many


def sets_of(text: Column, width: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            nodes, sizes, prints, many, grams = [], [], [], [np.zeros(1, np.int64)], []
            for _, _, data, offs in text_slices(array, 1 << 18):
                h, counts = shingle_sets(data, offs, width)
                edge = np.concatenate([[0], np.cumsum(counts)])
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
                nodes.append(mix(total[edge[1:]] - total[edge[:-1]] + counts.astype(np.uint64)))
                sizes.append(counts.astype(np.int64))
                words, each = words_of_prints(h, counts)
                prints.append(words)
                many.append(each)
                grams += [h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            cat = lambda x, t: pa.array((np.concatenate(x) if x else np.zeros(0, t)).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(many)), pa.int32()), cat(prints, np.uint64))
            yield pa.StructArray.from_arrays([cat(nodes, np.uint64), cat(sizes, np.int64), lists, pa.array(grams, pa.binary())], names=SETS.names)
            del nodes, sizes, prints, many, grams, lists
            give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SETS)(text)


def similar(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is ``least`` or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    limit = round(least * 1000)
    waiting = np.ones(len(sets), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(waiting)
        h = np.concatenate([sets[k] for k in left]) if len(left) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        return h[order], np.repeat(left, sizes[left])[order]

    h, owner = index()
    alive = len(h)
    a, b = [], []
    for root in np.argsort(-sizes, kind="stable").tolist():
        if not waiting[root]:
            continue
        waiting[root] = False
        alive -= sizes[root]
        queue = [root]
        while queue and alive:
            if 2 * alive < len(h):  # the sets already linked leave the index
                h, owner = index()
            x = queue.pop()
            lo, hi = np.searchsorted(h, sets[x], "left"), np.searchsorted(h, sets[x], "right")
            many = hi - lo
            at = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
            who, both = np.unique(owner[at], return_counts=True)
            near = who[waiting[who] & (both * 1000 >= limit * (sizes[x] + sizes[who] - both))]
            waiting[near] = False
            alive -= sizes[near].sum()
            queue += near.tolist()
            a += near.tolist()
            b += [root] * len(near)
    return a, b


def _verified(least: float):
    """Batches (root, tile, node, grams) sorted by root and tile -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            a, b = similar(sets, least)
            at = np.array(nodes, np.int64)
            nodes.clear()
            sets.clear()
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(at[np.array(x, np.int64)]) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            roots, tiles, found = (batch.column(k).to_pylist() for k in range(3))
            for k, key in enumerate(zip(roots, tiles, strict=True)):
                if key != now and nodes:
                    yield done()
                now = key
                nodes.append(found[k])
                sets.append(np.frombuffer(batch.column(3)[k].as_py(), np.uint64))
        if nodes:
            yield done()

    return run


def overlaps(least: float) -> Callable[[Column, Column], Column]:
    """Whether two sets of grams have a Jaccard similarity of ``least`` or more."""
    limit = round(least * 1000)

    def near(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both * 1000 >= limit * (len(a) + len(b) - both)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([near(x.as_py(), y.as_py()) for x, y in zip(left, right, strict=True)], pa.bool_())
            del left, right
            give_back()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.BooleanType())


def near_others(rows: DataFrame, partners: DataFrame, key: str, least: float) -> DataFrame:
    """``rows(node, n, grams, key)`` and ``partners(key, other, on, og)``, one of each key ->
    ``(a, b)``: those whose sets are similar.  A row meets its partner's set only if their sizes
    allow it, so it never carries much more than its own."""
    limit = round(least * 1000)
    fit = F.least("n", "on") * 1000 >= F.greatest("n", "on") * limit
    near = spread_join(rows, partners, key).where((F.col("node") != F.col("other")) & fit).where(overlaps(least)("grams", "og"))
    return near.select(F.col("node").alias("a"), F.col("other").alias("b"))


def jaccard_links(sets: DataFrame, folder: str, least: float, tile_shingles: int) -> DataFrame:
    """``sets(node, n, words, grams)`` -> ``(a, b)``: links between nodes with the same components
    as all pairs of sets of a similarity of ``least`` or more.

    Each group is compared with its hub (the node with the most candidates) first, then what is
    not linked with candidates that are.  All linked so far form one class, so only the nodes
    still open need comparing with the rest of their group: work is linear in a group of copies."""
    prints = stored(sets.select("node", "words").dropDuplicates(["node"]), folder, "prints")
    met = stored(table_links(prints, folder), folder, "met_links")
    edges = met.select(F.col("a").alias("node"), F.col("b").alias("other")).union(met.select("b", "a"))
    groups = connected_components(met, folder, "met")
    groups = stored(groups.distinct(), folder, "groups")
    one_each = sets.select("node", "n", "grams").join(groups.select("node"), "node", "left_semi").dropDuplicates(["node"])
    grouped = stored(spread_join(one_each, groups, "node"), folder, "grouped")

    busy = spread_join(groups, edges.groupBy("node").agg(F.count("*").alias("many")), "node")
    hubs = stored(busy.groupBy("root").agg(F.max(F.struct("many", "node")).alias("top")).select("root", F.col("top.node").alias("other")), folder, "hubs")
    partners = grouped.select(F.col("node").alias("other"), F.col("n").alias("on"), F.col("grams").alias("og"))
    hub_sets = stored(partners.join(hubs, "other"), folder, "hub_sets")
    starred = stored(near_others(grouped, hub_sets, "root", least), folder, "starred")
    settled = stored(starred.select(F.col("a").alias("node")).union(hubs.select("other")), folder, "settled")
    waiting = stored(groups.join(settled, "node", "left_anti"), folder, "waiting")
    tried = spread_join(edges.join(waiting.select("node"), "node", "left_semi"), settled.withColumnRenamed("node", "other"), "other").distinct()
    # the sets of those waiting, once for each settled candidate
    tried = spread_join(stored(tried, folder, "tried"), grouped.select("node", "n", "grams"), "node")
    chained = near_others(tried.withColumn("at", F.col("other")).drop("other"), partners.withColumn("at", F.col("other")), "at", least)
    chained = stored(chained, folder, "chained")

    still = waiting.join(chained.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(True).alias("open"))
    marked = grouped.select("root", "node", "n").join(stored(still, folder, "still"), "node", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    share = lambda part: F.ceil(F.coalesce(F.sum(F.when(part, F.col("n"))), F.lit(0)) / tile_shingles).cast("int")
    small = F.sum("n") <= tile_shingles
    left = marked.groupBy("root").agg(
        F.when(small, 1).otherwise(share(F.col("open"))).alias("opens"), F.when(small, 0).otherwise(share(~F.col("open"))).alias("rest"), F.max("open").alias("more")
    )
    left = stored(left.where("more").drop("more"), folder, "left")
    marked = stored(spread_join(marked.drop("n"), left, "root"), folder, "marked")
    # open nodes are dealt over the first chunks, linked ones over the rest; a tile is an
    # unordered pair of chunks of which one is open; with one chunk there is the tile 0 alone
    chunks, slot = F.col("opens") + F.col("rest"), F.xxhash64("node")
    own = F.when(F.col("open") | (F.col("rest") == 0), F.pmod(slot, F.col("opens"))).otherwise(F.col("opens") + F.pmod(slot, F.greatest("rest", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("open"), chunks).otherwise(F.col("opens")) - 1)
    tiles = F.transform(F.filter(others, lambda other: (other != own) | (chunks == 1)), lambda other: F.least(own, other).cast("long") * chunks + F.greatest(own, other))
    dealt = spread_join(grouped.select("node", "grams"), marked, "node").select("root", F.explode(tiles).alias("tile"), "node", "grams")
    dealt = dealt.repartition("root", "tile").sortWithinPartitions("root", "tile")
    return dealt.mapInArrow(_verified(least), "a long, b long").union(starred).union(chained).distinct()


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, tile_shingles: int = 1 << 19,
) -> DataFrame:
    """The documents without near-duplicates: which stay is as in ``simhash.keep_one``."""
    folder = work_dir(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), row_name(F.col(id_col), F.col(text_col)).alias("key"), sets_of(F.col(text_col), width).alias("s"))
    sets = stored(keyed.select("id", "key", "s.node", "s.n", "s.words", "s.grams"), folder, "sets")
    return first_of_class(docs, sets.select("id", "key", "node"), jaccard_links(sets, folder, least, tile_shingles), folder, id_col, text_col)
