"""Line dedup by pairwise alignment.

Lines are compared as lower-cased words.  Documents are paired by runs: from each line the
shortest run of neighbouring lines (blank ones do not count) forwards and backwards of at
least ``min_block_words`` words.  Every repeated block is made up of such runs, so none is
missed: a rare run (in at most ``rare_docs`` documents) pairs each holder with every earlier
one; a more frequent run pairs each holder with its first holder, so pairs grow with the
lines and groups of any size are found.

A pair is aligned by patience diff over the runs that both hold, in the order of their
lines; the aligned blocks, and nothing else, are deleted from the later document, blank lines
inside included.  An alignment gives each run one partner in one order, so a passage held
twice or in another order is left over: what is left of the later document is aligned again,
until no shared run is left.  Lines that only a later alignment took are told apart as moved.
There are as many alignments as a passage has copies or an order has reversals.  Of every
passage the first holder keeps it.  Only places of shared runs travel, never whole documents,
so a long first holder costs no more than a short one.

Earlier means a smaller id (of any type that sorts).  Nulls: a row without an id is left as
it is; a null text stays null.  Rows of equal id are one document: none is later, they are
not compared with each other.  Empty texts have no lines with words.  A document may end up
empty; its row stays.  Columns named like the results are replaced.  Empty table: empty
result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import LOWER, columns_of, fresh, give_back, mix, row_name, spare, span_hashes, spread_join, stored, text_slices, words_of, work_dir
from seqspan.llm.rules import lines_of

_B = np.uint64(0xA0761D6478BD642F)
_B_INV = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
RUNS = T.StructType([T.StructField("h", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.ArrayType(T.IntegerType())))])


def line_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each line's lower-cased words (0: no words), its number of words, lines per row."""
    starts, ends, _ = words_of(data, offs)
    word = span_hashes(LOWER[data], starts, ends)
    ls, le, per_row = lines_of(data, offs)
    first, past = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    count = past - first
    # order within the line enters through a position factor
    place = np.arange(len(word)) - np.repeat(first, count)
    power = np.cumprod(np.full(int(count.max(initial=0)) + 1, _B, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(word * power[place], dtype=np.uint64)])
    h = mix(total[past] - total[first] + count.astype(np.uint64))
    h = np.where(h == 0, np.uint64(1), h)
    return np.where(count > 0, h, np.uint64(0)), count, per_row


def runs_of(hashes: np.ndarray, words: np.ndarray, per_row: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The shortest runs of at least ``least`` words from each line with words, forwards and
    backwards: row, hash, first and last line number within the row, in that order, each once."""
    some = hashes != 0
    row = np.repeat(np.arange(len(per_row)), per_row)
    number = (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row))[some]
    row, h, n = row[some], hashes[some], words[some].astype(np.int64)
    past = np.cumsum(n)
    before = past - n
    at, least = np.arange(len(h)), max(1, least)
    last = np.searchsorted(past, before + least)
    first = np.searchsorted(before, past - least, "right") - 1
    a, b = np.concatenate([at, first]), np.concatenate([last, at])
    fits = (a >= 0) & (b < len(h))
    a, b = a[fits], b[fits]
    fits = row[a] == row[b]
    a, b = a[fits], b[fits]
    power, back = (np.cumprod(np.full(len(h) + 1, x, np.uint64)) for x in (_B, _B_INV))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    out = mix((total[b + 1] - total[a]) * back[a] + (b + 1 - a).astype(np.uint64))
    order = np.lexsort((b, a, out, row[a]))
    a, b, out = a[order], b[order], out[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, out = a[new], b[new], out[new]
    return row[a], out, number[a], number[b]


def runs(text: Column, least: int) -> Column:
    """Of each text: hashes of its runs, and of each the lines (first, last, first, last, ...)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            h, spans, per_row, per_h = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
            for i, j, data, offs in text_slices(array):
                hashes, words, n = line_hashes(data, offs)
                row, out, first, last = runs_of(hashes, words, n, least)
                new = np.ones(len(out), bool)
                new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
                h.append(out[new].view(np.int64))
                spans.append(np.stack([first, last], 1).ravel().astype(np.int32))
                per_row.append(np.bincount(row[new], minlength=j - i))
                per_h.append(2 * np.diff(np.append(np.flatnonzero(new), len(out))))
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            edge, inner = (pa.array(np.cumsum(np.concatenate(x)), pa.int32()) for x in (per_row, per_h))
            at = pa.ListArray.from_arrays(inner, cat(spans, np.int32))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(edge, cat(h, np.int64)), pa.ListArray.from_arrays(edge, at)], names=RUNS.names)
            del h, spans, per_row, per_h, at
            give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RUNS)(text)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences: equal ends, then lines unique on both sides in
    longest increasing order, then the gaps between them likewise."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0 += 1
            b0 += 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1 -= 1
            b1 -= 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at: dict[int, int] = {}
        for i in range(a0, a1):
            at[a[i]] = -1 if a[i] in at else i
        found: dict[int, int] = {}
        for j in range(b0, b1):
            if b[j] in at:
                found[b[j]] = -1 if b[j] in found else j
        pairs = [(at[h], j) for h, j in found.items() if j >= 0 and at[h] >= 0]  # rising in j
        if not pairs:
            continue
        tops, ends, back = [], [], []
        for k, (i, _) in enumerate(pairs):
            p = bisect_left(tops, i)
            back.append(ends[p - 1] if p else -1)
            if p == len(tops):
                tops.append(i)
                ends.append(k)
            else:
                tops[p], ends[p] = i, k
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        out += chain
        edge = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edge, edge[1:], strict=False)]
    return sorted(out)


def matched_runs(theirs: list[int], mine: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (first line, last line, hash) of the later document that one alignment matches.  Where
    every run left stands twice, nothing is unique: then their first places are aligned."""
    found = patience(theirs, [h for *_, h in mine])
    if found:
        return [mine[k] for _, k in found]
    first: dict[int, tuple[int, int, int]] = {}
    for run in mine:
        first.setdefault(run[2], run)
    firsts = list(first.values())
    return [firsts[k] for _, k in patience(theirs, [h for *_, h in firsts])]


def common_blocks(shared: list[tuple[int, int, list[int]]]) -> tuple[set[int], set[int]]:
    """``shared`` runs (hash, first line in the earlier document, lines in the later one) ->
    lines of the later document in blocks of the first alignment, and those that later
    alignments of what is left took."""
    theirs = [h for _, h in sorted((line, h) for h, line, _ in shared)]
    mine = sorted((at[k], at[k + 1], h) for h, _, at in shared for k in range(0, len(at), 2))
    aligned: set[int] = set()
    later: set[int] = set()
    now = aligned
    while mine:
        taken = matched_runs(theirs, mine)
        if not taken:
            break
        for first, last, _ in taken:
            now.update(range(first, last + 1))
        done = set(taken)
        mine = [x for x in mine if x not in done and not all(k in aligned or k in later for k in range(x[0], x[1] + 1))]
        left = {h for *_, h in mine}
        theirs, now = [h for h in theirs if h in left], later
    return aligned, later


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, a, h, line, at) sorted by d and a -> (d, gone, moved)."""
    now: tuple[bytes, bytes] | None = None
    shared: list[tuple[int, int, list[int]]] = []
    aligned: set[int] = set()
    rest: set[int] = set()

    def pair() -> None:
        for whole, part in zip((aligned, rest), common_blocks(shared), strict=True):
            whole.update(part)
        shared.clear()

    def document(d: bytes) -> pa.RecordBatch:
        lists = [pa.array([sorted(x)], pa.list_(pa.int32())) for x in (aligned | rest, rest - aligned)]
        aligned.clear()
        rest.clear()
        return pa.RecordBatch.from_arrays([pa.array([d], pa.binary()), *lists], names=["d", "gone", "moved"])

    for batch in batches:
        for d, a, h, line, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now != (d, a):
                pair()
                if now[0] != d:
                    yield document(now[0])
            now = d, a
            shared.append((h, line, at))
    if now is not None:
        pair()
        yield document(now[0])


def _without(text: Column, gone: Column) -> Column:
    """The text without the numbered lines."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for t, g in zip(texts, lists, strict=True):
                if g.as_py() is None:
                    out.append(None)
                    continue
                drop = set(g.as_py())
                out.append("\n".join(x for k, x in enumerate(t.as_py().split("\n")) if k not in drop))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.StringType())(text, gone)


def shared_runs(table: DataFrame, folder: str, rare_docs: int) -> DataFrame:
    """``table(dk, id, runs)`` -> ``(a, d, h, line, at)``: runs that an earlier document a and
    a later one d hold, a's first line of it, d's lines."""
    each = table.select("dk", "id", F.explode(F.arrays_zip("runs.h", "runs.at")).alias("r"))
    held = stored(each.select(F.col("r.h").alias("h"), "id", "dk", F.col("r.at").alias("at")), folder, "held")
    met = held.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "dk", F.col("at")[0].alias("line"))).alias("first")).where("n > 1")
    met = stored(met, folder, "met")
    both = spread_join(held, met.where(F.col("n") > rare_docs), "h").where("first.id < id")
    to_first = both.select(F.col("first.dk").alias("a"), F.col("dk").alias("d"), "h", F.col("first.line").alias("line"), "at")
    # at most rare_docs holders a run, so the lists are short
    few = held.join(met.where(F.col("n") <= rare_docs).select("h"), "h").groupBy("h").agg(F.collect_list(F.struct("id", "dk", "at")).alias("x"))
    pairs = few.select("h", F.explode("x").alias("later"), "x").select("h", "later", F.explode("x").alias("earlier")).where("earlier.id < later.id")
    rare = pairs.select(F.col("earlier.dk").alias("a"), F.col("later.dk").alias("d"), "h", F.col("earlier.at")[0].alias("line"), F.col("later.at").alias("at"))
    return to_first.unionByName(rare)


def cut_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = 20, rare_docs: int = 8) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: null, or the numbers of the lines to delete
    (``gone``) and those of them that no first alignment took (``moved``)."""
    folder = work_dir(docs.sparkSession)
    key = row_name(F.col(id_col), F.col(text_col))
    table = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    table = table.select(key.alias("dk"), F.col(id_col).alias("id"), runs(F.col(text_col), min_block_words).alias("runs"))
    one_each = stored(table.where(F.size("runs.h") > 0).dropDuplicates(["dk"]), folder, "documents")
    shared = shared_runs(one_each, folder, rare_docs).select("d", "a", "h", "line", "at")
    found = shared.repartition("d").sortWithinPartitions("d", "a").mapInArrow(_aligned, "d binary, gone array<int>, moved array<int>")
    dk, cut = spare(docs, "dk"), spare(docs, "cut")
    found = stored(found, folder, "cut").select(F.col("d").alias(dk), F.struct("gone", "moved").alias(cut)).hint("shuffle_hash")
    return docs.withColumn(dk, F.when(F.col(id_col).isNotNull(), key)).join(found, dk, "left").drop(dk), cut


def shortened(text_col: str, cut: str) -> Column:
    """The text without the lines to delete; as it is where there are none."""
    some = F.col(cut).isNotNull()
    return F.when(some, _without(F.when(some, F.col(text_col)), F.col(cut)["gone"])).otherwise(F.col(text_col))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated blocks cut from ``text_col``, n_lines, deleted_lines (their
    numbers in the original text; empty if none) and moved_lines (those outside first alignments)."""
    added = ["n_lines", "deleted_lines", "moved_lines"]
    joined, cut = cut_lines(fresh(docs, added), id_col=id_col, text_col=text_col, **options)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(text_col, F.lit("\n")) + 1).cast("long")
    lists = [F.coalesce(F.col(cut)[x], F.array().cast("array<int>")) for x in ("gone", "moved")]
    kept = [shortened(text_col, cut).alias(name) if name == text_col else c for c, name in zip(columns_of(joined), joined.columns, strict=True) if name != cut]
    return joined.select(*kept, *[c.alias(x) for c, x in zip([n_lines, *lists], added, strict=True)])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
