"""LM scoring with a log-frequency Bloom filter.

One pass cuts every text into tokens (lower-cased words and one end); each chunk of texts
deals its distinct words and bigrams by hash, with their counts in training texts, so a word
that stands in every text comes once a chunk.  Each segment of hash space, a partition of its
own, sums its share and puts it as quantised counts into its region of one filter: a count
on level j enters levels 1 to j, and a lookup probes rising levels until one is missing.
Levels grow by ``RATIO``.  Words and bigrams are kept from count 1 on.

A region takes ``probes / ln 2`` bits an entry at every size, so the filter grows with its
entries and its error rate does not.  It is never brought together: a segment looks up the
n-grams of all chunks of texts in its own region and sends back their levels, a byte each,
and exact counts of words for the base score; they meet the chunk's tokens in one task.
Hashes travel sorted, as steps from one to the next, and what a step leaves on disk goes
when the next has read it.

The model interpolates: p(w|h) = s * c(hw) / c(h) + (1 - s) * p(w), all counts read from the
filter, c(h) rounded up and the others down so that no distribution sums to more than 1
(false positives aside).  s depends on the level of c(h); it is set by expectation
maximisation over all training tokens, their own occurrence left out: chunks count tokens by
their three levels, and these counts are all that reaches the driver.

Nulls: a null text is empty (one token, the end); a null id counts as the empty id text.
Repeated rows are training text as often as they stand.  No training text: base and score
are log10(0.1 / 0.1) = 0 a token.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.llm.common import LOWER, crc_remainder, dropped, give_back, mix, pair_hash, row_key, row_sums, span_hashes, spread_join, stored, stored_once, text_slices, words_of, work_dir

RATIO = 1.2
_END = np.uint64(0x656E64)  # the end token, and the context before a first word
_FLUSH_TOKENS = 600_000
_PROBED = 1 << 17  # n-grams looked up at once
_ZSTD = pa.Codec("zstd", compression_level=6)


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes row after row, each row's words then its end; tokens per row."""
    low = LOWER[data]
    starts, ends, counts = words_of(low, offs)
    out = np.empty(len(starts) + len(counts), np.uint64)
    last = np.cumsum(counts + 1) - 1
    is_end = np.zeros(len(out), bool)
    is_end[last] = True
    out[is_end], out[~is_end] = mix(np.array([_END]))[0], span_hashes(low, starts, ends)
    return out, counts + 1


def contexts_of(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each; before the first of a row, the end token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = mix(np.array([_END]))[0]
    return before


def level_starts(least: int, most: float = 1e15) -> np.ndarray:
    """Smallest count of each level."""
    out = [least]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.float64)


_UNI = _BI = level_starts(1)


# ---------------------------------------------------------------- counting


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _dumped(x: tuple) -> bytes:
    """Packed for disk and shuffle: numbers of words and levels are mostly small."""
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _loaded(x: pa.Scalar) -> tuple:
    raw = x.as_buffer()
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), "zstd"))


def _deltas(x: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted hashes as steps from one to the next: the low 32 bits, which do not compress, and
    the rest byte by byte, mostly zeros."""
    d = np.diff(x, prepend=np.uint64(0))
    high = np.ascontiguousarray((d >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return d.astype(np.uint32), _ZSTD.compress(high.tobytes(), asbytes=True)


def _summed(low: np.ndarray, high: bytes) -> np.ndarray:
    """The hashes of ``_deltas``."""
    rest = np.frombuffer(pa.decompress(high, 4 * len(low), "zstd"), np.uint8).reshape(4, -1)
    rest = np.ascontiguousarray(rest.T).view("<u4").ravel().astype(np.uint64)
    return np.cumsum(rest << np.uint64(32) | low, dtype=np.uint64)


def _named(h: np.ndarray, segments: int) -> np.ndarray:
    """48 bits that name a hash within its segment, in the same order."""
    return h << np.uint64(segments.bit_length() - 1) >> np.uint64(16)


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _packed(tokens: np.ndarray, counts: np.ndarray, train: np.ndarray, keys: np.ndarray) -> bytes:
    """One chunk of texts: keys, token counts, train, distinct words, the word's number of each token."""
    order = np.argsort(tokens, kind="stable")
    h = tokens[order]
    first = _runs(h)
    word = np.empty(len(h), np.uint32)
    word[order] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.concatenate([first, [len(h)]])))
    return _dumped((keys, _small(counts), train, _deltas(h[first]), _small(word)))


def _bigrams(kinds: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's tokens: the context's number, bigram hashes in order, that order, runs of equal ones."""
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(counts) - counts] = np.searchsorted(kinds, mix(np.array([_END]))[0])
    g = pair_hash(kinds[context], kinds[word])
    order = np.argsort(g, kind="stable")
    g = g[order]
    return context, g, order, _runs(g)


def _dealt(segments: int):
    """Chunks (p, payload) -> rows (seg, kind, p, payload): distinct words (kind 0) and bigrams
    (kind 1) of each segment with their counts in training texts."""
    shift = np.uint64(64 - segments.bit_length() + 1)

    def shares(g: np.ndarray) -> np.ndarray:
        return np.searchsorted((g >> shift).astype(np.int64) if segments > 1 else np.zeros(len(g), np.int64), np.arange(segments + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, counts, train, kinds, word = _loaded(x)
                kinds = _summed(*kinds)
                at, counts = np.repeat(train, counts), counts.astype(np.int64)
                n = np.bincount(word[at], minlength=len(kinds))
                edge = shares(kinds)
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = edge[s], edge[s + 1]
                    yield _batch([(s, 0, p, _dumped((*_deltas(kinds[a:b]), _small(n[a:b]))), 0.0, 0.0, 0.0)])
                _, g, order, first = _bigrams(kinds, word, counts)
                n, g = np.add.reduceat(at[order].astype(np.uint32), first), g[first]
                del order, at, word
                edge = shares(g)
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = edge[s], edge[s + 1]
                    yield _batch([(s, 1, p, _dumped((*_deltas(_named(g[a:b], segments)), _small(n[a:b]))), 0.0, 0.0, 0.0)])
                give_back()

    return run


_ROWS = "seg int, kind int, p long, payload binary, n double, v double, e double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["seg", "kind", "p", "payload", "n", "v", "e"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (key columns, train, text) -> chunks (p, payload)."""
    part, flushed, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal flushed, held, size
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        p = (part << 24) + flushed
        flushed, held, size = flushed + 1, [], 0
        out = pa.RecordBatch.from_arrays([pa.array([p]), pa.array([_packed(*joined)], pa.binary())], names=["p", "payload"])
        del joined
        give_back()
        return out

    for batch in batches:
        *names, train, texts = batch.columns
        keys, train = np.stack([k.to_numpy() for k in names], 1), train.to_numpy(zero_copy_only=False)
        for i, j, data, offs in text_slices(texts):
            tokens, counts = tokens_of(data, offs)
            held.append((tokens, counts, train[i:j], keys[i:j]))
            size += len(tokens)
            if size >= _FLUSH_TOKENS:
                yield flush()
    if held:
        yield flush()


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = _runs(h)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _segment(seg: int, rows: list[tuple[int, int, object]], segments: int, probes: int) -> Iterator[tuple]:
    """All rows of one segment -> counts and levels of each chunk's n-grams, and the region."""
    sums = [_merged([np.zeros(0, np.uint64), *(_summed(*x[:2]) for kind, _, x in rows if kind == k)], [np.zeros(0, np.int64), *(x[-1] for kind, _, x in rows if kind == k)]) for k in (0, 1)]
    (uni, many), (bi, often) = sums
    u, b = np.searchsorted(_UNI, many, "right"), np.searchsorted(_BI, often, "right")
    entries = float(u.sum() + b.sum())  # one a level
    bits = max(1024, -(-int(entries * probes / np.log(2)) // 8) * 8)
    names = _named(uni, segments)
    region = filled(bits, probes, (names[u > 0], u[u > 0], 1), (bi[b > 0], b[b > 0], 2))
    yield seg, 4, 0, np.packbits(region, bitorder="little").tobytes(), float(many.sum()), float((many > 0).sum()), entries
    found = [probed(region, h, salt, len(_UNI) - 1, probes).astype(np.uint8) for h, salt in ((names, 1), (bi, 2))]
    for kind, p, x in rows:
        at = np.searchsorted(sums[kind][0], _summed(*x[:2]))
        yield seg, 6 + kind, p, _dumped((found[0][at], _small(many[at])) if kind == 0 else (found[1][at],)), 0.0, 0.0, 0.0


def _sum_segments(segments: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for r in _segment(now, rows, segments, probes):
                yield _batch([r])
            rows.clear()
            give_back()

        for batch in batches:
            for k in range(batch.num_rows):
                seg, kind, p = (batch.column(c)[k].as_py() for c in range(3))
                payload = batch.column(3)[k]
                if seg != now and rows:
                    yield from done()
                now = seg
                rows.append((kind, p, _loaded(payload)))
        if rows:
            yield from done()

    return run


def _met(rows: list[tuple[int, object]]) -> tuple[bytes, bytes]:
    """Rows (kind, payload) of one chunk in order of segments -> its texts' keys, token counts,
    base sums, known tokens, distinct codes of levels, and the code's number of each token;
    and the codes with the number of training tokens of each."""
    keys, counts, train, kinds, word = next(_loaded(x) for kind, x in rows if kind == 2)
    kinds = _summed(*kinds)
    counts = counts.astype(np.int64)
    # segments are ranges of hashes, so what they send back is in order of the hashes
    words, pairs = ([_loaded(x) for kind, x in rows if kind == k] for k in (6, 7))
    u, b = (np.concatenate([x[0] for x in back]).astype(np.uint32) for back in (words, pairs))
    c = np.concatenate([x[1].astype(np.float64) for x in words])
    base, known = row_sums(np.log10(c + 0.1)[word], counts), row_sums((c > 0)[word], counts)
    context, g, order, first = _bigrams(kinds, word, counts)
    both = np.empty(len(g), np.uint32)
    both[order] = np.repeat(b, np.diff(np.concatenate([first, [len(g)]])))
    del g, order
    codes, at = np.unique(u[context] << np.uint32(16) | both << np.uint32(8) | u[word], return_inverse=True)
    many = np.bincount(at[np.repeat(train, counts)], minlength=len(codes))
    return _dumped((keys, counts, base, known, codes, _small(at))), _dumped((codes, _small(many)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kinds 2, 6, 7 sorted by chunk and segment -> one row a chunk."""
    now, rows = None, []

    def done() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _met(rows)], names=["payload", "seen"])
        rows.clear()
        give_back()
        return out

    for batch in batches:
        kinds, ps, payload = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        for k, (kind, p) in enumerate(zip(kinds, ps, strict=True)):
            if p != now and rows:
                yield done()
            now = p
            rows.append((kind, payload[k]))
    if rows:
        yield done()


# ---------------------------------------------------------------- the filter


def _level_hash(h: np.ndarray, salt: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and odd step of a level's probes."""
    x = mix(h + np.uint64((salt + level * 0x9E3779B1) * 0xD1B54A32D192ED03 % (1 << 64)))
    return x, (x >> np.uint64(32)) | np.uint64(1)


def _place(x: np.ndarray, y: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Bit of a region for one probe of a level."""
    return ((x + np.uint64(probe) * y) & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)


def filled(bits: int, probes: int, *entries: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """A region with the entries (hashes, levels, salt)."""
    region = np.zeros(bits, bool)
    for h, top, salt in entries:
        for level in range(1, int(top.max(initial=0)) + 1):
            h, top = h[top >= level], top[top >= level]
            x, y = _level_hash(h, salt, level)
            for k in range(probes):
                region[_place(x, y, k, bits)] = True
    return region


def probed(region: np.ndarray, h: np.ndarray, salt: int, most: int, probes: int) -> np.ndarray:
    """The highest level up to which all are found: 0 if not even the first."""
    if len(h) > _PROBED:
        return np.concatenate([probed(region, h[k : k + _PROBED], salt, most, probes) for k in range(0, len(h), _PROBED)])
    out = np.zeros(len(h), np.int64)
    alive = np.arange(len(h))
    for level in range(1, most + 1):
        x, y = _level_hash(h[alive], salt, level)
        for k in range(probes):
            hit = region[_place(x, y, k, len(region))]
            if not hit.all():
                alive, x, y = alive[hit], x[hit], y[hit]
        if not len(alive):
            break
        out[alive] = level
    return out


def parts_of(codes: np.ndarray, n: float, v: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code of levels (context << 16 | bigram << 8 | word): p(w), c(hw) rounded down,
    c(h) rounded up, level of c(h)."""
    context, both, each = (codes >> 16).astype(np.int64), (codes >> 8 & 255).astype(np.int64), (codes & 255).astype(np.int64)
    p = (np.concatenate([[0.0], _UNI])[each] + 0.1) / (n + 0.1 * (v + 1))
    up = np.concatenate([[1.0], np.maximum(_UNI[1:] - 1, 1), [_UNI[-1]]])[context]
    # no bigram is more frequent than its words
    both = np.where((each > 0) & (context > 0), np.concatenate([[0.0], _BI])[both], 0.0)
    return p, np.minimum(both, up), up, context


class LogFrequencyFilter:
    """Quantised counts by repeated membership probes.  ``regions(seg, payload)`` holds the
    packed bits of each segment; only ``levels``, asked on the driver, reads them from there."""

    def __init__(self, segments: int, probes: int, regions: DataFrame, n: float, v: float):
        self.segments, self.probes, self.regions, self.n, self.v = segments, probes, regions, n, v
        self.shares = np.full(len(_UNI) + 1, 0.3)  # s by level of the context's count

    def levels(self, h: np.ndarray, salt: int, most: int) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        shift = np.uint64(64 - (self.segments.bit_length() - 1))
        seg = (h >> shift).astype(np.int64) if self.segments > 1 else np.zeros(len(h), np.int64)
        for s, bits in self.regions.where(F.col("seg").isin(np.unique(seg).tolist())).toLocalIterator():
            mine = np.flatnonzero(seg == s)
            region = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
            out[mine] = probed(region, _named(h[mine], self.segments), salt, most, self.probes)
        return out

    def parts(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each token: p(w), c(hw) rounded down, c(h) rounded up, level of c(h)."""
        context = contexts_of(tokens, counts)
        u, c = self.levels(tokens, 1, len(_UNI) - 1), self.levels(context, 1, len(_UNI) - 1)
        b = self.levels(pair_hash(context, tokens), 2, len(_BI) - 1)
        return parts_of(c << 16 | b << 8 | u, self.n, self.v)


def fitted_shares(codes: np.ndarray, many: np.ndarray, n: float, v: float, rounds: int = 8) -> np.ndarray:
    """Shares by level of the context, from how many training tokens have each code of levels:
    all that expectation maximisation asks of a token."""
    shares = np.full(len(_UNI) + 1, 0.3)
    if len(codes):
        p, both, up, context = parts_of(codes, n, v)
        inside = np.maximum(both - 1, 0) / np.maximum(up - 1, 1)
        sums = lambda x: np.bincount(context, x, len(shares))
        here = sums(many)
        seen = np.flatnonzero(here)
        for _ in range(rounds):
            s = shares[context]
            mine = s * inside / (s * inside + (1 - s) * p)
            shares = np.clip((sums(mine * many) + 1) / (here + 10), 0.01, 0.95)
            shares = np.interp(np.arange(len(shares)), seen, shares[seen])  # no token on a level: as its neighbours
    shares[0] = 0.0  # nothing follows a context never seen
    return shares


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of training tokens by code, summed over the chunks of a task."""
    codes, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        each = [_loaded(x) for x in batch.column(0)]
        if each:
            codes, many = _merged([codes, *(c.astype(np.int64) for c, _ in each)], [many, *(m for _, m in each)])
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(many)], names=["code", "many"])


def train(docs: DataFrame, *, text_col: str = "text", train_col: str = "train", probes: int = 10) -> tuple[LogFrequencyFilter, DataFrame]:
    """``docs(dk[, dk2], train, text)``, one or two key columns -> the filter, and a table of chunks of texts: see ``_met``."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    source = docs.select(*[c for c in ("dk", "dk2") if c in docs.columns], F.col(train_col).alias("train"), F.col(text_col).alias("text"))
    parts = source.rdd.getNumPartitions()
    segments = 1 << max(2, (max(1, parts) - 1).bit_length())  # at most an input split each
    texts = stored(source.mapInArrow(_count, "p long, payload binary"), folder, "texts")
    dealt = texts.mapInArrow(_dealt(segments), _ROWS).repartitionById(segments, F.col("seg")).sortWithinPartitions("seg")
    summed = stored_once(dealt.mapInArrow(_sum_segments(segments, probes), _ROWS), folder, "segments")
    n, v = (float(x or 0) for x in summed.where("kind = 4").agg(F.sum("n"), F.sum("v")).first())
    model = LogFrequencyFilter(segments, probes, summed.where("kind = 4").select("seg", "payload"), n, v)
    back = summed.where("kind <> 4").select("seg", "kind", "p", "payload").unionByName(texts.selectExpr("-1 as seg", "2 as kind", "p", "payload"))
    back = back.repartition(max(1, parts), "p").sortWithinPartitions("p", "seg")
    chunks = stored_once(back.mapInArrow(_chunks, "payload binary, seen binary"), folder, "chunks")
    dropped(texts, folder, "texts")
    tally = chunks.select("seen").mapInArrow(_tally, "code long, many long").groupBy("code").agg(F.sum("many").alias("many")).where("many > 0").toArrow()
    model.shares = fitted_shares(*(c.to_numpy() for c in tally.columns), n, v)
    return model, chunks


def _scores(shares: np.ndarray, n: float, v: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                keys, counts, base, known, codes, at = _loaded(x)
                p, both, up, context = parts_of(codes, n, v)
                s = shares[context]
                score = row_sums(np.log10(s * both / up + (1 - s) * p)[at], counts)
                names = ["dk", "dk2"][: keys.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*np.ascontiguousarray(keys.T), counts, base, known, score)], names=[*names, "n_tokens", "base", "known", "score"])
            give_back()

    return run


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, **options) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    dk, dk2 = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("text"), dk.alias("dk"), dk2.alias("dk2"),
        (crc_remainder(id_col, folds) != 0).alias("train"),
    )
    model, chunks = train(keyed, **options)
    each = chunks.select("payload").mapInArrow(_scores(model.shares, model.n, model.v), "dk long, dk2 long, n_tokens long, base double, known long, score double")
    each = each.groupBy("dk", "dk2").agg(*[F.max(c).alias(c) for c in ("n_tokens", "base", "known", "score")])
    norm = float(np.log10(model.n + 0.1 * (model.v + 1)))
    return spread_join(keyed.select("_id", "dk", "dk2", "train"), each, ["dk", "dk2"]).select(
        F.col("_id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
