"""Quality rules: counts by word and line, and a linear-chain CRF that marks lines.

Every line becomes a few binary features; Viterbi decoding labels it content or boilerplate,
and a text is kept if content lines hold at least ``min_content`` of its words.  The CRF is
fitted by gradient steps on a bounded sample: lines of documents labelled good count as
content, lines of documents labelled bad, and lines that several sampled documents share,
as boilerplate.

Nulls and empty texts have no words and fail the base rules.  Without labelled rows of both
classes all weights are 0 and every line is content (ties go to content).  Columns named
like the results are replaced.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspan.llm.common import IS_WORD, crc_remainder, distinct_sorted, fresh, give_back, mix, row_sums, span_hashes, text_slices, words_of
from seqspan.llm.sampling import labelled_sample

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True
_LOW[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"'")] = True
_WINDOW = 8
_Q = np.uint64(0xD6E8FEB86659FD93)

RESULT = T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "n_content_lines", "n_lines")])


def _repeated(keys: np.ndarray, all_of_them: bool) -> np.ndarray:
    """Which keys occur twice or more (or: occur earlier in the array)."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = keys[order][1:] == keys[order][:-1]
        same[1:] = equal
        if all_of_them:
            same[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each \\n-split line (a text has one line at least), lines per row."""
    breaks = np.flatnonzero(data == 10)
    per_row = np.diff(np.searchsorted(breaks, offs)) + 1
    first = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    starts = np.empty(int(per_row.sum()), np.int64)
    ends = np.empty(len(starts), np.int64)
    is_first = np.zeros(len(starts), bool)
    is_first[first] = True
    is_last = np.zeros(len(starts), bool)
    is_last[first + per_row - 1] = True
    starts[is_first], starts[~is_first] = offs[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offs[1:], breaks
    return starts, ends, per_row


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def analyse(data: np.ndarray, offs: np.ndarray) -> dict:
    """Base counts of each text, and for each of its lines words and feature row."""
    rows = len(offs) - 1
    starts, ends, counts = words_of(data, offs)
    word = span_hashes(data, starts, ends)
    edge = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(rows), counts)
    salt = mix(np.arange(1, rows + 1).astype(np.uint64))
    repeat = np.zeros(len(word), bool)
    if len(word) >= _WINDOW:
        m = len(word) - _WINDOW + 1
        window = np.zeros(m, np.uint64)
        for k in range(_WINDOW):
            window = window * _Q + word[k : k + m]
        valid = np.flatnonzero(doc[:m] == doc[_WINDOW - 1 :])
        found = valid[_repeated(mix(window[valid]) ^ salt[doc[valid]], True)]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + _WINDOW, -1)
        repeat = np.cumsum(cover[:-1]) > 0
    points = (data & 0xC0) != 0x80
    ls, le, per_row = lines_of(data, offs)
    line_doc = np.repeat(np.arange(rows), per_row)
    at = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    line_words = at[1] - at[0]
    line_hash = span_hashes(data, ls, le)
    dup = _repeated(line_hash ^ salt[line_doc], False) & (line_words > 0)
    run = {k: _running(v) for k, v in {"symbol": _SYMBOL[data], "upper": _UPPER[data], "low": _LOW[data], "word": IS_WORD[data]}.items()}
    of = lambda k: run[k][le] - run[k][ls]
    chars = np.maximum(1, of("word"))
    letters = np.maximum(1, of("upper") + of("low"))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    again_run, repeat_run = _running(again), _running(repeat)
    w = np.maximum(1, line_words)
    last = np.zeros(len(ls), bool)
    some = at[1] > at[0]
    if len(starts):
        last[some] = _STOP[data[ends[at[1][some] - 1] - 1]]
    share = lambda x, y: x / y
    again_share, repeat_share = share(again_run[at[1]] - again_run[at[0]], w), share(repeat_run[at[1]] - repeat_run[at[0]], w)
    symbol, upper = share(of("symbol"), chars), share(of("upper"), letters)
    position = np.arange(len(ls)) - np.repeat(np.concatenate([[0], np.cumsum(per_row)])[:-1], per_row)
    columns = [
        np.ones(len(ls), bool), line_words == 0, (line_words > 0) & (line_words < 4), (line_words >= 4) & (line_words < 10), line_words >= 30,
        symbol > 0.02, symbol > 0.1, symbol > 0.25, upper > 0.3, upper > 0.7, last, dup, again_share > 0.1, again_share > 0.4,
        repeat_share > 0.2, repeat_share > 0.6, position == 0,
    ]
    base = {
        "n_words": counts, "word_chars": row_sums((IS_WORD[data] & points).astype(np.int64), np.diff(offs)),
        "n_symbols": row_sums(_SYMBOL[data].astype(np.int64), np.diff(offs)),
        "n_dup_lines": row_sums(dup.astype(np.int64), per_row), "n_repeat_words": row_sums(repeat.astype(np.int64), counts),
    }
    return {"base": base, "x": np.stack(columns, 1).astype(np.float64), "per_row": per_row, "line_words": line_words, "line_hash": line_hash}


N_FEATURES = 17
NO_MODEL = {"w": np.zeros((N_FEATURES, 2)), "t": np.zeros((2, 2))}


def _by_step(per_row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each line position: rows (longest first) that have it, and the line's number."""
    order = np.argsort(-per_row, kind="stable")
    first = (np.concatenate([[0], np.cumsum(per_row)])[:-1])[order]
    sizes = per_row[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))
        yield order[:m], first[:m] + k


def viterbi(x: np.ndarray, per_row: np.ndarray, model: dict) -> np.ndarray:
    """The best labelling of each row's lines: 0 content, 1 boilerplate (ties: content)."""
    emit = x @ model["w"]
    best = np.zeros((len(per_row), 2))
    back = np.zeros((len(x), 2), np.int8)
    steps = list(_by_step(per_row))
    for k, (rows, line) in enumerate(steps):
        if k == 0:
            best[rows] = emit[line]
            continue
        via = best[rows][:, :, None] + model["t"]
        back[line] = via.argmax(1)
        best[rows] = via.max(1) + emit[line]
    state = best.argmax(1).astype(np.int8)
    out = np.zeros(len(x), np.int8)
    last = per_row - 1
    for k, (rows, line) in reversed(list(enumerate(steps))):
        out[line] = state[rows]
        state[rows] = np.where(last[rows] >= k, back[line, state[rows]] if k else state[rows], state[rows])
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def fit_crf(x: np.ndarray, gold: np.ndarray, per_row: np.ndarray, *, rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> dict:
    """Adagrad on the mean log likelihood by forward-backward over all rows at once."""
    model = {k: v.copy() for k, v in NO_MODEL.items()}
    steps, total = list(_by_step(per_row)), max(1, len(x))
    seen = {k: np.full_like(v, 1e-8) for k, v in model.items()}
    one = np.eye(2)[gold]
    inner = np.ones(len(x), bool)
    inner[np.concatenate([[0], np.cumsum(per_row)])[:-1]] = False
    pairs = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(pairs, (gold[at - 1], gold[at]), 1)
    for _ in range(rounds):
        emit, t = x @ model["w"], model["t"]
        fwd, bwd = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for k, (_, line) in enumerate(steps):
            fwd[line] = emit[line] + (_log_sum(fwd[line - 1][:, :, None] + t, 1) if k else 0)
        for k, (_, line) in reversed(list(enumerate(steps))):
            if k:
                bwd[line - 1] = _log_sum(t + (emit[line] + bwd[line])[:, None, :], 2)
        both = fwd + bwd
        p = np.exp(both - _log_sum(both, 1)[:, None])
        z = _log_sum(both, 1)[at]
        edge = np.exp(fwd[at - 1][:, :, None] + t + (emit[at] + bwd[at])[:, None, :] - z[:, None, None]).sum(0)
        for k, g in (("w", x.T @ (one - p) / total), ("t", (pairs - edge) / total)):
            g = g - l2 * model[k]
            seen[k] += g * g
            model[k] += rate * g / np.sqrt(seen[k])
    return model


def train(texts: pa.Array, y: np.ndarray, *, shared_by: int = 3) -> dict:
    if len(np.unique(y)) < 2:
        return NO_MODEL
    parts = [(i, analyse(d, o)) for i, _, d, o in text_slices(texts)]
    doc = np.concatenate([np.repeat(np.arange(len(a["per_row"])) + i, a["per_row"]) for i, a in parts])
    cat = {k: np.concatenate([a[k] for _, a in parts]) for k in ("x", "per_row", "line_words", "line_hash")}
    h, n = distinct_sorted(cat["line_hash"])
    # a line shared by sampled documents, its copies inside one text not counted
    once = ~_repeated(cat["line_hash"] ^ mix(doc.astype(np.uint64)), False)
    h, n = distinct_sorted(cat["line_hash"][once])
    common = (n[np.searchsorted(h, cat["line_hash"])] >= shared_by) & (cat["line_words"] > 0)
    gold = ((y[doc] == 0) | common).astype(np.int64)
    return fit_crf(cat["x"], gold, cat["per_row"])


def label_array(array: pa.Array, model: dict) -> pa.StructArray:
    cols: dict[str, list[np.ndarray]] = {f.name: [] for f in RESULT.fields}
    for _, _, data, offs in text_slices(array):
        a = analyse(data, offs)
        content = (viterbi(a["x"], a["per_row"], model) == 0) & (a["line_words"] > 0)
        more = {"content_words": row_sums(a["line_words"] * content, a["per_row"]), "n_content_lines": row_sums(content.astype(np.int64), a["per_row"]), "n_lines": a["per_row"]}
        for k, v in (a["base"] | more).items():
            cols[k].append(v)
    whole = [pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for v in cols.values()]
    return pa.StructArray.from_arrays(whole, names=list(cols))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1000, max_lines: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A CRF from at most ``per_class`` documents of each quality label, none of them with more
    than ``max_lines`` lines (such texts are decoded whole, but training steps go line by line)."""
    texts, y, _ = labelled_sample(docs, labels, "quality", crc_remainder(id_col, 5) != 0, id_col=id_col, text_col=text_col, per_class=per_class)
    short = pc.less(pc.count_substring(texts, "\n"), max_lines)
    return train(texts.filter(short), y[short.to_numpy(zero_copy_only=False)])


def checked(docs: DataFrame, model: dict, *, text_col: str = "text", min_words: int = 20, max_repeat: float = 0.30, min_content: float = 0.5) -> DataFrame:
    """``docs`` with the counts of RESULT, base_failed and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield label_array(array, sent.value)
            give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    names = [f.name for f in RESULT.fields]
    out = fresh(docs, [*names, "base_failed", "kept", "_r"]).withColumn("_r", F.arrow_udf(run, RESULT)(F.col(text_col)))
    out = out.select("*", "_r.*").drop("_r")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    content = F.col("content_words") >= min_content * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & content)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = checked(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
