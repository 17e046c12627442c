"""Bytes, words and hashes under the text operators."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqspan.llm import common, linededup
from seqspan.llm.linededup import common_blocks, patience, runs_of
from seqspan.llm.rules import NO_MODEL, label_array, viterbi
from seqspan.llm.simhash import near_pairs

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t#.1", max_size=40)), max_size=8)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1 << 20]))
def test_words_as_the_pattern_cuts_them(texts, limit):
    got = []
    for _, _, data, offs in common.text_slices(pa.array(texts, pa.string()), limit):
        s, e, n = common.words_of(data, offs)
        flat = [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
        edge = np.concatenate([[0], np.cumsum(n)])
        got += [flat[a:b] for a, b in zip(edge, edge[1:], strict=False)]
    assert got == [words(t) for t in texts]


def test_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(common, "_HASH_SPAN", 64)
    rng = np.random.default_rng(0)
    spans = [b"x" * 5, b"", b"y" * 64, b"z" * 200, b"x" * 5, b"y" * 64, b"", b"z" * 200] + [bytes(rng.integers(97, 99, 3)) for _ in range(200)]
    edge = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    h = common.span_hashes(np.frombuffer(b"".join(spans), np.uint8), edge[:-1], edge[1:])
    by = {}
    for s, x in zip(spans, h.tolist(), strict=True):
        assert by.setdefault(s, x) == x
    assert len(set(by.values())) == len(by)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=14), st.lists(st.integers(1, 6), max_size=14))
def test_patience_is_an_alignment(a, b):
    out = patience(a, b)
    assert all(a[i] == b[j] for i, j in out)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(out, out[1:], strict=False))
    assert patience(a, a) == [(k, k) for k in range(len(a))]


def cut_lines(a, b, words, least):
    """Lines of ``b`` (0: a blank line) that an earlier ``a`` takes away."""
    size = dict(zip(b, words, strict=True))
    runs = []
    for x in (a, b):
        found = runs_of(np.array(x, np.uint64), np.array([size.get(h, 5) if h else 0 for h in x]), np.array([len(x)]), least)
        by = {}
        for h, first, last in zip(*(c.tolist() for c in found[1:]), strict=True):
            by.setdefault(h, []).extend((first, last))
        runs.append(by)
    aligned, rest = common_blocks([(h, runs[0][h][0], at) for h, at in runs[1].items() if h in runs[0]])
    return sorted(aligned | rest)


def test_blocks_skip_blank_lines_and_short_runs():
    assert cut_lines([1, 2, 3], [9, 1, 0, 2, 3, 8, 1], [5] * 7, 15) == [1, 2, 3, 4]
    assert cut_lines([1, 2, 3], [9, 1, 0, 2, 3, 8, 1], [5] * 7, 16) == []


def test_common_blocks_held_twice_or_in_another_order():
    passage = [1, 2, 3]
    assert cut_lines([7, *passage, 8], [4, *passage, 5, *passage, 6], [5] * 9, 15) == [1, 2, 3, 5, 6, 7]
    assert cut_lines([7, *passage, 9, *passage, 8], [4, *passage, 5], [5] * 5, 15) == [1, 2, 3]
    assert cut_lines([1, 2, 7, 3, 4], [3, 4, 8, 1, 0, 2], [10] * 6, 20) == [0, 1, 3, 4, 5]
    # a short line is covered from either end of its block
    assert cut_lines([6, 1, 2, 3, 7], [1, 2, 3, 9, 1, 2, 3], [18, 2, 5, 9, 18, 2, 5], 20) == [0, 1, 2, 4, 5, 6]


def test_nothing_is_cut_without_an_alignment(monkeypatch):
    shared = [(11, 0, [0, 3]), (12, 5, [4, 9, 20, 25])]
    assert common_blocks(shared) == (set(range(10)), set(range(20, 26)))
    monkeypatch.setattr(linededup, "patience", lambda a, b: [])
    assert common_blocks(shared) == (set(), set())


def test_each_copy_and_each_moved_passage_comes_from_an_alignment(monkeypatch):
    calls = []

    def watched(a, b):
        calls.append(patience(a, b))
        return calls[-1]

    monkeypatch.setattr(linededup, "patience", watched)
    one, two, three = (1, 0, [0, 2, 10, 12, 20, 22]), (2, 4, [5, 7]), (3, 8, [3, 4])  # one thrice, three before two
    aligned, later = common_blocks([one, two, three])
    assert aligned | later == {*range(8), *range(10, 13), *range(20, 23)} and len(later) >= 8
    matched = [k for found in calls for k in found]
    assert len(matched) == 5 and len([x for x in calls if x]) >= 3  # as many alignments as the passage has copies


@settings(deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12), st.integers(2, 9))
def test_common_blocks_are_all_runs_held_by_both(a, b, least):
    words = [1 + h % 3 for h in b]
    want = set()
    for i in range(len(b)):
        for e in range(i + 1, len(b) + 1):
            if sum(words[i:e]) >= least and any(a[k : k + e - i] == b[i:e] for k in range(len(a))):
                want |= set(range(i, e))
    assert cut_lines(a, b, words, least) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_near_pairs_join_what_all_pairs_join(n):
    rng = np.random.default_rng(n)
    centers = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(centers[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)))[:, None]

    def roots(pairs):
        up = list(range(len(fps)))
        for i, j in pairs:
            while up[i] != i:
                i = up[i]
            while up[j] != j:
                j = up[j]
            up[max(i, j)] = min(i, j)
        out = []
        for i in range(len(fps)):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    every = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i, 0] ^ fps[j, 0])).count("1") <= 3]
    a, b = near_pairs(fps, 3, 0)
    assert roots(zip(a.tolist(), b.tolist(), strict=True)) == roots(every)
    assert len(a) <= max(4 * len(fps), len(every))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    model = {"w": rng.normal(size=(17, 2)), "t": rng.normal(size=(2, 2))}
    sizes = np.array([3, 1, 5, 2])
    x = rng.normal(size=(sizes.sum(), 17))
    got, at = viterbi(x, sizes, model), 0
    for n in sizes:
        emit = x[at : at + n] @ model["w"]
        score = lambda path: sum(emit[k, y] for k, y in enumerate(path)) + sum(model["t"][p, q] for p, q in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(([int(c) for c in np.binary_repr(m, n)] for m in range(2**n)), key=score)
        assert got[at : at + n].tolist() == best
        at += n


def plain_counts(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="a b\n#", max_size=120)), min_size=1, max_size=6))
def test_base_counts(texts):
    out = label_array(pa.array(texts, pa.string()), NO_MODEL).to_pylist()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [[r[k] for k in names] for r in out] == [plain_counts(t) for t in texts]
    assert all(r["content_words"] == r["n_words"] for r in out)  # without a model every line is content
