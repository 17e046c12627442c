"""Exact edit distances of many pairs at once: bit-parallel columns over numpy words.

``F.levenshtein`` takes some 17 ns for each cell of the distance matrix; here one machine
word holds 64 cells of a column and a numpy call takes a step of a whole Arrow batch, which
is many times faster as long as most of the matrix is needed.  A ``Block`` of texts is set up
once and compared with one text after the other, each with its own limit; what leaves its
limit leaves the block.  Small limits of single pairs are quicker in the JVM:
``F.levenshtein(a, b, limit)`` looks at a band only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 4096  # pairs of a step: their words stay in the cache
_ONE = np.uint64(1)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters (code points) of all texts in one array, and the edges of each text."""
    n = len(texts)
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        _, offsets, data = texts.buffers()
        edge = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
        return raw.astype(np.uint32), edge - edge[0]
    each = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts.to_pylist()]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def table_of(chars: np.ndarray, edge: np.ndarray, fill: int) -> np.ndarray:
    """One text a row, filled up on the right."""
    size = np.diff(edge)
    out = np.full((len(size), int(size.max(initial=0))), fill, chars.dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = chars
    return out


#: a distance beyond its limit, and no limit
FAR = np.int32(1 << 30)
_CHECK = 8  # columns between looks at what can still stay within its limit


class Block:
    """Texts as bit patterns: word w of text r holds letters 64 w to 64 w + 63, one bit each.

    ``places[k, w, r]`` has the bits where letter ``kinds[k]`` stands; the last kind stands for
    letters that no text of the block has."""

    def __init__(self, chars: np.ndarray, edge: np.ndarray):
        self.kinds, number = np.unique(chars, return_inverse=True)
        self.size = np.diff(edge)
        n, words = len(self.size), max(1, -(-int(self.size.max(initial=0)) // 64))
        rows = np.full((n, 64 * words), len(self.kinds), np.int32)
        rows[np.arange(64 * words) < self.size[:, None]] = number
        self.places = np.zeros((len(self.kinds) + 1, words, n), np.uint64)
        for k in range(len(self.kinds)):
            self.places[k] = np.packbits(rows == k, axis=1, bitorder="little").view(np.uint64).T
        inside = np.packbits(rows < len(self.kinds), axis=1, bitorder="little").view(np.uint64)
        self.inside = np.ascontiguousarray(inside.T)

    def numbers(self, chars: np.ndarray) -> np.ndarray:
        """Letters as rows of ``places``."""
        if not len(self.kinds):
            return np.zeros(len(chars), np.int64)
        at = np.minimum(np.searchsorted(self.kinds, chars), len(self.kinds) - 1)
        return np.where(self.kinds[at] == chars, at, len(self.kinds))

    def distances(self, text: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Of every text of the block to ``text``; ``FAR`` beyond ``limit``, one for each text.

        A column's bits are its steps up and down, so its last cell is a count of bits, and the
        distance is at least that cell less the columns left: texts that cannot come back
        within their limit leave the block."""
        out, rows = np.full(len(self.size), FAR, np.int32), None
        if limit is not None:
            near = np.abs(self.size - len(text)) <= limit
            if not near.all():
                rows = np.flatnonzero(near)
        places, inside = (self.places, self.inside) if rows is None else (self.places[:, :, rows], self.inside[:, rows])
        rows = np.arange(len(self.size)) if rows is None else rows
        if not len(rows):
            return out
        up, down = np.full(inside.shape, ~np.uint64(0)), np.zeros(inside.shape, np.uint64)
        letter, left = self.numbers(text), len(text)
        first = 0 if limit is None else int(limit[rows].min())  # no cell exceeds its limit before this column
        for j, k in enumerate(letter):
            _step(places[k], up, down)
            left -= 1
            if limit is not None and (j + 1) % _CHECK == 0 and j >= first and left:
                low = _last_cell(up, down, inside, j + 1) - left
                keep = low <= limit[rows]
                many = np.count_nonzero(keep)
                if not many:
                    return out
                if 4 * many <= 3 * len(rows):
                    rows, up, down, places, inside = rows[keep], up[:, keep], down[:, keep], places[:, :, keep], inside[:, keep]
        d = _last_cell(up, down, inside, len(text))
        out[rows] = d if limit is None else np.where(d <= limit[rows], d, FAR)
        return out


def _last_cell(up: np.ndarray, down: np.ndarray, inside: np.ndarray, column: int) -> np.ndarray:
    return column + np.bitwise_count(up & inside).sum(0, dtype=np.int32) - np.bitwise_count(down & inside).sum(0, dtype=np.int32)


def _step(eq: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
    """One column further, word by word; ``up`` and ``down`` (words, texts) are changed."""
    top, rise, fall = np.uint64(63), _ONE, None
    for w in range(len(up)):
        u, d, e = up[w], down[w], eq[w]
        vertical = e | d
        if fall is not None:
            e = e | fall
        across = e & u
        across += u
        across ^= u
        across |= e
        minus = u & across
        plus = across
        plus |= u
        np.invert(plus, out=plus)
        plus |= d
        if w + 1 < len(up):
            carry, fall_next = plus >> top, minus >> top
        plus <<= _ONE
        plus |= rise
        minus <<= _ONE
        if fall is not None:
            minus |= fall
        np.bitwise_and(plus, vertical, out=d)
        vertical |= plus
        np.invert(vertical, out=vertical)
        np.bitwise_or(minus, vertical, out=u)
        if w + 1 < len(up):
            rise, fall = carry, fall_next


def column_distances(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, kinds: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Distances of rows of ``a`` and ``b``: tables of letter numbers below ``kinds``; ``FAR``
    beyond ``limit``, one for each pair.  Rows whose text of ``b`` has ended wait."""
    n, width = a.shape
    words = max(1, -(-width // 64))
    padded = np.full((n, 64 * words), kinds, a.dtype)
    padded[:, :width] = a
    places = np.zeros((kinds + 1, words, n), np.uint64)
    for k in range(kinds):
        places[k] = np.ascontiguousarray(np.packbits(padded == k, axis=1, bitorder="little")).view(np.uint64).T
    inside = np.ascontiguousarray(np.packbits(padded < kinds, axis=1, bitorder="little").view(np.uint64).T)
    out, rows = np.full(n, FAR, np.int32), np.arange(n)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    ended = b_size == 0
    out[ended] = a_size[ended]
    for j in range(b.shape[1]):
        keep = b_size[rows] > j
        if limit is not None and j % _CHECK == 0 and j:
            keep &= _last_cell(up, down, inside[:, rows], j) - (b_size[rows] - j) <= limit[rows]
        if not keep.all():
            rows, up, down = rows[keep], up[:, keep], down[:, keep]
        if not len(rows):
            break
        letter = b[rows, j]
        _step(np.stack([places[letter, w, rows] for w in range(words)]), up, down)
        done = np.flatnonzero(b_size[rows] == j + 1)
        if len(done):
            out[rows[done]] = _last_cell(up[:, done], down[:, done], inside[:, rows[done]], j + 1)
    return out if limit is None else np.where(out <= limit, out, FAR)


def pairs_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Distances of texts ``x`` of ``a`` and texts ``y`` of ``b``, side by side."""
    (a_chars, a_edge), (b_chars, b_edge) = a, b
    kinds, number = np.unique(np.concatenate([a_chars, b_chars]), return_inverse=True)
    left, right = table_of(number[: len(a_chars)], a_edge, len(kinds)), table_of(number[len(a_chars) :], b_edge, len(kinds))
    out = np.full(len(x), FAR, np.int32)
    for i in range(0, len(x), _SLICE):
        p, q = x[i : i + _SLICE], y[i : i + _SLICE]
        out[i : i + _SLICE] = column_distances(left[p], np.diff(a_edge)[p], right[q], np.diff(b_edge)[q], len(kinds), None if limit is None else limit[i : i + _SLICE])
    return out


def tile_distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], limit: np.ndarray | None = None, slack: int | None = None, allowed: np.ndarray | None = None) -> np.ndarray:
    """Distances of all texts of ``a`` (rows) to all of ``b`` (columns), texts as ``letters`` gives
    them; ``FAR`` beyond the row's ``limit`` and where ``allowed`` is not.

    With ``slack`` a row's limit falls to its least distance so far plus slack, so what can be
    neither nearest nor that near to the nearest may be ``FAR``."""
    (a_chars, a_edge), (b_chars, b_edge) = a, b
    n, m = len(a_edge) - 1, len(b_edge) - 1
    out = np.full((n, m), FAR, np.int32)
    wanted = n * m if allowed is None else np.count_nonzero(allowed)
    if not wanted:
        return out
    if wanted <= 4 * _SLICE or 8 * wanted <= n * m:  # few pairs: one by one, side by side
        x, y = np.divmod(np.arange(n * m), m) if allowed is None else np.nonzero(allowed)
        out[x, y] = pairs_of(a, b, x, y, None if limit is None else limit[x])
        return out
    if n >= m or slack is not None:
        block, now = Block(a_chars, a_edge), limit
        if slack is not None and limit is None:
            now = np.full(n, FAR, np.int32)
        for k in range(m):
            least = now if allowed is None else np.where(allowed[:, k], FAR if now is None else now, -1)
            out[:, k] = block.distances(b_chars[b_edge[k] : b_edge[k + 1]], least)
            if slack is not None:
                now = np.minimum(now, out[:, k] + slack)
        return out
    block = Block(b_chars, b_edge)
    for k in range(n):
        least = None if limit is None else np.full(m, limit[k], np.int32)
        if allowed is not None:
            least = np.where(allowed[k], FAR if least is None else least, -1)
        out[k] = block.distances(a_chars[a_edge[k] : a_edge[k + 1]], least)
    return out


def pair_distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Distances of texts without nulls, pair by pair."""
    a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
    out = np.zeros(len(a), np.int32)
    for i in range(0, len(a), _SLICE):
        (x, x_edge), (y, y_edge) = letters(a.slice(i, _SLICE)), letters(b.slice(i, _SLICE))
        kinds, number = np.unique(np.concatenate([x, y]), return_inverse=True)
        number = number.astype(np.int64)
        left, right = table_of(number[: len(x)], x_edge, len(kinds)), table_of(number[len(x) :], y_edge, len(kinds))
        out[i : i + _SLICE] = column_distances(left, np.diff(x_edge), right, np.diff(y_edge), len(kinds))
    return out
