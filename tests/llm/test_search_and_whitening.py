"""Exact top-k search and whitening against plain numpy, on odd rows too."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspan.llm import topk, whitening

VEC = "vec_id long, embedding array<double>, rid int, x string, shard int, row string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, k, "x", 7, "r") for k, r in enumerate(rows)], VEC).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---------------------------------------------------------------- 11


def plain_topk(rows, k, scale=256, asks=lambda i: i % 50 == 0):
    """(query id, rank, id, score), queries in order of their vectors' place."""
    some = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for n, (i, q) in enumerate(some):
        if i is None or not asks(i):
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j is None, j or 0) for m, (j, c) in enumerate(some) if m != n and len(c) == len(q))
        out += [(i, r + 1, None if no else j, -s) for r, (s, no, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.mark.parametrize(("shard_rows", "block", "tile", "fan"), [(1 << 16, 256, 4096, 16), (40, 3, 7, 2)])
def test_topk_equals_all_pairs(spark, shard_rows, block, tile, fan):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6)).round(2)
    v[100:240] = v[7]  # a third are copies: ties go to the smaller id
    v[300] = 0
    rows = [(int(i), v[n].tolist()) for n, i in enumerate(rng.permutation(400))]
    out = topk.nearest(frame(spark, rows), shard_rows=shard_rows, block=block, tile=tile, fan=fan)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert got(out) == plain_topk(rows, 5)


def test_topk_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.0, 0.0]), (50, None), (100, [NAN, 1.0]), (1, [INF, 0.0]), (2, [None, 1.0]), (None, [5.0, 5.0]), (None, [5.0, 5.0]),
        (3, [-1.0, 0.001]), (150, [1.0, 2.0, 3.0]), (200, []), (4, []), (-50, [1.0, -1.0]),
    ]
    out = topk.nearest(frame(spark, rows))
    assert got(out) == plain_topk(rows, 5)
    assert [r.vec_id for r in out.where("query_id = -50").orderBy("rank").collect()].count(None) == 2
    assert topk.nearest(frame(spark, rows).limit(0)).count() == 0
    assert got(topk.nearest(frame(spark, rows), query=F.col("vec_id") == 3, k=2)) == plain_topk(rows, 2, asks=lambda i: i == 3)


def test_topk_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-(2**30), 2**30, (60, 3)) / 256 + 0.25
    v[:, 0] = 2.0**21  # sums near 2**58: their last digits differ
    rows = [(n, x.tolist()) for n, x in enumerate(v)]
    assert got(topk.nearest(frame(spark, rows), tile=7)) == plain_topk(rows, 5)
    with pytest.raises(ValueError):
        topk.nearest(frame(spark, rows), k=0)


# ---------------------------------------------------------------- 13


def plain_whitening(vectors, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors])
    n = len(x)
    c = x - x.mean(0)
    values, turn = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(values)[::-1][:components]
    return x, values[order], turn[:, order], c @ turn[:, order] / np.sqrt(values[order]), values.sum()


@pytest.mark.parametrize("decay", [0.2, 0.999])
def test_whitening_equals_plain_eigenvectors(spark, decay):
    """A spectrum that falls fast is met by power passes, a flat one in the full dimension."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(700, 24)) * decay ** np.arange(24) + 0.3
    v = v @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = [(n, x.tolist()) for n, x in enumerate(v)]
    out = whitening.whiten(frame(spark, rows)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    x, values, _, white, trace = plain_whitening(v)
    assert len(out) == 700 * 8 and {r.n for r in out} == {700} and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    found = np.zeros((700, 8))
    for r in out:
        found[r.vec_id, r.component - 1] = r.whitened
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9)
    sign = np.sign((found * white).sum(0))
    assert np.abs(found * sign - white).max() < 1e-6
    sums = x.sum(0)
    exact = [sum((700 * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert all(r.deviation == exact[r.vec_id] for r in out)


def test_passes_end_early_or_expand(spark):
    rng = np.random.default_rng(9)
    for decay, expanded in ((0.1, False), (1.0, True)):
        v = (rng.normal(size=(300, 40)) * np.maximum(decay ** np.arange(40), 1e-5) * 1e6).astype(np.int64)
        rows = spark.createDataFrame([(x,) for x in v.tolist()], "x array<long>")
        model = whitening.fit(rows, 300, v.sum(0), components=4, oversample=4, passes=6, tolerance=1e-10)
        assert model.expanded is expanded and model.passes <= 7


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(10)
    good = rng.normal(size=(30, 3)).tolist()
    rows = [(k, v) for k, v in enumerate(good)] + [(0, good[0]), (None, good[1]), (90, None), (91, [NAN, 0.0, 0.0]), (92, [None, 1.0, 1.0]), (93, [INF, 0.0, 0.0]), (94, []), (95, [1.0])]
    df = frame(spark, rows)
    out = whitening.whiten(df.withColumns({"component": F.lit("gone"), "a.b": F.lit(1)}))
    assert out.columns == ["vec_id", "rid", "x", "shard", "row", "a.b", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    taken = out.collect()
    assert len(taken) == 32 * 3 and {r.n for r in taken} == {32} and {r.vec_id for r in taken} == {*range(30), None}
    assert math.isclose(sum(r.explained for r in taken if r.vec_id == 5), 1.0)
    assert whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns and whitening.whiten(df.limit(0)).count() == 0
    alone = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(0, None, 0.0, 0.0)] * 2
    line = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])).where("vec_id = 4").orderBy("component").collect()
    assert line[0].whitened is not None and [r.whitened for r in line[1:]] == [None, None] and math.isclose(line[0].explained, 1.0)


def test_whitening_deviation_of_large_sums():
    x = np.array([[3 * 10**9, -5], [-(3 * 10**9), 7]])
    dev = whitening.deviations(x, 4 * 10**9, x.sum(0))
    assert [[int(a) for a in r] for r in dev] == [[4 * 10**9 * int(v) - int(s) for v, s in zip(r, x.sum(0), strict=True)] for r in x]
    c = whitening.centred(x, 4 * 10**9, x.sum(0))
    assert np.allclose(c, [[float(Fraction(int(v)) - Fraction(int(s), 4 * 10**9)) for v, s in zip(r, x.sum(0), strict=True)] for r in x])
