"""Whitening of embeddings: randomised range finder, power passes, Rayleigh-Ritz.

Vectors become whole numbers (``scale`` and ``shift``), so counts and sums are exact.  A random
basis of ``components`` + ``oversample`` directions goes through passes over all centred rows:
each pass gives V Q for the covariance V, its rows summed task by task and then by entry.  The
same product serves the Rayleigh-Ritz step (eigenpairs of Q'VQ with their residuals) and, made
orthonormal, the next pass.  If the residuals of the wanted components are not below
``tolerance`` of the largest eigenvalue after ``passes``, as with spectra that fall slowly, the
basis is expanded to the full dimension, where one more pass is exact.

Only sums of entries reach the driver: dimension times basis width, at most the square of the
dimension (some thousand dimensions; the same is broadcast).  Each pass reads the stored rows
again; nothing is kept in memory between passes.

Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do
vectors of another length than the most frequent one (of two equally frequent, the longer).
Null ids and repeated rows are rows like others.  Eigenvalues below 1e-12 of the trace count
as zero: their whitened values are null, and they have no part in the identity error.  With no
spread at all explained is 0.  A deviation that does not fit a long is null.  Fewer than
``components`` dimensions give as many components.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.llm.common import columns_of, fresh, spare, stored, work_dir
from seqspan.llm.topk import finite, vectors_of

_BATCH = 4096  # rows centred at once
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: 64-bit where that is enough."""
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(sums.astype(np.float64)).max(initial=0)) < 2.0**62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums.astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def totals(rows: DataFrame, column: str, width: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what ``each`` makes of a batch's vectors: ``width`` numbers.

    A task adds up its batches, entries are added across tasks by a grouped sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            x = vectors_of(batch.column(0))
            for i in range(0, len(x), _BATCH):
                total += each(x[i : i + _BATCH])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    parts = rows.select(column).mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    table = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[table.column("at").to_numpy()] = table.column("value").to_numpy()
    return out


class Whitening:
    """Components of a covariance: eigenvalues falling, unit vectors as columns, trace."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float, passes: int, expanded: bool):
        self.n, self.sums, self.values, self.vectors, self.trace, self.passes, self.expanded = n, sums, values, vectors, trace, passes, expanded

    @property
    def spread(self) -> np.ndarray:
        """Which components have any spread."""
        return self.values > 1e-12 * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the square root of the eigenvalue; nan without spread."""
        root = np.sqrt(np.where(self.spread, self.values, np.nan))
        return centred(x, self.n, self.sums) @ self.vectors / root


def fit(rows: DataFrame, n: int, sums: np.ndarray, components: int, oversample: int, passes: int, tolerance: float) -> Whitening:
    """``rows(x)``, longs of one length, all of them in every pass."""
    spark, d = rows.sparkSession, len(sums)
    wanted = min(components, d)

    def product(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """V times basis, and the trace of V."""
        sent = spark.sparkContext.broadcast((n, sums, basis))

        def each(x: np.ndarray) -> np.ndarray:
            n_, sums_, basis_ = sent.value
            c = centred(x, n_, sums_)
            return np.append((c.T @ (c @ basis_)).ravel(), (c * c).sum())

        out = totals(rows, "x", d * basis.shape[1] + 1, each)
        sent.unpersist()
        return out[:-1].reshape(d, -1) / n, float(out[-1]) / n

    def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1][:wanted]
        values, turn = values[order], turn[:, order]
        vectors = basis @ turn
        return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)

    draw = np.random.default_rng(13).standard_normal
    basis = np.linalg.qr(draw((d, min(d, wanted + oversample))))[0]
    done, expanded = 0, basis.shape[1] == d
    while True:
        image, trace = product(basis)
        done += 1
        values, vectors, residuals = ritz(basis, image)
        if expanded or residuals.max(initial=0) <= tolerance * max(values.max(initial=0), 0):
            break
        if done < passes:
            basis = np.linalg.qr(image)[0]
        else:
            basis, expanded = np.linalg.qr(np.concatenate([vectors, draw((d, d))], axis=1))[0], True
    return Whitening(n, sums, np.maximum(values, 0), vectors, trace, done, expanded)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, centred before
    multiplying: one pass for their mean, one for the covariance."""
    at = np.flatnonzero(model.spread)
    if not len(at):
        return 0.0
    sent = rows.sparkSession.sparkContext.broadcast(model)
    mean = totals(rows, "x", len(at), lambda x: sent.value.whitened(x)[:, at].sum(0)) / model.n

    def each(x: np.ndarray) -> np.ndarray:
        w = sent.value.whitened(x)[:, at] - mean
        return (w.T @ w).ravel()

    cov = totals(rows, "x", len(at) ** 2, each).reshape(len(at), -1) / model.n
    return float(np.abs(cov - np.eye(len(at))).max())


def _transformed(sent):
    """Rows (x) -> (deviation, whitened)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x, model = vectors_of(column), sent.value
            deviation, values = [], [np.zeros((0, len(model.values)))]
            for i in range(0, len(x), _BATCH):
                dev = deviations(x[i : i + _BATCH], model.n, model.sums)
                if float(np.abs(dev.astype(np.float64)).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**62:
                    deviation += (dev * dev).sum(1).tolist()
                else:
                    deviation += [v if v < 1 << 63 else None for v in (sum(int(y) ** 2 for y in row) for row in dev)]
                values.append(model.whitened(x[i : i + _BATCH]))
            flat = np.concatenate(values)
            edge = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
            lists = pa.ListArray.from_arrays(edge, pa.array(flat.ravel(), from_pandas=True))
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], names=["deviation", "whitened"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<deviation: bigint, whitened: array<double>>")


def whiten(
    vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8, oversample: int = 8, passes: int = 4, tolerance: float = 1e-12,
    scale: int = 1024, shift: int = 100_000,
) -> DataFrame:
    """The usable rows with their other columns, once for each component (from 1, falling
    eigenvalue): n, deviation (sum of (n x - S)^2), whitened, explained, identity_error."""
    if components < 1 or oversample < 0 or passes < 1:
        raise ValueError("components and passes must be positive, oversample not negative")
    spark, folder = vectors.sparkSession, work_dir(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    others = fresh(vectors, [*ADDED, vector_col])
    kept = F.struct(*columns_of(others), F.lit(True).alias(spare(others, "_some")))
    rows = vectors.where(finite(vector) & (F.size(vector) > 0)).select(kept.alias("row"), F.transform(vector, lambda c: F.floor(c * scale) + shift).alias("x"))
    rows = stored(rows, folder, "rows")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    back = [F.col("row").getField(name).alias(name) for name in others.columns]
    if top is None:
        none = rows.select(*back, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
        return none.withColumns({x: F.lit(0.0) for x in ADDED[3:]})
    d, n = int(top.d), int(top.n)
    rows = rows.where(F.size("x") == d)
    sums = rows.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    s = np.array([int(r.s) for r in sorted(sums, key=lambda r: r.at)], object)
    s = s.astype(np.int64) if max(abs(int(v)) for v in s) < 1 << 62 else s
    model = fit(rows.select("x"), n, s, components, oversample, passes, tolerance)
    error = identity_error(rows.select("x"), model)
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    out = rows.select("row", _transformed(spark.sparkContext.broadcast(model))(F.col("x")).alias("out"))
    out = out.select("row", F.col("out.deviation").alias("deviation"), F.posexplode("out.whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(x) for x in explained]), F.col("at") + 1)
    return out.select(
        *back, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
