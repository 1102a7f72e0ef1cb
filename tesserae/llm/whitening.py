"""Whitening of embeddings from an exact integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session

#: Rows that are multiplied at once, and the size from which an entry counts as this size.
BLOCK, MOST = 4096, 1 << 62
#: Bits of a limb; limbs of all partitions are added as longs.
LIMB = 32
#: An eigenvalue of less than this part of the trace counts as zero.
RANK = 1e-12

SCATTER = "dims int, i int, limb int, part array<bigint>"
WHITE = "id bigint, dims int, deviation bigint, w array<double>"


def _integers(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and floor(scale * entry) of the vectors (column v) without null or non-finite entries, for each length."""
    v = batch.column("v")
    sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for dims in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dims)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            c = values[starts[part][:, None] + np.arange(dims)]
            good = np.isfinite(c).all(axis=1)
            if good.any():
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * c[good])
                yield part[good], np.clip(scaled, -float(MOST), float(MOST)).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """The cross-products of whole numbers: as doubles or longs where no sum can leave them, else as Python's."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if len(y) * most * most < 2**53:
        x = y.astype(np.float64)
        return (x.T @ x).astype(np.int64)
    if len(y) * most * most < 2**63:
        return y.T @ y
    x = y.astype(object)
    return x.T @ x


class Scatter:
    """Count, sums and cross-products of whole vectors, exact at any size."""

    def __init__(self, dims: int) -> None:
        self.n, self.total = 0, np.zeros((dims, dims + 1), object)  # column 0: sums

    def add(self, y: np.ndarray) -> None:
        self.n += len(y)
        sums = y.astype(object).sum(axis=0) if np.abs(y.astype(np.float64)).max(initial=0) * len(y) >= 2**62 else y.sum(axis=0)
        self.total[:, 0] += sums.astype(object)
        self.total[:, 1:] += products(y).astype(object)

    def limbs(self) -> Iterator[tuple[int, int, list[int]]]:
        """Row (-1: the count), number of the limb, limb of each entry; the last limb has the sign."""
        yield -1, 0, [self.n]
        for i, row in enumerate(self.total.tolist()):
            limb = 0
            while any(row):
                done = all(-(1 << LIMB) < x < 1 << LIMB for x in row)
                yield i, limb, [x if done else x & ((1 << LIMB) - 1) for x in row]
                row, limb = [0 if done else x >> LIMB for x in row], limb + 1


def _partials(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        for b in batches:
            for _, y in _integers(b, scale):
                found.setdefault(y.shape[1], Scatter(y.shape[1])).add(y)
        for dims, s in found.items():
            for i, limb, part in s.limbs():
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([i], pa.int32()), pa.array([limb], pa.int32()), pa.array([part], pa.list_(pa.int64()))], ["dims", "i", "limb", "part"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of one row's limbs over all partitions."""
    return rows.iloc[:1].assign(part=[np.sum(np.stack(rows["part"].tolist()), axis=0).tolist()])


class Fit:
    """What whitening needs of all vectors of one length."""

    def __init__(self, dims: int, rows: list, components: int) -> None:
        total = np.zeros((dims, dims + 1), object)
        for r in rows:
            if r.i < 0:
                self.n = int(r.part[0])
            else:
                total[r.i] += np.array([x << (LIMB * r.limb) for x in r.part], object)
        n, self.sums = self.n, [int(x) for x in total[:, 0]]
        exact = n * total[:, 1:] - np.outer(total[:, 0], total[:, 0])  # n times n times the covariance, in whole numbers
        v = np.array([[int(x) / (n * n) for x in row] for row in exact], np.float64)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(sum(int(exact[i, i]) for i in range(dims)) / (n * n))
        self.values = np.where(values[order] > RANK * self.trace, values[order], 0.0)
        self.axes = np.ascontiguousarray(vectors[:, order])
        self.mean = np.array([s / n for s in self.sums], np.float64)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n y - S)^2; None beyond 64 bits."""
        n, s = self.n, self.sums
        about = ((n * y.astype(np.float64) - np.array(s, np.float64)) ** 2).sum(axis=1)
        small = max(map(abs, s)) < 2**61 and n * max(abs(int(y.max())), abs(int(y.min()))) < 2**61
        out: list[int | None] = [None] * len(y)
        if small:
            fits = about < 2**62
            d = n * y[fits] - np.array(s, np.int64)
            for at, x in zip(np.flatnonzero(fits).tolist(), (d * d).sum(axis=1).tolist(), strict=True):
                out[at] = x
        for at in np.flatnonzero((about < 2.0**63 * 1.01) & ~(small & (about < 2**62))).tolist():
            x = sum((n * int(a) - b) ** 2 for a, b in zip(y[at], s, strict=True))
            out[at] = x if x < 2**63 else None
        return out

    def whitened(self, y: np.ndarray) -> list[list[float | None]]:
        with np.errstate(divide="ignore", invalid="ignore"):
            w = ((y - self.mean) @ self.axes) / np.sqrt(self.values)
        return [[x if e else None for x, e in zip(r, self.values.tolist(), strict=True)] for r in w.tolist()]


def _white(fits: dict[int, Fit], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, y in _integers(b, scale):
                fit = fits[y.shape[1]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array([y.shape[1]] * len(at), pa.int32()), pa.array(fit.deviation(y), pa.int64()), pa.array(fit.whitened(y), pa.list_(pa.float64()))],
                    ["id", "dims", "deviation", "w"])

    return run


def whiten(rows: DataFrame, components: int = 8, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of vectors: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become whole numbers floor(scale * entry); entries of over 2^62 then count as 2^62. A constant that is
    added to all entries changes none of the results, so the sums are those of shifted vectors. Each partition
    adds up its count, sums and cross-products exactly (doubles and longs only where no sum can leave them, else
    Python's numbers) and gives them as limbs of 32 bits, which are added row by row of the matrix. n * X'X - S S' is
    formed in whole numbers and only then divided and decomposed. The driver has dims * dims numbers for each
    length of vectors, whatever the number of rows.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; vectors of different lengths are
    whitened apart, each among its own. A component whose eigenvalue is zero has a null ``whitened`` and takes no
    part in ``identity_error`` (null if none is left; ``explained`` is null where the trace is zero). ``deviation`` is
    null beyond 64 bits. Repeated rows and null ids keep a row each and count as often as they occur; an empty
    table gives no rows.
    """
    spark = session(rows)
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    parts = base.mapInArrow(_partials(scale), SCATTER)
    summed = parts.groupBy("dims", "i", "limb").applyInPandas(_summed, SCATTER).collect()  # dims * dims numbers
    by: dict[int, list] = {}
    for r in summed:
        by.setdefault(r.dims, []).append(r)
    fits = {dims: Fit(dims, own, components) for dims, own in by.items()}
    white = cut(base.mapInArrow(_white(fits, scale), WHITE), "whitened")
    each = max((len(f.values) for f in fits.values()), default=0)
    pairs = [(i, j) for i in range(each) for j in range(i, each)]
    off = [F.abs(F.covar_pop(F.get("w", i), F.get("w", j)) - float(i == j)) for i, j in pairs]  # centred as it runs; nulls take no part
    errors = {r.dims: r.e for r in white.groupBy("dims").agg(F.greatest(*off, F.lit(None).cast("double"), F.lit(None).cast("double")).alias("e")).collect()} if pairs else {}
    facts = [(d, f.n, [float(e) / f.trace if f.trace else None for e in f.values], errors.get(d)) for d, f in fits.items()]
    known = spark.createDataFrame(facts, "dims int, n bigint, share array<double>, identity_error double")  # a row for each length
    return (
        white.join(F.broadcast(known), "dims")
        .select("id", "n", "deviation", "identity_error", "share", F.posexplode("w").alias("at", "whitened"))
        .select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("share")[F.col("at")].alias("explained"), "identity_error"))
