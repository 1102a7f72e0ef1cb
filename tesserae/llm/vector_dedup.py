"""Near-duplicate vectors by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, session
from .topk import usable

#: Projections of unit vectors on Gaussian directions. Two vectors at cosine 0.98 lie 0.2
#: apart, so a difference of their projections is normal with deviation 0.2.
PROJECTIONS = 24
#: Windows in deviations of a pair at the threshold: of cells by two projections, and of the counts.
CELL_WINDOW, COUNT_WINDOW = 2.75, 2.0
#: Collisions that a pair needs. Binomial(24, 0.954) stays below 18 with a chance under 1e-4.
COLLISIONS = 18
#: Vectors of a cell that are aimed at, and of a block; larger cells are compared in pairs of blocks.
CELL, BLOCK = 4096, 16_384
#: Projections of a cell at most, and how many times fewer vectors a cell has with each.
MOST_CELL, SPREAD = 12, 2.5


@cache
def directions(dims: int) -> np.ndarray:
    """Columns of PROJECTIONS directions for counts, then MOST_CELL ones for cells."""
    return np.random.default_rng(17).standard_normal((PROJECTIONS + MOST_CELL, dims)).T


def cell_projections(vectors: int) -> int:
    """Projections that make a cell, by the distinct vectors of a label."""
    return min(MOST_CELL, max(1, math.ceil(math.log(max(1, vectors / CELL), SPREAD))))


def cell_window(primary: int) -> float:
    """The window of each of ``primary`` projections, so that all together find a pair with the chance that two have."""
    normal = NormalDist()
    chance = (2 * normal.cdf(CELL_WINDOW) - 1) ** 2
    return normal.inv_cdf((1 + chance ** (1 / primary)) / 2)


def deviation(threshold: float) -> float:
    """Of the difference of two projections at the threshold: the distance of the unit vectors."""
    return math.sqrt(2 * (1 - threshold))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length in doubles; they are scaled first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cells(unit: np.ndarray, primary: int, dev: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies of vectors: row, cell, and a bit for each projection in which the copy lies below its home.

    A cell is twice as wide as the window. A vector goes to its home and down to the cells
    that its window reaches, one and a half in each projection on average. Both vectors
    of a pair thus come to the cell of the lower home in each projection, and are
    compared there alone: where no projection has both below their homes.
    """
    window = cell_window(primary) * dev
    p = unit @ directions(unit.shape[1])[:, PROJECTIONS : PROJECTIONS + primary]
    home = np.floor(p / (2 * window)).astype(np.int32)
    below = np.floor((p - window) / (2 * window)).astype(np.int32) < home
    row, cell, bits = np.arange(len(unit)), home, np.zeros(len(unit), np.int32)
    for j in range(primary):
        more = np.flatnonzero(below[row, j])
        down = cell[more].copy()
        down[:, j] -= 1
        row, cell, bits = np.r_[row, row[more]], np.r_[cell, down], np.r_[bits, bits[more] | 1 << j]
    return row, cell, bits


def _copies(dev: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (dims, n), part in b.groupby([b["v"].map(len), "distinct"]):
                raw = np.stack(part["v"].to_numpy())
                primary = cell_projections(int(n))
                row, cell, bits = cells(_unit(raw), primary, dev)
                held = [x.tobytes() for x in raw.astype("<f8" if raw.dtype == np.float64 else "<f4")]
                yield pd.DataFrame({
                    "label": part["label"].to_numpy()[row], "dims": dims, "cell": [x.tobytes() for x in cell], "bits": bits,
                    "id": part["id"].to_numpy()[row], "weight": part["weight"].to_numpy()[row], "v": [held[i] for i in row]})

    return run


def _compare(threshold: float, kind: str):
    width = COUNT_WINDOW * deviation(threshold)

    def side(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        unit = _unit(np.frombuffer(b"".join(rows["v"]), kind).reshape(len(rows), -1))
        return unit, unit @ directions(unit.shape[1])[:, :PROJECTIONS], rows["bits"].to_numpy(), rows["id"].to_numpy(), rows["weight"].to_numpy()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows["i"].iat[0] == rows["j"].iat[0]
        left, right = (rows, rows) if one else (rows[rows["role"] == 0], rows[rows["role"] == 1])
        if left.empty or right.empty:
            return pd.DataFrame({"edge": [], "a": [], "b": []})
        h, ph, bh, hid, hw = side(left)
        e, pe, be, eid, ew = side(right) if not one else (h, ph, bh, hid, hw)
        order = np.argsort(pe, axis=0, kind="stable")
        rank = np.argsort(order, axis=0, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(pe, order, axis=0)
        found_h, found_e = [], []
        step = max(1, (1 << 22) // len(e))
        for at in range(0, len(h), step):
            part = ph[at : at + step]
            first = at if one else 0  # of a block with itself each pair once
            hits = np.zeros((len(part), len(e) - first), np.uint8)
            for j in range(PROJECTIONS):  # a window around each query in each sorted projection
                lo = np.searchsorted(ordered[:, j], part[:, j] - width, "left")[:, None]
                hi = np.searchsorted(ordered[:, j], part[:, j] + width, "right")[:, None]
                hits += (rank[first:, j] >= lo) & (rank[first:, j] < hi)
            x, y = np.nonzero(hits >= COLLISIONS)
            x, y = x + at, y + first
            good = (bh[x] & be[y] == 0) & (hid[x] != eid[y]) & (not one or x < y)
            x, y = x[good], y[good]
            good = np.einsum("ij,ij->i", h[x], e[y]) >= threshold
            found_h.append(x[good])
            found_e.append(y[good])
        x, y = np.concatenate(found_h), np.concatenate(found_e)
        ids, index = np.unique(np.r_[hid[x], eid[y]], return_inverse=True)
        i, j = index[: len(x)], index[len(x) :]
        links = (np.bincount(i, ew[y], len(ids)) + np.bincount(j, hw[x], len(ids))).astype(np.int64)
        root = np.arange(len(ids))
        while len(x):  # the block's own components, so that it sends a star for each
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if np.array_equal(before, root):
                break
        star = root != np.arange(len(ids))
        return pd.concat([pd.DataFrame({"edge": False, "a": ids, "b": links}), pd.DataFrame({"edge": True, "a": ids[star], "b": ids[root[star]]})])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label at a cosine of at least ``threshold``.

    Returns a row per vector: id, n_links, component_id (smallest id reachable), kept (id
    is component_id). Vectors that are null, empty, zero or hold null or non-finite components, null
    labels and null ids link with nothing; vectors of different lengths don't either.
    Equal vectors of a label are compared once and weigh as many links as they are.

    Each vector goes to a cell by its first projections and, one and a half copies for each, to
    those below that its window reaches (``cells``); the more vectors its label has, the more projections
    make a cell, and the wider their windows are. Within a cell the window collisions over the other, sorted
    projections are counted for each pair, and pairs that pass the count are verified by cosine. A
    pair at the threshold itself is found with a chance of 0.988 at every number of cell
    projections; closer ones with more. A cell of over 16,384 vectors is compared in pairs of blocks,
    and blocks send counts and one star per component, never their pairs.
    """
    session(vectors)
    double = dict(vectors.dtypes)[vec_col] == "array<double>"
    good = usable(vec_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)
    plain = vectors.select(F.col(id_col).alias("id"), F.when(good, F.col(label_col)).alias("label"), F.when(good, F.col(vec_col)).alias("v"))
    reps = cut(
        plain.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vector-reps")
    distinct = cut(reps.groupBy("label").agg(F.count("*").alias("distinct")), "vector-labels")
    kind = dict(reps.dtypes)["label"]
    dev = deviation(threshold)
    copies = cut(
        reps.join(distinct, "label").select(F.col("rep").alias("id"), "label", "v", "weight", "distinct")
        .mapInPandas(_copies(dev), f"label {kind}, dims int, cell binary, bits int, id bigint, weight bigint, v binary"), "vector-cells")
    cell = ["label", "dims", "cell"]
    sizes = cut(copies.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cell-sizes")
    dealt = copies.join(sizes, cell).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row goes to the pairs of its block with each block, once
    roles = (
        dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "bits", "id", "weight", "v"))
    found = cut(roles.groupBy(*cell, "i", "j").applyInPandas(_compare(threshold, "<f8" if double else "<f4"), "edge boolean, a bigint, b bigint"), "vector-links")
    links = found.where("not edge").groupBy("a").agg(F.sum("b").alias("n"))
    groups = connected_components(found.where("edge"))
    known = cut(
        reps.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "vector-known")
    out = plain.join(known, ["label", "v"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
