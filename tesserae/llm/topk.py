"""Exact top-k inner-product search by a three-phase uniform threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, session

#: Queries of a block, which bounds what is broadcast (their vectors and cutoffs) and collected.
QUERIES = 1 << 15
#: Candidates that are scored at once, and scores.
ROWS, SCORES = 4096, 1 << 22
#: One row of so many takes part in phase 1.
SHARE = 8
#: Runs of components, the most telling first; a pair's score is resolved run by run while it may reach the cutoff.
SEGMENTS = 4
#: Part of the pairs below which those still open are resolved one by one.
SPARSE = 0.05


def usable(vector: str) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False))


def quantised(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and floor(scale * x) of the usable vectors (column v) with an id, for each length."""
    v, sizes = batch.column("v"), pc.fill_null(pc.list_value_length(batch.column("v")), -1).to_numpy(zero_copy_only=False)
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero((sizes == dims) & known)
        x = values[starts[at][:, None] + np.arange(dims)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], np.floor(scale * x[good])


def _exact(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether doubles add and multiply these integers exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53


class Block:
    """Queries of one length, their components in the order of their weight."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, place: np.ndarray) -> None:
        self.order = np.argsort(-(v * v).sum(axis=0), kind="stable")
        self.ids, self.place, self.v = ids, place, np.ascontiguousarray(v[:, self.order])
        self.runs = [s for s in np.array_split(np.arange(v.shape[1]), SEGMENTS) if len(s)]
        self.rest = self._rest(self.v)

    def _rest(self, v: np.ndarray) -> np.ndarray:
        """The norm of what follows each run, a little more than it is."""
        return np.stack([np.sqrt((v[:, r[-1] + 1 :] ** 2).sum(axis=1)) * (1 + 1e-9) for r in self.runs] or [np.zeros(len(v))])

    def scores(self, c: np.ndarray) -> np.ndarray:
        if _exact(self.v, c):
            return self.v @ c[:, self.order].T
        whole = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape)
        return whole(self.v) @ whole(c[:, self.order]).T

    def reaching(self, c: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Pairs whose score is at least the query's cutoff, their scores, and how many products of runs were made.

        A run adds to the scores of all pairs; Cauchy-Schwarz bounds what the runs after it can
        add. When few pairs can still reach their cutoffs, the rest of these scores is resolved alone.
        """
        if not _exact(self.v, c):
            got = self.scores(c)
            i, j = np.nonzero(got >= np.where(np.isfinite(low), low, -np.inf)[:, None].astype(object))
            return i, j, got[i, j], got.size * len(self.runs)
        c = np.ascontiguousarray(c[:, self.order])
        rest, total, made = self._rest(c), np.zeros((len(self.v), len(c))), 0
        for n, r in enumerate(self.runs):
            total += self.v[:, r] @ c[:, r].T
            made += total.size
            if n + 1 == len(self.runs):
                break
            open_ = total + self.rest[n][:, None] * rest[n] >= low[:, None]
            if open_.mean() < SPARSE:
                i, j = np.nonzero(open_)
                more = slice(r[-1] + 1, None)
                score = np.concatenate([total[a, b] + np.einsum("ij,ij->i", self.v[a, more], c[b, more]) for a, b in zip(*(np.array_split(x, 1 + len(i) // 65_536) for x in (i, j)), strict=True)])
                good = score >= low[i]
                return i[good], j[good], score[good], made + len(i) * (len(self.runs) - n - 1)
        i, j = np.nonzero(total >= low[:, None])
        return i, j, total[i, j], made


def _parts(batches: Iterator[pa.RecordBatch], scale: int, blocks: dict[int, Block], share: int):
    """Candidates by length in bounded parts, each with the queries of that length."""
    for b in batches:
        ids = b.column("id")
        for at, c in quantised(b, scale):
            block = blocks.get(c.shape[1])
            if block is None:
                continue
            own = ids.take(pa.array(at)).to_numpy(zero_copy_only=False)
            step = max(1, min(ROWS, SCORES // len(block.v)))
            own, c = own[::share], c[::share]
            for i in range(0, len(c), step):
                yield block, own[i : i + step], c[i : i + step]


def _lists(blocks: dict[int, Block], k: int, scale: int):
    """Phase 1: of each query the k best scores among a share of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for block, own, c in _parts(batches, scale, blocks, SHARE):
            if not _exact(block.v, c):
                continue  # fewer lists lower the cutoff at most
            got = np.where(own == block.ids[:, None], -np.inf, block.scores(c))
            held = best.get(c.shape[1])
            got = got if held is None else np.concatenate([held, got], axis=1)
            best[c.shape[1]] = -np.partition(-got, k - 1, axis=1)[:, :k] if got.shape[1] > k else got
        for dims, got in best.items():
            i, j = np.nonzero(np.isfinite(got))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[dims].place[i], pa.int64()), pa.array(got[i, j].astype(np.int64))], ["q", "score"])

    return run


def _entries(blocks: dict[int, Block], low: dict[int, np.ndarray], scale: int):
    """Phases 2 and 3: the rows that can reach a query's cutoff, with their exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own, c in _parts(batches, scale, blocks, 1):
            i, j, score, _ = block.reaching(c, low[c.shape[1]])
            other = block.ids[i] != own[j]
            i, j, score = i[other], j[other], score[other]
            if len(i):
                exact = [int(x) for x in score] if score.dtype == object else score.astype(np.int64)  # beyond 64 bits an error
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.place[i], pa.int64()), pa.array(block.ids[i], pa.int64()), pa.array(own[j], pa.int64()), pa.array(exact, pa.int64())], ["q", "query_id", "vec_id", "score"])

    return run


def _blocks(rows: pa.Table, scale: int) -> dict[int, Block]:
    out = {}
    for b in rows.combine_chunks().to_batches():
        for at, v in quantised(b, scale):
            out[v.shape[1]] = Block(b.column("id").to_numpy()[at], v, b.column("q").to_numpy()[at])
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each query row: query_id, rank, vec_id, score.

    Components become floor(scale * x); ties go to the smaller id; rows with the query's
    own id take no part, nor do null ids, vectors that are null or hold null or non-finite
    components, or pairs of different lengths. Repeated query rows are asked once, rows of one id and
    different vectors each have their own ranks; repeated candidate rows are ranked each. Fewer than k rows
    are all returned; empty tables give none. A score beyond 64 bits is an error.

    Queries go out in blocks of about 32,768, so what is broadcast is bounded and no candidate is ever shuffled
    or copied; a block is a pass over the candidates. Phase 1 gathers from each task the k best scores of an
    eighth of its rows; the k-th best of all is a cutoff that no answer falls below. Phase 2 broadcasts
    the cutoffs; each task scores its rows run by run of components and keeps the pairs that
    can still reach them. Phase 3 resolves the rest of their scores exactly.
    """
    spark = session(vectors)
    shape = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    rows = shape(vectors).where("id is not null and v is not null")
    asked = shape(queries).where(F.col("id").isNotNull() & usable("v")).dropDuplicates(["id", "v"])
    n = math.ceil(asked.count() / QUERIES)
    asked = cut(asked.withColumns({"block": F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n))), "q": F.monotonically_increasing_id()}), "topk-queries")
    found = None
    for block in range(n):
        blocks = _blocks(asked.where(F.col("block") == block).select("id", "v", "q").toArrow(), scale)
        lists = rows.mapInArrow(_lists(blocks, k, scale), "q bigint, score bigint")
        best = Window.partitionBy("q").orderBy(F.desc("score"))
        kth = lists.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("q", "score").toArrow()  # a row a query at most
        known = dict(zip(kth["q"].to_pylist(), kth["score"].to_pylist(), strict=True))
        low = {dims: np.array([known.get(q, -np.inf) for q in b.place.tolist()], np.float64) for dims, b in blocks.items()}
        part = rows.mapInArrow(_entries(blocks, low, scale), "q bigint, query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = part if n == 1 else cut(part, "topk-found")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
