"""Deletion of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, keyed, partitions, session
from .shingles import _ODD
from .suffix_dedup import _mixed, merged, window_minima

#: Lines of a fingerprint. Runs of ``run`` lines hold a window of run - GRAM + 1 of them.
GRAM = 2
#: Lines that are fingerprinted at once.
LINES = 200_000


def line_hashes(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines, the places of those that aren't blank, and their hashes."""
    lines = text.split("\n")
    bare = [x.strip(" \t\r") for x in lines]
    at = np.array([i for i, x in enumerate(bare) if x], np.int64)
    hashes = pd.util.hash_array(np.array([x for x in bare if x], object), categorize=False) if len(at) else np.zeros(0, np.uint64)
    return lines, at, hashes


def fingerprints(h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected places of a text's lines, and for each the hashes of the runs of ``run`` lines around it.

    Winnowing: of each window of bigrams the leftmost least is selected, so any run of
    ``run`` lines holds a selected one, and equal runs select the same. A match on it extends by
    up to run - GRAM lines either way: column o is the run that starts o lines before the place;
    0 where the text has none.
    """
    n = len(h) - run + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros((0, run - GRAM + 1), np.uint64)
    grams = _mixed(h[:-1] * _ODD[0] + h[1:] * _ODD[1])
    picked = np.unique(window_minima(grams, run - GRAM + 1)[1])
    whole = _mixed(sum(h[j : j + n] * _ODD[j % 60] for j in range(run)) + np.uint64(run)) | np.uint64(1)
    starts = picked[:, None] - np.arange(run - GRAM + 1)
    good = (starts >= 0) & (starts < n)
    return picked, np.where(good, whole[np.clip(starts, 0, n - 1)], np.uint64(0))


def _later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries aren't the first of their key by document and place."""
    order = np.lexsort((start, doc, key))
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def _located(run: int, buckets: int):
    """Runs by the bucket of their fingerprint; of equal runs of a batch only the first goes on."""

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            nonlocal held, size
            gram, key, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            # a run that several of its places reach is one entry, under the least of their fingerprints
            order = np.lexsort((gram, start, doc, key))
            gram, key, doc, start = gram[order], key[order], doc[order], start[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))
            gram, key, doc, start = gram[new], key[new], doc[new], start[new]
            again = _later(key, doc, start)
            where = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.flatnonzero(~again)
            order = order[np.argsort(where[order], kind="stable")]
            rows = [(int(where[p[0]]), True, key[p].tobytes(), doc[p].tobytes(), start[p].tobytes()) for p in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(p)]
            rows.append((int(where[0]), False, b"", doc[again].tobytes(), start[again].tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "open", "k", "x", "y"])

        for b in batches:
            for doc, text in zip(b["doc"].tolist(), b["t"].tolist(), strict=True):
                _, _, h = line_hashes(text)
                picked, runs = fingerprints(h, run)
                row, column = np.nonzero(runs)
                if len(row):
                    gram = _mixed(h[picked] * _ODD[0] + h[picked + 1] * _ODD[1])[row]
                    start = picked[row] - column
                    held.append((gram, runs[row, column], np.full(len(row), doc, np.int64), start))
                    size += len(row)
                if size >= LINES:
                    yield flush()
        if held:
            yield flush()

    return flow


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """The runs of a bucket that start earlier elsewhere."""
    read = lambda keep, c, t=np.int64: np.frombuffer(b"".join(rows.loc[rows["open"] == keep, c]), t)
    key, doc, start = read(True, "k", np.uint64), read(True, "x"), read(True, "y")
    again = _later(key, doc, start)
    return pd.DataFrame({"doc": np.concatenate((doc[again], read(False, "x"))), "start": np.concatenate((start[again], read(False, "y")))})


def _cleaned(run: int, carry: int):
    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, starts in zip(b["doc"].tolist(), b["t"].tolist(), b["starts"].tolist(), strict=True):
                if text is None:
                    out.append((doc, None, 0, 0))
                    continue
                lines = text.split("\n")
                if starts is None or not len(starts):
                    out.append((doc, text, len(lines), 0))
                    continue
                s = np.asarray(starts, np.int64)
                _, at, _ = line_hashes(text)
                gone = {int(i) for a, e in merged(s, s + run) for i in at[a:e]}
                out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
            yield pd.DataFrame(out, columns=["doc", "text", "n_lines", "n_removed"]).assign(**{f"c{i}": b[f"c{i}"].array for i in range(carry)})

    return flow


def dedup(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Delete each line covered by a run of ``run`` lines that also starts earlier.

    Lines are compared without spaces, tabs and carriage returns at their ends; blank lines
    count for no run and stay. Earlier means a smaller id, or the same document and an
    earlier line. Returns id, text, n_lines, n_removed and the columns of ``carry``; others are ignored. A
    null text stays null with 0 lines; a text with fewer lines than a run stays as it is;
    an empty table gives none. Rows of one id are documents of their own, in the order of
    their texts; rows of null ids too, and come last.
    """
    spark = session(docs)
    extra = {f"c{i}": c for i, c in enumerate(carry)}
    own = f"c{len(carry)}"  # the id travels as one more carried column
    whole = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *(F.col(c).alias(k) for k, c in extra.items()))).withColumnRenamed("id", own)
    lined = whole.select("doc", "t").where(F.col("t").contains("\n"))
    starts = (
        lined.mapInPandas(_located(run, max(64, 2 * partitions(spark))), "bucket int, open boolean, k binary, x binary, y binary")
        .groupBy("bucket").applyInPandas(_repeated, "doc bigint, start bigint").groupBy("doc").agg(F.collect_list("start").alias("starts")))
    kinds = dict(whole.dtypes)
    schema = "doc bigint, text string, n_lines bigint, n_removed bigint" + "".join(f", {k} {kinds[k]}" for k in [*extra, own])
    out = whole.join(starts, "doc", "left").mapInPandas(_cleaned(run, len(carry) + 1), schema)
    return out.withColumn("doc", F.nullif(own, F.lit(NO_ID))).drop(own).withColumnsRenamed({"doc": id_col, "text": text_col} | extra)
