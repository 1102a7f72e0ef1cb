"""Quality classifier: document evidence combined with host and path posteriors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session
from .shingles import _ODD, word_hashes
from .suffix_dedup import _mixed

#: Labelled documents that the classifier is fitted on, at most; they go to the driver as features.
FIT_ROWS = 12_000
#: Documents of the class that a telling word must occur in, at least and as a part of the class; telling words at most.
WORD_DOCS, WORD_PART, WORDS = 5, 0.01, 1000
#: Log-odds from which a word is telling; a word of few documents reaches it only if all are of the class.
TELLING = 4.5
#: ASCII punctuation ends words; A-Z in lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))
_HEADS = ("low", "toxic")
#: Part of the minima that near copies share, and minima of a run by which they meet.
NEAR, BAND = 0.8, 4
_MINIMA = np.random.default_rng(41).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def structure(texts: list[str | None]) -> np.ndarray:
    """Shape of whole texts: a row of features each."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    firsts = np.cumsum(sizes) - sizes
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), firsts) if len(firsts) else np.zeros(0)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, space, high = (data >= 48) & (data <= 57), data <= 32, data >= 128
    comma = (data == 44) | (data == 46)
    other = ~(upper | lower | digit | space | high | comma)
    hashes, counts = word_hashes(texts, _FOLD)
    doc = np.repeat(np.arange(len(raw)), counts)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))) if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, doc))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(hashes) else np.zeros(0, bool)
    distinct = np.bincount(doc[order][new], minlength=len(raw))
    words = np.maximum(counts, 1)
    chars = np.maximum(sizes - per(space), 1)
    return np.stack([
        per(upper) / chars, per(other) / chars, per(digit) / chars, per(comma) / words, chars / words / 10,
        np.bincount(doc[same], minlength=len(raw)) / words, distinct / words, np.log(distinct + 1) / np.log(words + 2),
        np.log1p(counts) / 10, per(data == 10) / words], axis=1)


def minima(words: np.ndarray) -> np.ndarray:
    """The least hash of a text's word bigrams under each of 64 functions; none for a text of one word."""
    grams = np.unique(words[:-1] * _ODD[0] + words[1:] * _ODD[1])
    return np.array([_mixed(grams * odd).min() for odd in _MINIMA] if len(grams) else [], np.uint64)


def _own_texts(grams: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Whether a document isn't a near copy of a kept one before it with the same labels.

    Near copies have 80 % of their minima in common, an estimate of the Jaccard of their bigrams; they meet by
    runs of four minima. Copies would make chance words of their one text look telling; of
    different labels the words that differ may be what tells.
    """
    kept: dict[tuple, list[int]] = defaultdict(list)
    out = np.ones(len(grams), bool)
    for i, g in enumerate(grams):
        own = [(*labels[i].tolist(), j, g[j : j + BAND].tobytes()) for j in range(0, len(g), BAND)]
        out[i] = not any((g == grams[k]).mean() >= NEAR for k in {k for key in own for k in kept[key]})
        if out[i]:
            for key in own:
                kept[key].append(i)
    return out


def _lexicon(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur in documents of a class far more often than in others: hashes and log-odds."""
    every, back = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    own = np.repeat(y, [len(s) for s in sets])
    inside, whole = np.bincount(back[own > 0], minlength=len(every)), np.bincount(back, minlength=len(every))
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    odds = np.log((inside + 0.5) / (whole - inside + 0.5)) - base
    top = np.flatnonzero((inside >= max(WORD_DOCS, WORD_PART * y.sum())) & (odds >= TELLING))
    top = np.sort(top[np.argsort(-odds[top], kind="stable")[:WORDS]])
    return every[top], odds[top]


def _words(texts: list[str | None], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The most telling word of each text, and the number of telling words."""
    hashes, counts = word_hashes(texts, _FOLD)
    keys, odds = lexicon
    out = np.zeros((len(texts), 2))
    if len(keys) and len(hashes):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == hashes)
        doc = np.repeat(np.arange(len(texts)), counts)[hit]
        np.maximum.at(out[:, 0], doc, odds[at[hit]])
        out[:, 1] = np.log1p(np.bincount(doc, minlength=len(texts)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until the loss falls; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = np.r_[np.full(x.shape[1] - 1, ridge * len(x)), 1e-9]
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + (keep * w * w).sum() / 2
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.clip(np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w), -5, 5)
        while (then := loss(w - step)) > now and np.abs(step).max() >= 1e-6:
            step /= 2
        if then <= now:
            w, now = w - step, then
        if np.abs(step).max() < 1e-6:
            break
    return w


def _inputs(head: int, shape: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Low quality shows in the shape of a text and in words; toxicity in words alone."""
    return np.c_[shape, shape**2, words] if head == 0 else words


@dataclass
class Model:
    """A head for low quality and one for toxic text."""

    mean: np.ndarray
    scale: np.ndarray
    lexicons: list[tuple[np.ndarray, np.ndarray]]
    weights: list[np.ndarray]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        shape = (structure(texts) - self.mean) / self.scale
        return np.stack([np.c_[_inputs(j, shape, _words(texts, lex)), np.ones(len(texts))] @ w for j, (lex, w) in enumerate(zip(self.lexicons, self.weights, strict=True))], 1)


def fit(shape: np.ndarray, sets: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit both heads; y has a column each. Halves take their words from one another, so words aren't scored on their own documents."""
    mean, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    x = (shape - mean) / scale
    lexicons, weights = [], []
    for j in range(len(_HEADS)):
        seen = np.zeros((len(y), 2))
        for half in (0, 1):
            other = np.arange(len(y)) % 2 != half
            keys, odds = _lexicon([s for s, o in zip(sets, other, strict=True) if o], y[other, j])
            for i in np.flatnonzero(~other).tolist():
                hit = np.isin(keys, sets[i]) if len(keys) else np.zeros(0, bool)
                if hit.any():
                    seen[i] = odds[hit].max(), np.log1p(hit.sum())
        lexicons.append(_lexicon(sets, y[:, j]))
        weights.append(_logistic(_inputs(j, x, seen), y[:, j]))
    return Model(mean, scale, lexicons, weights)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["t"].tolist()
        hashes, counts = word_hashes(texts, _FOLD)
        own = np.split(hashes, np.cumsum(counts)[:-1])
        sets, grams = [np.unique(w).tobytes() for w in own], [minima(w).tobytes() for w in own]
        yield pd.DataFrame({"doc": b["doc"], "low": b["low"], "toxic": b["toxic"], "shape": list(structure(texts)), "words": sets, "grams": grams})


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model from at most ``rows`` labelled documents, those of least id hash; None without labels."""
    good = labels.where("doc is not null and low is not null and toxic is not null").groupBy("doc").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    chosen = good.orderBy(F.xxhash64("doc"), "doc").limit(rows)  # bounded by the parameter, so it can be broadcast
    got = docs.join(F.broadcast(chosen), "doc").select("doc", "t", "low", "toxic").mapInPandas(_sampled, "doc bigint, low int, toxic int, shape array<double>, words binary, grams binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values("doc", kind="stable").drop_duplicates("doc")
    got = got[_own_texts([np.frombuffer(g, np.uint64) for g in got["grams"]], got[["low", "toxic"]].to_numpy(np.int64))]
    return fit(np.stack(got["shape"].to_numpy()), [np.frombuffer(w, np.uint64) for w in got["words"]], got[["low", "toxic"]].to_numpy(float))


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            z = model.logits(texts) if model else np.full((len(texts), 2), -30.0)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            either = 1 - (1 - p[:, 0]) * (1 - p[:, 1])
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(x) for x in (p[:, 0], p[:, 1], either))], ["key", "p_low", "p_toxic", "p"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score whole documents as unwanted (low quality or toxic) and decide which stay.

    ``labels`` has ids with quality 0/1 and toxic 0/1. Evidence: two logistic heads over the
    shape of the text and telling words, fitted on a bounded sample of labelled rows
    without near copies of the same labels.
    Priors: the expected share of unwanted documents per host and per path of a host, over all
    documents but the one that is scored; a host's share shrinks toward the global one, a path's toward its host's,
    by a strength that the spread between sites gives (method of moments), so sparse sites
    follow their parents and no document speaks for itself twice. The site's log-odds over the global ones shift the document's.

    Returns id, host, path, p_low, p_toxic, evidence (probability by text), prior (the
    path's), score and keep (score below ``threshold``). Null hosts and paths are
    sites of their own; a null text is an empty one; without usable labels all are
    kept; repeated rows keep a row each; an empty table gives none.
    """
    session(docs)
    # ids, hosts and paths stand in a struct, as pandas would turn whole numbers among nulls into doubles
    key = F.struct(F.col(id_col).alias("doc"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"), key.alias("key"))
    known = labels.select(F.col(id_col).alias("doc"), F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int")).alias("low"), F.coalesce(F.col("toxic"), F.lit(0)).cast("int").alias("toxic"))
    model = fitted(text, known, fit_rows)
    kind = dict(text.dtypes)["key"]
    scores = cut(
        text.select("t", "key").mapInArrow(_scored(model), f"key {kind}, p_low double, p_toxic double, p double").select("key.*", "p_low", "p_toxic", "p"), "quality-scores")
    paths = cut(scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "quality-hosts")
    total = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    overall = min(max((total[1] or 0.0) / max(total[0] or 0, 1), 1e-6), 1 - 1e-6)

    def strength(sites: DataFrame, n: str, mean, center) -> float:
        """Prior documents per site: p(1 - p) / variance between sites - 1, the sampling variance taken off."""
        got = sites.agg(F.sum(F.col(n) * (mean - center) ** 2), F.count("*"), F.sum(n)).first()
        p = overall * (1 - overall)
        between = ((got[0] or 0.0) - p * (got[1] or 0)) / max(got[2] or 0, 1)
        return min(max(p / between - 1, 1.0), 1e6) if between > 0 else 1e6

    k = strength(hosts, "hn", F.col("hs") / F.col("hn"), F.lit(overall))
    sites = paths.join(hosts.select(F.col("host").alias("h"), "hn", "hs"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m = strength(sites, "n", F.col("s") / F.col("n"), (F.col("hs") + k * overall) / (F.col("hn") + k))
    sites = cut(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs"), "quality-sites")
    known = scores.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    of_host = (F.col("hs") - F.col("p") + k * overall) / (F.col("hn") - 1 + k)
    out = known.withColumn("prior", (F.col("s") - F.col("p") + m * of_host) / (F.col("n") - 1 + m))
    odds = lambda c: F.log(c / (1 - c))
    clipped = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))
    shifted = odds(clipped(F.col("p"))) + odds(clipped(F.col("prior"))) - float(np.log(overall / (1 - overall)))
    score = 1 / (1 + F.exp(-shifted))
    return out.select(F.col("doc").alias(id_col), "host", "path", "p_low", "p_toxic", F.col("p").alias("evidence"), "prior", score.alias("score"), (score < threshold).alias("keep"))
