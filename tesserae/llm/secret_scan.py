"""Secrets in texts: plain patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session

# The plain patterns, the least length of what counts, the group that is counted.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 6, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24, 0))
#: No assignment is in a text without one of these, whatever its case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = (*(p[0] for p in PATTERNS), "random")
#: Runs of characters of encodings that are tested, from this length on, with their padding.
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)

# The encodings, fewest symbols first, each in the order of its digits.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("hex-upper", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER), ("base36-upper", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"), ("mixed", UPPER + LOWER + DIGITS + "+/-_"))
#: All symbols; pairs of neighbours are counted over these.
SYMBOLS = UPPER + LOWER + DIGITS + "+/-_"
_OF = np.full(256, len(SYMBOLS), np.uint16)
_OF[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))

#: Share of false discoveries; a string that randomness would give less often than RANDOM isn't random.
LEVEL, RANDOM = 0.01, 0.001
#: Bins of a p-value's decimal logarithm for each unit, and the least logarithm.
BINS, LEAST = 100, -300

FOUND = "id string, pairs array<bigint>, kind array<int>, starts array<int>, ends array<int>, encoding array<int>, n array<int>, same array<double>, runs array<int>, serial array<double>"
JUDGED = "id string, kind array<int>, starts array<int>, ends array<int>, stratum array<int>, logp array<double>, random array<boolean>"


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns, the leftmost of each kind that don't overlap; too short ones are dropped."""
    low = text.lower()
    skip = {0} if not any(h in low for h in HINTS) else set()
    return [(k, *m.span()) for k, (_, pattern, least, group) in enumerate(PATTERNS) if k not in skip for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def inferred(token: str) -> int:
    """Number of the encoding with the fewest symbols that has all of a token's."""
    used = set(token)
    return next(i for i, s in enumerate(_sets()) if used <= s)


@lru_cache(maxsize=1)
def _sets() -> list[frozenset]:
    return [frozenset(s) for _, s in ENCODINGS]


@lru_cache(maxsize=1)
def _digits() -> list[np.ndarray]:
    """For each encoding the digit of each byte."""
    out = []
    for _, symbols in ENCODINGS:
        table = np.full(256, -1, np.int64)
        table[np.frombuffer(symbols.encode(), np.uint8)] = np.arange(len(symbols))
        out.append(table)
    return out


def statistics(token: str, encoding: int) -> tuple[int, float, int, float]:
    """Length, pairs of equal symbols (what the chi-squared statistic counts), changes between the halves of the alphabet, sum of products of neighbours."""
    k = len(ENCODINGS[encoding][1])
    v = _digits()[encoding][np.frombuffer(token.encode(), np.uint8)]
    counts = np.bincount(v, minlength=k).astype(np.float64)
    high, x = v >= k / 2, v - (k - 1) / 2
    return len(v), float((counts * (counts - 1)).sum() / 2), int((high[1:] != high[:-1]).sum()), float((x[1:] * x[:-1]).sum())


class Battery:
    """Moments of the three statistics for random strings and for ordinary text of an encoding.

    Each statistic is a sum over pairs, so that its mean is exact under both. Ordinary text has the corpus's own
    symbols and neighbours, as far as they belong to the encoding.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs = pairs.reshape(len(SYMBOLS), len(SYMBOLS)).astype(np.float64)
        self.facts = [self._facts(symbols) for _, symbols in ENCODINGS]

    def _facts(self, symbols: str) -> dict[str, float]:
        k, at = len(symbols), _OF[np.frombuffer(symbols.encode(), np.uint8)]
        both = self.pairs[np.ix_(at, at)] + 1 / k  # pairs that never occur aren't impossible
        both /= both.sum()
        p, v = (both.sum(axis=0) + both.sum(axis=1)) / 2, np.arange(k) - (k - 1) / 2
        change, product = (v[:, None] >= 0) != (v[None, :] >= 0), v[:, None] * v[None, :]
        mean = float((both * product).sum())
        return {
            "k": k, "s2": float((p**2).sum()), "s3": float((p**3).sum()), "change": float(both[change].sum()), "even": float(change.mean()),
            "serial": mean, "serial_var": float((both * product**2).sum()) - mean**2, "square": float(product.var())}

    @staticmethod
    def _collisions(n: float, s2: float, s3: float) -> tuple[float, float]:
        pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
        return pairs * s2, pairs * (s2 - s2**2) + 6 * triples * (s3 - s2**2)

    def judge(self, encoding: int, n: int, same: float, runs: int, serial: float) -> tuple[float, bool]:
        """Decimal logarithm of the chance that ordinary text looks as random, and whether randomness would give this.

        Against ordinary text, the statistics' distances are weighted by how far random strings of this length would be
        from it, so that what tells most counts most. Against randomness, the least of three two-sided chances counts three times.
        """
        f, m = self.facts[encoding], n - 1
        random = [self._collisions(n, 1 / f["k"], 1 / f["k"] ** 2), (m * f["even"], m * f["even"] * (1 - f["even"])), (0.0, m * f["square"])]
        usual = [self._collisions(n, f["s2"], f["s3"]), (m * f["change"], m * f["change"] * (1 - f["change"])), (m * f["serial"], m * f["serial_var"])]
        total = weight = 0.0
        worst = 1.0
        for x, (mean, var), (own, own_var) in zip((same, runs, serial), random, usual, strict=True):
            worst = min(worst, math.erfc(abs(x - mean) / math.sqrt(2 * max(var, 1e-12))))
            sd = math.sqrt(max(own_var, 1e-12))
            far = (mean - own) / sd
            total, weight = total + far * (x - own) / sd, weight + far * far
        z = total / math.sqrt(weight) if weight > 0 else 0.0
        return log_tail(z), 3 * worst >= RANDOM


def log_tail(z: float) -> float:
    """Decimal logarithm of the chance that a normal variable is above z."""
    if z < 30:
        return math.log10(max(math.erfc(z / math.sqrt(2)) / 2, 1e-300))
    return max(float(LEAST), (-z * z / 2 - math.log(z * math.sqrt(2 * math.pi))) / math.log(10))


def stratum(encoding: int, n: int) -> int:
    """Encoding and length class; lengths of a class differ by at most a half."""
    return encoding * 100 + min(99, int(2 * math.log2(n)))


def neighbours(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring symbols, first by second."""
    wide, text = len(SYMBOLS) + 1, np.frombuffer("\n".join(texts).encode(), np.uint8)
    counts = np.zeros(wide * wide, np.int64)
    for i in range(0, len(text), 1 << 18):
        of = _OF[text[i : i + (1 << 18) + 1]]
        counts += np.bincount(of[:-1] * np.uint16(wide) + of[1:], minlength=wide * wide)
    return counts.reshape(wide, wide)[:-1, :-1].ravel()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FOUND.split(", ")]
    seen = None
    for b in batches:
        rows = []
        for i, t in zip(b["id"].tolist(), b["t"].tolist(), strict=True):
            spans, tested = plain_spans(t), []
            for m in CANDIDATE.finditer(t):
                token = m.group().rstrip("=")
                encoding = inferred(token)
                tested.append((len(KINDS) - 1, *m.span(), encoding, *statistics(token, encoding)))
            tested += [(*s, -1, 0, 0.0, 0, 0.0) for s in spans]
            rows.append((i, None, *([list(c) for c in zip(*tested, strict=True)] or [[] for _ in names[2:]])))
        counts = neighbours(b["t"].tolist())
        seen = counts if seen is None else seen + counts
        yield pd.DataFrame(rows, columns=names)
    if seen is not None:
        yield pd.DataFrame([(None, seen.tolist(), *[None] * (len(names) - 2))], columns=names)


def _judged(counts: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        battery = Battery(np.array(counts))
        for b in batches:
            strata, logs, random = [], [], []
            for row in zip(b["encoding"], b["n"], b["same"], b["runs"], b["serial"], strict=True):
                own = [(stratum(e, n), *battery.judge(int(e), int(n), s, int(r), c)) if e >= 0 else (-1, 0.0, False) for e, n, s, r, c in zip(*row, strict=True)]
                for to, k in ((strata, 0), (logs, 1), (random, 2)):
                    to.append([x[k] for x in own])
            yield b[["id", "kind", "starts", "ends"]].assign(stratum=strata, logp=logs, random=random)

    return run


def weights(strata: list[tuple[int, int, int]]) -> dict[int, float]:
    """For each stratum (number, tests, those with p above a half) the logarithm of its share of ordinary strings over that of random ones."""
    out = {}
    for s, tests, above in strata:
        usual = min(0.99, max(0.01, (above + 1) / (0.5 * tests)))
        out[s] = math.log10(usual / (1 - usual))
    return out


def threshold(bins: list[tuple[int, int]], tests: int, level: float) -> int:
    """The largest bin whose upper edge is at most level * (tests up to it) / (all tests); below all bins if none is."""
    best, seen = LEAST * BINS - 1, 0
    for b, count in sorted(bins):
        seen += count
        if 10.0 ** min(300.0, (b + 1) / BINS) * tests <= level * seen:
            best = b
    return best


def scan(docs: DataFrame, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of whole texts: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, by start, then by kind (assign, access, hex, random), then by end, joined by commas;
    ``base_sha256`` is the digest of those of the plain patterns (assign, access and hex), of which none is dropped.

    Each run of 16 or more symbols of common encodings is tested with its smallest alphabet: chi-squared against
    uniform symbols (by the number of equal pairs), runs over the halves of the alphabet, and serial correlation. Ordinary text is
    described by counts of neighbouring symbols over the whole corpus. A run gets the chance that ordinary text of its length and
    alphabet would look so random. Strata of encoding and length weigh these by their estimated share of ordinary runs
    (Storey), and the rule of Benjamini and Hochberg holds over all strata at ``level``. A found run must also be what randomness
    would give (3 * least chance at least 0.001), which shuts out ordered and periodic runs. It becomes a span of kind ``random``
    unless it lies within a plain one.

    One pass over the texts keeps only counts and statistics; the driver takes 66 * 66 counts, a row for each stratum and one for
    each hundredth of a logarithm. A null text is empty; repeated rows and null ids keep a row each; an empty
    table gives none. What is ``random`` depends on the whole table, the plain kinds don't.
    """
    session(docs)
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = cut(base.mapInPandas(_scan, FOUND), "secrets")
    counts = [0] * len(SYMBOLS) ** 2
    for at, n in found.where("pairs is not null").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # 66 * 66 rows
        counts[at] = n
    judged = cut(found.where("pairs is null").mapInPandas(_judged(counts), JUDGED), "secrets-judged")
    tests = judged.select(F.explode(F.arrays_zip("stratum", "logp")).alias("x")).select("x.*").where("stratum >= 0")
    strata = tests.groupBy("stratum").agg(F.count("*").alias("n"), F.count(F.when(F.col("logp") > math.log10(0.5), 1)).alias("above")).collect()  # encodings times length classes
    weight = weights([tuple(r) for r in strata])
    known = F.create_map(*[F.lit(x) for s, w in weight.items() for x in (s, w)]) if weight else F.create_map(F.lit(-2), F.lit(0.0))
    bin_of = lambda logp, s: F.floor((logp + known[s]) * BINS).cast("int")
    bins = tests.where(F.col("logp") <= math.log10(level)).groupBy(bin_of(F.col("logp"), F.col("stratum")).alias("bin")).count().collect()  # LEAST * BINS at most
    best = threshold([tuple(r) for r in bins], sum(r.n for r in strata), level)
    zipped = F.arrays_zip("starts", "kind", "ends", "stratum", "logp", "random")
    span = lambda x: F.struct(x["starts"].alias("s"), x["kind"].alias("k"), x["ends"].alias("e"))
    plain = F.transform(F.filter(zipped, lambda x: x["stratum"] < 0), span)
    passed = F.filter(zipped, lambda x: F.when(x["stratum"] >= 0, x["random"] & (x["logp"] <= math.log10(level)) & (bin_of(x["logp"], x["stratum"]) <= best)).otherwise(False))
    extra = F.filter(F.transform(passed, span), lambda x: ~F.exists("plain", lambda p: (p["s"] <= x["s"]) & (p["e"] >= x["e"])))
    kind = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("plain", lambda x: x["k"] == KINDS.index(name))).cast("bigint").alias(f"n_{name}")
    return judged.withColumn("plain", plain).withColumn("extra", extra).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("plain")), 256).alias("base_sha256"), joined(F.concat("plain", "extra")).alias("spans"))
