"""Scores and identities of vectors as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, different lengths or a zero norm."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms).otherwise(0.0)


def relatedness(cos: Column) -> Column:
    """Cosine moved to 1e-9 .. 1."""
    return F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos + 1) / 2)))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """A term's part of BM25."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))).otherwise(0.0)


def saturated(score: Column) -> Column:
    return score / (score + 1)


def field_match(query: Column, field: Column) -> Column:
    """The part of distinct query terms that a field holds."""
    return F.when((F.size(query) > 0) & (F.size(field) > 0), F.size(F.array_intersect(query, field)) / F.size(query)).otherwise(0.0)


def lexical(text: Column, path: Column, symbol: Column) -> Column:
    """Weighted field scores, clipped at 1."""
    return F.least(F.lit(1.0), text * 0.45 + path * 0.30 + symbol * 0.35)


def hybrid(vector: Column, lex: Column) -> Column:
    """The lexical score lifts what the vector score leaves."""
    return vector + (1 - vector) * lex


def input_hash(text: Column) -> Column:
    """SHA-256 of an embedding input."""
    return F.sha2(text, 256)


def vector_key(hash_: Column, model: Column, dims: Column) -> Column:
    """SHA-256 of hash, model and dimensions between NULs."""
    return F.sha2(F.concat_ws("\0", hash_, model, dims.cast("string")), 256)


def model_key(model: Column, dims: Column) -> Column:
    """SHA-256 of model and dimensions."""
    return F.sha2(F.concat_ws("\0", model, dims.cast("string")), 256)


def record_key(*parts: Column) -> Column:
    """Fields joined by colons."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def ceil_division(value: Column, divisor: int) -> Column:
    """0 for values that aren't positive."""
    return F.when(value > 0, F.ceil(value / divisor)).otherwise(0).cast("long")


def token_estimate(json: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(json) + 3) / 4)
