"""Messages, tool calls and payloads: inputs of models and merges of their parts."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

_MARK = r"(?:[ \t]*(?:> )*(?:[-*+] |[0-9]+\. |[A-Za-z0-9-]+: )|[ \t]*(?:> )+)"
#: A marked line (its lead is white space and quote signs), an indented line, or a paragraph up to what isn't of it.
_BLOCK = re.compile(rf"^(?=(?P<lead>[ \t]*(?:> )*))(?P<mark>{_MARK})(?P<body>.+)$|^[ \t].*$|^(?P<prose>.+(?:\n(?!{_MARK}.|[ \t]).+)*)$", re.M)


def embedding_input(path: Column, kind: Column, name: Column, body: Column, most: int = 32_000, line: int = 4000) -> Column:
    """Path, symbol and language before the body, whose lines and whole are capped in characters."""
    symbol = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("symbol: "), F.coalesce(kind, F.lit("")), F.lit(" "), name, F.lit("\n"))).otherwise("")
    lang = P.language(path)
    head = F.concat(F.lit("path: "), path, F.lit("\n"), symbol, F.when(lang != "", F.concat(F.lit("language: "), lang, F.lit("\n"))).otherwise(""), F.lit("\n"))
    return F.substring(F.concat(head, F.array_join(F.transform(T.body_lines(body), lambda l: F.substring(l, 1, line)), "\n")), 1, most)


def _filled(text: str, width: int, first: str = "", hang: str = "") -> str:
    """A paragraph in lines of at most ``width`` bytes; a longer word has a line of its own."""
    as_bytes = lambda x: x.encode().decode("latin-1")
    lines = textwrap.wrap(
        as_bytes(text), width, initial_indent=as_bytes(first), subsequent_indent=as_bytes(hang), expand_tabs=False,
        replace_whitespace=False, break_long_words=False, break_on_hyphens=False)
    return "\n".join(lines).encode("latin-1").decode()


def wrap(text: str, width: int) -> str:
    """Paragraphs filled to a width; lists, quotes and trailers hang under their marks, indented lines stay."""

    def shaped(block: re.Match) -> str:
        if block["prose"]:
            return _filled(block["prose"].replace("\n", " "), width)
        if block["mark"] and len(block["mark"].encode()) < width:
            return _filled(block["body"].strip(), width, block["mark"], block["lead"] + " " * (len(block["mark"]) - len(block["lead"])))
        return block[0]

    return text if width <= 0 else _BLOCK.sub(shaped, re.sub(r"[ \t]+$", "", text.strip(), flags=re.M)).strip()


def wrapped(text: Column, width: int = 72) -> Column:
    """Texts with their bodies wrapped."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else wrap(t, width), na_action=None)

    return run(text)


def merged_calls(primary: DataFrame, streamed: DataFrame) -> DataFrame:
    """Calls with blanks filled from the streamed ones by id, else call id, else place (C25): batch, ord, id, call_id, name, arguments.

    Nameless calls go; a batch without named calls has the streamed ones.
    """
    fields = ("id", "call_id", "name", "arguments")
    side = lambda tag, *on: streamed.select(*(F.col(c).alias(f"_{tag}_{c}") for c in on), F.struct(*fields).alias(tag))
    last = lambda c: streamed.where(F.coalesce(c, F.lit("")) != "").groupBy("batch", c).agg(F.max_by(F.struct(*fields), "ord").alias("patch"))
    by_id, by_call = last("id").withColumnRenamed("patch", "p1"), last("call_id").withColumnRenamed("patch", "p2")
    by_place = side("p3", "batch", "ord").withColumnsRenamed({"_p3_batch": "batch", "_p3_ord": "ord"})
    joined = primary.join(by_id, ["batch", "id"], "left").join(by_call, ["batch", "call_id"], "left").join(by_place, ["batch", "ord"], "left")
    patch = F.coalesce("p1", "p2", "p3")
    full = lambda c: F.when(T.stripped(F.coalesce(c, F.lit(""))) != "", F.col(c)).otherwise(patch[c])
    got = joined.select("batch", "ord", *(F.coalesce(full(c), F.lit("")).alias(c) for c in fields))
    got = got.withColumn("call_id", F.when(F.col("call_id") == "", F.col("id")).otherwise(F.col("call_id"))).withColumn("arguments", T.stripped(F.col("arguments"))).where("name <> ''")
    rest = streamed.join(got.select("batch").distinct(), "batch", "left_anti").select("batch", "ord", *fields)
    return got.unionByName(rest)


def unanswered(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Ids asked but not answered, and answered but not asked (C28): batch, id, error."""
    both = items.select("batch", "id", F.lit(True).alias("_a")).join(answers.select("batch", "id", F.lit(True).alias("_b")), ["batch", "id"], "full_outer")
    return both.where("_a is null or _b is null").select("batch", "id", F.when(F.col("_b").isNull(), "missing answer").otherwise("unknown id").alias("error"))


def compacted(value: Column, most: int = 16 << 10, shown: int = 1024) -> Column:
    """Long texts as their size and beginning."""
    lines = T.line_count(value)
    return F.when(F.octet_length(value) >= most, F.struct(
        F.octet_length(value).alias("bytes"), F.substring(value, 1, shown).alias("preview"), F.lit(True).alias("truncated"), lines.alias("lines")))


def redacted(message: Column, raw: str, safe: str) -> Column:
    """A message without an address, its user, password and query values."""
    from urllib.parse import parse_qsl, quote, unquote, urlsplit

    parts = urlsplit(raw)
    secrets = [x for x in (parts.username, parts.password, *(v for _, v in parse_qsl(parts.query))) if x]
    out = F.replace(message, F.lit(raw), F.lit(safe))
    for s in sorted({f(x) for x in secrets for f in (str, unquote, lambda y: quote(y, safe=""))}, key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return out


def strict_json(rows: DataFrame, json: str, schema: str, names: list[str]) -> DataFrame:
    """Rows decoded by a schema; members that it doesn't name are an error in ``errors``."""
    decoded = F.from_json(F.col(json), schema, {"mode": "PERMISSIVE"})
    extra = F.filter(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), lambda k: ~F.lower(k).isin(*[n.lower() for n in names]))
    bad = F.array_compact(F.array(F.when(F.try_parse_json(json).isNull(), "not JSON")))
    return rows.withColumns({"value": decoded, "errors": F.concat(bad, F.transform(extra, lambda k: F.concat(F.lit("unknown member "), k)))})


def envelope(tool: str, ok: Column, data: Column, error: Column, truncated: Column) -> Column:
    """A tool's result as JSON."""
    return F.to_json(F.struct(ok.alias("ok"), F.lit(tool).alias("tool"), F.when(ok, data).alias("data"), F.when(~ok, error).alias("error"), truncated.alias("truncated")))


def brief_line(score: Column, location: Column, summary: Column) -> Column:
    """A line of a brief listing."""
    return F.format_string("%.2f %s %s", score, location, summary)


def preserved_suffix(subject: Column, reference: Column) -> Column:
    """A subject with the task mark ``(T1)`` of a reference, if it has none."""
    mark = F.regexp_extract(reference, r"(\(T[0-9]+\))\s*$", 1)
    return F.when((mark != "") & ~subject.rlike(r"\(T[0-9]+\)\s*$"), F.concat(F.rtrim(subject), F.lit(" "), mark)).otherwise(subject)


def common_prefix(items: DataFrame, leaf: str = "leaf", place: str = "ord", value: str = "item") -> DataFrame:
    """The leading items that all leaves share (E14): ord, item."""
    leaves = items.select(leaf).distinct().count()
    same = items.groupBy(place).agg(F.count_distinct(leaf).alias("n"), F.min(value).alias(value), F.max(value).alias("_high"))
    marked = same.withColumn("_bad", ((F.col("n") < leaves) | (F.col(value) != F.col("_high"))).cast("int"))
    first_bad = marked.where("_bad = 1").agg(F.coalesce(F.min(place), F.lit(1 << 30))).first()[0]
    return marked.where(F.col(place) < first_bad).select(place, value).orderBy(place)


def repeated(calls: DataFrame) -> DataFrame:
    """Calls whose name and canonical arguments came before."""
    from ..functions.web import canonical_json

    keyed = calls.withColumn("_s", F.concat_ws("\0", "name", canonical_json(F.col("arguments"))))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy("ord"))).where("_n > 1").drop("_s", "_n")
