"""Bounded read queries: list, read, grep, find, pointers, outlines and paging."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import golang as G
from ..functions import paths as P

#: Matches and files by default and at most, bytes of a file that grep reads.
MATCHES, FILES, MOST_FILES, GREP_BYTES = 100, 200, 1000, 2 << 20


def listed(files: DataFrame, prefix: str = "", most: int = FILES) -> DataFrame:
    """Paths at or below a prefix in order; one more than asked tells of truncation."""
    most = min(most, MOST_FILES)
    kept = files if prefix in ("", ".") else files.where((F.col("path") == prefix) | F.col("path").startswith(f"{prefix}/"))
    return kept.select("path").distinct().orderBy("path").limit(most + 1)


def checked_pattern(pattern: str) -> str:
    """A pattern that RE2 and Java read alike; look-around and back references are errors."""
    if re.search(r"\(\?[=!<](?!\w+>)|\\[1-9]|\(\?>|[*+?}]\+", pattern):
        raise ValueError(f"pattern {pattern!r} uses look-around, a back reference or a possessive quantifier")
    return pattern


def grep(files: DataFrame, pattern: str, prefix: str = "", glob: str = "", most: int | None = MATCHES, text: str = "text") -> DataFrame:
    """Lines that match, with their numbers (L05): path, line, match.

    Files over 2 MiB and those with a NUL byte are skipped; ``most`` None returns all.
    """
    kept = files.where((F.octet_length(text) <= GREP_BYTES) & (F.instr(F.col(text), "\0") == 0) & F.col(text).rlike(f"(?m){checked_pattern(pattern)}"))
    if prefix:
        kept = kept.where((F.col("path") == prefix) | F.col("path").startswith(f"{prefix}/"))
    if glob:
        kept = kept.where(P.matches_glob(F.col("path"), glob))
    lines = kept.select("path", F.posexplode(F.split(text, "\r?\n")).alias("at", "match")).where(F.col("match").rlike(pattern))
    out = lines.select("path", (F.col("at") + 1).alias("line"), F.substring("match", 1, 1000).alias("match"))
    return out if most is None else out.orderBy("path", "line").limit(most)


def find(files: DataFrame, glob: str, kind: str = "any", most: int | None = FILES) -> DataFrame:
    """Files and directories that match a glob (L06): path, kind."""
    dirs = files.select(F.explode(P.ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct().withColumn("kind", F.lit("directory"))
    both = files.select("path").distinct().withColumn("kind", F.lit("file")).unionByName(dirs)
    out = both.where(P.matches_glob(F.col("path"), glob))
    out = out if kind == "any" else out.where(F.col("kind") == kind)
    return out if most is None else out.orderBy("path").limit(most)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page with the total, and whether and where the next begins."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must not be negative and limit must be 1 to 500")
    total = rows.count()
    more = offset + limit < total
    return rows.orderBy(*order).offset(offset).limit(limit).withColumns({
        "total": F.lit(total).cast("long"), "has_more": F.lit(more), "next_offset": F.lit(offset + limit if more else None).cast("long")})


def within_bytes(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The longest prefix in order whose JSON fits a number of bytes (F11). Its length is bounded by the cap."""
    from pyspark.sql import Window

    sized = rows.orderBy(order).limit(most).withColumn("_size", F.octet_length(F.to_json(F.struct(*rows.columns))))
    running = F.sum("_size").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("_sum", running).where(F.col("_sum") <= most).drop("_size", "_sum")


def _steps(path: str) -> list[str]:
    if path and not path.startswith("/"):
        raise ValueError("a pointer is empty or starts with /")
    return [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]


def pointer(json: Column, path: str) -> Column:
    """The value at a JSON pointer as text; null if there is none.

    Numbers of up to 38 digits keep their value; ``exact_pointer`` keeps their text.
    """
    index = re.compile(r"0|[1-9][0-9]*")
    quoted = lambda k: k.replace("\\", "\\\\").replace("'", "\\'")
    out = "$" + "".join(f"[{k}]" if index.fullmatch(k) else f"['{quoted(k)}']" for k in _steps(path))
    return F.try_variant_get(F.try_parse_json(json), out, "string")


def exact_pointer(json: Column, path: str) -> Column:
    """The same, with numbers as they are written, of any length."""
    steps = _steps(path)

    class Number(str):
        __slots__ = ()

    def text(v):
        import json as j

        if isinstance(v, str) or v is None:
            return v
        held: list[str] = []

        def shown(x):
            if isinstance(x, Number):
                held.append(str(x))
                return f"\0{len(held) - 1}\0"
            return {k: shown(y) for k, y in x.items()} if isinstance(x, dict) else [shown(y) for y in x] if isinstance(x, list) else x

        out = j.dumps(shown(v), separators=(",", ":"), ensure_ascii=False)
        return re.sub(r'"\\u0000(\d+)\\u0000"', lambda m: held[int(m[1])], out)

    def one(doc: str | None) -> str | None:
        import json as j

        try:
            v = j.loads(doc, parse_int=Number, parse_float=Number) if doc is not None else None
        except ValueError:
            return None
        for s in steps:
            if isinstance(v, dict) and s in v:
                v = v[s]
            elif isinstance(v, list) and re.fullmatch(r"0|[1-9][0-9]*", s) and int(s) < len(v):
                v = v[int(s)]
            else:
                return None
        return text(v)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(one, na_action=None)

    return run(json)


def json_members(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Top members of JSON objects with their kinds, in key order (H09): key, pointer, kind. Text that is no object has none."""
    out = rows.select(F.col(key).alias("_k"), F.explode(F.from_json(json, "map<string,variant>")).alias("name", "value"))
    value = F.schema_of_variant("value")
    kind = F.when(value.startswith("OBJECT"), "object").when(value.startswith("ARRAY"), "array").when(value == "STRING", "string").when(value == "BOOLEAN", "boolean").when(value == "VOID", "null").otherwise("number")
    escaped = F.replace(F.replace(F.col("name"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return out.select(F.col("_k").alias(key), F.concat(F.lit("/"), escaped).alias("pointer"), kind.alias("kind"))


def markdown_outline(files: DataFrame, text: str = "text") -> DataFrame:
    """Headings of levels 1 to 6 outside fences (I73): path, line, level, title.

    A fence closes with a run of its own character at least as long as the one that opened it.
    """
    lines = F.split(text, "\r?\n")
    state = F.struct(F.lit("").alias("fence"), F.lit(0).alias("n"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("out"))

    def step(s, l):
        mark = F.regexp_extract(l, r"^ {0,3}(`{3,}|~{3,})", 1)
        closes = (s["fence"] != "") & mark.startswith(s["fence"]) & l.rlike(r"^ {0,3}(`{3,}|~{3,})\s*$")
        opens = (s["fence"] == "") & (mark != "")
        head = F.regexp_extract(l, r"^ {0,3}(#{1,6})(?:\s|$)", 1)
        title = F.regexp_replace(F.regexp_extract(l, r"^ {0,3}#{1,6}\s+(.*)$", 1), r"\s+#+\s*$|\s+$", "")
        entry = F.struct((s["n"] + 1).alias("line"), F.length(head).alias("level"), title.alias("title"))
        fence = F.when(closes, "").when(opens, mark).otherwise(s["fence"])
        return F.struct(fence.alias("fence"), (s["n"] + 1).alias("n"), F.when((s["fence"] == "") & (head != ""), F.array_append(s["out"], entry)).otherwise(s["out"]).alias("out"))

    entries = files.select("path", F.explode(F.aggregate(lines, state, step, lambda s: s["out"])).alias("e"))
    return entries.select("path", "e.line", "e.level", "e.title")


def go_outline(files: DataFrame, text: str = "text") -> DataFrame:
    """Functions, methods with their receiver, and types, also those of groups, by line (I74): path, line, kind, name.

    What precedes an unfinished declaration, and its own head, is told as well.
    """
    s = files.select("path", F.explode(G.statements(F.regexp_replace(text, "\r\n", "\n"))).alias("s")).select("path", "s.*").withColumn("word", G.keyword(F.col("head"))).where("word in ('func', 'type')")
    receiver, name = G.receiver(F.col("head")), G.function_name(F.col("head"))
    func = F.struct(F.lit(None).cast("int").alias("line"), F.concat(F.when(receiver != "", F.concat(receiver, F.lit("."))).otherwise(""), name).alias("name"))
    each = s.select("path", "start", "word", (receiver != "").alias("method"), F.explode(F.when(F.col("word") == "func", F.array(func)).otherwise(G.spec_names(F.col("head"), F.col("names")))).alias("e"))
    kind = F.when(F.col("word") == "type", "type").when(F.col("method"), "method").otherwise("function")
    return each.where("e.name <> ''").select("path", F.coalesce("e.line", "start").alias("line"), kind.alias("kind"), F.col("e.name").alias("name"))
