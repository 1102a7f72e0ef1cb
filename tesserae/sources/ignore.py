"""Ignore rules as a join of paths with compiled patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.graph import written

RULES = "base string, line int, key string, pattern string, anchored boolean, negated boolean, only_dir boolean"


def trimmed(line: str) -> str:
    """A line without its end and without trailing spaces, but for one behind an odd number of backslashes."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and (len(line[:-1]) - len(line[:-1].rstrip("\\"))) % 2 == 0:
        line = line[:-1]
    return line


def expression(glob: str) -> str:
    """A pattern's regular expression: * and ? stay within a name, ** goes over directories, a backslash makes a sign plain."""
    out, at = "", 0
    while at < len(glob):
        c, rest = glob[at], glob[at:]
        if rest == "**" and (at == 0 or glob[at - 1] == "/"):
            return out + ".+"
        if rest.startswith("**/") and (at == 0 or glob[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif c in "*?":
            out, at = out + ("[^/]*" if c == "*" else "[^/]"), at + 1
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]/]*)\]", rest)):
            inner = re.sub(r"([\\\[&~^])", r"\\\1", m[2])
            out, at = out + f"[{'^/' if m[1] else ''}{inner}]", at + m.end()
        elif c == "\\" and at + 1 < len(glob):
            out, at = out + re.escape(glob[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    return out


def compiled(base: str, number: int, line: str) -> tuple | None:
    """A rule as a row of RULES; None for blank lines and comments.

    ``key`` is what a path must have for the pattern to match at all: its name, its extension, its whole place below the base,
    or the first directory of that; without any of these the rule is tried on all paths below its base.
    """
    line = trimmed(line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    only_dir = line.endswith("/")
    line = line.rstrip("/") if only_dir else line
    anchored, glob = "/" in line, line.lstrip("/")
    if not glob:
        return None
    literal = lambda s: not re.search(r"[*?\[\\]", s)
    if literal(glob):
        key = f"path:{glob}" if anchored else f"name:{glob}"
    elif not anchored and (m := re.fullmatch(r"\*[^*?\[\\]*\.([^*?\[\\.]+)", glob)):
        key = f"ext:{m[1]}"
    elif anchored and "/" in glob and literal(first := glob.split("/")[0]):
        key = f"head:{first}"
    else:
        key = "any"
    return base, number, key, expression(glob), anchored, negated, only_dir


def rules(files: DataFrame, name: str = ".gitignore", excludes: tuple[str, ...] = ()) -> DataFrame:
    """The compiled rules of all ignore files of a listing (path, text), after those of ``excludes``, which hold for the whole."""
    folder = F.regexp_replace(P.directory(F.col("path")), r"^\.$", "")
    own = files.where(P.base(F.col("path")) == name).select(folder.alias("base"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "rule"))
    given = [("", i, line) for i, line in enumerate(line for text in excludes for line in text.splitlines())]
    before = files.sparkSession.createDataFrame([(b, i - len(given), r) for b, i, r in given], "base string, line int, rule string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [compiled(*x) for x in zip(b["base"], b["line"], b["rule"], strict=True)]
            yield pd.DataFrame([r for r in rows if r], columns=[c.split()[0] for c in RULES.split(", ")])

    return own.unionByName(before).mapInPandas(run, RULES)


def ignored(places: DataFrame, rules_: DataFrame) -> DataFrame:
    """Places (place, is_dir) that the last matching rule ignores: place, is_dir. Parents are not looked at."""
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("place", "/")) - 1), lambda i: F.array_join(F.slice(F.split("place", "/"), 1, i), "/"))
    below = places.select("place", "is_dir", F.explode(above).alias("base"))
    rest = F.when(F.col("base") == "", F.col("place")).otherwise(F.substring("place", F.length("base") + 2, F.lit(1 << 20)))
    below = below.withColumn("rest", rest).withColumn("name", P.base(F.col("place")))
    keys = F.array_distinct(F.array(
        F.lit("any"), F.concat(F.lit("name:"), F.col("name")), F.concat(F.lit("path:"), F.col("rest")), F.concat(F.lit("ext:"), F.substring_index("name", ".", -1)),
        F.concat(F.lit("head:"), F.substring_index("rest", "/", 1))))
    met = below.withColumn("key", F.explode(keys)).join(rules_, ["base", "key"])
    against = F.when(F.col("anchored"), F.col("rest")).otherwise(F.col("name"))
    hit = met.where((F.col("is_dir") | ~F.col("only_dir")) & F.rlike(against, F.concat(F.lit("^(?s:"), F.col("pattern"), F.lit(r")\z"))))
    last = hit.groupBy("place", "is_dir").agg(F.max_by("negated", F.struct(F.length("base"), "line")).alias("negated"))
    return last.where(~F.col("negated")).select("place", "is_dir")


def kept(files: DataFrame, rules_: DataFrame) -> DataFrame:
    """Files that no rule ignores, neither themselves nor a directory above them.

    Each distinct directory and file is tried once, with the rules that its name, extension or place selects.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("place"), (i < F.size(parts)).alias("is_dir")))
    each = files.select("path", F.explode(steps).alias("s")).select("path", "s.place", "s.is_dir").distinct()
    out = written(ignored(each.select("place", "is_dir").distinct(), rules_))
    lost = each.join(out, ["place", "is_dir"]).select("path").distinct()
    return files.join(lost, "path", "left_anti")
