"""Top-level declarations of Go sources, by a scan over tokens and brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, raw strings, strings and runes: what brackets, keywords and line ends mean nothing in.
OPAQUE = r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:\\.[^'\n]*|[^'\\\n])'"
#: Stands for the line end within a raw string.
INSIDE = "\u0001"
STATEMENT = "struct<start:int,end:int,head:string,names:array<struct<line:int,name:string>>>"


def masked(text: Column) -> Column:
    """The text with the same lines and columns, comments blank, strings and runes as quotation marks.

    One alternation finds them from left to right, so that a comment sign in a string, or a quotation mark in a comment, opens nothing.
    """
    found = F.regexp_extract_all(text, F.lit(OPAQUE), 0)

    def one(p: Column, t: Column) -> Column:
        blank = F.regexp_replace(t, r"[^\n]", " ")
        quoted = F.regexp_replace(F.regexp_replace(t, r"[^\n]", '"'), "\n", INSIDE + "\n")
        return F.concat(p, F.when(t.isNull(), "").when(t.startswith("/"), blank).otherwise(quoted))

    return F.array_join(F.zip_with(F.split(text, OPAQUE, -1), found, one), "")


def statements(text: Column, whole: bool = False) -> Column:
    """Top-level statements: (start, end, head, names), lines from 1; an unfinished last one has no end. ``whole``: none of a text that has one.

    A statement goes on while a bracket is open, or its line doesn't end in what lets a statement end (a name, a literal, a closing
    bracket). ``names`` are what each line one bracket deep begins with, where a statement can begin: the specs of
    a group. Of several statements on a line the first is seen.
    """
    count = lambda l, signs: F.length(F.regexp_replace(l, f"[^{signs}]", ""))
    spec = lambda l: F.regexp_extract(l, r"^\s*([\p{L}_][\p{L}\p{Nd}_]*(?:\s*,\s*[\p{L}_][\p{L}\p{Nd}_]*)*)", 1)
    facts = F.transform(F.split(masked(text), "\n"), lambda l: F.struct(
        l.alias("l"), (F.trim(F.regexp_replace(l, r"[\s]+", " ")) == "").alias("blank"), (count(l, r"(\[{") - count(l, r")\]}")).alias("more"),
        l.rlike(r"[\p{L}\p{Nd}_\")\]}]\s*$").alias("done"), l.rlike(r"\(\s*$").alias("group"), F.regexp_replace(spec(l), r"\s*,\s*", ", ").alias("spec")))
    none = F.array().cast("array<struct<line:int,name:string>>")
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit("").alias("head"), F.lit(False).alias("fresh"), none.alias("names"), F.array().cast(f"array<{STATEMENT}>").alias("out"))

    def step(s: Column, l: Column) -> Column:
        n, opens, depth = s["n"] + 1, (s["start"] == 0) & ~l["blank"], s["depth"] + l["more"]
        start, head = F.when(opens, n).otherwise(s["start"]), F.when(opens, l["l"]).otherwise(s["head"])
        named = s["fresh"] & (s["depth"] == 1) & (l["spec"] != "")
        names = F.when(named, F.array_append(s["names"], F.struct(n.alias("line"), l["spec"].alias("name")))).otherwise(s["names"])
        ends = (start > 0) & ~l["blank"] & (depth <= 0) & l["done"]
        row = F.struct(start.alias("start"), n.alias("end"), head.alias("head"), names.alias("names"))
        fresh = F.when(l["blank"], s["fresh"]).otherwise((depth == 1) & (l["done"] | l["group"]))
        return F.struct(
            n.alias("n"), F.when(ends, 0).otherwise(depth).alias("depth"), F.when(ends, 0).otherwise(start).alias("start"), F.when(ends, "").otherwise(head).alias("head"),
            (fresh & ~ends).alias("fresh"), F.when(ends, none).otherwise(names).alias("names"), F.when(ends, F.array_append(s["out"], row)).otherwise(s["out"]).alias("out"))

    rest = lambda s: F.array(F.struct(s["start"].alias("start"), F.lit(None).cast("int").alias("end"), s["head"].alias("head"), s["names"].alias("names")))
    last = lambda s: F.array().cast(f"array<{STATEMENT}>") if whole else F.concat(s["out"], rest(s))
    return F.aggregate(facts, begin, step, lambda s: F.when(s["start"] > 0, last(s)).otherwise(s["out"]))


#: A name, and a receiver's brackets.
NAME, RECEIVER = r"([\p{L}_][\p{L}\p{Nd}_]*)", r"\(([^()]*)\)"


def keyword(head: Column) -> Column:
    """func, type, const or var, where a statement is such a declaration."""
    return F.regexp_extract(head, r"^\s*(func|type|const|var)\b", 1)


def receiver(head: Column) -> Column:
    """The type that a method belongs to, without pointer and parameters; empty for functions."""
    inside = F.regexp_replace(F.regexp_extract(head, rf"^\s*func\s*{RECEIVER}\s*{NAME}", 1), r"\[.*$", "")
    return F.regexp_extract(inside, NAME + r"\s*$", 1)


def function_name(head: Column) -> Column:
    return F.regexp_extract(head, rf"^\s*func\s*(?:{RECEIVER}\s*)?{NAME}", 2)


def spec_names(head: Column, names: Column) -> Column:
    """Lines and names that a type, const or var declaration introduces (line null: the declaration's own)."""
    own = F.regexp_replace(F.regexp_extract(head, rf"^\s*(?:type|const|var)\s+({NAME[1:-1]}(?:\s*,\s*{NAME[1:-1]})*)", 1), r"\s*,\s*", ", ")
    first = lambda c: F.regexp_extract(c, "^" + NAME, 1)
    one = F.array(F.struct(F.lit(None).cast("int").alias("line"), own.alias("name")))
    found = F.when(own != "", one).otherwise(names)
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), F.when(keyword(head) == "type", first(x["name"])).otherwise(x["name"]).alias("name")))
