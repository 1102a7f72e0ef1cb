"""Text functions as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized_query(q: Column) -> Column:
    """Trim, collapse white space, lower case."""
    return F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))


def framed_query(q: Column, most: int = 32_000) -> Column:
    """The query with its frame in front, unless that exceeds the cap."""
    framed = F.concat(F.lit("implementation entrypoint for "), q)
    return F.when(F.char_length(framed) <= most, framed).otherwise(F.substring(q, 1, most))


def capped(text: Column, most: int) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, most)


def terms(text: Column) -> Column:
    """Lower-case search terms in order.

    Words end at what is neither letter nor digit, and before an upper-case letter that
    follows a lower-case one or a digit, or that a lower-case one follows within a run of
    upper-case ones. After a word of over 3 bytes with a single final s comes its singular.
    """
    parted = F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(?=\p{Lu})", "$1 ")
    parted = F.regexp_replace(parted, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 ")
    words = F.filter(F.split(parted, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    plural = lambda w: (F.octet_length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    both = lambda w: F.when(plural(w), F.array(w, F.substring(w, F.lit(1), F.char_length(w) - 1))).otherwise(F.array(w))
    return F.flatten(F.transform(words, lambda w: both(F.lower(w))))


def distinct_terms(text: Column) -> Column:
    """Terms in the order of their first use."""
    return F.array_distinct(terms(text))


def body_lines(text: Column) -> Column:
    """Lines of a normalised body: LF ends, one final line end dropped."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", ""), "\n", -1)


def numbered_excerpt(lines: Column, first: Column, most_lines: int = 40, most_bytes: int = 12_288) -> Column:
    """Numbered lines from the first one, up to line and byte caps at line granularity."""
    shown = F.transform(F.slice(lines, 1, most_lines), lambda l, i: F.concat((first + i).cast("string"), F.lit(": "), l))
    start = F.struct(F.lit(0).alias("bytes"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def step(s, l):
        size = s["bytes"] + F.octet_length(l) + F.when(F.size(s["kept"]) > 0, 1).otherwise(0)
        fits = ~s["full"] & (size <= most_bytes)
        return F.struct(F.when(fits, size).otherwise(s["bytes"]).alias("bytes"), F.when(fits, F.array_append(s["kept"], l)).otherwise(s["kept"]).alias("kept"), (~fits).alias("full"))

    return F.aggregate(shown, start, step, lambda s: F.array_join(s["kept"], "\n"))


def prompt(text: Column) -> Column:
    """Trim lines, collapse three or more line ends to two."""
    lined = F.array_join(F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1), lambda l: stripped(l)), "\n")
    return stripped(F.regexp_replace(lined, "\n{3,}", "\n\n"))


def single_line(text: Column, most: int) -> Column:
    """White space collapsed, then capped."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def valid_text(data: Column, most_lines: int) -> Column:
    """Bytes as text without invalid UTF-8, capped in lines."""
    return F.array_join(F.slice(F.split(F.regexp_replace(F.make_valid_utf8(data), "�", ""), "\n", -1), 1, most_lines), "\n")


def release_scope(summary: Column) -> Column:
    """Text in the first parentheses, if it holds no space."""
    return F.regexp_extract(summary, r"^[^(]*\(([^ )]*)\)", 1)


def commit_scope(subject: Column) -> Column:
    """The scope of a prefix that ends with a parenthesis before its colon."""
    return F.regexp_extract(subject, r"^[^:(]*\(([^:]*)\):", 1)


#: Words that labels show in a form of their own.
ACRONYMS = {"accesslog": "Access Logs", "api": "API", "cli": "CLI", "tls": "TLS", "ui": "UI", "webui": "WebUI", "ovh": "OVH"}


def label(value: Column) -> Column:
    """Parts between -, _, / and . with capitals or as acronyms, joined by /."""
    known = F.create_map(*(F.lit(x) for kv in ACRONYMS.items() for x in kv))
    parts = F.filter(F.split(F.trim(value), r"[-_/. \t]*[-_/.][-_/. \t]*"), lambda p: p != "")
    shown = lambda p: F.coalesce(F.try_element_at(known, F.lower(p)), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p))))
    return F.array_join(F.transform(parts, shown), "/")


def human_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    return (
        F.when(n == 0, "").when(n == 1, F.try_element_at(items, F.lit(1)))
        .when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(items, -1))))


def subject(message: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(message, "\n"), lambda l: stripped(l)), lambda l: l != ""), 0), F.lit(""))


def short_revision(rev: Column, size: int = 12) -> Column:
    return F.substring(rev, 1, size)


def markdown(text: Column) -> Column:
    """Backslashes before characters that Markdown reads."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def code_span(text: Column) -> Column:
    """A code span whose fence is longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.char_length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def escaped_prompt(text: Column) -> Column:
    """Angle brackets and ampersands as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def line_range(text: Column, start: Column, end: Column, numbered: bool = False) -> Column:
    """Lines of an inclusive range, on request with their numbers."""
    lines = F.slice(F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1), start, F.greatest(end - start + 1, F.lit(0)))
    shown = F.transform(lines, lambda l, i: F.concat(F.lpad((start + i).cast("string"), 6, " "), F.lit("\t"), l)) if numbered else lines
    return F.array_join(shown, "\n")


def line_count(text: Column) -> Column:
    """Line ends, and a last line without one."""
    ends = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def clamped_message(message: Column, most_lines: int = 10, most_words: int = 1000) -> Column:
    """The first lines, and of them the first words (I16)."""
    lines = F.slice(F.split(stripped(message), "\n"), 1, most_lines)

    def step(s, l):
        words = F.filter(F.split(l, r"\s+"), lambda w: w != "")
        kept = F.slice(words, F.lit(1), F.greatest(F.lit(most_words) - s["n"], F.lit(0)))
        line = F.when(F.size(words) <= F.lit(most_words) - s["n"], l).otherwise(F.array_join(kept, " "))
        more = s["n"] < most_words
        return F.struct((s["n"] + F.size(kept)).alias("n"), F.when(more, F.array_append(s["out"], line)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return stripped(F.aggregate(lines, start, step, lambda s: F.array_join(s["out"], "\n")))


#: The rule of generated files, and the line that marks them.
GO_RULE, GO_MARK = "go-generated-comment", r"^// Code generated .* DO NOT EDIT\.$"


def is_go_generated(path: Column, header: Column) -> Column:
    """Whether the mark of generated code stands before the first line that isn't comment."""
    lines = F.filter(F.transform(F.split(header, "\n"), lambda l: stripped(l)), lambda l: l != "")
    start = F.struct(F.lit(False).alias("block"), F.lit(False).alias("over"), F.lit(False).alias("found"))

    def step(s, l):
        ends, opens = l.contains("*/"), l.startswith("/*") & ~s["block"]
        code = ~s["block"] & ~l.startswith("//") & ~l.startswith("/*")
        return F.struct(
            ((s["block"] | opens) & ~ends).alias("block"), (s["over"] | code).alias("over"),
            (s["found"] | (~s["over"] & l.rlike(GO_MARK))).alias("found"))

    return path.endswith(".go") & F.aggregate(lines, start, step, lambda s: s["found"])


def has_do_not_edit(source: Column) -> Column:
    """Whether a comment before the package clause says that the file isn't to be edited."""
    head = F.regexp_extract(source, r"(?s)^(.*?)(?:^|\n)package\s", 1)
    comments = F.regexp_extract_all(head, F.lit(r"(?s)(//[^\n]*|/\*.*?\*/)"), F.lit(1))
    return F.exists(comments, lambda c: c.contains("DO NOT EDIT"))


#: A conventional prefix: a word, on request a scope, and a mark of breaking changes.
CONVENTIONAL = r"^[a-z]+(\([^)]+\))?!?$"


def is_conventional(summary: Column) -> Column:
    """Whether a summary has a conventional prefix before its first colon."""
    return (F.instr(summary, ":") > 0) & F.trim(F.substring_index(summary, ":", 1)).rlike(CONVENTIONAL)


def is_title_case(summary: Column) -> Column:
    """Whether a summary without such a prefix begins with a capital."""
    return ~is_conventional(summary) & summary.rlike("^[A-Z]")


def is_chore(summary: Column) -> Column:
    """Whether a summary is of a chore."""
    return F.lower(summary).rlike(r"^chore[(:]")


def clipped_match(text: Column, most: int = 1000) -> Column:
    """A match within a number of bytes that doesn't split a character, with an ellipsis where it was cut."""
    from .web import cut_at_character

    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut_at_character(text, most), F.lit("...")))


def single_line_bytes(text: Column, most: int) -> Column:
    """White space collapsed, then cut at a number of bytes at a character's border."""
    from .web import cut_at_character

    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.octet_length(flat) <= most, flat).otherwise(F.trim(cut_at_character(flat, most)))


def has_line(text: Column, wanted: Column) -> Column:
    """Whether a text has a line of a number; a final line end begins no line."""
    return (wanted >= 1) & (line_count(text) >= wanted)
