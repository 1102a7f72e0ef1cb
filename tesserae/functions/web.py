"""URL, HTML, version and JSON functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports that a scheme implies.
PORTS = {"http": "80", "https": "443", "ssh": "22", "git": "9418"}
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^@/?#]*@)?([^/:?#]*)(?::([0-9]+))?([^?#]*)"
SCP = r"^(?:[^@/:]+@)?([^/:@]+):([^/].*)$"


def sanitized(url: Column) -> Column:
    """Without user, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^@/]*@", "$1")


def identity(url: Column) -> Column:
    """One text for all forms of a repository's address (I68): host in lower case, path without .git."""
    url = F.trim(url)
    scheme, host, port, path = (F.regexp_extract(url, URL, i) for i in (1, 2, 3, 4))
    ports = F.create_map(*(F.lit(x) for kv in PORTS.items() for x in kv))
    own = (port != "") & ~port.eqNullSafe(F.try_element_at(ports, F.lower(scheme)))
    tidy = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "/+", "/"), "^/+|/+$", ""), r"\.git$", "")
    net = F.concat(F.lower(host), F.when(own, F.concat(F.lit(":"), port)).otherwise(""), F.lit("/"), tidy(path))
    scp = F.concat(F.lower(F.regexp_extract(url, SCP, 1)), F.lit("/"), tidy(F.regexp_extract(url, SCP, 2)))
    return F.when((scheme != "") & (F.lower(scheme) != "file"), net).when(F.lower(scheme) == "file", path).when(url.rlike(SCP), scp).otherwise(url)


def web(url: Column) -> Column:
    """An https address of a repository."""
    return F.concat(F.lit("https://"), identity(url))


def version(name: Column) -> Column:
    """(major, minor, patch) of [v]X.Y.Z without leading zeros, else null."""
    pattern = r"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
    part = lambda i: F.regexp_extract(name, pattern, i).try_cast("int")
    return F.when(name.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def bumped(name: Column, part: str) -> Column:
    """The next version."""
    v = version(name)
    up = {"major": (v["major"] + 1, F.lit(0), F.lit(0)), "minor": (v["major"], v["minor"] + 1, F.lit(0)), "patch": (v["major"], v["minor"], v["patch"] + 1)}[part]
    return F.concat(F.when(name.startswith("v"), "v").otherwise(""), F.array_join(F.array(*up), "."))


def _main_text(html: str | None, wanted: str, most: int) -> str | None:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.inside, self.skipped, self.kept = 0, 0, []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"):
                return
            if self.inside or not wanted or ("id", wanted) in attrs:
                self.inside += 1
            self.skipped += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skipped -= tag in ("script", "style") and self.skipped > 0
            self.inside -= self.inside > 0

        def handle_data(self, data):
            if (self.inside or not wanted) and not self.skipped:
                self.kept.append(data)

    if html is None:
        return None
    reader = Reader()
    reader.feed(html)
    reader.close()
    out = " ".join(" ".join(reader.kept).split()).encode()
    return out[:most].decode(errors="ignore")


def main_text(html: Column, wanted: str = "main-content", most: int = 32 << 10) -> Column:
    """Visible text of the element with an id, white space collapsed, capped in bytes."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda h: _main_text(h, wanted, most), na_action=None)

    return run(html)


def limited(text: Column, most_bytes: int, most_lines: int) -> Column:
    """Line and byte caps that don't split a character, with a mark where text was cut."""
    kept = lines = F.substring_index(text, "\n", most_lines) if most_lines else text
    if most_bytes:
        kept = F.when(F.octet_length(lines) > most_bytes, cut_at_character(lines, most_bytes)).otherwise(lines)
    return F.when(kept == text, text).otherwise(F.concat(kept, F.lit("\n[truncated]")))


def cut_at_character(text: Column, most: int) -> Column:
    """The longest beginning of at most so many bytes that ends before the first byte of a character."""
    raw = F.encode(text, "UTF-8")
    starts = lambda n: F.hex(F.substring(raw, n + 1, 1)).rlike("^[^89AB]")
    out = F.lit(max(most - 3, 0))
    for n in range(max(most - 2, 0), most + 1):
        out = F.when(starts(n), n).otherwise(out)
    return F.decode(F.substring(raw, F.lit(1), out), "UTF-8")


def float_bytes(vector: Column) -> Column:
    """Little-endian 32-bit floats of a vector (I51); ``crc32`` of them is its checksum."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else pd.Series(v, dtype="float32").to_numpy().astype("<f4").tobytes())

    return run(vector)


def _canonical(text: str | None) -> str | None:
    import json

    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return text.strip()


def canonical_json(json: Column) -> Column:
    """JSON with sorted keys and without spaces; text that isn't JSON stays as it is, trimmed."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(_canonical)

    return run(json)
