"""What kind of content bytes are, by signatures of their first 512."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at.
HEAD = 512
# Tags that make a page, when they come first but for white space, in any case, with a space or > after them.
PAGE = ("<!DOCTYPE HTML", "<HTML", "<HEAD", "<SCRIPT", "<IFRAME", "<H1", "<DIV", "<FONT", "<TABLE", "<A", "<STYLE", "<TITLE", "<B", "<BODY", "<BR", "<P", "<!--")
# Types and the bytes that they begin with, as hexadecimal digits; a point is any digit.
SIGNATURES = (
    ("application/pdf", "255044462D"), ("application/postscript", "252150532D41646F62652D"), ("text/plain; charset=utf-16be", "FEFF"), ("text/plain; charset=utf-16le", "FFFE"),
    ("text/plain; charset=utf-8", "EFBBBF"), ("image/x-icon", "00000100"), ("image/x-icon", "00000200"), ("image/bmp", "424D"), ("image/gif", "474946383761"),
    ("image/gif", "474946383961"), ("image/webp", "52494646........574542505650"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"),
    ("audio/aiff", "464F524D........41494646"), ("audio/mpeg", "494433"), ("application/ogg", "4F67675300"), ("audio/midi", "4D54686400000006"),
    ("video/avi", "52494646........41564920"), ("audio/wave", "52494646........57415645"), ("video/mp4", "........66747970(6D7034|.{16}(.{8})*?6D7034)"), ("video/webm", "1A45DFA3"),
    ("application/vnd.ms-fontobject", "(..){34}4C50"), ("font/ttf", "00010000"), ("font/otf", "4F54544F"), ("font/collection", "74746366"), ("font/woff", "774F4646"), ("font/woff2", "774F4632"),
    ("application/x-gzip", "1F8B08"), ("application/zip", "504B0304"), ("application/x-rar-compressed", "526172211A0700"), ("application/x-rar-compressed", "526172211A070100"), ("application/wasm", "0061736D"))
#: White space before a page's first tag, and bytes that no text holds.
SPACE, BINARY = "(09|0A|0C|0D|20)*+", "0[0-8BEF]|1[0-9AC-F]"


def _any_case(tag: str) -> str:
    sign = lambda c: f"({ord(c.upper()):02X}|{ord(c.lower()):02X})" if c.isalpha() else f"{ord(c):02X}"
    return "".join(map(sign, tag)) + ("" if tag == "<!--" else "(20|3E)")


def content_type(data: Column) -> Column:
    """The media type of bytes: the first signature that fits, else text unless a byte says otherwise."""
    h = F.hex(F.substring(data, 1, HEAD))
    out = F.when(h.rlike(f"^{SPACE}({'|'.join(map(_any_case, PAGE))})"), "text/html; charset=utf-8").when(h.rlike(f"^{SPACE}3C3F786D6C"), "text/xml; charset=utf-8")
    for kind, signature in SIGNATURES:
        out = out.when(h.rlike(f"^{signature}"), kind)
    return out.when(h.rlike(f"^(?:(?!{BINARY})..)*+$"), "text/plain; charset=utf-8").otherwise("application/octet-stream")
