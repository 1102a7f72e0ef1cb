"""Kinds of content against a table of examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.functions.sniff import content_type
from tesserae.sources import files

EXAMPLES = [
    (b"", "text/plain; charset=utf-8"), (b"release notes\n", "text/plain; charset=utf-8"), (b"a\x00b", "application/octet-stream"), (b"a\x1bb", "text/plain; charset=utf-8"), (b"a\x0bb", "application/octet-stream"),
    (b"\n\t <!doctype HTML>", "text/html; charset=utf-8"), (b"<htmlx>", "text/plain; charset=utf-8"), (b"<HtMl >", "text/html; charset=utf-8"), (b"<!--x", "text/html; charset=utf-8"), (b"<p>", "text/html; charset=utf-8"),
    (b"  <?xml version", "text/xml; charset=utf-8"), (b"%PDF-1.7\n", "application/pdf"), (b"%!PS-Adobe-3", "application/postscript"), (b"\xfe\xff\x00a", "text/plain; charset=utf-16be"), (b"\xef\xbb\xbfa", "text/plain; charset=utf-8"),
    (b"GIF89a..", "image/gif"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"RIFF1234WEBPVP8 ", "image/webp"), (b"RIFF1234WAVEfmt", "audio/wave"), (b"RIFF1234AVI LIST", "video/avi"),
    (b"\x00\x00\x00\x18ftypmp42\x00\x00\x00\x00", "video/mp4"), (b"\x00\x00\x00\x18ftypisom\x00\x00\x02\x00mp41", "video/mp4"), (b"\x1a\x45\xdf\xa3", "video/webm"), (b"x" * 34 + b"LP", "application/vnd.ms-fontobject"),
    (b"\x1f\x8b\x08\x00", "application/x-gzip"), (b"PK\x03\x04", "application/zip"), (b"Rar!\x1a\x07\x01\x00", "application/x-rar-compressed"), (b"\x00asm", "application/wasm"), (b"x" * 512 + b"\x00", "text/plain; charset=utf-8"),
    ("é ü\n".encode(), "text/plain; charset=utf-8"), (b"BM6", "image/bmp"), (b"\x00\x00\x01\x00", "image/x-icon"), (b"\x00\x01\x00\x00", "font/ttf"), (b"OggS\x00", "application/ogg")]


def test_examples(spark):
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(EXAMPLES)], "i int, d binary")
    got = {r.i: r.t for r in df.select("i", content_type(F.col("d")).alias("t")).collect()}
    assert [(EXAMPLES[i][0], t) for i, t in sorted(got.items())] == EXAMPLES


@pytest.mark.parametrize(("path", "data", "want"), [
    ("main.go", b"package main\nfunc main() {}\n", True), ("component.tsx", b"export function Component() { return <div /> }\n", True), ("README.md", b"# title\n", True),
    ("data.json", b'{"release":"notes"}', True), ("config.yaml", b"release: notes\n", True), ("config.toml", b"release = 1\n", True), ("schema.sql", b"select 1;\n", True), ("feed.xml", b"<feed />\n", True),
    ("LOCKFILE", b"release notes\n", True), ("icon.svg", b"<svg/>", False), ("doc.pdf", b"%PDF-1.7\n", False), ("image.png", b"release notes\n", False), ("archive.bin", b"release notes\n", False),
    ("unknown.zzz", b"%PDF-1.7\n", False), ("unknown.zzz", b"text", True), ("UPPER.PNG", b"text", False), ("noend", b"PK\x03\x04", False)])
def test_table(spark, path, data, want):
    df = spark.createDataFrame([(path, bytearray(data))], "p string, d binary")
    assert df.select(files.is_text(F.col("p"), F.col("d"))).first()[0] == want
