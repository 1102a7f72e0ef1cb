"""Reader of git repositories: loose and packed objects, trees, commits and references as tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.graph import written
from .files import FILE_BYTES, SNIFF, is_text

OBJECTS = "hash string, kind string, size bigint, data binary"
#: Kinds of pack entries, and modes of directories, links and submodules.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAMED_DELTA = 6, 7
DIRECTORY, LINK, GITLINK = "40000", "120000", "160000"


def _named(kind: str, data: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data, usedforsecurity=False).hexdigest()


def _loose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            head, _, data = zlib.decompress(content).partition(b"\0")
            kind, size = head.decode().split(" ")
            rows.append(("".join(path.split("/")[-2:]), kind, int(size), data))
        yield pd.DataFrame(rows, columns=["hash", "kind", "size", "data"])


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian number of 7-bit groups, and the place after it."""
    out = shift = 0
    while True:
        out |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return out, at


def _patched(base: bytes, delta: bytes) -> bytes:
    """A delta's copies from its base and its own bytes, one after another."""
    _, at = _number(delta, 0)
    size, at = _number(delta, at)
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op < 0x80:
            out += delta[at : at + op]
            at += op
            continue
        place = [0] * 7
        for bit in range(7):
            if op >> bit & 1:
                place[bit], at = delta[at], at + 1
        start, n = int.from_bytes(place[:4], "little"), int.from_bytes(place[4:], "little") or 0x10000
        out += base[start : start + n]
    if len(out) != size:
        raise ValueError("a delta doesn't give the size that it promises")
    return bytes(out)


def _inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """One compressed stream and the place after it, fed in steps so that the rest isn't copied."""
    stream, out = zlib.decompressobj(), []
    while not stream.eof:
        piece = data[at : at + 65_536]
        if not len(piece):
            raise ValueError("a pack ends within an object")
        out.append(stream.decompress(piece))
        at += len(piece) - len(stream.unused_data)
    return b"".join(out), at


def unpacked(pack: bytes) -> Iterator[tuple[str, str, int, bytes]]:
    """Objects of a pack: hash, kind, size, data. Bases of deltas must be in the pack."""
    magic, version, count = struct.unpack(">4sII", pack[:12])
    if magic != b"PACK" or version not in (2, 3):
        raise ValueError("no pack of version 2 or 3")
    if hashlib.sha1(pack[:-20], usedforsecurity=False).digest() != pack[-20:]:
        raise ValueError("a pack's checksum is wrong")
    view, at = memoryview(pack), 12
    known: dict[int, tuple[str, bytes]] = {}
    places: dict[bytes, int] = {}
    waiting: list[tuple[int, bytes, bytes]] = []

    def told(place: int, kind: str, data: bytes) -> tuple[str, str, int, bytes]:
        name = _named(kind, data)
        known[place], places[bytes.fromhex(name)] = (kind, data), place
        return name, kind, len(data), data

    for _ in range(count):
        place, first = at, pack[at]
        at += 1
        while pack[at - 1] >= 0x80:
            at += 1
        code, base = first >> 4 & 7, None
        if code == OFFSET_DELTA:
            back, at = pack[at] & 0x7F, at + 1
            while pack[at - 1] >= 0x80:
                back, at = (back + 1 << 7) | pack[at] & 0x7F, at + 1
            base = place - back
        elif code == NAMED_DELTA:
            base, at = pack[at : at + 20], at + 20
        data, at = _inflated(view, at)
        if base is None:
            yield told(place, KINDS[code], data)
        elif (where := base if isinstance(base, int) else places.get(base)) in known:
            kind, body = known[where]
            yield told(place, kind, _patched(body, data))
        else:
            waiting.append((place, base, data))
    while waiting:
        ready = [w for w in waiting if (w[1] if isinstance(w[1], int) else places.get(w[1])) in known]
        if not ready:
            raise ValueError("a delta's base isn't in the pack")
        for place, base, data in ready:
            kind, body = known[base if isinstance(base, int) else places[base]]
            yield told(place, kind, _patched(body, data))
        waiting = [w for w in waiting if w not in ready]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for content in b["content"]:
            rows, held = [], 0
            for row in unpacked(content):
                rows.append(row)
                held += row[2]
                if held > 16 << 20:
                    yield pd.DataFrame(rows, columns=["hash", "kind", "size", "data"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["hash", "kind", "size", "data"])


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """All objects of a repository's folder (A08): hash, kind, size, data. A pack is read by one task and must be below 2 GB."""
    read = lambda glob, depth: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(f"{folder}/objects{depth}").select("path", "content")
    loose = read("[0-9a-f]*", "").where(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]{38}$")).mapInPandas(_loose, OBJECTS)
    packs = read("*.pack", "").mapInPandas(_packed, OBJECTS)
    return loose.unionByName(packs).dropDuplicates(["hash"])


def blobs(objs: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """Blobs with their data, null beyond a size."""
    return objs.where("kind = 'blob'").select(F.col("hash").alias("blob"), "size", F.when(F.col("size") <= most, F.col("data")).alias("data"))


def tree_entries(objs: DataFrame) -> DataFrame:
    """Entries of all trees: tree, name, mode, child."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry = re.compile(rb"([0-7]+) ([^\0]+)\0(.{20})", re.S)
        for b in batches:
            rows = [(h, m[2].decode(errors="replace"), m[1].decode(), m[3].hex()) for h, data in zip(b["hash"], b["data"], strict=True) for m in entry.finditer(data)]
            yield pd.DataFrame(rows, columns=["tree", "name", "mode", "child"])

    return objs.where("kind = 'tree'").select("hash", "data").mapInPandas(run, "tree string, name string, mode string, child string")


def commits(objs: DataFrame) -> DataFrame:
    """Commits: sha, tree, parents, author, email, author_time, message."""
    text = F.decode("data", "UTF-8")
    head, message = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n", 2)[0], F.regexp_extract(text, r"(?s)^.*?\n\n(.*)$", 1)
    field = lambda name, i=1, p="(.*)": F.regexp_extract(head, rf"(?m)^{name} {p}$", i)
    who = r"(.*?) ?<(.*)> (\d+) ([+-]\d{4})"
    return objs.where("kind = 'commit'").select(
        F.col("hash").alias("sha"), field("tree").alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), 1).alias("parents"),
        field("author", 1, who).alias("author"), field("author", 2, who).alias("email"), F.timestamp_seconds(field("author", 3, who).try_cast("bigint")).alias("author_time"), message.alias("message"))


def parent_edges(commits_: DataFrame) -> DataFrame:
    """Edges for reachability: sha, parent, ordinal."""
    return commits_.select("sha", F.posexplode_outer("parents").alias("ordinal", "parent"))


def references(spark: SparkSession, folder: str) -> DataFrame:
    """References, loose ones before packed ones: name, target (of symbolic ones), hash."""
    text = spark.read.text([f"{folder}/HEAD", f"{folder}/refs"], wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("f"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("v"))
    name = F.when(F.col("f").endswith("/HEAD") & ~F.col("f").contains("/refs/"), "HEAD").otherwise(F.concat(F.lit("refs/"), F.regexp_replace("f", r"^.*?/refs/", "")))
    symbolic = F.col("v").startswith("ref: ")
    loose = text.select(name.alias("name"), F.when(symbolic, F.substring("v", 6, 10_000)).alias("target"), F.when(~symbolic, F.col("v")).alias("hash"))
    lines = spark.read.option("pathGlobFilter", "packed-refs").text(folder).where(F.col("value").rlike(r"^[0-9a-f]{40} "))
    packed = lines.select(F.substring("value", 42, 10_000).alias("name"), F.lit(None).cast("string").alias("target"), F.substring("value", 1, 40).alias("hash"))
    return loose.unionByName(packed.join(loose.select("name"), "name", "left_anti"))


def flattened(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """All entries below root trees (root) but directories (A06, A03): root, path, mode, blob. A level a round."""
    level = roots.select("root", F.lit("").alias("prefix"), F.col("root").alias("tree")).distinct()
    out = None
    while True:
        found = written(level.join(entries, "tree").select("root", F.concat("prefix", "name").alias("path"), "mode", "child"))
        leaves = found.where(F.col("mode") != DIRECTORY).select("root", "path", "mode", F.col("child").alias("blob"))
        out = leaves if out is None else out.unionByName(leaves)
        level = found.where(F.col("mode") == DIRECTORY).select("root", F.concat("path", F.lit("/")).alias("prefix"), F.col("child").alias("tree"))
        if level.isEmpty():
            return out


def gitlinks(flat: DataFrame) -> DataFrame:
    """Submodules of flat trees (H04): root, path, sha."""
    return flat.where(F.col("mode") == GITLINK).select("root", "path", F.col("blob").alias("sha"))


def tree_files(flat: DataFrame, blobs_: DataFrame, scope: list[str] | None = None, missing: str | None = None) -> DataFrame:
    """Files of flat trees with the reason for leaving each out (A02, A03, A04): root, path, blob, size, content, reason.

    Paths outside the scope, links and submodules are no files. The size is tested before the content is joined. A
    blob that a cache lacks has the reason ``missing`` (a filtered cache lacks what is oversized); without one it is an error when read.
    """
    files = flat.where(~F.col("mode").isin(GITLINK, LINK))
    if scope:
        files = files.where(P.in_scope(F.col("path"), P.normalized_scope(scope)))
    dot = P.is_hidden(F.col("path"), scope)
    known = files.join(blobs_.select("blob", "size"), "blob", "left")
    lost = F.lit(missing) if missing else F.raise_error(F.concat(F.lit("no blob "), F.col("blob"))).cast("string")
    by_name = (
        F.when(dot & P.base(F.col("path")).startswith("."), "dot_file").when(dot, "dot_dir").when(F.col("size").isNull(), lost)
        .when(F.col("size") > FILE_BYTES, "oversized").when(~is_text(F.col("path")), "non_text"))
    known = known.withColumn("by_name", by_name)
    body = blobs_.select("blob", "data").join(known.where("by_name is null").select("blob").distinct(), "blob", "left_semi")
    out = known.join(body, "blob", "left")
    binary = F.hex(F.substring("data", 1, SNIFF)).rlike("^(..)*00")
    reason = F.coalesce("by_name", F.when(binary, "binary").when(~is_text(F.col("path"), F.col("data")), "non_text"))
    return out.select("root", "path", "blob", "size", F.when(reason.isNull(), F.col("data")).alias("content"), reason.alias("reason"))


def file_at(flat: DataFrame, blobs_: DataFrame, path: str) -> DataFrame:
    """One regular file at each root (A12, L13): root, path, blob, size, text."""
    at = flat.where((F.col("path") == path) & ~F.col("mode").isin(GITLINK, LINK))
    return at.join(blobs_, "blob").select("root", "path", "blob", "size", F.decode("data", "UTF-8").alias("text"))


def resolved(expression: str, refs: DataFrame, commits_: DataFrame) -> str:
    """The commit of a name, an abbreviated id, or either with ~n and ^n after it; nothing means HEAD."""
    name, steps = re.fullmatch(r"([^~^]*)((?:[~^]\d*)*)", expression.strip() or "HEAD").groups()
    known = {r["name"]: (r["target"], r["hash"]) for r in refs.where(F.col("name").isin("HEAD", name, *(f"refs/{x}{name}" for x in ("", "tags/", "heads/", "remotes/"))) | F.col("target").isNotNull()).collect()}
    at = next((n for n in (name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}") if n in known), None)
    sha = None
    for _ in range(10):
        if at is None:
            break
        target, sha = known.get(at) or (None, None)
        if sha is None and target is not None and target not in known:
            hit = refs.where(F.col("name") == target).select("hash").first()
            sha = hit and hit[0]
        at = None if sha else target
    if sha is None and re.fullmatch("[0-9a-f]{4,40}", name):
        hits = commits_.where(F.col("sha").startswith(name)).select("sha").limit(2).collect()
        sha = hits[0][0] if len(hits) == 1 else None
    if sha is None:
        raise ValueError(f"no commit for {expression!r}")
    for kind, n in re.findall(r"([~^])(\d*)", steps):
        for which in [1] * int(n or 1) if kind == "~" else [int(n or 1)]:
            row = commits_.where(F.col("sha") == sha).select(F.get("parents", F.lit(which - 1))).first() if which else (sha,)
            if row is None or row[0] is None:
                raise ValueError(f"no commit for {expression!r}")
            sha = row[0]
    return sha
