"""The trie of conversations against one built in memory."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tesserae.llm import prefix_trie
from tesserae.llm.prefix_trie import prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, n string, part string"
REBUILD = {"heads": "crc32(cast(conv as string)) % 4", "base": "conv - conv % 20"}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "n", "p") for r in rows], SCHEMA).repartition(parts)


def plain(rows, rebuild=True):
    """All nodes by walking the sequences in memory."""
    own = defaultdict(list)
    tie = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, tie(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = {}
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out[(min(m), len(p))] = (min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows_of(seed):
    r = random.Random(seed)
    text = lambda: r.choice(["a b c", "a  b", "x", "", None, "é ü\tß", "w " * 9])
    rows = []
    for c in [*range(0, 45), 57, 77, 100, 119, -5, -20, -33]:
        for t in range(r.choice([1, 2, 3, 4, 6])):
            rows.append((c, r.choice([t, t, t, None, 1]), r.choice(["user", "assistant", None]), text()))
    rows += [(None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x")]
    return rows


def as_dict(df):
    got = [tuple(r) for r in df.collect()]
    out = {(r[0], r[1]): r[2:] for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = rows_of(seed)
    rebuilt = trie(frame(spark, rows), **REBUILD)
    assert rebuilt.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert as_dict(rebuilt) == plain(rows)
    assert as_dict(trie(frame(spark, rows))) == plain(rows, rebuild=False)


def test_long_conversation_over_many_parts(spark, monkeypatch):
    """One conversation and its copy hold nearly all rows, in several parts; common keys go by broadcast; merges take rounds."""
    monkeypatch.setattr(prefix_trie, "HEAVY_ROWS", 1)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rows = [(c, t, "user", f"t{t}") for c in (3, 21) for t in range(150)]
    rows += [(c, t, "user", f"t{t}" if t < c % 7 else f"{c} {t}") for c in range(30, 70) for t in range(6)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = prefix_trie.spread(frame(spark, rows), "conv_id", "turn", "role", "text")
        assert parts.where("conv = 3").select("part").distinct().count() > 1
        got = as_dict(trie(frame(spark, rows), **REBUILD))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert got == plain(rows)


def test_turnless_and_empty(spark):
    assert trie(frame(spark, [], 1)).count() == 0
    gone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:3]
    rows = [(c, 0, "user", "only") for c in gone]  # no base, and the only turn goes
    got = as_dict(trie(frame(spark, rows), **REBUILD))
    assert got == plain(rows) and list(got) == [(gone[0], 0)]


def test_sql(spark):
    """The registered query against its SQL."""
    import duckdb

    from tesserae.llm import queries

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {tuple(r) for r in duckdb.sql(queries.OP12_SQL).fetchall()}
    assert {tuple(r) for r in queries.op12_conversation_trie(spark, sf).collect()} == want and want
