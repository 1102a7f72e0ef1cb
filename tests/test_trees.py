"""Tree objects, pruned differences and renames by similarity, against git and plain loops."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae import view_queries
from tesserae.operators import renames, views
from tesserae.plans import graph
from tesserae.queries import SQL

from .test_git import ENV


def test_tree_ids_are_gits(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True, text=True, env=os.environ | ENV).stdout
    run("init", "-q", ".")
    for name in ("a/b/c.txt", "a/b.txt", "a.txt", "a-x", "a0", "ab/é.txt", "z/y/x/w", "run.sh"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "run.sh").chmod(0o755)
    run("add", "-A")
    root = run("write-tree").strip()
    files = [(p, m, b) for m, b, p in re.findall(r"(\d+) blob ([0-9a-f]{40})\t(.*)", run("-c", "core.quotepath=off", "ls-tree", "-r", root))]
    want = {p: t for t, p in re.findall(r"\d+ tree ([0-9a-f]{40})\t(.*)", run("-c", "core.quotepath=off", "ls-tree", "-r", "-t", root))} | {".": root}
    got = graph.merkle(spark.createDataFrame(files, "path string, mode string, blob string"))
    assert {r.dir: r.hash for r in got.collect()} == want
    assert graph.merkle(spark.createDataFrame([], "path string, blob string")).count() == 0


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned by sorting and made broadcasts while they run, as with many files."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_tree_ids_of_directories_that_tasks_share(spark, late_broadcasts):
    files = {f"{i % 3}/{i}": f"{i:040x}" for i in range(300)}
    tree = lambda es: hashlib.sha1(b"tree %d\0" % sum(map(len, es)) + b"".join(es)).hexdigest()
    entry = lambda mode, name, child: f"{mode} {name}\0".encode() + bytes.fromhex(child)
    want = {str(d): tree([entry("100644", n, b) for n, b in sorted((p[2:], b) for p, b in files.items() if p[0] == str(d))]) for d in range(3)}
    want["."] = tree([entry("40000", d, h) for d, h in sorted(want.items())])
    got = graph.merkle(spark.createDataFrame(list(files.items()), "path string, blob string").repartition(4)).collect()
    assert sorted((r.dir, r.hash) for r in got) == sorted(want.items())


def made(spark, files):
    return spark.createDataFrame([(p, "100644", b) for p, b in files.items()], "path string, mode string, blob string")


@pytest.mark.parametrize("seed", range(2))
def test_pruned_diff(spark, seed):
    """The same rows as from flat trees, and only what lies beside a change is read."""
    r = random.Random(seed)
    blob = lambda: f"{r.randrange(1 << 60):040x}"
    old = {f"d{i % 10}/e{i % 7}/f{i}": blob() for i in range(700)}
    new = dict(old)
    for p in r.sample(sorted(old), 3):
        new[p] = blob()
    gone, come = r.sample(sorted(old), 2)
    del new[gone]
    new[come + "x"] = old[gone]
    new["d1/e1"] = blob() if seed else new.get("d1/e1", blob())  # a file where a directory is, too
    new = {p: b for p, b in new.items() if not p.startswith("d1/e1/")}
    new["n/e/w"] = blob()
    trees = [graph.written(graph.tree_objects(made(spark, x))) for x in (old, new)]
    roots = [t.where("dir = '.'").first().tree for t in trees]
    entries = graph.written(trees[0].unionByName(trees[1]).select("tree", "name", "mode", "child").distinct())
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    for renamed in (False, True):
        got = {tuple(x) for x in views.pruned_diff(entries, *roots, renames=renamed).collect()}
        assert got == {tuple(x) for x in views.tree_diff(made(spark, old), made(spark, new), renames=renamed).collect()}
    small = dict(old, **{sorted(old)[0]: blob()})
    other = graph.written(graph.tree_objects(made(spark, small)))
    both = graph.written(trees[0].unionByName(other).select("tree", "name", "mode", "child").distinct())
    path = [t for x in (trees[0], other) for t in {y.tree for y in x.where("dir in ('.', 'd0', 'd0/e0')").collect()}]
    read = both.where(F.col("tree").isin(path))
    assert read.count() < both.count() / 4
    got = views.pruned_diff(read.mapInPandas(counted, read.schema), roots[0], other.where("dir = '.'").first().tree)
    assert [(x.path, x.status) for x in got.collect()] == [(sorted(old)[0], "modified")]
    assert views.pruned_diff(entries, roots[0], roots[0]).count() == 0


def test_pruned_diff_of_directories_that_tasks_share(spark, late_broadcasts):
    old = {f"{i % 3}/{i}": f"{i:040x}" for i in range(300)}
    new = dict(old, **{"1/1": f"{7:040x}", "2/x": f"{8:040x}"})
    trees = [graph.tree_objects(made(spark, x).repartition(4)) for x in (old, new)]
    assert [t.select("dir", "tree").distinct().count() for t in trees] == [4, 4]
    roots = [t.where("dir = '.'").first().tree for t in trees]
    got = views.pruned_diff(trees[0].unionByName(trees[1]).select("tree", "name", "mode", "child").distinct(), *roots, renames=False).collect()
    assert sorted((r.path, r.status) for r in got) == [("1/1", "modified"), ("2/x", "added")]


ODD = {
    "null text": [(0, "a", "en", "s0"), (1, None, "en", "s0"), (2, None, "en", "s0"), (3, "b", "en", "s0"), (4, None, "de", "s1"), (5, "c", "en", "s0"), (6, None, "en", "s0")],
    "null names": [(0, "a", "en", "s0"), (1, "b", None, "s0"), (2, "c", "en", None), (3, "d", "de", None), (None, "e", "en", "s0"), (4, "f", "en", "s0")],
    "repeated rows": [(0, "a", "en", "s0"), (1, "b", "en", "s0"), (1, "b", "en", "s0"), (2, "c", "en", "s0"), (3, "d", "de", "s1"), (3, "d", "de", "s1")],
    "no documents": [],
}


@pytest.mark.parametrize("name", ODD)
def test_pruned_tree_diff_of_odd_documents(spark, tmp_path, late_broadcasts, name):
    """As the SQL has them: null texts, paths with parts that are null, rows that come twice, and no rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table, rows, kind in (("documents", ODD[name], "doc_id bigint, text string, lang string, source string"), ("benchmark", [(0, "x"), (1, None if name == "null text" else "z"), (2, "y")], "item_id bigint, text string")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = view_queries.pruned_tree_diff(spark, str(tmp_path)).select("path", "status", "old_blob", "new_blob").collect()
    assert Counter(tuple(r) for r in got) == Counter(con.execute(SQL["pruned_tree_diff"]).fetchall())


def plain_renames(gone, come, blobs, least=60):
    """All pairs, sorted, one partner each."""
    cut = lambda d: Counter({k: n * len(k) for k, n in Counter(re.findall(rb"[^\n]{0,63}\n|[^\n]{1,64}", d)).items()})
    pairs = []
    for p, a in gone.items():
        for q, b in come.items():
            x, y = blobs[a], blobs[b]
            if x and y:
                score = sum((cut(x) & cut(y)).values()) * 10_000 // max(len(x), len(y))
                total = (score * 99 + renames.name_score(p, q) * 100) // 10_000
                if total >= least:
                    pairs.append((-total, p, q))
    out, used, taken = [], set(), set()
    for s, p, q in sorted(pairs):
        if p not in used and q not in taken:
            used.add(p)
            taken.add(q)
            out.append((p, q, -s))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_renames(spark, seed):
    r = random.Random(seed)
    line = lambda: b" ".join(r.choice([b"func", b"return", b"x", b"}", b"if err", b"\xc3\xa9"]) for _ in range(r.randint(1, 20))) + b"\n"
    gone, come, blobs = {}, {}, {}
    for i in range(14):
        text = [line() for _ in range(r.choice([1, 5, 30]))]
        blobs[f"a{i}"] = b"".join(text)
        gone[f"src/{i % 3}/f{i}.go"] = f"a{i}"
        for j in range(r.randint(0, 2)):
            edited = text[:]
            for _ in range(r.randint(0, max(1, len(text) // 2))):
                edited[r.randrange(len(edited))] = line()
            blobs[f"b{i}{j}"] = b"".join(edited) + (b"tail" if j else b"")
            come[f"pkg/{i % 3}/f{i}{j}.go"] = f"b{i}{j}"
    blobs |= {"e": b"", "l": b"y" * 1000, "m": b"y" * 900}
    gone |= {"empty": "e", "long": "l"}
    come |= {"none": "e", "longer": "m"}
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, blob string")
    data = spark.createDataFrame([(b, bytearray(x)) for b, x in blobs.items()], "blob string, data binary")
    got = sorted(tuple(x) for x in renames.renames(df(gone), df(come), data).collect())
    assert got == plain_renames(gone, come, blobs) and any(p == "long" for p, _, _ in got)


def test_copies_are_compared_once(spark, monkeypatch):
    """Pairs of copies come only in the end: no written table has as many rows as there are pairs. Copies fill several parts."""
    rows = []
    monkeypatch.setattr(renames, "written", lambda d: (w := graph.written(d), rows.append(w.count()))[0])
    monkeypatch.setattr(renames, "PART", 7, raising=False)
    text = "".join(f"line {i}\n" for i in range(9))
    old = {**{f"a{i}": text for i in range(40)}, "other": text + "more\n", "none": ""}
    new = {**{f"b{i}": text + "end" for i in range(30)}, "far": "else\n"}
    data = lambda d: spark.createDataFrame([(b, bytearray(x.encode())) for b, x in d.items()], "blob string, data binary")
    got = sorted(tuple(x) for x in renames.similar(data(old), data(new)).select("from", "to", "shared", "size").collect())
    n = len(text)
    assert got == sorted([(f"a{i}", f"b{j}", n, n + 3) for i in range(40) for j in range(30)] + [("other", f"b{j}", n, n + 5) for j in range(30)])
    assert max(rows) < 100


def test_moved_and_edited_file_in_a_view(spark):
    """A file that moves with an edit is one change, with its lines counted; an exact move goes first."""
    body = [f"line {i}\n" for i in range(20)]
    texts = {"1": "".join(body), "2": "".join([*body[:5], "other\n", *body[6:]]), "3": "else\n" * 9, "4": "".join(body[:3])}
    blobs = spark.createDataFrame([(k, len(v), bytearray(v.encode())) for k, v in texts.items()], "blob string, size int, data binary")
    old, new = made(spark, {"a/x.go": "1", "b/keep.go": "3", "b/y.go": "3"}), made(spark, {"c/x.go": "2", "b/keep.go": "3", "d/z.go": "3", "q": "4"})
    view = views.View(old, new, blobs)
    got = {r.path: (r.old_path, r.status) for r in view.changes.collect()}
    assert got == {"c/x.go": ("a/x.go", "renamed"), "d/z.go": ("b/y.go", "renamed"), "q": (None, "added")}
    assert {r.path: (r.adds, r.deletes) for r in view.stats().collect()}["c/x.go"] == (1, 1)
    assert "rename from a/x.go" in view.text().first()[0]
    exact = views.View(old, new, blobs, similar=False)
    assert {r.path: r.status for r in exact.changes.collect()} == {"a/x.go": "deleted", "c/x.go": "added", "d/z.go": "renamed", "q": "added"}


def test_name_score():
    assert renames.name_score("a/b.go", "a/b.go") == 100 and renames.name_score("b.go", "c.go") == 87 and renames.name_score("a/x", "b/y") == 12
