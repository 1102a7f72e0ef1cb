"""The reader of git objects against git itself."""

from __future__ import annotations

import os
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from tesserae.operators import views
from tesserae.plans import graph
from tesserae.sources import git

ENV = {"GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "A B", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Three commits, packed, with deltas, and one loose; a tag, a branch, a submodule link."""
    root = tmp_path_factory.mktemp("repo")

    def run(*args: str, day: int = 1) -> str:
        when = f"2024-01-0{day}T00:00:00+0000"
        return subprocess.run(["git", *args], cwd=root, check=True, capture_output=True, text=True, env=os.environ | ENV | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}).stdout

    run("init", "-q", "-b", "main", ".")
    lines = [f"line {i} of a longer text {i * i}" for i in range(400)]
    (root / "a").mkdir()
    (root / "a/long.txt").write_text("\n".join(lines))
    (root / "b.py").write_text("x = 1\ny = 2\nz = 3\n")
    (root / "gone.txt").write_text("gone\n")
    (root / "bin.dat").write_bytes(b"a\0b")
    run("add", "-A")
    run("commit", "-q", "-m", "first\n\nwith a body", day=1)
    run("tag", "v1.0.0")
    lines[7] = "changed"
    (root / "a/long.txt").write_text("\n".join(lines))
    (root / "b.py").write_text("x = 1\ny = 22\nz = 3\nw = 4\n")
    (root / "gone.txt").unlink()
    (root / "new.txt").write_text("no end of line")
    run("update-index", "--add", "--cacheinfo", f"160000,{'1' * 40},sub")
    run("add", "-A", "--", "a", "b.py", "gone.txt", "new.txt")
    run("commit", "-q", "-m", "second", day=2)
    run("gc", "-q", "--aggressive", "--prune=now")
    run("mv", "b.py", "c.py")
    run("commit", "-q", "-m", "third", day=3)
    return root, run


@pytest.fixture(scope="module")
def tables(spark, repo):
    objs = graph.written(git.objects(spark, f"file://{repo[0]}/.git"))
    return objs, git.commits(objs), git.references(spark, f"file://{repo[0]}/.git")


def test_objects_are_gits(repo, tables):
    want = dict(line.split(" ", 1) for line in repo[1]("cat-file", "--batch-check", "--batch-all-objects").splitlines())
    got = {r.hash: f"{r.kind} {r.size}" for r in tables[0].collect()}
    assert got == want
    assert all(git._named(r.kind, r.data) == r.hash for r in tables[0].collect())


def test_commits_and_revisions(repo, tables):
    objs, commits, refs = tables
    want = repo[1]("log", "--format=%H|%T|%P|%an|%ae|%at|%s").splitlines()
    got = {r.sha: r for r in commits.withColumn("at", F.unix_timestamp("author_time")).collect()}
    assert sorted(want) == sorted("|".join((r.sha, r.tree, " ".join(r.parents), r.author, r.email, str(r["at"]), r.message.split("\n")[0])) for r in got.values())
    for expression in ("", "HEAD", "main", "HEAD~1", "main^", "v1.0.0", "HEAD~2", repo[1]("rev-parse", "HEAD~1").strip()[:9]):
        assert git.resolved(expression, refs, commits) == repo[1]("rev-parse", expression or "HEAD").strip()
    with pytest.raises(ValueError, match="no commit"):
        git.resolved("HEAD~3", refs, commits)


def test_flat_trees_and_files(spark, repo, tables):
    objs, commits, _ = tables
    flat = git.flattened(git.tree_entries(objs), commits.select(F.col("tree").alias("root")))
    for rev in ("HEAD", "HEAD~1", "HEAD~2"):
        want = [tuple(x.split()[i] for i in (3, 2, 0)) for x in repo[1]("ls-tree", "-r", rev).splitlines()]
        tree = repo[1]("rev-parse", f"{rev}^{{tree}}").strip()
        assert sorted((r.path, r.blob, r.mode) for r in flat.where(F.col("root") == tree).collect()) == sorted(want)
    head = repo[1]("rev-parse", "HEAD^{tree}").strip()
    blobs = git.blobs(objs)
    files = {r.path: r for r in git.tree_files(flat.where(F.col("root") == head), blobs).collect()}
    assert {k: r.reason for k, r in files.items()} == {"a/long.txt": None, "bin.dat": "binary", "c.py": None, "new.txt": None}
    assert bytes(files["new.txt"].content) == b"no end of line"
    assert [r.path for r in git.gitlinks(flat.where(F.col("root") == head)).collect()] == ["sub"]
    assert git.file_at(flat.where(F.col("root") == head), blobs, "c.py").first().text == repo[1]("show", "HEAD:c.py")
    part = git.tree_files(flat.where(F.col("root") == head), blobs.where("false"), ["a"], missing="oversized").collect()
    assert [(r.path, r.reason) for r in part] == [("a/long.txt", "oversized")]


def test_views_are_gits(spark, repo, tables):
    """The difference of two trees by path, status, counts and text."""
    objs, commits, refs = tables
    flat = graph.written(git.flattened(git.tree_entries(objs), commits.select(F.col("tree").alias("root"))))
    at = lambda rev: flat.where(F.col("root") == repo[1]("rev-parse", f"{rev}^{{tree}}").strip()).drop("root")
    view = views.View(at("HEAD~2"), at("HEAD~1"), git.blobs(objs))
    status = dict(reversed(line.split("\t")) for line in repo[1]("diff", "--no-renames", "--name-status", "HEAD~2", "HEAD~1").splitlines())
    assert {r.path: r.status for r in view.status().collect()} == status
    stats = {p: (a, d) for a, d, p in (line.split("\t") for line in repo[1]("diff", "--no-renames", "--numstat", "HEAD~2", "HEAD~1").splitlines())}
    assert {r.path: (str(r.adds), str(r.deletes)) for r in view.stats().collect()} == stats
    body = lambda text: [re.sub("^(@@ .*? @@).*", r"\\1", x) for x in text.splitlines() if not x.startswith(("index ", "new file", "deleted file", "diff "))]
    text, cut = view.text().first()
    assert not cut
    assert body(text) == body(repo[1]("diff", "--no-renames", "HEAD~2", "HEAD~1", "--", "a", "b.py", "gone.txt", "new.txt", "sub"))
    assert [r.path for r in view.for_paths(spark.createDataFrame([("b.py",)], "path string")).paths().collect()] == ["b.py"]
    moved = views.View(at("HEAD~1"), at("HEAD"), git.blobs(objs))
    assert [(r.path, r.old_path, r.status) for r in moved.changes.collect()] == [("c.py", "b.py", "renamed")]
    assert sorted((r.path, r.status) for r in moved.status().collect()) == [("b.py", "D"), ("c.py", "A")]
    assert view.fingerprint().first() != moved.fingerprint().first()
    views.check_fingerprint(view, view.fingerprint().first()[0])
    with pytest.raises(ValueError, match="changed"):
        views.check_fingerprint(view, moved.fingerprint().first()[0])
    assert "+ y = 22" in view.excerpt().first()[0]
