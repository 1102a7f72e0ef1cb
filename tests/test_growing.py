"""Objects of a pack that arrives in pieces."""

from __future__ import annotations

import glob
import os
import random
import subprocess

import pytest

from tesserae.sources import growing

from .test_git import ENV


@pytest.fixture(scope="module")
def pack(tmp_path_factory):
    """A pack with deltas of deltas, and what git says is in it."""
    root = tmp_path_factory.mktemp("growing")
    run = lambda *a: subprocess.run(["git", *a], cwd=root, check=True, capture_output=True, text=True, env=os.environ | ENV).stdout
    run("init", "-q", "-b", "main", ".")
    r = random.Random(1)
    lines = [f"line {r.random()}" for _ in range(300)]
    for i in range(12):
        lines[r.randrange(300)] = f"changed {i} {r.random()}"
        (root / "a.txt").write_text("\n".join(lines))
        (root / f"b{i}").write_bytes(r.randbytes(2000))
        run("add", "-A")
        run("commit", "-q", "-m", f"c{i}")
    run("gc", "-q", "--aggressive", "--prune=now")
    data = open(glob.glob(f"{root}/.git/objects/pack/*.pack")[0], "rb").read()
    return data, dict(x.split(" ", 1) for x in run("cat-file", "--batch-check", "--batch-all-objects").splitlines())


def test_pieces(spark, pack, tmp_path, monkeypatch):
    """Whole objects come before the pack is whole; a restart repeats none; in the end all are there."""
    monkeypatch.setattr(growing, "SPLIT", 3000)
    data, want = pack
    spark.dataSource.register(growing.GrowingPack)
    path = str(tmp_path / "x.pack")

    def start():
        stream = spark.readStream.format("growing_pack").load(path)
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()

    def grown(to: int):
        with open(path, "ab") as f:
            f.write(data[os.path.getsize(path) if os.path.exists(path) else 0 : to])

    seen = []
    for to in (5, len(data) // 3, 2 * len(data) // 3, len(data)):
        grown(to)
        q = start()
        q.processAllAvailable()
        q.stop()
        rows = spark.read.schema(growing.SCHEMA).parquet(str(tmp_path / "out")).collect() if glob.glob(str(tmp_path / "out/*.parquet")) else []
        assert len({x.hash for x in rows}) == len(rows) and all(want[x.hash] == f"{x.kind} {x.size}" and len(x.data) == x.size for x in rows)
        seen.append(len(rows))
    assert seen[0] == 0 < seen[1] < seen[2] < seen[3] == len(want)


def test_ends_of_objects(pack, tmp_path):
    """A pack that is cut anywhere gives the objects before the cut, and none of another file."""
    data, want = pack
    path = str(tmp_path / "y.pack")
    sizes = []
    for to in [*range(0, len(data), 997), len(data) - 20, len(data)]:
        with open(path, "wb") as f:
            f.write(data[:to])
        reader = growing.PackStream(path)
        end = reader.latestOffset()["at"]
        assert end <= max(to, growing.FIRST)
        sizes.append(reader.seen)
    assert sizes == sorted(sizes) and sizes[-2:] == [len(want)] * 2
    with open(path, "wb") as f:
        f.write(b"not a pack at all")
    with pytest.raises(ValueError, match="no pack"):
        growing.PackStream(path).latestOffset()
    assert growing.PackStream(str(tmp_path / "none")).latestOffset() == {"at": growing.FIRST}
