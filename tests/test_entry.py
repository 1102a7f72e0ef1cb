"""The driver's contract."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = entry.__file__.rsplit("/", 1)[0]
FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 40


def test_without_training_operators(tmp_path):
    """The entry and the other queries work where the folder and its pipeline are missing."""
    code = "import sys, __spark_entry__ as e; assert not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()), e.queries(); assert 'hybrid_search' in e.queries()"
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr


def shown(value) -> str:
    """Values of both engines as one kind of text."""
    if isinstance(value, float):
        return "none" if math.isnan(value) else repr(int(value) if value.is_integer() else round(value, 6))
    return "none" if value is None or value is pd.NaT or value is pd.NA else repr(int(value)) if isinstance(value, (bool, np.integer, np.bool_)) else str(value)


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_queries_match_sql(spark, oracle, name):
    want = oracle.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert sorted(got) == sorted(want)
    rows = lambda d: sorted(tuple(map(shown, r)) for r in d[sorted(d)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
    assert len(want)
