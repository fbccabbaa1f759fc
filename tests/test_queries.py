"""Every query against its SQL in DuckDB."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lamina.plans import queries
from lamina.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r[c] for c in columns) for r in got]) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("scheme", ["file:", "file://", ""])
def test_arrow_stripes_lie_in_the_shared_folder(spark, small, tmp_path, scheme, monkeypatch):
    monkeypatch.setattr(queries, "work_path", lambda spark, name: f"{scheme}{tmp_path}/{name}")
    rows = QUERIES["scan_arrow_stripes"](spark, small).count()
    assert rows == spark.read.parquet(f"{small}/orders.parquet").count()
    assert list(tmp_path.rglob("stripe_*.arrow"))


def test_the_engine_stands_without_the_other_subpackage(tmp_path):
    """Where lamina.llm and its pipeline are missing the entry has the engine's queries; another missing module is an error."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root / "lamina", copy / "lamina", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    out = run("import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    assert out.stdout.split() == [str(len(QUERIES)), str(any(q.startswith("op") for q in QUERIES)), "True"], out.stderr
    (copy / "corpus_pipeline.py").write_text("import not_there")
    assert "not_there" in run("import __spark_entry__").stderr
