import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from millrace.queries import QUERIES, SQL
from tests.conftest import ROOT, SF

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    told = duck.sql(SQL[name])
    assert sorted(told.columns) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    want = sorted(tuple(map(plain, r)) for r in told.select(*[f'"{c}"' for c in columns]).fetchall())
    assert rows == want and rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_package_stands_without_the_corpus_subpackage(tmp_path):
    """In a copy of the repository from which the subpackage, its tests and the pipeline are deleted."""
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); import millrace.pipeline, millrace.cli, bench"
    clean = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != str(ROOT))}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0 and "error" not in found.stdout.lower().splitlines()[-1], found.stdout[-2000:]
    # Those that need no long Spark job are run there as well.
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_config.py", "tests/test_providers.py", "tests/test_functions.py", "tests/test_open_answers.py"], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=900)
    assert ran.returncode == 0, ran.stdout[-2000:]
