"""Every registered query of the ensemble operators against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from timberline import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"adaboost", "adacost", "contrast_p_values", "gbt_classes"}


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def text(row) -> tuple:
    return tuple(f"{round(x, 5) + 0.0:.5f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, engine, name):
    got = catalogue.queries()[name](spark, SF)
    want = engine.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    quoted = [f"`{n}`" for n in names]
    assert sorted(map(text, got.select(*quoted).collect())) == sorted(map(text, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - SLOW))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_without_the_corpus_package(tmp_path):
    root = os.path.dirname(os.path.dirname(__file__))
    for name in ("timberline", "__spark_entry__.py", *(["corpus_pipeline.py"] if os.path.exists(f"{root}/corpus_pipeline.py") else [])):
        subprocess.run(["cp", "-r", name, str(tmp_path)], check=True, cwd=root)
    subprocess.run(["rm", "-rf", str(tmp_path / "timberline/llm")], check=True)
    for _ in range(2):  # with the pipeline's file and without
        _lacks_corpus(tmp_path)
        subprocess.run(["rm", "-f", str(tmp_path / "corpus_pipeline.py")], check=True)


def _lacks_corpus(tmp_path):
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 40, any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.split() == ["True", "False"], said.stderr
