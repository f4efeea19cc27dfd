"""Queries against their SQL, registration, and the guard around this package."""

import os
import subprocess
import sys

import oracle
import pytest

import __spark_entry__ as entry_point
from shoplens.llm import queries

SF_DIR = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"
ROOT = os.path.dirname(os.path.abspath(entry_point.__file__))


def test_registered():
    names = entry_point.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(oracle, "NOT_IN_PLANS", ("CartesianProduct", "BroadcastNestedLoopJoin"))
    con = oracle.connect(SF_DIR)
    assert oracle.compare(spark, con, SF_DIR, queries.QUERIES[name], queries.ORACLES[name]) == []


def test_entry_point_without_this_package(tmp_path):
    """The rest must work when both folders and the pipeline are gone."""
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    package = tmp_path / "shoplens"
    package.mkdir()
    for name in os.listdir(os.path.join(ROOT, "shoplens")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "shoplens", name), package / name)
    code = "import __spark_entry__ as e; assert 'rfm' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_outside_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "shoplens")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "shoplens.llm" not in open(os.path.join(folder, f)).read()
