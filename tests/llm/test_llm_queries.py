"""The registered queries next to their SQL, and the guard around the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from conftest import SF
from wardline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql_agree(spark, name):
    assert compare.difference(entry.queries()[name](spark, SF), compare.duck(SF), queries.ORACLES[name]) is None


def test_each_operator_has_a_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_the_rest_imports_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "wardline.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op1_") or n == "pipeline"] and "flagship" in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
