"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_agree(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(e.SMOKE):
        assert e.entry(spark).limit(1).count() == 1


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest works when both folders and the pipeline are gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (copy / "reconcord" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'all_balances' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "reconcord")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n)).read()
                    assert "reconcord.llm" not in text and ".llm" not in text, n


@pytest.mark.parametrize("name", ["settlement_deadline", "fee_contract_asof", "bank_match_candidates"])
def test_no_cross_products_in_plans(spark, name):
    import __spark_entry__ as e

    if os.path.isdir(e.SMOKE):
        plan = e.queries()[name](spark, e.SMOKE)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Cross" in line]
        assert len(joins) <= 1  # the test view of bank lines is a product with two rows
