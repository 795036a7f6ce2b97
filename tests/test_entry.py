import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from curaspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["balanced_totals", "generation_stats", "binary_metrics", "nonrefused_index", "postprocess_cleaned", "adapter_extract"])
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 50


def test_nothing_imports_the_optional_subpackage():
    code = "import sys; sys.modules['curaspark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) == len(registry.queries())
    inner = [p for p in (ROOT / "curaspark").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in inner if "curaspark.llm" in p.read_text(encoding="utf-8")]
