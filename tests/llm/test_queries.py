import pytest

import __spark_entry__ as entry
from curaspark.llm import queries as q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_runs(spark, name):
    assert q.queries()[name](spark, FOLDER).count() >= 0


def test_columns(spark):
    want = {
        "p2_found": {"group": "string", "is_hate": "bigint"}, "p3_found": {"rec_a": "string", "rec_b": "string"}, "p4_found": {"original_idx": "bigint"},
        "p5_found": {"task_id": "bigint", "defect": "string"}, "p6_found": {"original_idx": "bigint", "bench": "string", "item_id": "bigint"},
        "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint", "lang": "string"},
    }
    for name, columns in want.items():
        assert dict(q.queries()[name](spark, FOLDER).dtypes) == columns


def test_registered():
    assert set(q.queries()) <= set(entry.queries()) and set(q.oracle_sql()) <= set(q.queries())
