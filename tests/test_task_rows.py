"""Tasks that group or join by nearly unique keys are sized by rows, not by compressed bytes."""

import pytest

from tensorloom import workload
from tensorloom.functions import storage

SF = "/root/testdata/sf0.01"


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 1 << 11)


@pytest.mark.parametrize("name", ["estimate_products", "semisparse_ttm", "semisparse_append", "semisparse_compare"])
def test_rows_move_to_sized_tasks_alone(spark, few_rows, name):
    """60,000 rows in tasks of 2048 at most on average; Spark's own exchanges, which it merges by bytes, only gather single rows."""
    df = workload.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert "ENSURE_REQUIREMENTS" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "")


def test_sized_tasks_change_no_result(spark, monkeypatch):
    for name in ("estimate_products", "semisparse_append"):
        monkeypatch.setattr(storage, "TASK_ROWS", 1 << 30)
        one = sorted(map(tuple, workload.queries()[name](spark, SF).collect()))
        monkeypatch.setattr(storage, "TASK_ROWS", 1 << 11)
        assert sorted(map(tuple, workload.queries()[name](spark, SF).collect())) == one
