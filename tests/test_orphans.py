from datetime import datetime as dt

import pytest

from starmill.operators.orphans import orphan_references


def rows(spark):
    refs = [(1, 10, dt(2024, 5, 1)), (1, 10, dt(2024, 5, 1)), (1, 11, dt(2024, 5, 1)), (1, 12, dt(2024, 5, 1)), (1, 13, dt(2024, 5, 1)), (1, None, dt(2024, 5, 1)), (2, None, dt(2024, 5, 1)), (None, None, dt(2024, 5, 1)), (1, 10, None), (1, 14, dt(2024, 5, 1))]
    targets = [(1, 10, dt(2024, 1, 1), None), (1, 12, dt(2024, 1, 1), dt(2024, 2, 1)), (1, 13, dt(2024, 6, 1), None), (1, 14, dt(2024, 1, 1), dt(2024, 2, 1)), (1, 14, dt(2024, 5, 1), None), (1, 14, dt(2024, 5, 1), None), (None, 11, dt(2024, 1, 1), None)]
    return spark.createDataFrame(refs, "o int, p bigint, t timestamp"), spark.createDataFrame(targets, "o int, p bigint, created timestamp, deleted timestamp")


@pytest.mark.parametrize("match, more", [("simple", set()), ("partial", {(2, None, "missing")}), ("full", {(1, None, "partial"), (2, None, "partial")})])
def test_semantics(spark, match, more):
    refs, targets = rows(spark)
    got = {(r.o, r.p, r.status) for r in orphan_references(refs, targets, ["o", "p"], "t", "created", "deleted", match).collect()}
    assert got == {(1, 11, "missing"), (1, 12, "deleted"), (1, 13, "late"), (1, 10, "late")} | more


def test_counts_and_empty(spark):
    refs, targets = rows(spark)
    none = targets.where("false")
    got = orphan_references(refs.withColumn("status", refs.o), none, ["o", "p"], "t", "created", "deleted").collect()
    assert sum((r.p, r.t) == (10, dt(2024, 5, 1)) for r in got) == 2 and {r.status for r in got} == {"missing"}
    assert orphan_references(refs.where("false"), targets, ["o", "p"], "t", "created", "deleted").collect() == []
    with pytest.raises(ValueError):
        orphan_references(refs, targets, ["o", "p"], "t", "created", "deleted", "other")


def test_plan_is_an_anti_join(spark):
    refs, targets = rows(spark)
    plan = orphan_references(refs, targets, ["o", "p"], "t", "created", "deleted")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_hot_key(spark):
    """A third of the references have one key; others carry columns of their own."""
    refs = spark.range(30_000).selectExpr("id AS n", "1 AS o", "IF(id % 3 = 0, 10L, id) AS p", "timestamp'2024-05-01' AS t")
    targets = spark.range(20_000).selectExpr("1 AS o", "id AS p", "timestamp'2024-01-01' AS created", "IF(id = 10, timestamp'2024-02-01', NULL) AS deleted")
    got = {r.status: r["count"] for r in orphan_references(refs, targets, ["o", "p"], "t", "created", "deleted").groupBy("status").count().collect()}
    assert got == {"deleted": 10_001, "missing": sum(k % 3 != 0 for k in range(20_000, 30_000))}
