import re
import statistics

import pytest
from pyspark.sql import functions as F

from starmill.operators.profile import Profiled, coverage, coverage_change, expressions, findings, fraction_rows, statistics as stats_of, value_counts

COLUMN = [Profiled("v", 0, 100, 5, whole=True)]


@pytest.fixture(scope="module")
def data(spark):
    import random

    r = random.Random(1)
    rows = [(1, round(r.gauss(50, 10), 3)) for _ in range(400)] + [(1, None)] * 3 + [(1, float("nan"))]
    rows += [(2, round(r.gauss(60, 10), 3)) for _ in range(300)] + [(2, None)] * 60
    rows += [(3, float(r.randrange(40, 60))) for _ in range(200)] + [(3, 500.0)] * 10
    rows += [(4, 7.25)] * 50 + [(None, 3.0)] + [(5, None)] * 4
    return rows, spark.createDataFrame(rows, "load_id bigint, v double")


def test_findings_and_medians(spark, data):
    rows, df = data
    counts = value_counts(df, "load_id", COLUMN)
    loads = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (4, 3), (5, 4)], "load_id bigint, prev_load_id bigint")
    stats = stats_of(counts, COLUMN)
    got = {r.load_id: r for r in stats.collect()}
    for load in (1, 2, 3, 4):
        inside = [v for k, v in rows if k == load and v is not None and 0 <= v <= 100]
        assert got[load].median == pytest.approx(statistics.median(inside))
    assert got[5].median is None and got[5].n_null == 4 and got[1].n_null == 4
    forms = fraction_rows(counts, expressions(counts), COLUMN)
    found = {(r.load_id, r.finding) for r in findings(stats, forms, loads, COLUMN).collect()}
    assert found == {(2, "null_rate"), (2, "shift"), (3, "out_of_range"), (3, "shift"), (3, "whole"), (4, "constant"), (4, "shift"), (5, "null_rate")}


def test_expressions_are_regular_and_cover(spark):
    import random

    r = random.Random(2)
    values = [float(r.randrange(10, 99)) + r.randrange(1, 100) / 100 for _ in range(3000)] + [1e300, 12345678.123]
    counts = value_counts(spark.createDataFrame([(1, v) for v in values], "load_id bigint, v double"), "load_id", COLUMN)
    found = expressions(counts).collect()
    assert any(re.fullmatch(e.regex, "47.25") for e in found)
    odd = {r.regex: r.n for r in coverage(counts, expressions(counts)).collect()}[None]
    assert odd == 2


def test_coverage_change_and_empty(spark):
    rows = [(1, i + 0.5) for i in range(100, 999)] + [(2, float(i)) for i in range(100, 999)]
    counts = value_counts(spark.createDataFrame(rows, "load_id bigint, v double"), "load_id", COLUMN)
    loads = spark.createDataFrame([(1, None), (2, 1)], "load_id bigint, prev_load_id bigint")
    change = {r.load_id: r.change for r in coverage_change(coverage(counts, expressions(counts)), loads).collect()}
    assert change[1] is None and change[2] == pytest.approx(1.0)
    none = value_counts(spark.createDataFrame([], "load_id bigint, v double"), "load_id", COLUMN)
    assert stats_of(none, COLUMN).collect() == [] and expressions(none).collect() == []


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "load_id bigint, v double, value string, n int")
    assert [tuple(r) for r in value_counts(df, "load_id", COLUMN).select(F.col("value"), F.col("n")).collect()] == [(2.0, 1)]
