import random

from pyspark.sql import functions as F

from starmill.llm.quantiles import RANK_BOUND, build_sketches, percentiles, rank_errors, roll_up


def test_error_bound_and_merging(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(5), r.lognormvariate(0, 1)) for _ in range(30_000)] + [("a", 1, float("nan")), ("b", 2, None), (None, 9, 4.0), ("", 9, 7.0), ("c", 8, None)]
    df = spark.createDataFrame(rows, "g string, d int, v double")
    values, groupings = {"v": F.col("v")}, {"g": ["g"], "d": ["d"], "both": ["g", "d"]}
    p = percentiles(roll_up(build_sketches(df, ["g", "d"], values), groupings, ["v"]), ["grouping", "g", "d"], ["v"])
    got = {(x.grouping, x.g, x.d): x for x in p.collect()}
    # a null key and an empty one are two groups, alone and together with another key
    assert got["g", None, None].p50 == 4.0 and got["g", "", None].p50 == 7.0 and got["g", "c", None].n == 0 and got["g", "c", None].p50 is None
    assert got["both", None, 9].p50 == 4.0 and got["both", "", 9].p50 == 7.0 and got["d", None, 9].n == 2
    errors = rank_errors(df, p, groupings, values).collect()
    assert len(errors) == 4 + 6 + 12 and all(e.worst <= RANK_BOUND + 1 / e.n for e in errors)
    assert {e.g for e in errors if e.grouping == "g"} == {"a", "b", "", None}


def test_small_groups_are_exact_and_empty_tables(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(1, 101)], "g string, v double")
    p = percentiles(build_sketches(df, ["g"], {"v": F.col("v")}), ["g"], ["v"]).first()
    assert (p.n, p.p50, p.p90, p.p99) == (100, 50.0, 90.0, 99.0)
    assert percentiles(build_sketches(df.where("false"), ["g"], {"v": F.col("v")}), ["g"], ["v"]).collect() == []


def test_ties(spark):
    df = spark.createDataFrame([("x", 5.0)] * 5000 + [("x", 9.0)] * 10, "g string, v double")
    assert percentiles(build_sketches(df, ["g"], {"v": F.col("v")}), ["g"], ["v"]).first().p90 == 5.0


def test_no_session_setting_is_changed(spark):
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    build_sketches(spark.createDataFrame([("x", 5.0)], "g string, v double"), ["g"], {"v": F.col("v")}).collect()
    assert spark.conf.get(name) == before
