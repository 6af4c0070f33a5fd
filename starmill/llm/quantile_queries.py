"""Problem 3: percentiles of magnitude and nobs per band, load and day.

Left out: nulls, NaN, magnitudes outside -2..30 (sentinels such as 99.99 and -99, infinities), and nobs below 1
(no observation).  Bands are told apart without regard to case and blanks; a null band is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.quantiles import RANK_BOUND, build_sketches, percentiles, rank_errors, roll_up
from starmill.queries import table

NAMES = ["magnitude", "nobs"]
KEYS = ["band", "load_id", "day"]
#: Each key by itself, and all three together.
GROUPINGS = {"band": ["band"], "load_id": ["load_id"], "day": ["day"], "cell": KEYS}


def _values() -> dict:
    return {"magnitude": F.when(F.col("magnitude").between(-2.0, 30.0), F.col("magnitude")), "nobs": F.when(F.col("nobs") >= 1, F.col("nobs"))}


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "spatial_index")
    return t.select(F.lower(F.trim("band")).alias("band"), "load_id", F.to_date("observed_at").alias("day"), "magnitude", "nobs")


def p3_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: one pair of sketches a (band, load, day)."""
    return build_sketches(_source(spark, sf_dir), KEYS, _values())


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per band, per load, per day and per (band, load, day), with the sketches themselves, to be combined later."""
    return percentiles(roll_up(p3_sketches(spark, sf_dir), GROUPINGS, NAMES), ["grouping", *KEYS], NAMES)


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = roll_up(p3_sketches(spark, sf_dir), {"day": ["day"]}, NAMES).withColumn("month", F.date_format("day", "yyyy-MM"))
    return percentiles(roll_up(days.drop("grouping"), {"month": ["month"]}, NAMES), ["grouping", "month"], NAMES)


def p3_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days combined: the day's sketches merged to months, each estimate checked against the exact ranks."""
    source = _source(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    errors = rank_errors(source, _months(spark, sf_dir), {"month": ["month"]}, _values())
    return errors.select("month", "column_name", "n", (F.col("worst") <= RANK_BOUND + 1.0 / F.col("n")).alias("within"))


def p3_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every estimate of p3_percentiles against the exact ranks: all have to lie within the bound."""
    errors = rank_errors(_source(spark, sf_dir), p3_percentiles(spark, sf_dir), GROUPINGS, _values())
    return errors.select("grouping", *KEYS, "column_name", "n", (F.col("worst") <= RANK_BOUND + 1.0 / F.col("n")).alias("within"))


QUERIES = {"p3_percentiles": p3_percentiles, "p3_months": p3_months, "p3_rank_check": p3_rank_check}
_LONG = """SELECT lower(trim(band)) AS band, load_id, CAST(observed_at AS DATE) AS day, 'magnitude' AS column_name, magnitude AS v FROM spatial_index WHERE magnitude BETWEEN -2 AND 30
 UNION ALL SELECT lower(trim(band)), load_id, CAST(observed_at AS DATE), 'nobs', nobs FROM spatial_index WHERE nobs >= 1"""
_KIND = {"band": "VARCHAR", "load_id": "BIGINT", "day": "DATE"}
_BY = lambda g, cs: f"SELECT '{g}' AS grouping, " + ", ".join(k if k in cs else f"CAST(NULL AS {_KIND[k]}) AS {k}" for k in KEYS) + f", column_name, count(*) AS n, TRUE AS within FROM v GROUP BY {', '.join(cs)}, column_name"
SQL = {
    "p3_rank_check": f"WITH v AS ({_LONG}) " + " UNION ALL ".join(_BY(g, cs) for g, cs in GROUPINGS.items()),
    "p3_months": f"WITH v AS ({_LONG}) SELECT strftime(day, '%Y-%m') AS month, column_name, count(*) AS n, TRUE AS within FROM v GROUP BY 1, 2",
}
