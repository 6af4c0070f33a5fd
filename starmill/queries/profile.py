"""Problem 2: loads of sky_catalog and spatial_index whose values are out of order."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators.profile import CHAR_BITS, LENGTH_BITS, TOKEN_BITS, Profiled, coverage, coverage_change, expressions, findings, fraction_rows, statistics, value_counts
from starmill.queries import table
from starmill.session import written

COLUMNS = {
    "sky_catalog": [Profiled("ra_error", 0, 1000, 12), Profiled("dec_error", 0, 1000, 12)],
    "spatial_index": [Profiled("magnitude", -2, 30, 1.0, whole=True)],
}
#: Columns without a valid range of their own, which are profiled too.
OTHERS = {"sky_catalog": ["id", "ra", "dec", "observed_at"], "spatial_index": ["id", "_healpix_29", "nobs", "band", "observed_at"]}
EVERY = {t: cs + [Profiled(c) for c in OTHERS[t]] for t, cs in COLUMNS.items()}
#: Columns whose expressions are shown: the three of the problem and one of text.
FORMED = {"sky_catalog": COLUMNS["sky_catalog"], "spatial_index": [*COLUMNS["spatial_index"], Profiled("band")]}


def _counts(spark: SparkSession, sf_dir: str, columns: dict[str, list[Profiled]]) -> DataFrame:
    """Value counts of the columns, named table.column; the statistics, the median and the expressions all read them."""
    parts = [value_counts(table(spark, sf_dir, t), "load_id", cs).withColumn("column_name", F.concat(F.lit(f"{t}."), "column_name")) for t, cs in columns.items()]
    return written(reduce(DataFrame.unionByName, parts), "value_counts")


def _whole_names(columns: dict[str, list[Profiled]]) -> list[Profiled]:
    return [replace(c, name=f"{t}.{c.name}") for t, cs in columns.items() for c in cs]


def _named(df: DataFrame) -> DataFrame:
    at = F.split("column_name", "\\.")
    return df.select(at[0].alias("table_name"), at[1].alias("column_name"), *[c for c in df.columns if c != "column_name"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, columns = _counts(spark, sf_dir, COLUMNS), _whole_names(COLUMNS)
    forms = fraction_rows(counts, expressions(counts), columns)
    return _named(findings(statistics(counts, columns), forms, table(spark, sf_dir, "loads"), columns))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of both tables."""
    counts, columns = _counts(spark, sf_dir, EVERY), _whole_names(EVERY)
    return _named(statistics(counts, columns).withColumn("median", F.round("median", 6)))


def p2_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expressions of each column, the distinct values under them, and what they cost."""
    return _named(expressions(_counts(spark, sf_dir, FORMED)).select("column_name", "regex", "n_values", F.round("bits", 3).alias("bits")))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each load that conform to no expression, and how far coverage moved since the load before."""
    counts = _counts(spark, sf_dir, FORMED)
    return _named(coverage_change(coverage(counts, expressions(counts)), table(spark, sf_dir, "loads")).withColumn("change", F.round("change", 6)))


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p2_expressions": p2_expressions, "p2_coverage": p2_coverage}
_DOUBLES = ("ra", "dec", "magnitude", "observed_at")
_NUMBER = {"observed_at": "epoch(observed_at)"}


def _long_sql(columns: dict[str, list[Profiled]]) -> str:
    """Every column as (v, x): its number, or its text where it has no number."""
    end = lambda v: "CAST('infinity' AS DOUBLE)" if v == math.inf else "CAST('-infinity' AS DOUBLE)" if v == -math.inf else f"CAST({v} AS DOUBLE)"

    def one(t: str, c: Profiled) -> str:
        v = f"CAST({_NUMBER.get(c.name, c.name)} AS DOUBLE)"
        pair = "CAST(NULL AS DOUBLE) AS v, band AS x" if c.name == "band" else f"CASE WHEN NOT isnan({v}) THEN {v} END AS v, {'CAST(NULL AS VARCHAR)' if c.name in _DOUBLES else f'CASE WHEN abs({v}) > {1 << 53} THEN CAST({c.name} AS VARCHAR) END'} AS x"
        return f"SELECT '{t}' AS table_name, '{c.name}' AS column_name, load_id, {pair}, {end(c.low)} AS lo, {end(c.high)} AS hi, {end(c.shift)} AS sh, {c.whole} AS wh FROM {t} WHERE load_id IS NOT NULL"

    return " UNION ALL ".join(one(t, c) for t, cs in columns.items() for c in cs)


def _stats_sql(columns: dict[str, list[Profiled]]) -> str:
    inside = "v BETWEEN lo AND hi AND isfinite(v)"
    return f"""SELECT table_name, column_name, load_id, count(*) AS n_rows, count(*) FILTER (v IS NULL AND x IS NULL) AS n_null, count(DISTINCT coalesce(x, CAST(v AS VARCHAR))) AS n_distinct, min(v) AS low, max(v) AS high, min(x) FILTER (v IS NULL) AS low_text, max(x) FILTER (v IS NULL) AS high_text,
 count(*) FILTER (v IS NOT NULL AND NOT ({inside})) AS n_outside, count(*) FILTER ({inside}) AS n_inside, count(*) FILTER ({inside} AND v <> floor(v)) AS n_fraction, median(v) FILTER ({inside}) AS median, any_value(sh) AS sh, any_value(wh) AS wh FROM ({_long_sql(columns)}) GROUP BY 1, 2, 3"""


# the tree of shapes again, as SQL: leaf shapes, their collapsed forms, and which of both costs less
_TEXT = r"coalesce(x, CASE WHEN isinf(v) THEN CASE WHEN v < 0 THEN '-Infinity' ELSE 'Infinity' END ELSE regexp_replace(CAST(v AS VARCHAR), '\.0$', '') END)"
_SHAPE = f"translate({_TEXT}, '012345678ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz', '{'9' * 9 + 'a' * 51}')"
_LOOSE = "regexp_replace(regexp_replace({}, '9+', '9+', 'g'), 'a+', 'a+', 'g')"
_ESCAPED = r"regexp_replace({}, '([.+*?()\[\]{{}}^$|\\])', '\\\1', 'g')"
_EXPRESSIONS = f"""l AS MATERIALIZED ({_long_sql(FORMED)}), s AS MATERIALIZED (SELECT *, {_SHAPE} AS shape FROM l WHERE v IS NOT NULL OR x IS NOT NULL),
 leaf AS (SELECT table_name, column_name, shape, count(*) AS m FROM (SELECT DISTINCT table_name, column_name, v, x, shape FROM s) WHERE shape <> '' GROUP BY 1, 2, 3),
 a AS (SELECT *, {_LOOSE.format("shape")} AS loose, length(shape) AS size, length(replace({_LOOSE.format("shape")}, '+', '')) AS runs, (length(shape) - length(replace(shape, '9', ''))) * log2(10) + (length(shape) - length(replace(shape, 'a', ''))) * log2(52) AS content FROM leaf),
 b AS (SELECT *, 2 * log2(1.0 + size / runs) + 1 AS run_bits FROM a),
 c AS (SELECT *, {TOKEN_BITS + LENGTH_BITS} * runs + m * content AS own, m * (content + runs * run_bits) AS as_loose, m * (size * {CHAR_BITS} + run_bits) AS plain, sum(m) OVER w AS cnt FROM b WINDOW w AS (PARTITION BY table_name, column_name, loose)),
 d AS (SELECT *, own + m * log2(cnt / m) AS bits, sum(as_loose) OVER w + {TOKEN_BITS} * runs AS loose_cost, sum(own + m * log2(cnt / m)) OVER w AS split_cost, sum(plain) OVER w AS loose_plain FROM c WINDOW w AS (PARTITION BY table_name, column_name, loose)),
 e AS MATERIALIZED (SELECT table_name, column_name, loose, shape, CAST(m AS BIGINT) AS n_values, bits FROM d WHERE split_cost < loose_cost AND bits < plain
  UNION ALL SELECT table_name, column_name, loose, NULL, CAST(max(cnt) AS BIGINT), max(loose_cost) FROM d WHERE split_cost >= loose_cost GROUP BY 1, 2, 3 HAVING max(loose_cost) < max(loose_plain))"""
_BARE = "replace(loose, '+', '')"
_REGEX = rf"CASE WHEN shape IS NOT NULL THEN replace(replace({_ESCAPED.format('shape')}, 'a', '[A-Za-z]'), '9', '\d') ELSE regexp_replace(regexp_replace({_ESCAPED.format(_BARE)}, 'a+', '[A-Za-z]+', 'g'), '9+', '\d+', 'g') END"
_SHARES = """f AS (SELECT s.table_name, s.column_name, s.load_id, CASE WHEN e.loose IS NULL THEN '' ELSE coalesce(e.shape, e.loose || ' ') END AS form, count(*) AS n FROM s LEFT JOIN e ON s.table_name = e.table_name AND s.column_name = e.column_name AND e.loose = {loose} AND (e.shape IS NULL OR e.shape = s.shape) GROUP BY 1, 2, 3, 4),
 h AS MATERIALIZED (SELECT *, n / sum(n) OVER (PARTITION BY table_name, column_name, load_id) AS share FROM f),
 p AS (SELECT DISTINCT load_id, prev_load_id FROM loads WHERE prev_load_id IS NOT NULL),
 u AS (SELECT h.table_name, h.column_name, h.load_id, form, share AS a, 0.0 AS b, CASE WHEN form = '' THEN n ELSE 0 END AS odd FROM h
  UNION ALL SELECT h.table_name, h.column_name, p.load_id, form, 0.0, share, 0 FROM h JOIN p ON h.load_id = p.prev_load_id)""".format(loose=_LOOSE.format("s.shape"))
SQL = {
    "p2_found": f"""WITH s AS ({_stats_sql(COLUMNS)}), j AS (SELECT s.*, b.median AS prior FROM s LEFT JOIN loads l ON s.load_id = l.load_id LEFT JOIN s b ON b.load_id = l.prev_load_id AND b.column_name = s.column_name)
 SELECT table_name, column_name, load_id, 'null_rate' AS finding FROM j WHERE n_null > 0.1 * n_rows UNION SELECT table_name, column_name, load_id, 'out_of_range' FROM j WHERE n_outside > 0.02 * (n_rows - n_null)
 UNION SELECT table_name, column_name, load_id, 'constant' FROM j WHERE n_distinct IN (1, 2) UNION SELECT table_name, column_name, load_id, 'whole' FROM j WHERE wh AND n_inside > 0 AND n_fraction = 0
 UNION SELECT table_name, column_name, load_id, 'shift' FROM j WHERE abs(median - prior) > sh""",
    "p2_profile": f"SELECT * EXCLUDE (sh, wh, median, n_fraction), round(median, 6) AS median FROM ({_stats_sql(EVERY)})",
    "p2_expressions": f"WITH {_EXPRESSIONS} SELECT table_name, column_name, {_REGEX} AS regex, n_values, round(bits, 3) AS bits FROM e",
    "p2_coverage": f"""WITH {_EXPRESSIONS}, {_SHARES} SELECT table_name, column_name, load_id, CAST(sum(odd) AS BIGINT) AS n_nonconforming, CASE WHEN sum(b) > 0 THEN round(sum(abs(a - b)) / 2, 6) END AS change
 FROM (SELECT table_name, column_name, load_id, form, sum(a) AS a, sum(b) AS b, sum(odd) AS odd FROM u GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING sum(a) > 0""",
}
