"""Problem 5: lines that cannot be read, with the reason; all others typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.values import bigint_of
from starmill.operators.badrows import parse_gaia, parse_pipe, tokenize_lines
from starmill.queries import table
from starmill.session import scratch_path
from starmill.sources.raw import raw_records


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(name, parse(table(spark, sf_dir, name))) for name, parse in (("gaia_minimum", parse_gaia), ("pipe_delimited", parse_pipe))]
    a, b = (df.where("reason is not null").select(F.lit(name).alias("table_name"), "file_no", "line_no", "reason") for name, df in parts)
    return a.unionByName(b)


def p5_gaia_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_gaia(table(spark, sf_dir, "gaia_minimum")).where("reason is null").drop("reason", "broken_at")


def p5_pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pipe(table(spark, sf_dir, "pipe_delimited")).where("reason is null").drop("reason", "broken_at")


def p5_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with line ends in their quoted fields, written as raw files and read again in chunks of 64 kB.

    The states of the chunks are composed over the files; the result tells each record's fields apart.
    """
    path = scratch_path(spark, "raw")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    soap = table(spark, sf_dir, "soap_files").where("path IS NOT NULL AND file_no IS NOT NULL")
    note = F.concat(F.col("path"), F.lit(' says "'), F.col("file_no").cast("string"), F.lit('",\n\n and more\n'))
    soap.select(F.concat_ws(",", F.col("file_no").cast("string"), quoted(note), F.coalesce(F.col("n_bytes").cast("string"), F.lit(""))).alias("value")).write.text(path)
    names = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator())
    records = raw_records(spark, names, chunk_bytes=1 << 16)
    t = tokenize_lines(records, "record", ",")
    f = lambda k: F.get("fields", F.lit(k))
    return t.select(bigint_of(f(0)).alias("file_no"), f(1).alias("note"), bigint_of(f(2)).alias("n_bytes"), F.size("fields").alias("n_fields"), F.col("broken_at").isNull().alias("sound"))


QUERIES = {"p5_raw_records": p5_raw_records, "p5_found": p5_found, "p5_gaia_rows": p5_gaia_rows, "p5_pipe_rows": p5_pipe_rows}
_INT = r"'[+-]?[0-9]+'"
_DBL = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PIPE = f"""SELECT file_no, line_no, c0, {_TRIM.format("c1")} AS c1, {_TRIM.format("c2")} AS c2, {_TRIM.format("c3")} AS c3,
 CASE WHEN len(list_filter(string_split(concat_ws('|', c0, c1, c2, c3, c4), '|'), lambda x: (length(x) - length(replace(x, '"', ''))) % 2 = 1)) > 0 THEN 'quoting'
 WHEN c4 IS NOT NULL OR c3 IS NULL THEN 'column_count'
 WHEN NOT regexp_full_match({_TRIM.format("c1")}, {_INT}) OR TRY_CAST({_TRIM.format("c1")} AS BIGINT) IS NULL OR {_TRIM.format("c2")} <> '' OR NOT regexp_full_match({_TRIM.format("c3")}, {_DBL}) THEN 'invalid_value' END AS reason FROM pipe_delimited"""
#: A sound field: bare without quotes, or quoted, with blanks round it.
_FIELD = r"""[ \t]*("([^"]|"")*"[ \t]*|[^",\t ][^",]*|)"""
_FULL = "'" + _FIELD + "(," + _FIELD + ")*'"
_LINE = "regexp_replace(regexp_replace(c0, '^﻿', ''), '\\r$', '')"
#: Of a sound line all fields with their commas, stripped and without quotes.
_FIELDS = """list_transform(list_transform(regexp_extract_all(line || ',', '[ \t]*("([^"]|"")*"[ \t]*|[^",]*),'), lambda x: trim(x[:-2], ' \t')), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END)"""
_GAIA = f"""SELECT file_no, line_no, CASE WHEN NOT regexp_full_match(line, {_FULL}) THEN 'quoting' WHEN len(f) <> 8 THEN 'column_count'
 WHEN NOT regexp_full_match(f[1], {_INT}) OR TRY_CAST(f[1] AS BIGINT) IS NULL OR trim(f[2], ' \t') = '' OR NOT regexp_full_match(f[3], {_DBL}) OR NOT TRY_CAST(f[3] AS DOUBLE) BETWEEN 0 AND 359.99999999999994
 OR NOT regexp_full_match(f[4], {_DBL}) OR NOT TRY_CAST(f[4] AS DOUBLE) BETWEEN -90 AND 90 OR len(list_filter(f[5:7], lambda x: x <> '' AND NOT regexp_full_match(x, {_DBL}))) > 0 THEN 'invalid_value' END AS reason, f
 FROM (SELECT *, {_FIELDS} AS f
 FROM (SELECT file_no, line_no, {_LINE} AS line FROM gaia_minimum) WHERE trim(line, ' \t') <> '' AND NOT starts_with(ltrim(line, ' \t'), '#') AND line <> 'solution_id,designation,ra,dec,phot_g_mean_flux,phot_bp_mean_flux,phot_rp_mean_flux,libname_gspphot')"""
SQL = {
    "p5_found": f"SELECT 'gaia_minimum' AS table_name, file_no, line_no, reason FROM ({_GAIA}) WHERE reason IS NOT NULL UNION ALL SELECT 'pipe_delimited', file_no, line_no, reason FROM ({_PIPE}) WHERE reason IS NOT NULL",
    "p5_gaia_rows": f"SELECT file_no, line_no, CAST(f[1] AS BIGINT) AS solution_id, f[2] AS designation, CAST(f[3] AS DOUBLE) AS ra, CAST(f[4] AS DOUBLE) AS dec, CAST(nullif(f[5], '') AS DOUBLE) AS phot_g_mean_flux, CAST(nullif(f[6], '') AS DOUBLE) AS phot_bp_mean_flux, CAST(nullif(f[7], '') AS DOUBLE) AS phot_rp_mean_flux, f[8] AS libname_gspphot FROM ({_GAIA}) WHERE reason IS NULL",
    "p5_pipe_rows": f"SELECT file_no, line_no, c0 AS letters, CAST(c1 AS BIGINT) AS ints, CAST(NULL AS VARCHAR) AS empty, CAST(c3 AS DOUBLE) AS numeric FROM ({_PIPE}) WHERE reason IS NULL",
    "p5_raw_records": """SELECT file_no, path || ' says "' || file_no || '",' || chr(10) || chr(10) || ' and more' || chr(10) AS note, n_bytes, 3 AS n_fields, TRUE AS sound FROM soap_files WHERE path IS NOT NULL AND file_no IS NOT NULL""",
}
