"""Problem 7: tens of thousands of small association files, consolidated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators.compaction import audit_files, compact, consolidate
from starmill.queries import table
from starmill.session import scratch_path

SMALL_BELOW = 2000
#: Records a target file: some 200 MB at 100 bytes a record.
ROWS_PER_FILE = 2_000_000
#: Records a file where the balance of the files is looked at.
FINE_ROWS = 200


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidates the records, sees that none was lost or doubled, and tells what the source files are by what was
    taken from each."""
    records = table(spark, sf_dir, "soap_2_177")
    moved, compared = consolidate(records, scratch_path(spark, "consolidated"), ROWS_PER_FILE)
    if lost := compared.where("NOT same").first():
        raise RuntimeError(f"source and consolidated records differ, such as in Dir {lost.Dir}")
    return audit_files(records, table(spark, sf_dir, "soap_files"), moved, SMALL_BELOW)


def p7_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, under its true directory, as read back from the files."""
    moved, _ = consolidate(table(spark, sf_dir, "soap_2_177"), scratch_path(spark, "consolidated"), ROWS_PER_FILE)
    return moved.drop("code", "file_no")


def p7_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the consolidation a directory."""
    return compact(table(spark, sf_dir, "soap_2_177"), scratch_path(spark, "compacted"), ROWS_PER_FILE)


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with files so small that every directory has many: how even and how ordered they are."""
    report = compact(table(spark, sf_dir, "soap_2_177"), scratch_path(spark, "balanced"), FINE_ROWS)
    return report.select("Dir", "n_files", "n_rows", (F.col("largest") <= 1.5 * FINE_ROWS).alias("even"), "in_order", "same")


QUERIES = {"p7_found": p7_found, "p7_layout": p7_layout, "p7_compacted": p7_compacted, "p7_balance": p7_balance}
_DIR = "CAST(floor({0} / 10000) * 10000 AS BIGINT)"
_UNIQUE = f"""SELECT count_id, CASE WHEN Norder = -1 THEN -1 ELSE coalesce({_DIR.format("Npix")}, Dir) END AS Dir, Norder, Npix, join_Norder, coalesce({_DIR.format("join_Npix")}, join_Dir) AS join_Dir, join_Npix, num_rows, counted_at
 FROM soap_2_177 QUALIFY row_number() OVER (PARTITION BY count_id ORDER BY file_no) = 1"""
SQL = {
    "p7_found": f"""WITH own AS (SELECT DISTINCT min(file_no) AS file_no FROM soap_2_177 GROUP BY count_id),
 held AS (SELECT file_no, sum(greatest(coalesce(num_rows, 0), 0)) AS total, bool_or((coalesce(Norder, 0) <> -1 AND coalesce(Dir <> {_DIR.format("Npix")}, FALSE)) OR coalesce(join_Dir <> {_DIR.format("join_Npix")}, FALSE)) AS wrong FROM soap_2_177 GROUP BY file_no),
 state AS (SELECT f.file_no, CASE WHEN h.file_no IS NULL THEN 'empty' WHEN f.file_no NOT IN (SELECT file_no FROM own) THEN 'repeat' WHEN total < {SMALL_BELOW} THEN 'small' END AS kind, wrong FROM soap_files f LEFT JOIN held h ON f.file_no = h.file_no)
 SELECT file_no, kind FROM state WHERE kind IS NOT NULL UNION ALL SELECT file_no, 'misfiled' FROM state WHERE wrong""",
    "p7_layout": f"SELECT *, CAST(0 AS BIGINT) AS target_file FROM ({_UNIQUE})",
    "p7_compacted": f"SELECT Dir, 1 AS n_files, count(*) AS n_rows, count(*) AS largest, TRUE AS in_order, TRUE AS same FROM ({_UNIQUE}) GROUP BY Dir",
    "p7_balance": f"SELECT Dir, CAST(ceil(count(*) / {FINE_ROWS}) AS BIGINT) AS n_files, count(*) AS n_rows, TRUE AS even, TRUE AS in_order, TRUE AS same FROM ({_UNIQUE}) GROUP BY Dir",
}
