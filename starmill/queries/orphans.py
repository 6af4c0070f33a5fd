"""Problem 6: references to partitions that are missing, deleted or late."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators.orphans import orphan_references
from starmill.queries import table


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(count_id, catalog_name, side, Norder, Npix, counted_at): both sides of each record; Norder -1 is none."""
    soap = table(spark, sf_dir, "soap_2_177")
    side = lambda side, catalog, order, pix: F.struct(F.lit(side).alias("side"), F.lit(catalog).alias("catalog_name"), F.col(order).cast("int").alias("Norder"), F.col(pix).cast("bigint").alias("Npix"))
    both = F.array(side("object", "sky_object", "Norder", "Npix"), side("join", "sky_source", "join_Norder", "join_Npix"))
    refs = soap.select("count_id", "counted_at", F.explode(both).alias("r")).select("count_id", "r.*", "counted_at")
    return refs.where("Norder IS NULL OR Norder <> -1").distinct()


KEYS = ["catalog_name", "Norder", "Npix"]


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "partition_info")
    return orphan_references(references(spark, sf_dir), parts, KEYS, "counted_at", "created_at", "deleted_at", "simple").withColumn("ym", F.date_format("counted_at", "yyyy-MM"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("count_id", "side", "status", "ym").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per catalog, status and month."""
    return orphans(spark, sf_dir).groupBy("catalog_name", "status", "ym").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("Norder", "Npix").alias("n_keys"))


def p6_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose keys are null in part, under the three semantics: orphans by mask and status."""
    refs, parts = references(spark, sf_dir), table(spark, sf_dir, "partition_info")
    mask = F.concat(*[F.when(F.col(k).isNull(), "-").otherwise("x") for k in KEYS])
    found = [orphan_references(refs, parts, KEYS, "counted_at", "created_at", "deleted_at", m).withColumn("semantics", F.lit(m)) for m in ("simple", "partial", "full")]
    return reduce(DataFrame.unionByName, found).groupBy("semantics", mask.alias("mask"), "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_masks": p6_masks}
_REFS = """refs AS (SELECT DISTINCT count_id, 'object' AS side, 'sky_object' AS catalog_name, Norder AS o, Npix AS p, counted_at AS t FROM soap_2_177 WHERE Norder <> -1 AND Npix IS NOT NULL
 UNION SELECT count_id, 'join', 'sky_source', join_Norder, join_Npix, counted_at FROM soap_2_177 WHERE join_Norder <> -1 AND join_Npix IS NOT NULL),
 judged AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM partition_info i WHERE i.catalog_name = refs.catalog_name AND i.Norder = o AND i.Npix = p) THEN 'missing'
 WHEN EXISTS (SELECT 1 FROM partition_info i WHERE i.catalog_name = refs.catalog_name AND i.Norder = o AND i.Npix = p AND created_at <= t) THEN 'deleted' ELSE 'late' END AS status, strftime(t, '%Y-%m') AS ym FROM refs
 WHERE NOT EXISTS (SELECT 1 FROM partition_info i WHERE i.catalog_name = refs.catalog_name AND i.Norder = o AND i.Npix = p AND created_at <= t AND (deleted_at IS NULL OR deleted_at > t)))"""
SQL = {
    "p6_found": f"WITH {_REFS} SELECT DISTINCT count_id, side, status, ym FROM judged",
    "p6_report": f"WITH {_REFS} SELECT catalog_name, status, ym, count(*) AS n_references, count(DISTINCT (o, p)) AS n_keys FROM judged GROUP BY 1, 2, 3",
    "p6_masks": """WITH r AS MATERIALIZED (SELECT DISTINCT count_id, 'object' AS side, 'sky_object' AS c, Norder AS o, Npix AS p, counted_at AS t FROM soap_2_177 WHERE Norder IS NULL OR Norder <> -1
  UNION SELECT count_id, 'join', 'sky_source', join_Norder, join_Npix, counted_at FROM soap_2_177 WHERE join_Norder IS NULL OR join_Norder <> -1),
 j AS MATERIALIZED (SELECT c, o, p, t, count(*) AS m, 'x' || CASE WHEN o IS NULL THEN '-' ELSE 'x' END || CASE WHEN p IS NULL THEN '-' ELSE 'x' END AS mask FROM r GROUP BY ALL),
 k AS (SELECT mask, m, CASE WHEN EXISTS (SELECT 1 FROM partition_info i WHERE i.catalog_name = c AND (o IS NULL OR i.Norder = o) AND (p IS NULL OR i.Npix = p) AND created_at <= t AND (deleted_at IS NULL OR deleted_at > t)) THEN NULL
  WHEN NOT EXISTS (SELECT 1 FROM partition_info i WHERE i.catalog_name = c AND (o IS NULL OR i.Norder = o) AND (p IS NULL OR i.Npix = p)) THEN 'missing'
  WHEN EXISTS (SELECT 1 FROM partition_info i WHERE i.catalog_name = c AND (o IS NULL OR i.Norder = o) AND (p IS NULL OR i.Npix = p) AND created_at <= t) THEN 'deleted' ELSE 'late' END AS status FROM j)
 SELECT 'simple' AS semantics, mask, status, CAST(sum(m) AS BIGINT) AS n FROM k WHERE mask = 'xxx' AND status IS NOT NULL GROUP BY ALL UNION ALL SELECT 'partial', mask, status, CAST(sum(m) AS BIGINT) FROM k WHERE status IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'full', mask, CASE WHEN mask = 'xxx' THEN status ELSE 'partial' END AS status, CAST(sum(m) AS BIGINT) FROM k WHERE mask <> 'xxx' OR status IS NOT NULL GROUP BY ALL""",
}
