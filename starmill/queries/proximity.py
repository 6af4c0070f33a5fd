"""Problem 1: objects close to other objects, and the margin cell that contains an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmill.functions.healpix import n_cells, sql_cell
from starmill.operators.proximity import clean_positions, near
from starmill.queries import table

RADIUS_ARCSEC = 2.0
REGION_ORDER = 7


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = clean_positions(table(spark, sf_dir, "sky_catalog"))
    return near(points, RADIUS_ARCSEC, table(spark, sf_dir, "negative_pairs").select("margin_pixel"), REGION_ORDER)


_POS = """SELECT id, min(r) AS ra, min(dec) AS dec FROM (SELECT id, (ra % 360.0 + 360.0) % 360.0 AS r, dec FROM sky_catalog
 WHERE id IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec) AND ra >= -360 AND ra < 720 AND dec >= -90 AND dec <= 90) GROUP BY id"""

QUERIES = {"p1_found": p1_found}
SQL = {
    "p1_found": f"""WITH pos AS ({_POS}), cell AS ({sql_cell("pos", "ra", "dec", REGION_ORDER, "cell", "id")}),
 region AS (SELECT DISTINCT margin_pixel FROM negative_pairs WHERE margin_pixel BETWEEN 0 AND {n_cells(REGION_ORDER) - 1})
 SELECT 'pair' AS kind, a.id AS key_a, b.id AS key_b FROM pos a JOIN pos b ON b.dec BETWEEN a.dec - 0.00056 AND a.dec + 0.00056 AND a.id < b.id
 WHERE degrees(2 * asin(sqrt(pow(sin(radians(a.dec - b.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(a.ra - b.ra) / 2), 2)))) <= {RADIUS_ARCSEC} / 3600
 UNION ALL SELECT 'margin', id, cell FROM cell JOIN region ON cell = margin_pixel""",
}
