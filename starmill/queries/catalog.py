"""The catalog operators over the test tables.

Objects are the ids of sky_catalog with a position; sources are the rows of spatial_index with a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.functions import healpix as hp
from starmill.operators import association as assoc
from starmill.operators import binning, index, margin
from starmill.operators.proximity import clean_positions
from starmill.queries import table
from starmill.queries.proximity import _POS
from starmill.session import written

ORDER = 10
THRESHOLD = 1000
MARGIN_ORDER = 7
MARGIN_ARCSEC = 600.0


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return clean_positions(table(spark, d, "sky_catalog")).withColumnRenamed("key", "id")


def _object_cells(spark: SparkSession, d: str) -> DataFrame:
    return hp.with_cell(_objects(spark, d), "ra", "dec", ORDER, "cell")


def _object_hist(spark: SparkSession, d: str) -> DataFrame:
    return _object_cells(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _source_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spatial_index").select("id", "band", hp.ancestor(F.col("_healpix_29"), 29, ORDER).alias("cell")).where("cell is not null")


def _object_alignment(spark: SparkSession, d: str, **kw) -> DataFrame:
    return binning.align(_object_hist(spark, d), ORDER, 0, THRESHOLD, keep_overfull=True, **kw)


def _source_alignment(spark: SparkSession, d: str) -> DataFrame:
    hist = binning.histogram_of_index(table(spark, d, "spatial_index"), "_healpix_29", ORDER)
    return binning.align(hist, ORDER, 0, 10 * THRESHOLD, keep_overfull=True)


def _objects_placed(spark: SparkSession, d: str) -> DataFrame:
    return binning.align_rows(_object_cells(spark, d), _object_alignment(spark, d), ORDER)


def _sources_placed(spark: SparkSession, d: str) -> DataFrame:
    return binning.align_rows(_source_cells(spark, d), _source_alignment(spark, d), ORDER)


def _live(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, "partition_info").where(F.col("catalog_name") == name).select("Norder", "Npix").distinct()


def cell_histogram(spark, d):
    return binning.histogram(_objects(spark, d), "ra", "dec", 8)


def cell_histogram_by_index(spark, d):
    return binning.histogram_of_index(table(spark, d, "spatial_index"), "_healpix_29", 8)


def spatial_index_ancestor(spark, d):
    t = table(spark, d, "spatial_index").select(*[hp.ancestor(F.col("_healpix_29"), 29, o).alias(f"order_{o}") for o in (0, 3, 7)])
    return t.groupBy("order_0", "order_3", "order_7").agg(F.count(F.lit(1)).alias("n"))


def pixel_descendant_range(spark, d):
    t = table(spark, d, "partition_info").select("Norder", "Npix").distinct()
    lo, hi = hp.descendant_range(F.col("Npix"), F.col("Norder"), 12)
    return t.select("Norder", "Npix", lo.alias("lo"), hi.alias("hi"))


def adaptive_alignment(spark, d):
    return _object_alignment(spark, d)


def adaptive_alignment_drop_siblings(spark, d):
    return binning.partitions_of(_object_alignment(spark, d, no_empty_siblings=True))


def constant_order_partitions(spark, d):
    return binning.partitions_of(binning.align(binning.histogram(_objects(spark, d), "ra", "dec", 5), 5, constant=True))


def aligned_partition_counts(spark, d):
    return _objects_placed(spark, d).groupBy("Norder", "Dir", "Npix").agg(F.count(F.lit(1)).alias("n_rows"))


def sky_fraction(spark, d):
    return binning.sky_fraction(binning.partitions_of(_object_alignment(spark, d))).select(F.round("moc_sky_fraction", 5).alias("moc_sky_fraction"))


def catalog_rows_with_partition_columns(spark, d):
    return _objects_placed(spark, d).select("id", "Norder", "Dir", "Npix")


def row_count_reconciliation(spark, d):
    a = _object_alignment(spark, d).select(F.col("cell").alias("c"), "Npix")
    joined = _object_cells(spark, d).join(a, F.col("cell") == F.col("c"), "left")
    counts = joined.agg(F.count(F.lit(1)).alias("expected"), F.count("Npix").alias("placed"))
    return counts.select("expected", "placed", (F.col("expected") == F.col("placed")).alias("same"))


def index_distinct(spark, d):
    rows = _sources_placed(spark, d)
    return index.index_rows(rows, "id", ["band"], include_healpix_29=False)


def index_range_buckets(spark, d):
    divisions = [0, 2000, 4000, 8000, 16000, 1 << 60]
    rows = index.index_rows(_sources_placed(spark, d), "id", include_healpix_29=False)
    return rows.groupBy(index.bucket_of("id", divisions).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def association_counts(spark, d):
    return assoc.association_counts(_objects_placed(spark, d), _sources_placed(spark, d), "id", "id")


def association_near_counts(spark, d):
    """Only between partitions that overlap or touch."""
    pairs = assoc.candidate_pairs(binning.partitions_of(_object_alignment(spark, d)), binning.partitions_of(_source_alignment(spark, d)))
    return assoc.association_counts(_objects_placed(spark, d), _sources_placed(spark, d), "id", "id", pairs)


def association_leaf(spark, d):
    return assoc.association_leaf(_objects_placed(spark, d), _sources_placed(spark, d), "id", "id")


def _sound_objects(spark, d):
    """Objects with a row whose errors are both within 0..1000; the sources of the others have no object."""
    good = table(spark, d, "sky_catalog").where("ra_error BETWEEN 0 AND 1000 AND dec_error BETWEEN 0 AND 1000").select("id").distinct()
    return _objects_placed(spark, d).join(good, "id", "left_semi")


def association_unmatched(spark, d):
    return assoc.unmatched_sources(_sound_objects(spark, d), _sources_placed(spark, d), "id", "id")


def association_reconciled(spark, d):
    """Of each source partition its sources, those matched and those unmatched within the candidate pairs: they add up."""
    objects, sources = written(_sound_objects(spark, d), "objects"), written(_sources_placed(spark, d), "sources")
    pairs = written(assoc.candidate_pairs(objects.select("Norder", "Npix").distinct(), sources.select("Norder", "Npix").distinct()), "pairs")
    key = ["join_Norder", "join_Npix"]
    every = sources.groupBy(F.col("Norder").alias("join_Norder"), F.col("Npix").alias("join_Npix")).agg(F.count(F.lit(1)).alias("n_sources"))
    matched = assoc.association_counts(objects, sources, "id", "id", pairs).groupBy(*key).agg(F.sum("num_rows").alias("n_matched"))
    lost = assoc.unmatched_sources(objects, sources, "id", "id", pairs).select(*key, F.col("num_rows").alias("n_unmatched"))
    out = every.join(matched, key, "left").join(lost, key, "left").fillna(0, ["n_matched", "n_unmatched"])
    return out.withColumn("same", F.col("n_sources") == F.col("n_matched") + F.col("n_unmatched"))


def association_partition_totals(spark, d):
    return assoc.partition_totals(association_counts(spark, d))


def association_combined_counts(spark, d):
    parts = table(spark, d, "soap_2_177").select("count_id", "Norder", hp.dir_of(F.col("Npix")).alias("Dir"), "Npix", "num_rows").where("Norder is not null").distinct()
    return assoc.partition_totals(parts)


def partition_overlap_pairs(spark, d):
    return assoc.overlapping_partitions(_live(spark, d, "sky_object"), _live(spark, d, "sky_source"))


def pixel_set_difference(spark, d):
    return _live(spark, d, "sky_source").join(_live(spark, d, "sky_object"), ["Norder", "Npix"], "left_anti")


def sky_ordered_partitions(spark, d):
    lo = hp.descendant_range(F.col("Npix"), F.col("Norder"), 12)[0]
    return _live(spark, d, "sky_source").select("Norder", "Npix", F.row_number().over(W.orderBy(lo, "Norder")).alias("position"))


def margin_coarse(spark, d):
    pairs = table(spark, d, "negative_pairs").where("margin_pixel is not null")
    return margin.margin_candidates(_objects(spark, d), pairs, "ra", "dec", MARGIN_ORDER).select("id", "margin_target_order", "margin_target_pixel")


def margin_pairs(spark, d):
    """The pairs of the object partitions and of the empty sky round them."""
    return margin.margin_pairs(margin.with_negatives(spark, _live(spark, d, "sky_object")), MARGIN_ORDER)


def margin_fine(spark, d):
    """Pairs one order below the finest partitions there can be, whose cells are still wider than the margin."""
    placed = written(_objects_placed(spark, d).drop("cell"), "placed")
    pairs = written(margin.margin_pairs(margin.with_negatives(spark, placed), ORDER + 1, ordered=False), "margin_pairs")
    return margin.margin_rows(placed, pairs, "ra", "dec", ORDER + 1, MARGIN_ARCSEC / 10)


def pixel_list_filter(spark, d):
    """Partitions that overlap the pixels (0, 5) and (2, 140), at any order."""
    wanted = spark.createDataFrame([(0, 5), (2, 140)], "Norder int, Npix bigint")
    return assoc.overlapping_partitions(_live(spark, d, "sky_source"), wanted).select("Norder", "Npix").distinct()


def in_pixel_rows(spark, d):
    return table(spark, d, "spatial_index").where(hp.in_pixel(F.col("_healpix_29"), 0, 5)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def band_array_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"value_{b}") for k, b in enumerate("ugriz")])


def path_derived_column(spark, d):
    return table(spark, d, "soap_files").select("file_no", F.regexp_extract("path", r"order_(\d+)/", 1).try_cast("int").alias("Norder"), F.regexp_extract("path", r"pixel_(\d+)/", 1).try_cast("bigint").alias("Npix"))


def union_shards(spark, d):
    a, b = (table(spark, d, "soap_2_177").select(F.col(f"{p}Norder").alias("Norder"), F.col(f"{p}Npix").alias("Npix")) for p in ("", "join_"))
    return a.unionByName(b).groupBy("Norder", "Npix").agg(F.count(F.lit(1)).alias("n"))


def column_min_max(spark, d):
    return table(spark, d, "spatial_index").agg(F.min("id").alias("id_min"), F.max("id").alias("id_max"), F.min("_healpix_29").alias("index_min"), F.max("_healpix_29").alias("index_max"))


_CELLS = hp.sql_cell("pos", "ra", "dec", ORDER, "cell", "id, ra, dec")


def _align_sql(name: str, cells: str, threshold: int) -> str:
    """CTEs {name}_hist, {name}_parts, {name}_align, {name}_rows from a CTE with a column cell of ORDER."""
    totals = " UNION ALL ".join(f"SELECT {o} AS Norder, cell >> {2 * (ORDER - o)} AS Npix, sum(n) AS n FROM {name}_hist GROUP BY ALL" for o in range(ORDER + 1))
    return f"""{name}_hist AS MATERIALIZED (SELECT cell, count(*) AS n FROM {cells} WHERE cell IS NOT NULL GROUP BY cell), {name}_tot AS MATERIALIZED ({totals}),
 {name}_parts AS MATERIALIZED (SELECT t.Norder, t.Npix, CAST(t.n AS BIGINT) AS n FROM {name}_tot t LEFT JOIN {name}_tot p ON p.Norder = t.Norder - 1 AND p.Npix = t.Npix >> 2 WHERE (t.n <= {threshold} OR t.Norder = {ORDER}) AND (t.Norder = 0 OR p.n > {threshold})),
 {name}_align AS MATERIALIZED (SELECT h.cell, p.Norder, p.Npix, p.n FROM (SELECT cell, o, cell >> (2 * ({ORDER} - o)) AS q FROM {name}_hist, (SELECT unnest(range({ORDER + 1})) AS o)) h JOIN {name}_parts p ON p.Norder = h.o AND p.Npix = h.q),
 {name}_rows AS MATERIALIZED (SELECT c.*, Norder, CAST(floor(Npix / 10000) * 10000 AS BIGINT) AS Dir, Npix FROM {cells} c JOIN {name}_align a ON c.cell = a.cell)"""


_OBJ = f"pos AS MATERIALIZED ({_POS}), oc AS MATERIALIZED ({_CELLS}), {_align_sql('o', 'oc', THRESHOLD)}"
_SRC = f"sc AS MATERIALIZED (SELECT id, band, _healpix_29 >> {2 * (29 - ORDER)} AS cell FROM spatial_index WHERE _healpix_29 IS NOT NULL), {_align_sql('s', 'sc', 10 * THRESHOLD)}"
_DIR = "CAST(floor({} / 10000) * 10000 AS BIGINT)"
_COUNTS = f"SELECT o.Norder, o.Dir, o.Npix, s.Norder AS join_Norder, s.Dir AS join_Dir, s.Npix AS join_Npix, count(*) AS num_rows FROM o_rows o JOIN s_rows s ON o.id = s.id GROUP BY ALL"
_SOUND = "SELECT DISTINCT id FROM sky_catalog WHERE id IS NOT NULL AND ra_error BETWEEN 0 AND 1000 AND dec_error BETWEEN 0 AND 1000"
_LIVE = "(SELECT DISTINCT Norder, Npix FROM partition_info WHERE catalog_name = '{}')"
_OVERLAP = "a.Npix << (2 * (12 - a.Norder)) < (b.Npix + 1) << (2 * (12 - b.Norder)) AND b.Npix << (2 * (12 - b.Norder)) < (a.Npix + 1) << (2 * (12 - a.Norder))"
#: Partitions and the coarsest empty pixels round them; the grid points on the edge of each; the cells met on a small
#: circle round each point, other than the partition's own.
_RING = f"""live AS MATERIALIZED (SELECT Norder AS o, Npix AS p FROM {_LIVE.format("sky_object")}), lines AS MATERIALIZED (SELECT o, p, o - k AS uo, p >> (2 * k) AS up FROM live, (SELECT unnest(range(1, {MARGIN_ORDER + 1})) AS k) WHERE k <= o),
 above AS MATERIALIZED (SELECT DISTINCT uo AS o, up AS p FROM lines), cand AS MATERIALIZED (SELECT 0 AS o, unnest(range(12)) AS p UNION SELECT o + 1, 4 * p + k FROM above, (SELECT unnest(range(4)) AS k)),
 held AS MATERIALIZED (SELECT DISTINCT c.o, c.p FROM cand c, (SELECT unnest(range(0, {MARGIN_ORDER + 1})) AS k) JOIN live l ON l.o = c.o - k AND l.p = c.p >> (2 * k)),
 parts AS MATERIALIZED (SELECT o, p FROM live UNION SELECT o, p FROM (SELECT * FROM cand EXCEPT SELECT * FROM above EXCEPT SELECT * FROM held)),
 xy AS (SELECT o, p, p >> (2 * o) AS f, {" + ".join(f"(((p & ((1 << (2 * o)) - 1)) >> {2 * b}) & 1) * {1 << b}" for b in range(MARGIN_ORDER))} AS ix, {" + ".join(f"(((p & ((1 << (2 * o)) - 1)) >> {2 * b + 1}) & 1) * {1 << b}" for b in range(MARGIN_ORDER))} AS iy, 1 << ({MARGIN_ORDER} - o) AS n FROM parts),
 g AS (SELECT o, p, f, CASE side WHEN 0 THEN ix * n + k WHEN 1 THEN ix * n + n WHEN 2 THEN ix * n + n - k ELSE ix * n END / {float(1 << MARGIN_ORDER)} AS x, CASE side WHEN 0 THEN iy * n WHEN 1 THEN iy * n + k WHEN 2 THEN iy * n + n ELSE iy * n + n - k END / {float(1 << MARGIN_ORDER)} AS y
  FROM (SELECT *, unnest(range(n)) AS k FROM xy), (SELECT unnest(range(4)) AS side)),
 r AS (SELECT *, f // 4 + 2 - x - y AS r, CASE WHEN f // 4 = 1 THEN 2 * (f % 4) ELSE 2 * (f % 4) + 1 END AS col FROM g), c AS (SELECT *, CASE WHEN r < 1 THEN r WHEN r > 3 THEN 4 - r ELSE 1.0 END AS cap FROM r),
 z AS (SELECT *, CASE WHEN r < 1 THEN 1 - cap * cap / 3 WHEN r > 3 THEN cap * cap / 3 - 1 ELSE (2 - r) * 2 / 3 END AS z, radians(CASE WHEN cap > 1e-15 THEN 45.0 * (col * cap + x - y) / cap ELSE 0.0 END) AS phi FROM c),
 v AS MATERIALIZED (SELECT DISTINCT o, p, z, sqrt(greatest(1 - z * z, 0)) AS s, phi FROM z),
 d AS (SELECT o, p, s * cos(phi) + q * (-sin(phi) * cos(t) - z * cos(phi) * sin(t)) AS vx, s * sin(phi) + q * (cos(phi) * cos(t) - z * sin(phi) * sin(t)) AS vy, z + q * s * sin(t) AS vz FROM v, (SELECT {0.05 / (1 << MARGIN_ORDER)} AS q, (unnest(range(16)) + 0.5) * pi() / 8 AS t)),
 pos AS MATERIALIZED (SELECT o, p, degrees(atan2(vy, vx)) AS ra, degrees(atan2(vz, sqrt(vx * vx + vy * vy))) AS dec FROM d)"""
QUERIES = {
    f.__name__: f
    for f in (
        cell_histogram, cell_histogram_by_index, spatial_index_ancestor, pixel_descendant_range, adaptive_alignment, adaptive_alignment_drop_siblings, constant_order_partitions, aligned_partition_counts,
        sky_fraction, catalog_rows_with_partition_columns, row_count_reconciliation, index_distinct, index_range_buckets, association_counts, association_near_counts, association_leaf,
        association_unmatched, association_reconciled, association_partition_totals, association_combined_counts, partition_overlap_pairs, pixel_set_difference, sky_ordered_partitions, margin_coarse, margin_pairs, margin_fine, pixel_list_filter,
        in_pixel_rows, band_array_explode, path_derived_column, union_shards, column_min_max,
    )
}
SQL = {
    "cell_histogram": f"WITH pos AS ({_POS}) SELECT cell, count(*) AS n FROM ({hp.sql_cell('pos', 'ra', 'dec', 8, 'cell')}) GROUP BY cell",
    "cell_histogram_by_index": "SELECT _healpix_29 >> 42 AS cell, count(*) AS n FROM spatial_index WHERE _healpix_29 IS NOT NULL GROUP BY 1",
    "spatial_index_ancestor": "SELECT _healpix_29 >> 58 AS order_0, _healpix_29 >> 52 AS order_3, _healpix_29 >> 44 AS order_7, count(*) AS n FROM spatial_index GROUP BY ALL",
    "pixel_descendant_range": "SELECT DISTINCT Norder, Npix, Npix << (2 * (12 - Norder)) AS lo, (Npix + 1) << (2 * (12 - Norder)) AS hi FROM partition_info",
    "adaptive_alignment": f"WITH {_OBJ} SELECT cell, Norder, Npix, n FROM o_align",
    "adaptive_alignment_drop_siblings": f"WITH {_OBJ} SELECT {ORDER} - down AS Norder, lo >> (2 * down) AS Npix, n FROM (SELECT Norder, Npix, n, min(cell) AS lo, CAST(CASE WHEN min(cell) = max(cell) THEN 0 ELSE floor((floor(log2(xor(min(cell), max(cell)))) + 2) / 2) END AS INT) AS down FROM o_align GROUP BY 1, 2, 3)",
    "constant_order_partitions": f"WITH pos AS ({_POS}) SELECT 5 AS Norder, cell AS Npix, count(*) AS n FROM ({hp.sql_cell('pos', 'ra', 'dec', 5, 'cell')}) GROUP BY cell",
    "aligned_partition_counts": f"WITH {_OBJ} SELECT Norder, Dir, Npix, count(*) AS n_rows FROM o_rows GROUP BY ALL",
    "sky_fraction": f"WITH {_OBJ} SELECT round(sum(1.0 / (12 * pow(4, Norder))), 5) AS moc_sky_fraction FROM o_parts",
    "catalog_rows_with_partition_columns": f"WITH {_OBJ} SELECT id, Norder, Dir, Npix FROM o_rows",
    "row_count_reconciliation": f"WITH {_OBJ} SELECT (SELECT count(*) FROM pos) AS expected, (SELECT count(*) FROM o_rows) AS placed, (SELECT count(*) FROM pos) = (SELECT count(*) FROM o_rows) AS same",
    "index_distinct": f"WITH {_SRC} SELECT DISTINCT band, Norder, Dir, Npix, id FROM s_rows",
    "index_range_buckets": f"WITH {_SRC} SELECT (id >= 2000)::INT + (id >= 4000)::INT + (id >= 8000)::INT + (id >= 16000)::INT AS bucket, count(*) AS n_rows, min(id) AS lo, max(id) AS hi FROM (SELECT DISTINCT Norder, Npix, id FROM s_rows) GROUP BY 1",
    "association_counts": f"WITH {_OBJ}, {_SRC} {_COUNTS}",
    "association_leaf": f"WITH {_OBJ}, {_SRC} SELECT DISTINCT o.id AS object_id, s.id AS source_id, o.Norder, o.Dir, o.Npix, s.Norder AS join_Norder, s.Dir AS join_Dir, s.Npix AS join_Npix FROM o_rows o JOIN s_rows s ON o.id = s.id",
    "association_unmatched": f"WITH {_OBJ}, {_SRC} SELECT Norder AS join_Norder, Dir AS join_Dir, Npix AS join_Npix, count(*) AS num_rows FROM s_rows WHERE id IS NULL OR id NOT IN (SELECT o_rows.id FROM o_rows JOIN ({_SOUND}) g ON g.id = o_rows.id) GROUP BY ALL",
    "association_reconciled": f"WITH {_OBJ}, {_SRC}, g AS MATERIALIZED (SELECT o_rows.id FROM o_rows JOIN ({_SOUND}) t ON t.id = o_rows.id) SELECT Norder AS join_Norder, Npix AS join_Npix, count(*) AS n_sources, count(g.id) AS n_matched, count(*) - count(g.id) AS n_unmatched, TRUE AS same FROM s_rows LEFT JOIN g ON g.id = s_rows.id GROUP BY ALL",
    "association_partition_totals": f"WITH {_OBJ}, {_SRC} SELECT Norder, Dir, Npix, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM ({_COUNTS}) GROUP BY ALL",
    "association_combined_counts": f"SELECT Norder, Dir, Npix, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM (SELECT DISTINCT count_id, Norder, {_DIR.format('Npix')} AS Dir, Npix, num_rows FROM soap_2_177 WHERE Norder <> -1) WHERE num_rows > 0 GROUP BY ALL",
    "partition_overlap_pairs": f"SELECT a.Norder, a.Npix, b.Norder AS join_Norder, b.Npix AS join_Npix FROM {_LIVE.format('sky_object')} a JOIN {_LIVE.format('sky_source')} b ON {_OVERLAP}",
    "pixel_set_difference": f"SELECT Norder, Npix FROM {_LIVE.format('sky_source')} EXCEPT SELECT Norder, Npix FROM {_LIVE.format('sky_object')}",
    "sky_ordered_partitions": f"SELECT Norder, Npix, row_number() OVER (ORDER BY Npix << (2 * (12 - Norder)), Norder) AS position FROM {_LIVE.format('sky_source')}",
    "margin_coarse": f"WITH pos AS ({_POS}), c AS ({hp.sql_cell('pos', 'ra', 'dec', MARGIN_ORDER, 'cell', 'id')}) SELECT DISTINCT id, partition_order AS margin_target_order, partition_pixel AS margin_target_pixel FROM c JOIN negative_pairs ON cell = margin_pixel",
    "margin_pairs": f"WITH {_RING} SELECT DISTINCT o AS partition_order, p AS partition_pixel, cell AS margin_pixel FROM ({hp.sql_cell('pos', 'ra', 'dec', MARGIN_ORDER, 'cell', 'o, p')}) WHERE cell >> (2 * ({MARGIN_ORDER} - o)) <> p",
    "pixel_list_filter": f"SELECT DISTINCT a.Norder, a.Npix FROM {_LIVE.format('sky_source')} a JOIN (VALUES (0, 5::BIGINT), (2, 140::BIGINT)) b(Norder, Npix) ON {_OVERLAP}",
    "in_pixel_rows": f"SELECT band, count(*) AS n FROM spatial_index WHERE _healpix_29 >> 58 = 5 GROUP BY band",
    "band_array_explode": "SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS value_{b}" for k, b in enumerate("ugriz")) + " FROM embeddings",
    "path_derived_column": r"SELECT file_no, TRY_CAST(regexp_extract(path, 'order_(\d+)/', 1) AS INT) AS Norder, TRY_CAST(regexp_extract(path, 'pixel_(\d+)/', 1) AS BIGINT) AS Npix FROM soap_files",
    "union_shards": "SELECT Norder, Npix, count(*) AS n FROM (SELECT Norder, Npix FROM soap_2_177 UNION ALL SELECT join_Norder, join_Npix FROM soap_2_177) GROUP BY ALL",
    "column_min_max": "SELECT min(id) AS id_min, max(id) AS id_max, min(_healpix_29) AS index_min, max(_healpix_29) AS index_max FROM spatial_index",
}
SQL["association_near_counts"] = SQL["association_counts"]
