"""The pipelines run from end to end in the shared folder, and what they wrote read back."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.healpix import MAX_ORDER, has_position, sql_cell, with_cell
from starmill.operators import binning
from starmill.operators.proximity import clean_positions
from starmill.plans import arguments as ar
from starmill.plans.pipeline import pipeline, verify
from starmill.queries import table
from starmill.queries.catalog import _OBJ, _SRC, ORDER, _align_sql
from starmill.queries.proximity import _POS
from starmill.session import scratch_path
from starmill.sources.layout import KEYS, OLD_INDEX, Catalog, filesystem, footers, leaf_names, read_fits_map, remove, write_leaves, write_text
from starmill.sources.readers import CsvReader, EcsvReader, FunctionReader, IndexedCsvReader, ParquetReader

THRESHOLD = 20_000


def _import_objects(spark: SparkSession, d: str, out: str) -> Catalog:
    reader = FunctionReader(function=lambda s, paths: clean_positions(s.read.parquet(*paths)).withColumnRenamed("key", "id"))
    pipeline(ar.ImportArguments(output_path=out, output_artifact_name="objects", input_file_list=[f"{d}/sky_catalog.parquet"], file_reader=reader, pixel_threshold=THRESHOLD, sort_columns="id", progress_bar=False), spark)
    return Catalog.open(f"{out}/objects")


def _import_sources(spark: SparkSession, d: str, out: str) -> Catalog:
    """The threshold is at least the largest cell of the mapping order, so that an id with many rows does not stop it."""
    reader = FunctionReader(function=lambda s, paths: s.read.parquet(*paths).where("_healpix_29 is not null").select("id", "band", "_healpix_29"))
    largest = binning.histogram_of_index(table(spark, d, "spatial_index"), "_healpix_29", ORDER).agg(F.max("n")).first()[0]
    pipeline(ar.ImportArguments(output_path=out, output_artifact_name="sources", catalog_type="source", input_file_list=[f"{d}/spatial_index.parquet"], file_reader=reader, use_healpix_29=True, highest_healpix_order=ORDER, pixel_threshold=max(10 * THRESHOLD, largest or 0), progress_bar=False), spark)
    return Catalog.open(f"{out}/sources")


def import_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _import_objects(spark, d, scratch_path(spark, "import")).read(spark, ["id", "Norder", "Dir", "Npix"])


def index_pipeline(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "index")
    catalog = _import_sources(spark, d, out)
    pipeline(ar.IndexArguments(output_path=out, output_artifact_name="by_id", input_catalog_path=catalog.path, indexing_column="id", include_healpix_29=False, progress_bar=False), spark)
    return spark.read.parquet(f"{out}/by_id/dataset/index")


def association_pipeline(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "association")
    objects, sources = _import_objects(spark, d, out), _import_sources(spark, d, out)
    pipeline(ar.SoapArguments(output_path=out, output_artifact_name="joined", object_catalog_dir=objects.path, object_id_column="id", source_catalog_dir=sources.path, source_object_id_column="id", progress_bar=False), spark)
    schema = "Norder int, Dir bigint, Npix bigint, join_Norder int, join_Dir bigint, join_Npix bigint, num_rows bigint"
    return spark.read.csv(f"{out}/joined/partition_join_info.csv", header=True, schema=schema)


def association_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of an association: rows, and row groups, one for each source partition."""
    out = scratch_path(spark, "matches")
    objects, sources = _import_objects(spark, d, out), _import_sources(spark, d, out)
    pipeline(ar.SoapArguments(output_path=out, output_artifact_name="joined", object_catalog_dir=objects.path, object_id_column="id", source_catalog_dir=sources.path, source_object_id_column="id", write_leaf_files=True, progress_bar=False), spark)
    catalog = Catalog.open(f"{out}/joined")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pq.read_metadata(pa.BufferReader(f)) for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.num_row_groups for m in sizes], pa.int64())], names=["at", "n_rows", "n_groups"])

    names = leaf_names(catalog.pixels)
    pixels = spark.createDataFrame([(k, *sorted(catalog.pixels, key=lambda p: (p[1] << (2 * (MAX_ORDER - p[0])), p[0]))[k]) for k in range(len(names))], "at bigint, Norder int, Npix bigint")
    return footers(spark, f"{catalog.path}/dataset", names).mapInArrow(groups, "at bigint, n_rows bigint, n_groups bigint").join(pixels, "at").drop("at")


def leaf_sort_order(spark: SparkSession, d: str) -> DataFrame:
    """Where the sink put each row in its leaf, sorted by the columns asked for."""
    out = scratch_path(spark, "sorted")
    reader = FunctionReader(function=lambda s, paths: with_cell(clean_positions(s.read.parquet(*paths)).withColumnRenamed("key", "id"), "ra", "dec", ORDER, "cell"))
    pipeline(ar.ImportArguments(output_path=out, output_artifact_name="objects", input_file_list=[f"{d}/sky_catalog.parquet"], file_reader=reader, pixel_threshold=THRESHOLD, sort_columns="cell,id", add_healpix_29=False, progress_bar=False), spark)
    leaves = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "Npix=*.parquet").parquet(f"{out}/objects/dataset")
    return leaves.select("id", F.col("Norder").cast("int").alias("Norder"), F.col("Npix").cast("bigint").alias("Npix"), (F.col("_metadata.row_index") + 1).alias("position"))


def catalog_properties(spark: SparkSession, d: str) -> DataFrame:
    """What the import tells of the catalog in its properties."""
    p = _import_objects(spark, d, scratch_path(spark, "properties")).properties
    names = {"rows": "nrows", "order": "order", "threshold": "max_rows", "ra": "col_ra", "dec": "col_dec"}
    rows = [(k, p[KEYS[v]]) for k, v in names.items()] + [(k, p[k]) for k in ("dataproduct_type", "obs_collection", "moc_sky_fraction")]
    return spark.createDataFrame(rows, "name string, value string")


def point_map_counts(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the point map with objects."""
    catalog = _import_objects(spark, d, scratch_path(spark, "map"))
    values, _ = read_fits_map(f"{catalog.path}/point_map.fits")
    cells = np.flatnonzero(values)
    return spark.createDataFrame(pd.DataFrame({"cell": cells.astype(np.int64), "n": values[cells].astype(np.int64)}))


def conversion_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of the older layout, made from an imported one, converted: its rows with their index and pixels."""
    out = scratch_path(spark, "conversion")
    catalog = _import_objects(spark, d, out)
    old = f"{out}/old"
    rows = catalog.read(spark).withColumnRenamed("_healpix_29", OLD_INDEX)
    write_leaves(rows, old, [OLD_INDEX]).collect()
    remove(f"{old}/_temporary")
    write_text(f"{old}/catalog_info.json", json.dumps({"catalog_name": "old", "catalog_type": "object", "total_rows": int(catalog.properties[KEYS["nrows"]]), "epoch": "J2000", "ra_column": "ra", "dec_column": "dec"}))
    pipeline(ar.ConversionArguments(output_path=out, output_artifact_name="new", input_catalog_path=old, progress_bar=False), spark)
    return Catalog.open(f"{out}/new").read(spark, ["id", "Norder", "Dir", "Npix"])


def margin_pipeline(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "margin")
    catalog = _import_objects(spark, d, out)
    pipeline(ar.MarginCacheArguments(output_path=out, output_artifact_name="margin", input_catalog_path=catalog.path, margin_threshold=60.0, progress_bar=False), spark)
    return Catalog.open(f"{out}/margin").read(spark, ["id", "Norder", "Npix", "margin_Norder", "margin_Npix"])


def verification_pipeline(spark: SparkSession, d: str) -> DataFrame:
    checks, _ = verify(spark, _import_objects(spark, d, scratch_path(spark, "verify")))
    return spark.createDataFrame([(name, passed) for name, passed, _ in checks], "check_name string, passed boolean")


def csv_reader(spark: SparkSession, d: str) -> DataFrame:
    """A table written as delimited text without header and read again with a schema."""
    path = scratch_path(spark, "csv")
    t = table(spark, d, "negative_pairs")
    t.write.csv(path, sep="|", nullValue="")
    return CsvReader(sep="|", header=False, column_names=t.columns, type_map=PAIR_TYPES).read(spark, [path])


PAIR_TYPES = {"partition_order": "Int32", "partition_pixel": "int64", "margin_pixel": "Int64"}


def gz_reader(spark: SparkSession, d: str) -> DataFrame:
    """The same in gzipped files with headers."""
    path = scratch_path(spark, "gz")
    table(spark, d, "negative_pairs").write.csv(path, header=True, nullValue="", compression="gzip")
    return CsvReader(type_map=PAIR_TYPES).read(spark, [path])


def indexed_reader(spark: SparkSession, d: str) -> DataFrame:
    """The same in files named by an index file."""
    path = scratch_path(spark, "indexed")
    table(spark, d, "negative_pairs").repartition(5).write.csv(path, header=True, nullValue="")
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator()]
    index = f"{scratch_path(spark, 'index_file')}/files.txt"
    write_text(index, "\n".join(names) + "\n\n")
    return IndexedCsvReader(type_map=PAIR_TYPES).read(spark, [index])


def zip_reader(spark: SparkSession, d: str) -> DataFrame:
    """The same in an archive of two files; types are those that hold all values of both."""
    t = table(spark, d, "negative_pairs").toPandas()  # a fixed table of some 41,000 rows
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(2):
            z.writestr(f"{k}.csv", t[k::2].astype("Int64").to_csv(index=False))
    path = f"{scratch_path(spark, 'zip')}/pairs.zip"
    fs, p = filesystem(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(held.getvalue())
    out = CsvReader().read(spark, [path])
    return out.select(F.col("partition_order").cast("int").alias("partition_order"), "partition_pixel", "margin_pixel")


def ecsv_reader(spark: SparkSession, d: str) -> DataFrame:
    """A table with lists, written as ECSV: names and types come from its header."""
    path = scratch_path(spark, "ecsv")
    head = "# %ECSV 1.0\n# ---\n# delimiter: ','\n# datatype:\n# - {name: vec_id, datatype: int64}\n# - {name: label, datatype: int32}\n# - {name: embedding, datatype: string, subtype: 'float32[null]'}\n# schema: astropy-2.0\nvec_id,label,embedding"
    rows = table(spark, d, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.concat(F.lit('"'), F.to_json("embedding"), F.lit('"'))).alias("value"))
    first = spark.createDataFrame([(head,)], "value string")
    first.unionByName(rows).coalesce(1).write.text(path)
    name = spark.read.format("binaryFile").load(path).select("path").first().path
    out = EcsvReader().read(spark, [name.removeprefix("file:")])
    return out.select("vec_id", "label", F.size("embedding").alias("n_values"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def parquet_reader(spark: SparkSession, d: str) -> DataFrame:
    """Projection reaches the scan: only two columns are read."""
    return ParquetReader(column_names=["id", "ra", "dec"]).read(spark, [f"{d}/sky_catalog.parquet"], ["ra", "dec"]).groupBy(has_position(F.col("ra"), F.col("dec")).alias("positioned")).agg(F.count(F.lit(1)).alias("n"))


def spatial_index_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each order at which the given index still agrees with the object's position."""
    objects = with_cell(clean_positions(table(spark, d, "sky_catalog")), "ra", "dec", MAX_ORDER, "cell")
    t = table(spark, d, "spatial_index").where("_healpix_29 is not null").select("id", "_healpix_29").join(objects, F.col("id") == F.col("key"))
    return t.agg(*[F.sum((F.shiftright("cell", 2 * (29 - o)) == F.shiftright("_healpix_29", 2 * (29 - o))).cast("bigint")).alias(f"order_{o}") for o in (0, 6, 12)])


QUERIES = {
    f.__name__: f
    for f in (
        import_pipeline, index_pipeline, association_pipeline, association_row_groups, leaf_sort_order, catalog_properties, point_map_counts, conversion_pipeline, margin_pipeline, verification_pipeline, csv_reader, gz_reader, indexed_reader,
        zip_reader, ecsv_reader, parquet_reader, spatial_index_check,
    )
}
_O = _OBJ.split(", o_hist AS")[0] + ", " + _align_sql("o", "oc", THRESHOLD)
_S = _SRC.split(", s_hist AS")[0] + ", " + _align_sql("s", "sc", 10 * THRESHOLD)
SQL = {
    "import_pipeline": f"WITH {_O} SELECT id, Norder, Dir, Npix FROM o_rows",
    "index_pipeline": f"WITH {_S} SELECT DISTINCT Norder, Dir, Npix, id FROM s_rows",
    "association_pipeline": f"WITH {_O}, {_S} SELECT o.Norder, o.Dir, o.Npix, s.Norder AS join_Norder, s.Dir AS join_Dir, s.Npix AS join_Npix, count(*) AS num_rows FROM o_rows o JOIN s_rows s ON o.id = s.id GROUP BY ALL",
    "verification_pipeline": "SELECT unnest(['row count', 'partitions', 'partitions do not overlap', 'rows lie in their partition', '_metadata']) AS check_name, TRUE AS passed",
    "association_row_groups": f"WITH {_O}, {_S} SELECT o.Norder, o.Npix, count(DISTINCT (o.id, s.Norder, s.Npix)) AS n_rows, count(DISTINCT (s.Norder, s.Npix)) AS n_groups FROM o_rows o JOIN s_rows s ON o.id = s.id GROUP BY 1, 2",
    "leaf_sort_order": f"WITH {_O} SELECT id, Norder, Npix, row_number() OVER (PARTITION BY Norder, Npix ORDER BY cell, id) AS position FROM o_rows",
    "catalog_properties": f"""WITH {_O}, p AS (SELECT DISTINCT Norder, Npix FROM o_rows) SELECT unnest(['rows', 'order', 'threshold', 'ra', 'dec', 'dataproduct_type', 'obs_collection', 'moc_sky_fraction']) AS name,
 unnest([CAST((SELECT count(*) FROM o_rows) AS VARCHAR), (SELECT CAST(max(Norder) AS VARCHAR) FROM p), '{THRESHOLD}', 'ra', 'dec', 'object', 'objects', (SELECT printf('%.5f', sum(1.0 / (12 * pow(4, Norder)))) FROM p)]) AS value""",
    "point_map_counts": f"WITH {_O} SELECT cell, n FROM o_hist",
    "conversion_pipeline": f"WITH {_O} SELECT id, Norder, Dir, Npix FROM o_rows",
    "spatial_index_check": f"""WITH pos AS MATERIALIZED ({_POS}), c AS MATERIALIZED ({sql_cell("pos", "ra", "dec", 12, "cell", "id")}), t AS (SELECT cell, _healpix_29 AS i FROM spatial_index s JOIN c ON s.id = c.id WHERE _healpix_29 IS NOT NULL)
 SELECT CAST(count(*) FILTER (cell >> 24 = i >> 58) AS BIGINT) AS order_0, count(*) FILTER (cell >> 12 = i >> 46) AS order_6, count(*) FILTER (cell = i >> 34) AS order_12 FROM t""",
    "csv_reader": "SELECT * FROM negative_pairs",
    "gz_reader": "SELECT * FROM negative_pairs",
    "indexed_reader": "SELECT * FROM negative_pairs",
    "zip_reader": "SELECT * FROM negative_pairs",
    "ecsv_reader": "SELECT vec_id, label, len(embedding) AS n_values, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings",
    "parquet_reader": "SELECT coalesce(isfinite(ra) AND dec BETWEEN -90 AND 90, FALSE) AS positioned, count(*) AS n FROM sky_catalog GROUP BY 1",
}
