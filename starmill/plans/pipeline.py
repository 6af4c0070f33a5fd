"""The six pipelines, chosen by the type of their arguments."""

from __future__ import annotations

import json
import smtplib
import traceback
from datetime import UTC, datetime
from email.message import EmailMessage

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill import __version__
from starmill.functions.healpix import MAX_ORDER, ancestor, descendant_range, dir_of, with_cell
from starmill.operators import association as assoc
from starmill.operators import binning, index, margin
from starmill.plans import arguments as args_of
from starmill.plans.resume import Stages
from starmill.session import ship_package
from starmill.sources import layout

INDEX = "_healpix_29"
Pixel = tuple[int, int]


def pipeline(args: args_of.RuntimeArguments, spark: SparkSession | None = None) -> None:
    """Run the pipeline that ``args`` is for; mail the outcome if an address is set."""
    runs = {
        args_of.ImportArguments: run_import, args_of.MarginCacheArguments: run_margin, args_of.IndexArguments: run_index, args_of.SoapArguments: run_soap,
        args_of.ConversionArguments: run_conversion, args_of.VerificationArguments: run_verification,
    }
    if type(args) not in runs:
        raise ValueError("unknown arguments: a pipeline is chosen by their type")
    spark = spark or SparkSession.builder.getOrCreate()
    ship_package(spark)
    try:
        runs[type(args)](args, spark)
    except Exception:
        _mail(args, "failed", traceback.format_exc())
        raise
    _mail(args, "succeeded", "")


def _mail(args: args_of.RuntimeArguments, outcome: str, text: str) -> None:
    if not args.completion_email_address:
        return
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = f"{args.output_artifact_name} {outcome}", "starmill@localhost", args.completion_email_address
    m.set_content(text or f"output_artifact_name: {args.output_artifact_name}")
    with smtplib.SMTP("localhost") as s:
        s.send_message(m)


def _size_kib(path: str) -> int:
    fs, p = layout.filesystem(path)
    return sum(f.size for f in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if f.type == pafs.FileType.File) // 1024


def _stages(a: args_of.RuntimeArguments, names: tuple[str, ...]) -> Stages:
    return Stages(a.tmp_path, names, a.resume, ("lines" if a.simple_progress_bar else "bar") if a.progress_bar else None)


def _same_work(a: args_of.RuntimeArguments, stages: Stages, *names: str) -> None:
    """Nothing done is of use if the arguments are not those it was done with; the dataset is begun anew then."""
    plan = {n: str(getattr(a, n)) for n in names}
    if not stages.same_plan(plan):
        stages.forget(*stages.names)
        layout.remove(f"{a.catalog_path}/dataset")


def _write_missing(a: args_of.RuntimeArguments, spark: SparkSession, stages: Stages, rows: DataFrame, expected: dict[Pixel, int], sort: list, **kw) -> None:
    """Write the leaves of ``expected`` pixels that an earlier run has not written, and see that all are there."""
    dataset = f"{a.catalog_path}/dataset"
    left = stages.todo(spark, dataset, expected)
    if left:
        if len(left) < len(expected):
            rows = rows.join(spark.createDataFrame(left, "Norder int, Npix bigint"), ["Norder", "Npix"], "left_semi").select(*rows.columns)
        written = {(r.Norder, r.Npix): r.n_rows for r in layout.write_leaves(rows, dataset, sort, n_tasks=a.n_tasks, **kw).toLocalIterator()}
        for pixel in left:
            if written.get(pixel, 0) != expected[pixel]:
                raise ValueError(f"pixel {pixel} has {written.get(pixel, 0)} rows where {expected[pixel]} were counted")
    stages.complete("reducing", stages.todo(spark, dataset, expected))


def _finish(args: args_of.RuntimeArguments, values: dict) -> None:
    now = datetime.now(UTC)
    extra = {"builder": f"starmill v{__version__}", "creation_date": now.strftime("%Y-%m-%dT%H:%MUTC"), "estsize": _size_kib(args.catalog_path), "release_date": "2024-09-18", "version": "v0.1"}
    layout.write_properties(args.catalog_path, values | extra | args.addl_properties)


def _pixel_files(spark: SparkSession, catalog_path: str, pixels: list[Pixel], expected: int | None) -> int:
    layout.write_csv(f"{catalog_path}/partition_info.csv", ["Norder", "Npix"], [(o, p) for o, p in sorted(pixels, key=lambda x: (x[1] << (2 * (29 - x[0])), x[0]))])
    rows = layout.write_metadata(spark, f"{catalog_path}/dataset", layout.leaf_names(pixels))
    if expected is not None and rows != expected:
        raise ValueError(f"the leaves hold {rows} rows, but the expectation is {expected}")
    return rows


# ---------------------------------------------------------------- import


def _positioned(df: DataFrame, a: args_of.ImportArguments) -> DataFrame:
    """Rows with the cell of the mapping order and, if wanted, the spatial index."""
    if a.use_healpix_29:
        return df.withColumn("__cell", ancestor(F.col(INDEX), MAX_ORDER, a.mapping_order))
    df = with_cell(df, a.ra_column, a.dec_column, MAX_ORDER, "__index")
    return df.withColumn("__cell", F.when(F.col("__index") >= 0, ancestor(F.col("__index"), MAX_ORDER, a.mapping_order)).otherwise(-1))


def _leaf_rows(a: args_of.ImportArguments, spark: SparkSession, parts: list[Pixel]) -> tuple[DataFrame, list[str]]:
    """The rows as they are stored, with the columns they are sorted by in a leaf."""
    rows = binning.place_rows(_positioned(a.file_reader.read(spark, a.input_paths), a), parts, a.mapping_order, "__cell").drop("__cell")
    given = [c for c in rows.columns if c not in ("__index", INDEX, *layout.PIXEL)]
    keep = a.add_healpix_29 or a.use_healpix_29
    if keep and not a.use_healpix_29:
        rows = rows.drop(INDEX).withColumnRenamed("__index", INDEX)
    own = [INDEX] if keep else []
    # without it the index is a column of the input like any other, where the input has it
    columns = [*given, *layout.PIXEL, *own] if a.add_healpix_29 else [*own, *given, *layout.PIXEL]
    if a.use_schema_file:
        from starmill.sources.readers import schema_of_file

        kinds = {f.name: f.dataType for f in schema_of_file(a.use_schema_file) if f.name not in (*layout.PIXEL, INDEX)}
        rows = rows.select(*own, *[F.col(c).cast(t).alias(c) for c, t in kinds.items()], *layout.PIXEL)
    else:
        rows = rows.select(*columns)
    return rows, own + ([c.strip() for c in a.sort_columns.split(",")] if a.sort_columns else [])


def run_import(a: args_of.ImportArguments, spark: SparkSession) -> None:
    """Two passes over the input: its positions for the histogram, all of it for the one shuffle to the leaves."""
    stages = _stages(a, args_of.STAGES)
    stages.same_inputs(a.input_paths)
    _same_work(a, stages, "ra_column", "dec_column", "use_healpix_29", "sort_columns", "add_healpix_29", "use_schema_file", "mapping_order", "lowest_healpix_order", "pixel_threshold", "drop_empty_siblings")
    wanted = a.run_stages or list(args_of.STAGES)
    hist_path, align_path = f"{a.tmp_path}/histogram", f"{a.tmp_path}/alignment"
    if "mapping" in wanted and not stages.done("mapping"):
        narrow = a.file_reader.read(spark, a.input_paths, [INDEX] if a.use_healpix_29 else [a.ra_column, a.dec_column])
        binning.histogram_of_all(narrow, a.mapping_order, a.ra_column, a.dec_column, INDEX if a.use_healpix_29 else None).write.mode("overwrite").parquet(hist_path)
        if lost := spark.read.parquet(hist_path).where(F.col("cell") == binning.NOWHERE).first():
            raise ValueError(f"{lost.n} rows have no valid position")
        stages.touch("mapping")
    hist = spark.read.parquet(hist_path)
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if a.expected_total_rows > 0 and total != a.expected_total_rows:
        raise ValueError(f"the input has {total} rows, but the expectation is {a.expected_total_rows}")
    constant = a.constant_healpix_order >= 0
    if "binning" in wanted and not stages.done("binning"):
        if not constant and (over := binning.overfull(hist, a.pixel_threshold).first()):
            raise ValueError(f"cell {over.cell} of order {a.mapping_order} has {over.n} rows, which exceeds threshold {a.pixel_threshold}: raise the threshold or the highest order")
        layout.remove(f"{a.catalog_path}/dataset")  # leaves of another alignment
        binning.align(hist, a.mapping_order, a.lowest_healpix_order, a.pixel_threshold, constant, a.drop_empty_siblings).write.mode("overwrite").parquet(align_path)
        stages.touch("binning")
    if "reducing" not in wanted and "finishing" not in wanted:
        return
    parts = {(int(r.Norder), int(r.Npix)): int(r.n) for r in binning.partition_counts(spark.read.parquet(align_path), hist).toLocalIterator()}
    pixels = sorted(parts)
    if "reducing" in wanted and not stages.done("reducing"):
        if not a.debug_stats_only:
            rows, sort = _leaf_rows(a, spark, pixels)
            _write_missing(a, spark, stages, rows, parts, sort)
        stages.touch("reducing")
    if "finishing" not in wanted:
        return
    if a.debug_stats_only:
        layout.write_csv(f"{a.catalog_path}/partition_info.csv", ["Norder", "Npix"], pixels)
        layout.write_schema(f"{a.catalog_path}/dataset", layout.stored_schema(_leaf_rows(a, spark, pixels)[0]))
    else:
        _pixel_files(spark, a.catalog_path, pixels, total)
    layout.write_point_map(f"{a.catalog_path}/point_map.fits", hist, a.mapping_order)
    _finish(a, {
        "obs_collection": a.output_artifact_name, "dataproduct_type": a.catalog_type, "nrows": total, "col_ra": a.ra_column, "col_dec": a.dec_column, "cols_sort": a.sort_columns,
        "max_rows": a.pixel_threshold, "order": max((o for o, _ in pixels), default=0), "moc_sky_fraction": f"{layout.sky_fraction(pixels):0.5f}",
    })
    stages.touch("finishing")
    stages.clean(a.delete_intermediate_parquet_files, a.delete_resume_log_files)


# ---------------------------------------------------------------- margin


def run_margin(a: args_of.MarginCacheArguments, spark: SparkSession) -> None:
    """The pairs and the margin rows are kept in the work folder until the leaves are written."""
    stages = _stages(a, ("mapping", "reducing", "finishing"))
    _same_work(a, stages, "input_catalog_path", "margin_threshold", "margin_order", "fine_filtering", "boundary_samples", "debug_filter_pixel_list")
    ra, dec = a.catalog.properties[layout.KEYS["col_ra"]], a.catalog.properties[layout.KEYS["col_dec"]]
    pairs_path, rows_path, dataset = f"{a.tmp_path}/margin_pairs", f"{a.tmp_path}/margin_rows", f"{a.catalog_path}/dataset"
    if not stages.done("mapping"):
        margin.margin_pairs(margin.with_negatives(spark, a.catalog.partitions(spark)), a.margin_order).write.mode("overwrite").parquet(pairs_path)
        found = margin.margin_rows(a.catalog.read(spark), spark.read.parquet(pairs_path), ra, dec, a.margin_order, a.margin_threshold, a.fine_filtering, a.boundary_samples)
        found.write.mode("overwrite").parquet(rows_path)
        layout.remove(dataset)
        stages.touch("mapping")
    rows = spark.read.parquet(rows_path)
    expected = {(int(r.Norder), int(r.Npix)): int(r.n) for r in rows.groupBy("Norder", "Npix").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not stages.done("reducing"):
        _write_missing(a, spark, stages, rows, expected, [INDEX] if INDEX in rows.columns else [])
        stages.touch("reducing")
    pixels = sorted(expected)
    total = _pixel_files(spark, a.catalog_path, pixels, sum(expected.values()))
    if not pixels:
        layout.write_schema(dataset, layout.stored_schema(rows))
    _finish(a, {
        "obs_collection": a.output_artifact_name, "dataproduct_type": "margin", "nrows": total, "col_ra": ra, "col_dec": dec, "primary_table_url": a.input_catalog_path, "margin_threshold": a.margin_threshold,
        "order": max((o for o, _ in pixels), default=0), "moc_sky_fraction": f"{layout.sky_fraction(pixels):0.5f}",
    })
    stages.touch("finishing")
    stages.clean(a.delete_intermediate_parquet_files, a.delete_resume_log_files)


# ---------------------------------------------------------------- index


def run_index(a: args_of.IndexArguments, spark: SparkSession) -> None:
    stages = _stages(a, ("indexing", "finishing"))
    _same_work(a, stages, "input_catalog_path", "indexing_column", "extra_columns", "include_healpix_29", "include_order_pixel", "drop_duplicates", "compute_partition_size", "division_hints")
    dataset = f"{a.catalog_path}/dataset"
    if not stages.done("indexing"):
        df = a.catalog.read(spark)
        if a.include_healpix_29 and INDEX not in df.columns:
            df = with_cell(df, a.catalog.properties[layout.KEYS["col_ra"]], a.catalog.properties[layout.KEYS["col_dec"]], MAX_ORDER, INDEX)
        rows = index.index_rows(df, a.indexing_column, a.extra_columns, a.include_healpix_29, a.include_order_pixel, a.drop_duplicates)
        # as many files as the leaves' bytes ask for; the index is narrower, so files come out smaller
        n = max(1, _size_kib(f"{a.input_catalog_path}/dataset") * 1024 // a.compute_partition_size + 1)
        layout.remove(dataset)
        parts = [(r.part, r.n_rows) for r in layout.write_parts(index.index_partitions(rows, a.indexing_column, n, a.division_hints), dataset, "index").toLocalIterator()]
        layout.write_csv(f"{a.tmp_path}/parts.csv", ["part", "n_rows"], sorted(parts))
        stages.touch("indexing")
    parts = [tuple(map(int, line.split(","))) for line in layout.read_text(f"{a.tmp_path}/parts.csv").splitlines()[1:]]
    total = layout.write_metadata(spark, dataset, [f"index/part.{p}.parquet" for p, _ in parts])
    if total != sum(n for _, n in parts):
        raise RuntimeError(f"the index files hold {total} rows where {sum(n for _, n in parts)} were written")
    _finish(a, {"obs_collection": a.output_artifact_name, "dataproduct_type": "index", "nrows": total, "primary_table_url": a.input_catalog_path, "index_column": a.indexing_column, "index_extra_column": a.extra_columns})
    stages.touch("finishing")
    stages.clean(a.delete_intermediate_parquet_files, a.delete_resume_log_files)


# ---------------------------------------------------------------- association

COUNTS = ("Norder", "Dir", "Npix", "join_Norder", "join_Dir", "join_Npix", "num_rows")


def run_soap(a: args_of.SoapArguments, spark: SparkSession) -> None:
    """Matches, unmatched sources and, if asked for, leaves; each is kept in the work folder when it is done.

    Matched and unmatched sources of every source partition have to add up, where each object id is one object.
    """
    stages = _stages(a, ("counting", "reducing", "finishing"))
    _same_work(a, stages, "object_catalog_dir", "object_id_column", "source_catalog_dir", "source_object_id_column", "source_id_column", "write_leaf_files")
    extra = [a.source_id_column] if a.source_id_column and a.source_id_column != a.source_object_id_column else []
    objects = a.objects.read(spark, [a.object_id_column, *layout.PIXEL])
    sources = a.sources.read(spark, list(dict.fromkeys([a.source_object_id_column, *extra, *layout.PIXEL])))
    pairs_path, counts_path, lost_path, leaf_path = (f"{a.tmp_path}/{n}" for n in ("source_object_map", "counts", "unmatched", "matches"))
    dataset = f"{a.catalog_path}/dataset"
    if not stages.done("counting"):
        assoc.candidate_pairs(a.objects.partitions(spark), a.sources.partitions(spark)).write.mode("overwrite").parquet(pairs_path)
        pairs = spark.read.parquet(pairs_path)
        if a.write_leaf_files:
            assoc.association_leaf(objects, sources, a.object_id_column, a.source_object_id_column, a.source_id_column, pairs).write.mode("overwrite").parquet(leaf_path)
            counts = spark.read.parquet(leaf_path).groupBy(*COUNTS[:-1]).agg(F.count(F.lit(1)).alias("num_rows"))
        else:
            counts = assoc.association_counts(objects, sources, a.object_id_column, a.source_object_id_column, pairs)
        counts.write.mode("overwrite").parquet(counts_path)
        assoc.unmatched_sources(objects, sources, a.object_id_column, a.source_object_id_column, pairs).write.mode("overwrite").parquet(lost_path)
        layout.remove(dataset)
        stages.touch("counting")
    # one row a pair of partitions
    info = [tuple(r[n] for n in COUNTS) for r in assoc.in_sky_order(spark.read.parquet(counts_path)).toLocalIterator()]
    pixels = sorted({(r[0], r[2]) for r in info})
    total = sum(r[-1] for r in info)
    if not stages.done("reducing"):
        if a.write_leaf_files:
            expected: dict[Pixel, int] = {}
            for r in info:
                expected[r[0], r[2]] = expected.get((r[0], r[2]), 0) + r[-1]
            along_sky = descendant_range(F.col("join_Npix"), F.col("join_Norder"))[0]
            a.n_tasks = a.n_tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _size_kib(f"{a.source_catalog_dir}/dataset") * 1024 // a.compute_partition_size + 1)
            _write_missing(a, spark, stages, spark.read.parquet(leaf_path), expected, [along_sky, "join_Norder", "object_id", "source_id"], split_groups_by=["join_Norder", "join_Npix"])
        stages.touch("reducing")
    if a.write_leaf_files:
        total = _pixel_files(spark, a.catalog_path, pixels, total)
        if not pixels:
            layout.write_schema(dataset, layout.stored_schema(spark.read.parquet(leaf_path)))
    layout.write_csv(f"{a.catalog_path}/partition_join_info.csv", list(COUNTS), info)
    layout.write_csv(f"{a.catalog_path}/partition_info.csv", ["Norder", "Npix"], pixels)
    lost = [(-1, 0, -1, r.join_Norder, r.join_Dir, r.join_Npix, r.num_rows) for r in spark.read.parquet(lost_path).orderBy("join_Norder", "join_Npix").toLocalIterator()]
    if lost:
        layout.write_csv(f"{a.catalog_path}/unmatched_sources.csv", list(COUNTS), lost)
    _finish(a, {
        "obs_collection": a.output_artifact_name, "dataproduct_type": "association", "nrows": total, "primary_table_url": a.object_catalog_dir, "col_assn_primary": a.object_id_column,
        "col_assn_primary_assn": "object_id", "assn_join_table_url": a.source_catalog_dir, "col_assn_join": a.source_object_id_column, "col_assn_join_assn": "source_id", "assn_leaf_files": a.write_leaf_files,
        "order": max((o for o, _ in pixels), default=0), "moc_sky_fraction": f"{layout.sky_fraction(pixels):0.5f}",
    })
    stages.touch("finishing")
    stages.clean(a.delete_intermediate_parquet_files, a.delete_resume_log_files)


# ---------------------------------------------------------------- conversion


def run_conversion(a: args_of.ConversionArguments, spark: SparkSession) -> None:
    base = a.input_catalog_path.rstrip("/")
    text = layout.read_text(f"{base}/catalog_info.json")
    if text is None:
        raise ValueError(f"{base} is not a catalog of the older layout: it has no catalog_info.json")
    info = json.loads(text)
    info.pop("epoch", None)
    kind = info.get("catalog_type")
    if kind not in ("object", "source", "margin", "association"):
        raise ValueError(f"Conversion of catalog type {kind} not supported")
    provenance = json.loads(layout.read_text(f"{base}/provenance_info.json") or "{}")
    runtime = provenance.get("tool_args", {}).get("runtime_args", {})
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "Npix=*.parquet").parquet(base)
    file = F.col("_metadata.file_path")
    df = df.withColumns({"__o": F.regexp_extract(file, r"Norder=(\d+)", 1).cast("int"), "__p": F.regexp_extract(file, r"Npix=(\d+)", 1).cast("bigint")})
    ra, dec = info.get("ra_column"), info.get("dec_column")
    dropped = [layout.OLD_INDEX, *layout.PIXEL, "__o", "__p"]
    given = [c for c in df.columns if c not in dropped]
    first = []
    layout.remove(f"{a.catalog_path}/dataset")
    if kind != "association" and ra and dec:
        df, first = with_cell(df, ra, dec, MAX_ORDER, INDEX), [INDEX]
    rows = df.select(*first, *given, F.col("__o").alias("Norder"), dir_of(F.col("__p")).alias("Dir"), F.col("__p").alias("Npix"))
    written = [(r.Norder, r.Npix, r.n_rows) for r in layout.write_leaves(rows, f"{a.catalog_path}/dataset", first, layout.SIGNED).collect()]
    total = _pixel_files(spark, a.catalog_path, [(o, p) for o, p, _ in written], int(info["total_rows"]) if info.get("total_rows") is not None else None)
    layout.convert_point_map(f"{base}/point_map.fits", f"{a.catalog_path}/point_map.fits")
    names = {"catalog_name": "obs_collection", "catalog_type": "dataproduct_type", "total_rows": "nrows", "ra_column": "col_ra", "dec_column": "col_dec"}
    values = {names.get(k, k): v for k, v in info.items()} | {"obs_collection": a.output_artifact_name, "nrows": total, "cols_sort": runtime.get("sort_columns"), "max_rows": runtime.get("pixel_threshold")}
    pixels = [(o, p) for o, p, _ in written]
    _finish(a, values | {"order": max((o for o, _ in pixels), default=0), "moc_sky_fraction": f"{layout.sky_fraction(pixels):0.5f}"})


# ---------------------------------------------------------------- verification


def verify(spark: SparkSession, catalog: layout.Catalog, columns: list[str] | None = None) -> tuple[list[tuple[str, bool, str]], list[tuple]]:
    """Checks as (name, passed, note), and (column, n, n_null, low, high) of the given columns."""
    df = catalog.read(spark)
    by = {(r.Norder, r.Npix): r for r in df.groupBy("Norder", "Npix").agg(F.count(F.lit(1)).alias("n"), *([F.min(INDEX).alias("lo"), F.max(INDEX).alias("hi")] if INDEX in df.columns else [])).toLocalIterator()}
    total = sum(r.n for r in by.values())
    checks = [("row count", str(total) == catalog.properties.get(layout.KEYS["nrows"]), f"{total} rows"), ("partitions", set(by) == set(catalog.pixels), f"{len(by)} partitions")]
    spans = sorted((p << (2 * (29 - o)), (p + 1) << (2 * (29 - o))) for o, p in catalog.pixels)
    checks.append(("partitions do not overlap", all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), ""))
    if INDEX in df.columns and catalog.properties.get("dataproduct_type") in ("object", "source"):
        outside = [k for k, r in by.items() if not (k[1] << (2 * (29 - k[0])) <= r.lo and r.hi < (k[1] + 1) << (2 * (29 - k[0])))]
        checks.append(("rows lie in their partition", not outside, str(outside[:5])))
    fs, p = layout.filesystem(f"{catalog.path}/dataset/_metadata")
    checks.append(("_metadata", fs.get_file_info(p).type == pafs.FileType.File, ""))
    spread = []
    if columns:
        r = df.agg(F.count(F.lit(1)), *[f(c) for c in columns for f in (F.count, F.min, F.max)]).first()
        spread = [(c, r[0], r[0] - r[1 + 3 * k], r[2 + 3 * k], r[3 + 3 * k]) for k, c in enumerate(columns)]
    return checks, spread


def run_verification(a: args_of.VerificationArguments, spark: SparkSession) -> None:
    checks, spread = verify(spark, a.catalog, a.field_distribution_cols)
    layout.write_csv(f"{a.catalog_path}/verification.csv", ["check", "passed", "note"], checks)
    if spread:
        layout.write_csv(f"{a.catalog_path}/field_distribution.csv", ["column", "n_rows", "n_null", "low", "high"], spread)
    if failed := [c[0] for c in checks if not c[1]]:
        raise ValueError(f"verification failed: {failed}")
