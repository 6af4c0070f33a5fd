import json
import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from starmill.functions import healpix as hp
from starmill.functions.geometry import exact_distance
from starmill.plans import arguments as ar
from starmill.plans.pipeline import pipeline, verify
from starmill.sources import layout
from starmill.sources.layout import Catalog, read_properties
from starmill.sources.readers import CsvReader


@pytest.fixture(scope="module")
def sky(tmp_path_factory):
    rng = np.random.default_rng(7)
    base = tmp_path_factory.mktemp("sky")
    n = 2000
    df = pd.DataFrame({"id": np.arange(n) + 700, "ra": np.concatenate([rng.uniform(0, 360, n // 2), rng.normal(300, 5, n // 2) % 360]), "dec": np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, n // 2))), rng.normal(-40, 5, n // 2)]), "mag": rng.integers(10, 14, n)})
    (base / "in").mkdir()
    for k in range(4):
        df[k::4].to_csv(base / "in" / f"part_{k}.csv", index=False)
    pd.DataFrame({"sid": np.arange(3 * n), "oid": np.repeat(df.id.to_numpy(), 3), "ra": np.repeat(df.ra.to_numpy(), 3), "dec": np.repeat(df.dec.to_numpy(), 3)}).to_parquet(base / "sources.parquet")
    return base, df


@pytest.fixture(scope="module")
def catalog(spark, sky):
    base, _ = sky
    pipeline(ar.ImportArguments(output_path=str(base), output_artifact_name="obj", input_path=str(base / "in"), file_reader=CsvReader(type_map={"id": "int64", "ra": "float64", "dec": "float64", "mag": "int64"}), highest_healpix_order=6, pixel_threshold=300, sort_columns="mag,id", expected_total_rows=2000), spark)
    return Catalog.open(str(base / "obj"))


def test_import(spark, sky, catalog):
    base, df = sky
    assert catalog.read(spark).count() == 2000
    p = read_properties(catalog.path)
    assert p[layout.KEYS["nrows"]] == "2000" and p["dataproduct_type"] == "object" and p[layout.KEYS["col_ra"]] == "ra" and p[layout.KEYS["max_rows"]] == "300"
    order, pixel = catalog.pixels[0]
    leaf = pq.ParquetFile(f"{catalog.path}/dataset/Norder={order}/Dir=0/Npix={pixel}.parquet")
    assert leaf.schema_arrow.names == ["id", "ra", "dec", "mag", "Norder", "Dir", "Npix", "_healpix_29"]
    assert [str(leaf.schema_arrow.field(c).type) for c in ("Norder", "Dir", "Npix", "_healpix_29")] == ["uint8", "uint64", "uint64", "int64"]
    t = leaf.read().to_pandas()
    assert (t == t.sort_values(["_healpix_29", "mag", "id"])).all().all()
    assert (t._healpix_29 // 4 ** (29 - order) == pixel).all()
    assert not os.path.exists(f"{catalog.path}/intermediate") and os.path.getsize(f"{catalog.path}/point_map.fits") % 2880 == 0
    assert pq.read_metadata(f"{catalog.path}/dataset/_metadata").num_rows == 2000
    checks, spread = verify(spark, catalog, ["mag"])
    assert all(c[1] for c in checks) and spread[0][:3] == ("mag", 2000, 0)


def test_resume_and_failures(spark, sky):
    base, _ = sky
    common = dict(output_path=str(base), input_path=str(base / "in"), file_reader=CsvReader(), highest_healpix_order=4, pixel_threshold=2000)
    with pytest.raises(ValueError, match="expectation"):
        pipeline(ar.ImportArguments(output_artifact_name="r", expected_total_rows=5, **common), spark)
    pipeline(ar.ImportArguments(output_artifact_name="r", run_stages=["binning"], **common), spark)
    assert os.path.exists(base / "r/intermediate/binning_done") and not os.path.exists(base / "r/dataset")
    other = dict(common, input_path=None, input_file_list=[str(base / "in/part_0.csv")])
    with pytest.raises(ValueError, match="input files are not"):
        pipeline(ar.ImportArguments(output_artifact_name="r", **other), spark)
    pipeline(ar.ImportArguments(output_artifact_name="r", **common), spark)
    assert Catalog.open(str(base / "r")).read(spark).count() == 2000
    with pytest.raises(ValueError, match="exceeds threshold"):
        pipeline(ar.ImportArguments(output_artifact_name="over", **dict(common, pixel_threshold=100, highest_healpix_order=1)), spark)
    pipeline(ar.ImportArguments(output_artifact_name="stats", debug_stats_only=True, **common), spark)
    assert os.path.exists(base / "stats/partition_info.csv") and os.listdir(base / "stats/dataset") and not any(n.startswith("Norder") for n in os.listdir(base / "stats/dataset"))
    assert pq.read_schema(base / "stats/dataset/_metadata").names == ["id", "ra", "dec", "mag", "Norder", "Dir", "Npix", "_healpix_29"]


def test_resume_by_leaf(spark, sky, capfd):
    """A leaf that is lost or broken is written again, the others are left as they are; another threshold starts anew."""
    base, _ = sky
    common = dict(output_path=str(base), output_artifact_name="again", input_path=str(base / "in"), file_reader=CsvReader(), highest_healpix_order=4, delete_resume_log_files=False, simple_progress_bar=True)
    pipeline(ar.ImportArguments(pixel_threshold=300, **common), spark)
    assert "reducing   3/4" in capfd.readouterr().err
    c = Catalog.open(str(base / "again"))
    leaves = [f"{c.path}/dataset/{n}" for n in layout.leaf_names(c.pixels)]
    stamps = {p: os.stat(p).st_mtime_ns for p in leaves}
    os.remove(leaves[0])
    part = pq.read_table(leaves[1], partitioning=None)
    pq.write_table(part.slice(1), leaves[1])
    for n in ("reducing", "finishing"):
        os.remove(f"{c.path}/intermediate/{n}_done")
    pipeline(ar.ImportArguments(pixel_threshold=300, **common), spark)
    assert Catalog.open(c.path).read(spark).count() == 2000
    assert {p for p in leaves if os.stat(p).st_mtime_ns != stamps[p]} == set(leaves[:2])
    pipeline(ar.ImportArguments(pixel_threshold=700, **common), spark)
    again = Catalog.open(c.path)
    assert again.pixels != c.pixels and again.read(spark).count() == 2000 and not os.path.exists(f"{c.path}/dataset/_temporary")


def test_broken_markers_and_lost_leaves(spark, tmp_path):
    from starmill.plans.resume import Stages

    (tmp_path / "b_done").write_text("")
    with pytest.raises(ValueError, match="a must be complete"):
        Stages(str(tmp_path), ("a", "b"), True)
    with pytest.raises(RuntimeError, match="1 of its keys"):
        Stages(str(tmp_path / "new"), ("a", "b"), True).complete("a", [(1, 2)])


def test_one_shuffle_of_the_rows(spark, sky):
    from starmill.plans.pipeline import _leaf_rows

    base, _ = sky
    a = ar.ImportArguments(output_path=str(base), output_artifact_name="plan", input_path=str(base / "in"), file_reader=CsvReader())
    rows, sort = _leaf_rows(a, spark, [(0, p) for p in range(12)])
    plan = layout.write_leaves(rows, str(base / "plan/dataset"), sort)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_row_groups(spark, tmp_path, monkeypatch):
    """A row group is as large as the aim, whatever the batches are; with groups it ends with them and nowhere else."""
    df = spark.range(60_000).selectExpr("id", "1 AS Norder", "0L AS Dir", "7L AS Npix", "cast(id / 25000 AS bigint) AS part")
    read = lambda d: pq.ParquetFile(f"{tmp_path}/{d}/Norder=1/Dir=0/Npix=7.parquet").metadata
    assert [tuple(r) for r in layout.write_leaves(df, str(tmp_path / "a"), ["id"]).collect()] == [(1, 7, 60_000)]
    assert read("a").num_row_groups == 1
    layout.write_leaves(df, str(tmp_path / "b"), ["id"], split_groups_by=["part"]).collect()
    assert [read("b").row_group(k).num_rows for k in range(read("b").num_row_groups)] == [25_000, 25_000, 10_000]


def test_point_map_of_any_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "MAP_BLOCK", 8)
    hist = spark.createDataFrame([(5, 2), (700, 3), (12 * 4**6 - 1, 9)], "cell bigint, n bigint")
    layout.write_point_map(str(tmp_path / "m.fits"), hist, 6)
    values, ring = layout.read_fits_map(str(tmp_path / "m.fits"))
    assert not ring and len(values) == 12 * 4**6 and {k: int(values[k]) for k in np.flatnonzero(values)} == {5: 2, 700: 3, 12 * 4**6 - 1: 9}
    assert os.path.getsize(tmp_path / "m.fits") % 2880 == 0


def test_import_by_index(spark, sky, catalog, tmp_path):
    catalog.read(spark, ["id", "_healpix_29"]).write.parquet(str(tmp_path / "in"))
    pipeline(ar.ImportArguments(output_path=str(tmp_path), output_artifact_name="i", input_path=str(tmp_path / "in"), use_healpix_29=True, constant_healpix_order=1, file_reader="parquet"), spark)
    c = Catalog.open(str(tmp_path / "i"))
    assert {o for o, _ in c.pixels} == {1} and c.read(spark).count() == 2000 and c.read(spark).columns == ["id", "Norder", "Dir", "Npix", "_healpix_29"]
    pipeline(ar.ImportArguments(output_path=str(tmp_path), output_artifact_name="j", input_path=str(tmp_path / "in"), use_healpix_29=True, add_healpix_29=False, constant_healpix_order=1, file_reader="parquet"), spark)
    j = Catalog.open(str(tmp_path / "j"))
    assert j.pixels == c.pixels and j.read(spark).count() == 2000 and j.read(spark).columns[0] == "_healpix_29"


def test_margin(spark, sky, catalog):
    base, df = sky
    pipeline(ar.MarginCacheArguments(output_path=str(base), output_artifact_name="m", input_catalog_path=catalog.path, margin_threshold=3600.0, margin_order=5 if catalog.highest_order < 5 else catalog.highest_order + 1), spark)
    got = {(r.id, r.Norder, r.Npix) for r in Catalog.open(str(base / "m")).read(spark).collect()}
    want = set()
    ra, dec = df.ra.to_numpy(), df.dec.to_numpy()
    for o, p in catalog.pixels + hp.complement(catalog.pixels):
        outside = hp.ang2pix_np(o, ra, dec) != p
        want |= {(int(i), o, p) for i in df.id[outside & (exact_distance(ra, dec, o, p) <= 1.0)]}
    assert got == want
    with pytest.raises(ValueError, match="higher order"):
        ar.MarginCacheArguments(output_path=str(base), output_artifact_name="m2", input_catalog_path=catalog.path, margin_threshold=60_000.0)
    with pytest.raises(ValueError, match="overlap"):
        catalog.overlapping([(3, 1)]) if (3, 1) not in [(o, p) for o, p in catalog.pixels] and not any(p == 1 >> 2 * (3 - o) for o, p in catalog.pixels if o <= 3) else Catalog("x", {}, [(0, 4)]).overlapping([(0, 5)])


def test_index(spark, sky, catalog):
    base, _ = sky
    for name, kw in (("ix", {}), ("iy", {"division_hints": [0, 1000, 2000, 10**6], "include_radec": True})):
        pipeline(ar.IndexArguments(output_path=str(base), output_artifact_name=name, input_catalog_path=catalog.path, indexing_column="id", **kw), spark)
        t = spark.read.parquet(f"{base}/{name}/dataset/index")
        assert t.count() == 2000 and t.columns[0] == "_healpix_29" and t.columns[-1] == "id"
        assert all(n.startswith("part.") and n.endswith(".parquet") for n in os.listdir(f"{base}/{name}/dataset/index"))
        assert pq.read_metadata(f"{base}/{name}/dataset/_metadata").num_rows == 2000
    assert {"ra", "dec"} <= set(t.columns) and read_properties(f"{base}/iy")[layout.KEYS["index_column"]] == "id"
    spans = sorted((r.lo, r.hi) for r in t.groupBy(F.input_file_name()).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and spans[0][1] < 1000 <= spans[1][0]


@pytest.fixture(scope="module")
def sources(spark, sky):
    base, _ = sky
    pipeline(ar.ImportArguments(output_path=str(base), output_artifact_name="src", input_file_list=[str(base / "sources.parquet")], catalog_type="source", highest_healpix_order=5, pixel_threshold=800), spark)
    return Catalog.open(str(base / "src"))


def test_association(spark, sky, catalog, sources):
    base, _ = sky
    common = dict(output_path=str(base), object_catalog_dir=catalog.path, object_id_column="id", source_catalog_dir=sources.path, source_object_id_column="oid")
    pipeline(ar.SoapArguments(output_artifact_name="a", **common), spark)
    info = pd.read_csv(base / "a/partition_join_info.csv")
    assert info.num_rows.sum() == 6000 and not os.path.exists(base / "a/unmatched_sources.csv")
    pipeline(ar.SoapArguments(output_artifact_name="l", write_leaf_files=True, source_id_column="sid", **common), spark)
    c = Catalog.open(str(base / "l"))
    assert c.read(spark).count() == 6000 and c.read(spark).columns[:2] == ["object_id", "source_id"]
    o, p = c.pixels[0]
    leaf = pq.ParquetFile(f"{c.path}/dataset/Norder={o}/Dir=0/Npix={p}.parquet")
    assert leaf.num_row_groups == len(info[(info.Norder == o) & (info.Npix == p)])


def test_unmatched(spark):
    from starmill.operators.association import association_counts, unmatched_sources

    obj = spark.createDataFrame([(1, 0, 3), (None, 0, 4)], "id bigint, Norder int, Npix bigint")
    src = spark.createDataFrame([(1, 1, 12)] * 5 + [(2, 1, 12)] * 3 + [(None, 1, 13)], "oid bigint, Norder int, Npix bigint")
    assert sorted((r.Npix, r.join_Npix, r.num_rows) for r in association_counts(obj, src, "id", "oid").collect()) == [(3, 12, 5), (4, 13, 1)]
    assert [(r.join_Npix, r.num_rows) for r in unmatched_sources(obj, src, "id", "oid").collect()] == [(12, 3)]


def test_unmatched_within_candidates(spark):
    """A source whose object lies in a partition that is no candidate is unmatched; nothing is lost."""
    from starmill.operators.association import association_counts, candidate_pairs, unmatched_sources

    obj = spark.createDataFrame([(1, 1, 0), (2, 1, 40), (3, 1, 1)], "id bigint, Norder int, Npix bigint")
    src = spark.createDataFrame([(1, 2, 1)] * 5 + [(2, 2, 1)] * 4 + [(3, 2, 1)] * 2 + [(None, 2, 1)], "oid bigint, Norder int, Npix bigint")
    pairs = candidate_pairs(obj, src)
    matched = {(r.Npix, r.join_Npix): r.num_rows for r in association_counts(obj, src, "id", "oid", pairs).collect()}
    lost = {r.join_Npix: r.num_rows for r in unmatched_sources(obj, src, "id", "oid", pairs).collect()}
    assert matched == {(0, 1): 5, (1, 1): 2} and lost == {1: 5} and sum(matched.values()) + sum(lost.values()) == src.count()


def test_conversion(spark, sky, catalog):
    base, df = sky
    old = base / "old"
    for o, p in catalog.pixels:
        t = pq.ParquetFile(f"{catalog.path}/dataset/Norder={o}/Dir=0/Npix={p}.parquet").read().to_pandas()
        (old / f"Norder={o}/Dir=0").mkdir(parents=True, exist_ok=True)
        t.rename(columns={"_healpix_29": layout.OLD_INDEX}).to_parquet(old / f"Norder={o}/Dir=0/Npix={p}.parquet")
    (old / "catalog_info.json").write_text(json.dumps({"catalog_name": "old", "catalog_type": "object", "total_rows": 2000, "epoch": "J2000", "ra_column": "ra", "dec_column": "dec"}))
    (old / "provenance_info.json").write_text(json.dumps({"tool_args": {"runtime_args": {"pixel_threshold": 300}}}))
    ring = np.arange(48, dtype=np.int64)
    layout.write_fits_map(str(old / "point_map.fits"), ring, 1)
    raw = (old / "point_map.fits").read_bytes()
    (old / "point_map.fits").write_bytes(raw.replace(b"'NESTED  '", b"'RING    '"))
    pipeline(ar.ConversionArguments(output_path=str(base), output_artifact_name="new", input_catalog_path=str(old)), spark)
    c = Catalog.open(str(base / "new"))
    assert c.pixels == catalog.pixels and c.read(spark).columns == ["_healpix_29", "id", "ra", "dec", "mag", "Norder", "Dir", "Npix"]
    values, is_ring = layout.read_fits_map(f"{c.path}/point_map.fits")
    assert not is_ring and (values[hp.ring_to_nested_np(1)] == ring).all() and values.dtype == ">i4"
    assert "epoch" not in c.properties and c.properties[layout.KEYS["max_rows"]] == "300"
    leaf = pq.read_schema(f"{c.path}/dataset/Norder={c.pixels[0][0]}/Dir=0/Npix={c.pixels[0][1]}.parquet")
    assert [str(leaf.field(n).type) for n in ("Norder", "Dir", "Npix")] == ["int8", "int64", "int64"]
    pipeline(ar.VerificationArguments(output_path=str(base), output_artifact_name="report", input_catalog_path=catalog.path), spark)
    assert os.path.exists(base / "report/verification.csv")


@pytest.mark.parametrize("kw, text", [
    ({"output_artifact_name": "bad name"}, "output_artifact_name may hold"), ({"run_stages": ["maping"]}, "run_stages"), ({"input_path": None}, "input_file_list"), ({"n_tasks": -1}, "n_tasks"), ({"catalog_type": "margin"}, "catalog_type"), ({"pixel_threshold": 10}, "pixel_threshold"), ({"highest_healpix_order": 30}, "highest"),
    ({"lowest_healpix_order": 8, "highest_healpix_order": 5}, "lowest"), ({"constant_healpix_order": 30}, "constant"), ({"output_path": ""}, "output_path"), ({"use_healpix_29": True, "sort_columns": "id"}, "sort columns"),
])
def test_arguments(sky, kw, text):
    base, _ = sky
    with pytest.raises(ValueError, match=text):
        ar.ImportArguments(**{"output_path": str(base), "output_artifact_name": "x", "input_path": str(base / "in"), **kw})


def test_more_arguments(sky):
    base, _ = sky
    with pytest.raises(FileNotFoundError):
        ar.ImportArguments(output_path=str(base), output_artifact_name="x", input_path=str(base / "in"), tmp_dir="/no/such/folder")
    with pytest.raises(ValueError, match="valid catalog"):
        ar.IndexArguments(output_path=str(base), output_artifact_name="x", input_catalog_path=str(base / "in"), indexing_column="id")
    with pytest.raises(ValueError, match="no columns nothing"):
        ar.IndexArguments(output_path=str(base), output_artifact_name="x", input_catalog_path=str(base / "obj"), indexing_column="nothing")
    with pytest.raises(ValueError, match="input_catalog"):
        ar.VerificationArguments(output_path=str(base), output_artifact_name="x")
    assert ar.VerificationArguments(output_path=str(base), output_artifact_name="x", input_catalog=Catalog.open(str(base / "obj"))).catalog.pixels
    assert ar.RuntimeArguments(output_path="o", output_artifact_name="x", resume_tmp="/here/").tmp_path == "/here"
    with pytest.raises(ValueError, match="unknown arguments"):
        pipeline(ar.RuntimeArguments(output_path=str(base), output_artifact_name="x"))
