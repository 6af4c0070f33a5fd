import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starmill.functions import geometry
from starmill.functions import healpix as hp
from starmill.operators import binning
from starmill.queries import catalog, pipelines

HOT = 311


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """One id with more rows in one cell of the mapping order than a partition may hold."""
    d = str(tmp_path_factory.mktemp("crowded"))
    ids = [HOT, 1, 2, 3]
    pd.DataFrame({"id": ids, "ra": [45.0, 45.1, 200.0, 310.0], "dec": [10.0, 10.1, -40.0, 70.0], "ra_error": 5, "dec_error": 7}).to_parquet(f"{d}/sky_catalog.parquet")
    cells = catalog._object_cells(spark, d).select("id", "cell").toPandas().set_index("id").cell
    rows = [(HOT, "g")] * (10 * catalog.THRESHOLD + 1) + [(k, "r") for k in ids]
    sources = pd.DataFrame(rows, columns=["id", "band"])
    sources["_healpix_29"] = sources.id.map(cells).astype("int64") * 4 ** (29 - catalog.ORDER)
    sources.to_parquet(f"{d}/spatial_index.parquet")
    return d, int(cells[HOT]), len(sources)


def test_a_cell_above_the_threshold_keeps_its_rows(spark, crowded):
    d, cell, n = crowded
    for query in (catalog.association_counts, catalog.association_near_counts):
        counts = query(spark, d).collect()
        assert sum(r.num_rows for r in counts) == n
        assert [r.num_rows for r in counts if (r.join_Norder, r.join_Npix) == (catalog.ORDER, cell)] == [n - 3]
    assert sum(r.num_rows for r in catalog.association_partition_totals(spark, d).collect()) == n
    assert {r.source_id for r in catalog.association_leaf(spark, d).collect()} == {HOT, 1, 2, 3}
    assert {(r.id, r.band) for r in catalog.index_distinct(spark, d).collect()} == {(HOT, "g"), (HOT, "r"), (1, "r"), (2, "r"), (3, "r")}
    assert [(r.n_rows, r.lo, r.hi) for r in catalog.index_range_buckets(spark, d).collect()] == [(4, 1, HOT)]


def test_pipelines_take_a_cell_above_the_threshold(spark, crowded, monkeypatch):
    d, _, n = crowded
    monkeypatch.setattr(pipelines, "THRESHOLD", catalog.THRESHOLD)
    assert {r.id for r in pipelines.index_pipeline(spark, d).collect()} == {HOT, 1, 2, 3}
    assert sum(r.num_rows for r in pipelines.association_pipeline(spark, d).collect()) == n


def test_unmatched_sources_of_a_cell_above_the_threshold_count(spark, crowded, tmp_path):
    d, cell, n = crowded
    pd.read_parquet(f"{d}/spatial_index.parquet").to_parquet(tmp_path / "spatial_index.parquet")
    pd.read_parquet(f"{d}/sky_catalog.parquet").query(f"id != {HOT}").to_parquet(tmp_path / "sky_catalog.parquet")
    lost = catalog.association_unmatched(spark, str(tmp_path)).collect()
    assert [(r.join_Norder, r.join_Npix, r.num_rows) for r in lost] == [(catalog.ORDER, cell, n - 3)]


def test_overfull_cells_are_partitions_only_if_asked_for(spark):
    hist = spark.createDataFrame([(0, 50), (1, 5), (2, 3), (500, 1)], "cell bigint, n bigint")
    found = lambda **kw: sorted(tuple(r) for r in binning.align(hist, 4, 0, 10, **kw).collect())
    assert found() == [(1, 4, 1, 5), (2, 4, 2, 3), (500, 0, 1, 1)]
    assert found(keep_overfull=True) == [(0, 4, 0, 50), (1, 4, 1, 5), (2, 4, 2, 3), (500, 0, 1, 1)]
    assert found(keep_overfull=True, no_empty_siblings=True) == [(0, 4, 0, 50), (1, 4, 1, 5), (2, 4, 2, 3), (500, 4, 500, 1)]


def test_margins_of_partitions_of_the_mapping_order(spark, tmp_path):
    """Each of them gets the rows within the margin of its boundary, and so does the empty sky, but no other pixel."""
    rng = np.random.default_rng(1)
    n = 2 * catalog.THRESHOLD
    ra, dec = 45.0 + rng.uniform(-0.05, 0.05, n), 10.0 + rng.uniform(-0.05, 0.05, n)
    pd.DataFrame({"id": range(n), "ra": ra, "dec": dec}).to_parquet(tmp_path / "sky_catalog.parquet")
    d = str(tmp_path)
    placed = catalog._objects_placed(spark, d).drop("cell").cache()
    parts = {(r.Norder, r.Npix) for r in placed.select("Norder", "Npix").distinct().collect()}
    dense = sorted(p for o, p in parts if o == catalog.ORDER)
    assert placed.count() == n and dense
    got = catalog.margin_fine(spark, d).select("id", "Norder", "Npix").collect()
    assert len(got) == len(set(got))
    assert {(r.Norder, r.Npix) for r in got} <= parts | set(hp.complement(sorted(parts)))
    targets = spark.createDataFrame([(catalog.ORDER, p) for p in dense], "o int, p bigint")
    away = (F.col("Norder") != F.col("o")) | (F.col("Npix") != F.col("p"))
    near = geometry.boundary_distance(F.col("ra"), F.col("dec"), F.col("o"), F.col("p")) <= catalog.MARGIN_ARCSEC / 10
    want = placed.crossJoin(targets).where(away).where(near).select("id", "o", "p").collect()
    assert want and {tuple(r) for r in got if r.Norder == catalog.ORDER and r.Npix in dense} == {tuple(r) for r in want}
