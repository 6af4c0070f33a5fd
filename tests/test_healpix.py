import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.functions import healpix as hp
from starmill.functions.geometry import exact_distance, margin_order_for, polygon_distance

FOURTEEN = [(0, 4), (1, 47), *[(2, p) for p in range(176, 188)]]


@pytest.mark.parametrize("order", [0, 1, 5, 12, 20, 29])
def test_center_lies_in_its_cell(order):
    rng = np.random.default_rng(order)
    cells = rng.integers(0, hp.n_cells(order), 5000)
    ra, dec = hp.center_np(order, cells)
    assert (hp.ang2pix_np(order, ra, dec) == cells).all()


def test_column_equals_numpy_and_bad_positions_have_none(spark):
    rng = np.random.default_rng(1)
    ra, dec = rng.uniform(-360, 720, 3000), np.degrees(np.arcsin(rng.uniform(-1, 1, 3000)))
    rows = [(float(a), float(d)) for a, d in zip(ra, dec)] + [(0.0, 90.0), (0.0, -90.0), (360.0, 0.0), (-0.0, 0.0)]
    bad = [(None, 1.0), (1.0, None), (float("nan"), 0.0), (float("inf"), 0.0), (1.0, 91.0), (1.0, float("nan"))]
    df = spark.createDataFrame(rows + bad, "ra double, dec double")
    got = [r.c for r in hp.with_cell(df, "ra", "dec", 11, "c").select("c").collect()]
    assert got[: len(rows)] == hp.ang2pix_np(11, [r[0] for r in rows], [r[1] for r in rows]).tolist()
    assert got[len(rows) :] == [-1] * len(bad)


def test_filter_on_the_cell_is_not_inlined(spark):
    df = hp.with_cell(spark.createDataFrame([(1.0, 2.0)], "ra double, dec double"), "ra", "dec", 8, "c")
    joined = df.join(spark.createDataFrame([(5,)], "c bigint"), "c")
    assert len(joined._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_ring_counts_of_the_fourteen_pixels():
    assert sum(len(hp.margin_ring(o, p, 3 - o)) for o, p in FOURTEEN) == 196
    negative = hp.complement(FOURTEEN)
    assert negative == [(0, p) for p in range(12) if p not in (4, 11)]
    assert sum(len(hp.margin_ring(o, p, 3 - o)) for o, p in FOURTEEN + negative) == 536


def test_neighbours_are_mutual():
    for cell in range(hp.n_cells(2)):
        assert all(cell in hp.neighbours(2, n) for n in hp.neighbours(2, cell))
        assert len(hp.neighbours(2, cell)) in (7, 8)


def test_ranges_and_ancestors(spark):
    df = spark.createDataFrame([(2, 7)], "o int, p bigint")
    lo, hi = hp.descendant_range(F.col("p"), F.col("o"), 4)
    assert tuple(df.select(lo, hi).first()) == (7 * 16, 8 * 16)
    assert df.select(hp.ancestor(F.lit(7 * 16 + 3), 4, 2)).first()[0] == 7


def test_distances():
    ra, dec = hp.boundary_np(1, [17], 8)
    assert exact_distance(ra[0], dec[0], 1, 17).max() < 1e-6
    assert polygon_distance(ra[0], dec[0], 1, 17, 8).max() < 1e-6
    # cell 0 of order 2 touches no pole; a point on the equator line between two faces
    inside_ra, inside_dec = hp.center_np(1, [17])
    assert exact_distance(inside_ra, inside_dec, 1, 17)[0] == pytest.approx(polygon_distance(inside_ra, inside_dec, 1, 17, 64)[0], abs=1e-3)
    # at the equator a degree apart: 360 arcsec reach 0.1 degree, at 89.9 degrees of dec all of the circle
    near = exact_distance(np.arange(360.0), np.zeros(360), 1, 0)
    assert (near >= 0).all()
    assert margin_order_for(5.0) == 14


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_ring_order_goes_from_north_to_south_and_east(order):
    nested = hp.ring_to_nested_np(order)
    assert sorted(nested.tolist()) == list(range(hp.n_cells(order)))
    ra, dec = hp.center_np(order, nested)
    z = np.round(np.sin(np.radians(dec)), 9)
    assert (np.diff(z) <= 0).all() and (np.diff(ra)[np.diff(z) == 0] > 0).all()
