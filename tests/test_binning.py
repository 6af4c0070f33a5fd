import numpy as np
import pandas as pd
import pytest

from starmill.functions import healpix as hp
from starmill.operators import binning

H = 6


def top_down(counts, order, pixel, lowest, threshold):
    cells = {c: n for c, n in counts.items() if c >> 2 * (H - order) == pixel}
    total = sum(cells.values())
    if not total:
        return []
    if order >= lowest and total <= threshold:
        return [(order, pixel, total)]
    return [] if order == H else [x for k in range(4) for x in top_down(cells, order + 1, 4 * pixel + k, lowest, threshold)]


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(0)
    ra, dec = np.concatenate([rng.uniform(0, 360, 1500), rng.normal(100, 3, 1500)]), np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, 1500))), rng.normal(20, 3, 1500)])
    cell, n = np.unique(hp.ang2pix_np(H, ra, dec), return_counts=True)
    return dict(zip(cell.tolist(), n.tolist()))


@pytest.mark.parametrize("lowest, threshold", [(0, 100), (2, 100), (0, 10_000), (1, 20)])
def test_adaptive_equals_top_down(spark, counts, lowest, threshold):
    hist = spark.createDataFrame(pd.DataFrame({"cell": list(counts), "n": list(counts.values())}))
    a = binning.align(hist, H, lowest, threshold)
    want = sorted(x for p in range(12) for x in top_down(counts, 0, p, lowest, threshold))
    assert sorted((r.Norder, r.Npix, r.n) for r in binning.partitions_of(a).collect()) == want
    for r in a.collect():
        assert r.cell >> 2 * (H - r.Norder) == r.Npix
    assert binning.overfull(hist, threshold).count() == sum(n > threshold for n in counts.values())


def test_dropping_empty_siblings_keeps_the_number(spark, counts):
    hist = spark.createDataFrame(pd.DataFrame({"cell": [5, 6, 4**H * 3 + 1, 4**H * 3 + 16], "n": [1, 2, 3, 4]}))
    a = binning.align(hist, H, 0, 100, no_empty_siblings=True)
    assert {(r.cell, r.Norder, r.Npix) for r in a.collect()} == {(5, 5, 1), (6, 5, 1), (4**H * 3 + 1, 3, 3 << 6), (4**H * 3 + 16, 3, 3 << 6)}


def test_constant_and_equal_orders(spark):
    hist = spark.createDataFrame([(7, 3), (9, 1_000_000)], "cell bigint, n bigint")
    for kw in ({"constant": True}, {"lowest": H}):
        assert sorted((r.Norder, r.Npix, r.n) for r in binning.align(hist, H, **kw).collect()) == [(H, 7, 3), (H, 9, 1_000_000)]
    assert binning.sky_fraction(spark.createDataFrame([(0, 4), (0, 11)], "Norder int, Npix bigint")).first()[0] == pytest.approx(1 / 6)


def test_histograms(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, 2.0), (float("nan"), 1.0)], "ra double, dec double")
    h = binning.histogram(df, "ra", "dec", 3)
    assert [r.n for r in h.collect()] == [2]
    assert [r.n for r in binning.merge_histograms(h, h).collect()] == [4]
    i = spark.createDataFrame([(5 << 58,), (None,), ((5 << 58) + 9,)], "_healpix_29 bigint")
    assert [tuple(r) for r in binning.histogram_of_index(i, "_healpix_29", 0).collect()] == [(5, 2)]
    assert binning.suggest_threshold(1000, 100_000, 1_000_000) == 10_000
