import numpy as np
import pandas as pd
import pytest

from starmill.functions import healpix as hp
from starmill.functions.rtree import RTree
from starmill.operators.proximity import QuadTree, cell_boxes, clean_positions, distance_deg, near, search_boxes


def brute(ra, dec, keys, radius):
    out = set()
    for i in range(len(ra)):
        d = distance_deg(ra[i], dec[i], ra, dec)
        out |= {(int(keys[i]), int(keys[j])) for j in np.flatnonzero(d <= radius) if keys[i] < keys[j]}
    return out


def test_rtree_equals_all_pairs():
    rng = np.random.default_rng(0)
    a, b = (np.column_stack([c, c + rng.uniform(0, 0.1, c.shape)])[:, [0, 1, 2, 3]] for c in (rng.uniform(0, 1, (700, 2)), rng.uniform(0, 1, (50, 2))))
    got = {(i, j) for w, n in RTree(a).probe(b) for i, j in zip(w.tolist(), n.tolist())}
    want = {(i, j) for i in range(50) for j in range(700) if a[j, 0] <= b[i, 2] and a[j, 2] >= b[i, 0] and a[j, 1] <= b[i, 3] and a[j, 3] >= b[i, 1]}
    assert got == want
    assert list(RTree(np.empty((0, 4))).probe(b)) == []


def test_boxes_hold_their_cells():
    rng = np.random.default_rng(3)
    ra, dec = rng.uniform(0, 360, 200_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 200_000)))
    ra, dec = np.concatenate([ra, [0, 10, 359.999]]), np.concatenate([dec, [90, 89.9999, -89.9999]])
    for order in (0, 3, 7):
        cell = hp.ang2pix_np(order, ra, dec)
        who, box = cell_boxes(order, cell)
        ok = np.zeros(len(ra), bool)
        inside = (box[:, 0] <= ra[who]) & (ra[who] <= box[:, 2]) & (box[:, 1] <= dec[who]) & (dec[who] <= box[:, 3])
        ok[who[inside]] = True
        assert ok.all()


def test_quadtree_covers_and_separates():
    rng = np.random.default_rng(4)
    tree = QuadTree.build(rng.uniform(0, 360, 5000), rng.uniform(-90, 90, 5000), 50, 12)
    box = tree.boxes()
    ra, dec = rng.uniform(0, 360, 1000), rng.uniform(-90, 90, 1000)
    leaf = tree.leaf(ra, dec)
    assert ((box[leaf, 0] <= ra) & (ra <= box[leaf, 2]) & (box[leaf, 1] <= dec) & (dec <= box[leaf, 3])).all()


@pytest.mark.parametrize("leaf_points", [16, 20_000])
def test_pairs_across_edges_poles_and_ra_zero(spark, leaf_points):
    rng = np.random.default_rng(5)
    n = 1200
    ra = np.concatenate([rng.uniform(0, 360, n), rng.normal(0, 0.02, n) % 360, rng.uniform(0, 360, n), np.full(30, 77.0)])
    dec = np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.normal(0, 0.02, n), 90 - np.abs(rng.normal(0, 0.01, n)), np.full(30, -3.0)])
    keys = rng.permutation(len(ra)) + 1
    radius = 20.0
    df = spark.createDataFrame(pd.DataFrame({"key": keys, "ra": ra, "dec": dec}))
    cells = hp.ang2pix_np(7, ra, dec)
    known = np.unique(cells)[::2]
    regions = spark.createDataFrame(pd.DataFrame({"margin_pixel": [*known.tolist(), *known.tolist(), -5, 1 << 40]}))
    rows = near(df, radius, regions, 7, leaf_points=leaf_points).collect()
    pairs = [(r.key_a, r.key_b) for r in rows if r.kind == "pair"]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(ra, dec, keys, radius / 3600)
    margins = [(r.key_a, r.key_b) for r in rows if r.kind == "margin"]
    assert len(margins) == len(set(margins)) and set(margins) == {(int(k), int(c)) for k, c in zip(keys, cells) if c in set(known.tolist())}


def test_dirty_rows_and_empty_tables(spark):
    rows = [(1, 10.0, 0.0, "x"), (1, 370.0, 0.0, "y"), (2, 10.0, 0.0001, None), (3, float("nan"), 0.0, "x"), (4, 10.0, None, "x"), (5, 10.0, 91.0, "x"), (6, 725.0, 0.0, "x"), (None, 10.0, 0.0, "x"), (7, -360.0, 0.0, "x")]
    df = spark.createDataFrame(rows, "id bigint, ra double, dec double, key string")
    points = clean_positions(df)
    assert sorted(tuple(r) for r in points.collect()) == [(1, 10.0, 0.0), (2, 10.0, 0.0001), (7, 0.0, 0.0)]
    regions = spark.createDataFrame([(None,)], "margin_pixel bigint")
    assert [tuple(r) for r in near(points, 2.0, regions).collect()] == [("pair", 1, 2)]
    assert near(points.where("false"), 2.0, regions).collect() == []


def test_search_boxes_at_the_pole():
    who, box = search_boxes(np.array([5.0, 5.0]), np.array([90.0, 0.0]), 0.1)
    assert (box[who == 0][0, [0, 2]] == [0, 360]).all() and len(who) == 2


def test_crowded_places_come_block_by_block(spark):
    """Blocks of probes shrink where each finds many; a dense leaf splits down to two radii."""
    tree = RTree(np.tile([[1.0, 1.0, 1.0, 1.0]], (3000, 1)))
    sizes = [len(i) for i, _ in tree.probe(np.tile([[1.0, 1.0, 1.0, 1.0]], (500, 1)), aim=30_000)]
    assert sum(sizes) == 3000 * 500 and max(sizes[1:]) <= 30_000
    rng = np.random.default_rng(8)
    n = 1500
    ra, dec = 10 + rng.uniform(0, 0.5, n), rng.uniform(0, 0.5, n)
    df = spark.createDataFrame(pd.DataFrame({"key": np.arange(n), "ra": ra, "dec": dec}))
    rows = near(df, 120.0, leaf_points=20).collect()
    pairs = [(r.key_a, r.key_b) for r in rows]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(ra, dec, np.arange(n), 120.0 / 3600)
