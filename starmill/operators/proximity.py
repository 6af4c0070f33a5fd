"""Points near other points, and the region that contains a point, on the sphere.

Plan: a bounded sample of the positions gives a quadtree over the (ra, dec) plane, whose leaves hold
about as many points each; every point goes to the leaf it lies in and, as a replica, to the leaves that
its search box reaches; each leaf bulk-loads an R-tree and probes it with its own points; candidates are
refined with the exact distance; a pair is emitted only in the leaf that holds its reference point (the
point with the smaller id), so no pair comes twice and no distinct is needed.  Regions (nested cells) go to
every leaf their box overlaps and are refined by the exact cell of the point.

Only the sample and the leaf table (some 10 bytes a leaf) reach the driver; both are bounded by
``sample_limit``.  The sample only places the cuts: all rows are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions import healpix as hp
from starmill.functions.rtree import RTree
from starmill.session import written

ROOT = 360.0  # side of the quadtree's root; its upper half in dec is empty
MAX_DEPTH = 20


class QuadTree:
    """Leaves as sorted starts of Morton intervals at ``MAX_DEPTH``; they cover the whole root."""

    def __init__(self, starts: np.ndarray):
        self.starts = starts

    @classmethod
    def build(cls, ra: np.ndarray, dec: np.ndarray, per_leaf: int, max_depth: int) -> QuadTree:
        codes = np.sort(cls.code(ra, dec))
        starts, todo = [], [(0, 0)]
        while todo:
            start, depth = todo.pop()
            size = 1 << (2 * (MAX_DEPTH - depth))
            lo, hi = np.searchsorted(codes, [start, start + size])
            if hi - lo <= per_leaf or depth >= max_depth:
                starts.append(start)
            else:
                todo += [(start + k * (size >> 2), depth + 1) for k in range(4)]
        return cls(np.sort(np.array(starts, dtype=np.int64)))

    @staticmethod
    def code(ra, dec) -> np.ndarray:
        top = (1 << MAX_DEPTH) - 1
        scale = (1 << MAX_DEPTH) / ROOT
        x = np.clip(np.floor(np.asarray(ra) * scale), 0, top).astype(np.int64)
        y = np.clip(np.floor((np.asarray(dec) + 90.0) * scale), 0, top).astype(np.int64)
        return hp.spread_np(x) + (hp.spread_np(y) << 1)

    def leaf(self, ra, dec) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(ra, dec), side="right") - 1

    def boxes(self) -> np.ndarray:
        size = np.diff(np.append(self.starts, np.int64(1) << (2 * MAX_DEPTH)))
        side = np.sqrt(size.astype(float)) * ROOT / (1 << MAX_DEPTH)
        x, y = hp.squeeze_np(self.starts) * ROOT / (1 << MAX_DEPTH), hp.squeeze_np(self.starts >> 1) * ROOT / (1 << MAX_DEPTH) - 90.0
        return np.column_stack([x, y, x + side, y + side])


def search_boxes(ra: np.ndarray, dec: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes in (ra, dec) that hold the disc of ``radius`` degrees round each point: (point numbers, boxes).

    A box across ra 0 or 360 becomes two; a disc that holds a pole takes all right ascensions.
    """
    slack = radius * (1 + 1e-9) + 1e-12
    near_pole = np.abs(dec) + slack >= 90.0
    with np.errstate(invalid="ignore", divide="ignore"):
        half = np.degrees(np.arcsin(np.clip(np.sin(np.radians(slack)) / np.cos(np.radians(dec)), 0, 1))) * (1 + 1e-9)
    x0, x1 = np.where(near_pole, 0.0, ra - half), np.where(near_pole, 360.0, ra + half)
    box = np.column_stack([np.maximum(x0, 0), np.maximum(dec - slack, -90), np.minimum(x1, 360.0), np.minimum(dec + slack, 90)])
    who = np.arange(len(ra))
    left, right = np.flatnonzero(x0 < 0), np.flatnonzero(x1 > 360.0)
    wrapped = [box]
    for at, lo, hi in ((left, x0[left] + 360.0, np.full(len(left), 360.0)), (right, np.zeros(len(right)), x1[right] - 360.0)):
        b = box[at].copy()
        b[:, 0], b[:, 2] = lo, hi
        wrapped.append(b)
    return np.concatenate([who, left, right]), np.concatenate(wrapped)


def cell_boxes(order: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes in (ra, dec) that hold each nested cell, with slack: (cell numbers, boxes)."""
    ra, dec = hp.boundary_np(order, cell, 4)
    mid, _ = hp.center_np(order, cell)
    off = np.mod(ra - mid[:, None] + 180.0, 360.0) - 180.0
    polar = np.abs(dec).max(axis=1) > 90.0 - 1e-9
    off = np.where(np.abs(dec) > 90.0 - 1e-9, 0.0, off)
    slack_x, slack_y = 0.2 * (off.max(axis=1) - off.min(axis=1)) + 1e-9, 0.2 * (dec.max(axis=1) - dec.min(axis=1)) + 1e-9
    x0, x1 = np.where(polar, 0.0, mid + off.min(axis=1) - slack_x), np.where(polar, 360.0, mid + off.max(axis=1) + slack_x)
    y0, y1 = np.maximum(dec.min(axis=1) - slack_y, -90), np.minimum(dec.max(axis=1) + slack_y, 90)
    who = np.arange(len(cell))
    left, right = np.flatnonzero(x0 < 0), np.flatnonzero(x1 > 360.0)
    box = np.column_stack([np.maximum(x0, 0), y0, np.minimum(x1, 360.0), y1])
    parts = [box]
    for at, lo, hi in ((left, x0[left] + 360.0, np.full(len(left), 360.0)), (right, np.zeros(len(right)), x1[right] - 360.0)):
        b = box[at].copy()
        b[:, 0], b[:, 2] = lo, hi
        parts.append(b)
    return np.concatenate([who, left, right]), np.concatenate(parts)


def distance_deg(ra_a, dec_a, ra_b, dec_b) -> np.ndarray:
    """Great-circle distance by the haversine formula, exact for small angles."""
    a, b = np.radians(dec_a), np.radians(dec_b)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(ra_a - ra_b) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


def clean_positions(df: DataFrame, key: str = "id", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """One row (key, ra, dec) for each key with a position; ``ra`` modulo 360.

    A row has a position if ra and dec are finite, dec is within -90..90 and ra within -360..720 (720
    excluded).  Of several positions of a key the smallest is taken.  Null keys are dropped.
    """
    x, y = F.col(ra).cast("double"), F.col(dec).cast("double")
    ok = F.col(key).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (x >= -360.0) & (x < 720.0) & (y >= -90.0) & (y <= 90.0)
    at = F.pmod(x, F.lit(360.0))
    return (
        df.where(ok).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(F.when(at >= 360.0, 0.0).otherwise(at).alias("ra"), y.alias("dec"))).alias("p"))
        .select("key", "p.ra", "p.dec")
    )


def near(points: DataFrame, radius_arcsec: float, regions: DataFrame | None = None, region_order: int = 7, sample_limit: int = 200_000, leaf_points: int = 20_000) -> DataFrame:
    """Pairs of points within a distance, and the region of each point.

    points: (key bigint, ra double in [0, 360), dec double), one row a key, no nulls, see clean_positions.
    regions: one column of nested cells of ``region_order``; repeated, null and impossible cells count not.
    Returns (kind string, key_a bigint, key_b bigint): ``pair`` with key_a < key_b at most
    ``radius_arcsec`` apart, ``margin`` with the point's key and the cell that contains it.
    Empty inputs give no rows; points at one place are all paired with each other, so n points within two radii give
    some n ** 2 rows, block by block, from the tasks of their leaves.

    sample_limit bounds the rows taken to the driver to place the cuts; leaf_points is the aim of points a leaf.
    """
    spark = points.sparkSession
    radius = radius_arcsec / 3600.0
    points = written(points.select("key", "ra", "dec"), "points")  # it is read for the count, the sample and the join
    total = points.count()
    aim = int(min(leaf_points, max(512, total / (4 * spark.sparkContext.defaultParallelism))))
    buckets = max(1, math.ceil(total / sample_limit))
    sample = points.where(F.pmod(F.xxhash64("key"), F.lit(buckets)) == 0).select("ra", "dec").toPandas()
    # a leaf is at least two radii wide, so a point's box reaches into three others at most
    deepest = max(0, min(MAX_DEPTH, int(math.log2(ROOT / max(2 * radius, ROOT / (1 << MAX_DEPTH))))))
    tree = QuadTree.build(sample.ra.to_numpy(float), sample.dec.to_numpy(float), max(16, aim // buckets), deepest)
    starts = tree.starts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quad = QuadTree(starts)
        index = RTree(quad.boxes())
        for b in batches:
            ra, dec, key = b.ra.to_numpy(float), b.dec.to_numpy(float), b.key.to_numpy(np.int64)
            home = quad.leaf(ra, dec)
            who, box = search_boxes(ra, dec, radius)
            # almost all boxes lie in their point's own leaf: only the others are looked up
            a, c = quad.leaf(box[:, 0], box[:, 1]), quad.leaf(box[:, 2], box[:, 3])
            out = np.flatnonzero((a != home[who]) | (c != home[who]) | (who != np.arange(len(who))))
            pairs = [np.column_stack([who[out][i], leaf]) for i, leaf in index.probe(box[out])]
            far = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            far = far[home[far[:, 0]] != far[:, 1]]
            yield pd.DataFrame({"leaf": home, "kind": np.int8(0), "key": key, "ra": ra, "dec": dec})
            yield pd.DataFrame({"leaf": far[:, 1], "kind": np.int8(1), "key": key[far[:, 0]], "ra": ra[far[:, 0]], "dec": dec[far[:, 0]]})

    def place_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RTree(QuadTree(starts).boxes())
        for b in batches:
            cell = b.cell.to_numpy(np.int64)
            who, box = cell_boxes(region_order, cell)
            for i, leaf in index.probe(box):
                hit = np.unique(np.column_stack([who[i], leaf]), axis=0)
                yield pd.DataFrame({"leaf": hit[:, 1], "kind": np.int8(2), "key": cell[hit[:, 0]], "ra": 0.0, "dec": 0.0})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the points of a leaf are held, what they give is handed on block by block
        yield from probe_leaf(pd.concat(list(batches), ignore_index=True), radius, region_order)

    schema = "leaf bigint, kind tinyint, key bigint, ra double, dec double"
    placed = points.mapInPandas(place, schema)
    if regions is not None:
        cell = F.col(regions.columns[0]).cast("bigint").alias("cell")
        cells = regions.select(cell).where(F.col("cell").between(0, hp.n_cells(region_order) - 1)).distinct()
        placed = placed.unionByName(cells.mapInPandas(place_regions, schema))
    return placed.groupBy("leaf").applyInPandas(join, "kind string, key_a bigint, key_b bigint")


def probe_leaf(pdf: pd.DataFrame, radius: float, region_order: int) -> Iterator[pd.DataFrame]:
    """Results whose reference point lies in this leaf."""
    columns = ["kind", "key_a", "key_b"]
    kind = pdf.kind.to_numpy()
    points, cells = pdf[kind < 2], pdf.key.to_numpy(np.int64)[kind == 2]
    key, ra, dec, home = points.key.to_numpy(np.int64), points.ra.to_numpy(float), points.dec.to_numpy(float), points.kind.to_numpy() == 0
    mine = np.flatnonzero(home)
    yield pd.DataFrame({"kind": pd.Series([], dtype=str), "key_a": np.empty(0, np.int64), "key_b": np.empty(0, np.int64)})
    if not len(mine):
        return
    if len(key) > 1:
        tree = RTree(np.column_stack([ra, dec, ra, dec]))
        who, box = search_boxes(ra[mine], dec[mine], radius)
        for i, j in tree.probe(box):
            a = mine[who[i]]
            keep = key[a] < key[j]
            a, j = a[keep], j[keep]
            keep = distance_deg(ra[a], dec[a], ra[j], dec[j]) <= radius
            # a box split at ra 0 may show a pair twice only if both halves touch the point
            found = np.unique(np.column_stack([key[a[keep]], key[j[keep]]]), axis=0)
            yield pd.DataFrame({"kind": "pair", "key_a": found[:, 0], "key_b": found[:, 1]}, columns=columns)
    if len(cells):
        who, box = cell_boxes(region_order, cells)
        tree = RTree(box)
        at = hp.ang2pix_np(region_order, ra[mine], dec[mine])
        for i, j in tree.probe(np.column_stack([ra[mine], dec[mine], ra[mine], dec[mine]])):
            cell = cells[who[j]]
            keep = at[i] == cell
            found = np.unique(np.column_stack([key[mine[i[keep]]], cell[keep]]), axis=0)
            yield pd.DataFrame({"kind": "margin", "key_a": found[:, 0], "key_b": found[:, 1]}, columns=columns)
