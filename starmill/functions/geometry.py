"""Distances to the boundary of cells, and the resolution of orders."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from starmill.functions import healpix as hp

#: Ratio of a cell's mean size to the least distance across it; an assumption, see README.
MIN_DISTANCE_RATIO = 1.6
EXACT_STEP = 16


def resolution_arcmin(order: int) -> float:
    """Mean side of a cell."""
    return math.degrees(math.sqrt(math.pi / 3) / (1 << order)) * 60


def min_distance_arcmin(order: int) -> float:
    return resolution_arcmin(order) / MIN_DISTANCE_RATIO


def margin_order_for(threshold_arcsec: float) -> int:
    """The finest order whose cells are nowhere narrower than the threshold."""
    for order in range(hp.MAX_ORDER, -1, -1):
        if min_distance_arcmin(order) * 60 >= threshold_arcsec:
            return order
    return 0


@lru_cache(maxsize=4096)
def _edge(order: int, pixel: int, step: int) -> np.ndarray:
    ra, dec = hp.boundary_np(order, [pixel], step)
    return hp.xyz_np(ra[0], dec[0])


def _arc_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between points (n, 3) and great-circle arcs a-b (m, 3): (n, m)."""
    normal = np.cross(a, b)
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    normal = normal / np.where(size > 0, size, 1)
    off = np.abs(np.arcsin(np.clip(p @ normal.T, -1, 1)))
    inside = (np.einsum("nk,mk->nm", p, np.cross(normal, a)) >= 0) & (np.einsum("nk,mk->nm", p, np.cross(b, normal)) >= 0)
    chord = lambda q: 2 * np.arcsin(np.clip(np.linalg.norm(p[:, None, :] - q[None, :, :], axis=2) / 2, 0, 1))
    return np.where(inside, off, np.minimum(chord(a), chord(b)))


def polygon_distance(ra, dec, order: int, pixel: int, step: int) -> np.ndarray:
    """Degrees to the polygon of ``step`` points an edge joined by great circles."""
    v = _edge(order, pixel, step)
    p = hp.xyz_np(ra, dec)
    out = np.empty(len(p))
    for at in range(0, len(p), 4096):
        out[at : at + 4096] = _arc_distance(p[at : at + 4096], v, np.roll(v, -1, axis=0)).min(axis=1)
    return np.degrees(out)


def exact_distances(ra: np.ndarray, dec: np.ndarray, order: np.ndarray, pixel: np.ndarray, within: float | None = None) -> np.ndarray:
    """Degrees from each point to the true boundary of a cell of its own.

    Of each edge that can hold the nearest point, the stretch round its nearest sampled point is narrowed down; an
    edge cannot if its nearest sample is farther than half a step beyond the nearest sample of all.  within: only
    whether a distance is at most so many degrees has to be right; a point whose samples tell is not looked at closer.
    """
    order, pixel = np.asarray(order, dtype=np.int64), np.asarray(pixel, dtype=np.int64)
    out = np.empty(len(order))
    for at in range(0, len(order), 4096):
        s = slice(at, at + 4096)
        out[s] = _exact_block(hp.xyz_np(ra[s], dec[s]), order[s], pixel[s], within)
    return out


def _exact_block(p: np.ndarray, order: np.ndarray, pixel: np.ndarray, within: float | None) -> np.ndarray:
    n = len(p)
    face, ix, iy, ns = np.empty(n, np.int64), np.empty(n), np.empty(n), np.ldexp(1.0, order.astype(int))
    chord, half = np.empty((n, 4 * EXACT_STEP + 1)), np.empty(n)
    for o in np.unique(order).tolist():
        rows = np.flatnonzero(order == o)
        cells, which = np.unique(pixel[rows], return_inverse=True)
        face[rows], ix[rows], iy[rows] = (x[which] for x in hp.face_xy_np(o, cells))
        v = hp.xyz_np(*hp.boundary_np(o, cells, EXACT_STEP))
        v = np.concatenate([v, v[:, :1]], axis=1)
        half[rows] = (np.linalg.norm(np.diff(v, axis=1), axis=2).max(axis=1) * 0.6)[which]
        chord[rows] = np.sqrt(np.clip(2 - 2 * np.einsum("nk,nmk->nm", p[rows], v[which]), 0, None))
    best = chord.min(axis=1)
    nearest = best.copy()
    open_ = np.ones(n, dtype=bool)
    if within is not None:
        reach = 2 * np.sin(np.radians(within) / 2)
        open_ = (nearest > reach) & (nearest - half <= reach)
    grid = np.linspace(0.0, 1.0, 9)
    for side in range(4):
        own = chord[:, side * EXACT_STEP : (side + 1) * EXACT_STEP + 1]
        rows = np.flatnonzero(open_ & (own.min(axis=1) - half <= nearest))
        if not len(rows):
            continue
        q, f, x0, y0, size = p[rows], face[rows], ix[rows], iy[rows], ns[rows]

        def at(t: np.ndarray, q=q, f=f, x0=x0, y0=y0, size=size, side=side) -> np.ndarray:
            x, y = ((t, 0 * t), (0 * t + 1, t), (1 - t, 0 * t + 1), (0 * t, 1 - t))[side]
            r, d = hp.project_np(f, (x0 + x) / size, (y0 + y) / size)
            return np.linalg.norm(q - hp.xyz_np(r, d), axis=1)

        mid, width = own[rows].argmin(axis=1) / EXACT_STEP, 2.0 / EXACT_STEP
        lo = np.clip(mid - width / 2, 0.0, 1.0 - width)
        for _ in range(9):
            d = np.stack([at(lo + g * width) for g in grid])
            best[rows] = np.minimum(best[rows], d.min(axis=0))
            mid, width = lo + width * grid[d.argmin(axis=0)], width / 4
            lo = np.clip(mid - width / 2, 0.0, 1.0 - width)
    return np.degrees(2 * np.arcsin(np.clip(best / 2, 0, 1)))


def exact_distance(ra, dec, order: int, pixel: int) -> np.ndarray:
    """Degrees to the true boundary of one cell."""
    ra, dec = np.atleast_1d(np.asarray(ra, dtype=float)), np.atleast_1d(np.asarray(dec, dtype=float))
    return exact_distances(ra, dec, np.full(len(ra), order), np.full(len(ra), pixel))


def _distances(r: pd.Series, d: pd.Series, o: pd.Series, p: pd.Series, samples: int | None, within: float | None) -> np.ndarray:
    """Arcseconds, NaN where something is null."""
    out = np.full(len(r), np.nan)
    ok = (r.notna() & d.notna() & o.notna() & p.notna()).to_numpy()
    rr, dd, oo, pp = r.to_numpy(float)[ok], d.to_numpy(float)[ok], o[ok].to_numpy(np.int64), p[ok].to_numpy(np.int64)
    if samples is None:
        out[ok] = exact_distances(rr, dd, oo, pp, None if within is None else within / 3600.0) * 3600.0
        return out
    found = np.empty(len(rr))
    for (order, pixel), rows in pd.DataFrame({"o": oo, "p": pp}).groupby(["o", "p"]).indices.items():
        found[rows] = polygon_distance(rr[rows], dd[rows], order, pixel, samples)
    out[ok] = found * 3600.0
    return out


def boundary_distance(ra: Column, dec: Column, order: Column, pixel: Column, samples: int | None = None) -> Column:
    """Arcseconds from a point to the boundary of a cell, from either side.

    samples: None for the true boundary, else a polygon of so many points an edge.  Nulls give null.
    """

    @F.pandas_udf("double")
    def distance(r: pd.Series, d: pd.Series, o: pd.Series, p: pd.Series) -> pd.Series:
        out = pd.Series(_distances(r, d, o, p, samples, None))
        return out.where(out.notna())

    return distance(ra, dec, order, pixel)


def near_boundary(ra: Column, dec: Column, order: Column, pixel: Column, arcsec: float, samples: int | None = None) -> Column:
    """Whether ``boundary_distance`` is at most ``arcsec``; false for nulls.  Most points are told by the samples alone."""

    @F.pandas_udf("boolean")
    def near(r: pd.Series, d: pd.Series, o: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(np.nan_to_num(_distances(r, d, o, p, samples, arcsec), nan=np.inf) <= arcsec)

    return near(ra, dec, order, pixel)
