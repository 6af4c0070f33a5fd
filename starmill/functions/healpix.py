"""HEALPix (nested scheme) as Catalyst column expressions and as numpy kernels.

The projection is that of Gorski et al. 2005, ApJ 622, 759.  A face is a unit square with coordinates
(x, y); a nested cell number is the face number followed by the interleaved bits of x and y.

Positions that are null or not finite have no cell: -1 in the column functions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 29
#: (shift, mask) of each step that spreads the low 32 bits of a number to the even bits.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def n_cells(order: int) -> int:
    return 12 << (2 * order)


# ---------------------------------------------------------------- columns


def ancestor(cell: Column, order: int, target: int) -> Column:
    """The cell of order ``target`` that contains ``cell`` of ``order``; null stays null."""
    return F.shiftright(cell, 2 * (order - target))


def descendant_range(cell: Column, order: Column | int, target: int = MAX_ORDER) -> tuple[Column, Column]:
    """First and one past the last cell of order ``target`` inside ``cell``."""
    if isinstance(order, int):
        size = F.lit(1 << (2 * (target - order)))
    else:
        size = F.pow(F.lit(4.0), F.lit(target) - order).cast("bigint")
    return cell * size, (cell + 1) * size


def dir_of(cell: Column) -> Column:
    """Directory that limits the fan-out of the leaf layout."""
    return (F.floor(cell / 10000) * 10000).cast("bigint")


def in_pixel(index: Column, order: int, pixel: int) -> Column:
    """Range predicate on an order-29 index, so that it reaches the parquet row groups."""
    size = 1 << (2 * (MAX_ORDER - order))
    return (index >= F.lit(pixel * size)) & (index < F.lit((pixel + 1) * size))


def has_position(ra: Column, dec: Column) -> Column:
    """True for finite coordinates with dec within -90..90; never null."""
    x, y = ra.cast("double"), dec.cast("double")
    return F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x) & y.between(-90.0, 90.0), F.lit(False))


def with_cell(df: DataFrame, ra: str, dec: str, order: int, name: str) -> DataFrame:
    """Append the nested cell of (``ra``, ``dec``) in degrees as bigint column ``name``; -1 without a position.

    Pure column arithmetic.  ``ra`` is taken modulo 360.  The steps are separate projections: inlining them
    would double the expression at each step of the bit spreading.  For the same reason the column is never null:
    a filter on it, such as a join infers for a nullable key, would be pushed through the projections and be
    inlined.  Leave rows out by has_position, not by the cell.
    """
    t = lambda s: f"__{name}_{s}"
    ns = float(1 << order)
    top = (1 << order) - 1
    df = df.withColumn(t("ok"), has_position(F.col(ra), F.col(dec)))
    ok = F.col(t("ok"))
    df = df.withColumns({
        t("tt"): F.when(ok, F.pmod(F.pmod(F.col(ra).cast("double"), F.lit(360.0)), F.lit(360.0)) / 90.0).otherwise(0.0),
        t("z"): F.when(ok, F.sin(F.radians(F.col(dec).cast("double")))).otherwise(0.0),
        t("c"): F.when(ok, F.cos(F.radians(F.col(dec).cast("double")))).otherwise(0.0),
    })
    tt, z, za = F.col(t("tt")), F.col(t("z")), F.abs(F.col(t("z")))
    ntt = F.least(F.floor(tt), F.lit(3)).cast("bigint")
    width = F.when(za > 0.99, ns * F.col(t("c")) / F.sqrt((1.0 + za) / 3.0)).otherwise(ns * F.sqrt(F.greatest(3.0 * (1.0 - za), F.lit(0.0))))
    df = df.withColumns({t("eq"): za <= 2.0 / 3.0, t("nt"): ntt, t("w"): width})
    eq, nt, w, tp = F.col(t("eq")), F.col(t("nt")), F.col(t("w")), tt - F.col(t("nt"))
    up, down = ns * (0.5 + tt) - ns * z * 0.75, ns * (0.5 + tt) + ns * z * 0.75
    df = df.withColumns({
        t("jp"): F.when(eq, F.floor(up)).otherwise(F.least(F.floor(tp * w), F.lit(top))).cast("bigint"),
        t("jm"): F.when(eq, F.floor(down)).otherwise(F.least(F.floor((1.0 - tp) * w), F.lit(top))).cast("bigint"),
    })
    jp, jm = F.col(t("jp")), F.col(t("jm"))
    fp, fm = F.shiftright(jp, order), F.shiftright(jm, order)
    low = lambda c: c.bitwiseAND(F.lit(top))
    face_eq = F.when(fp == fm, fp.bitwiseAND(F.lit(3)) + 4).when(fp < fm, fp.bitwiseAND(F.lit(3))).otherwise(fm.bitwiseAND(F.lit(3)) + 8)
    north = z >= 0
    df = df.withColumns({
        t("f"): F.when(eq, face_eq).when(north, nt).otherwise(nt + 8),
        t("x"): F.when(eq, low(jm)).when(north, top - jm).otherwise(jp),
        t("y"): F.when(eq, top - low(jp)).when(north, top - jp).otherwise(jm),
    })
    for shift, mask in _SPREAD:
        if (1 << order) > (1 << shift) or shift == 1:
            df = df.withColumns({t(a): F.col(t(a)).bitwiseOR(F.shiftleft(F.col(t(a)), shift)).bitwiseAND(F.lit(mask)) for a in "xy"})
    out = F.shiftleft(F.col(t("f")), 2 * order) + F.col(t("x")) + F.shiftleft(F.col(t("y")), 1)
    return df.withColumn(name, F.coalesce(F.when(ok, out), F.lit(-1).cast("bigint"))).drop(*[t(s) for s in ("ok", "tt", "z", "c", "eq", "nt", "w", "jp", "jm", "f", "x", "y")])


def sql_cell(table: str, ra: str, dec: str, order: int, name: str, keep: str = "*") -> str:
    """The same computation as ANSI SQL, for oracle queries: a SELECT of ``keep`` and ``name``."""
    ns, top = float(1 << order), (1 << order) - 1
    body = f"""SELECT *, ((CAST({ra} AS DOUBLE) % 360.0) + 360.0) % 360.0 / 90.0 AS q_tt, sin(radians(CAST({dec} AS DOUBLE))) AS q_z, cos(radians(CAST({dec} AS DOUBLE))) AS q_c FROM {table}"""
    body = f"""SELECT *, abs(q_z) <= 2.0 / 3.0 AS q_eq, CAST(least(floor(q_tt), 3) AS BIGINT) AS q_nt, CASE WHEN abs(q_z) > 0.99 THEN {ns} * q_c / sqrt((1.0 + abs(q_z)) / 3.0) ELSE {ns} * sqrt(greatest(3.0 * (1.0 - abs(q_z)), 0.0)) END AS q_w FROM ({body})"""
    body = f"""SELECT *, CAST(CASE WHEN q_eq THEN floor({ns} * (0.5 + q_tt) - {ns} * q_z * 0.75) ELSE least(floor((q_tt - q_nt) * q_w), {top}) END AS BIGINT) AS q_jp, CAST(CASE WHEN q_eq THEN floor({ns} * (0.5 + q_tt) + {ns} * q_z * 0.75) ELSE least(floor((1.0 - (q_tt - q_nt)) * q_w), {top}) END AS BIGINT) AS q_jm FROM ({body})"""
    body = f"""SELECT *, CASE WHEN q_eq THEN CASE WHEN (q_jp >> {order}) = (q_jm >> {order}) THEN ((q_jp >> {order}) & 3) + 4 WHEN (q_jp >> {order}) < (q_jm >> {order}) THEN (q_jp >> {order}) & 3 ELSE ((q_jm >> {order}) & 3) + 8 END WHEN q_z >= 0 THEN q_nt ELSE q_nt + 8 END AS q_f,
 CASE WHEN q_eq THEN q_jm & {top} WHEN q_z >= 0 THEN {top} - q_jm ELSE q_jp END AS q_x0, CASE WHEN q_eq THEN {top} - (q_jp & {top}) WHEN q_z >= 0 THEN {top} - q_jp ELSE q_jm END AS q_y0 FROM ({body})"""
    for k, (shift, mask) in enumerate(_SPREAD):
        body = f"SELECT *, (q_x{k} | (q_x{k} << {shift})) & {mask} AS q_x{k + 1}, (q_y{k} | (q_y{k} << {shift})) & {mask} AS q_y{k + 1} FROM ({body})"
    return f"SELECT {keep}, (q_f << {2 * order}) + q_x5 + (q_y5 << 1) AS {name} FROM ({body})"


# ---------------------------------------------------------------- numpy


def spread_np(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.int64)
    for shift, mask in _SPREAD:
        v = (v | (v << shift)) & np.int64(mask)
    return v


def squeeze_np(v: np.ndarray) -> np.ndarray:
    """Inverse of spread_np: gathers the even bits."""
    v = np.asarray(v, dtype=np.int64) & np.int64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & np.int64(mask)
    return v


def ang2pix_np(order: int, ra, dec) -> np.ndarray:
    ra, dec = np.atleast_1d(np.asarray(ra, float)), np.atleast_1d(np.asarray(dec, float))
    ns, top = 1 << order, (1 << order) - 1
    tt, rad = np.mod(np.mod(ra, 360.0), 360.0) / 90.0, np.radians(dec)
    z, za = np.sin(rad), np.abs(np.sin(rad))
    eq = za <= 2.0 / 3.0
    jp, jm = np.floor(ns * (0.5 + tt) - ns * z * 0.75).astype(np.int64), np.floor(ns * (0.5 + tt) + ns * z * 0.75).astype(np.int64)
    fp, fm = jp >> order, jm >> order
    face = np.where(fp == fm, (fp & 3) + 4, np.where(fp < fm, fp & 3, (fm & 3) + 8))
    x, y = jm & top, top - (jp & top)
    nt = np.minimum(np.floor(tt), 3).astype(np.int64)
    w = np.where(za > 0.99, ns * np.cos(rad) / np.sqrt((1.0 + za) / 3.0), ns * np.sqrt(np.maximum(3.0 * (1.0 - za), 0.0)))
    pp, pm = np.minimum(np.floor((tt - nt) * w), top).astype(np.int64), np.minimum(np.floor((1.0 - (tt - nt)) * w), top).astype(np.int64)
    north = z >= 0
    face = np.where(eq, face, np.where(north, nt, nt + 8))
    x = np.where(eq, x, np.where(north, top - pm, pp))
    y = np.where(eq, y, np.where(north, top - pp, pm))
    return (face << (2 * order)) + spread_np(x) + (spread_np(y) << 1)


def face_xy_np(order: int, cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell = np.atleast_1d(np.asarray(cell, dtype=np.int64))
    inside = cell & np.int64((1 << (2 * order)) - 1)
    return cell >> (2 * order), squeeze_np(inside), squeeze_np(inside >> 1)


def project_np(face, x, y) -> tuple[np.ndarray, np.ndarray]:
    """(ra, dec) in degrees of the point (x, y) in [0, 1] of a face.

    The face's lowest corner lies on ring ``row`` (in units of faces from the north pole) and at
    ``col`` eighths of the circle.  At the poles every right ascension is right; 0 is returned.
    """
    face = np.asarray(face)
    row = face // 4 + 2
    col = np.where(face // 4 == 1, 2 * (face % 4), 2 * (face % 4) + 1)
    r = row - x - y
    cap = np.where(r < 1, r, np.where(r > 3, 4 - r, 1.0))
    z = np.where(r < 1, 1 - cap * cap / 3, np.where(r > 3, cap * cap / 3 - 1, (2 - r) * 2 / 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.where(cap > 1e-15, 45.0 * (col * cap + x - y) / np.where(cap > 1e-15, cap, 1.0), 0.0)
    # near a pole arcsin(z) loses digits: use the distance from the pole instead
    s = cap / math.sqrt(3.0)
    dec = np.where(np.abs(z) > 0.9, np.sign(z) * (90.0 - 2 * np.degrees(np.arcsin(np.clip(s / math.sqrt(2.0), 0, 1)))), np.degrees(np.arcsin(np.clip(z, -1, 1))))
    return np.mod(phi, 360.0), dec


def boundary_np(order: int, cell, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(ra, dec) arrays of shape (n, 4 * step): points on each cell's boundary, in order round it."""
    face, ix, iy = face_xy_np(order, cell)
    s = np.arange(step) / step
    bx = np.concatenate([s, np.ones(step), 1 - s, np.zeros(step)])
    by = np.concatenate([np.zeros(step), s, np.ones(step), 1 - s])
    ns = float(1 << order)
    return project_np(face[:, None], (ix[:, None] + bx) / ns, (iy[:, None] + by) / ns)


def center_np(order: int, cell) -> tuple[np.ndarray, np.ndarray]:
    face, ix, iy = face_xy_np(order, cell)
    ns = float(1 << order)
    return project_np(face, (ix + 0.5) / ns, (iy + 0.5) / ns)


def xyz_np(ra, dec) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)


def radec_np(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.mod(np.degrees(np.arctan2(v[..., 1], v[..., 0])), 360.0), np.degrees(np.arctan2(v[..., 2], np.hypot(v[..., 0], v[..., 1])))


def ring_to_nested_np(order: int) -> np.ndarray:
    """Nested cell of each ring-ordered cell: rings from the north pole, eastwards within."""
    ns = 1 << order
    p = np.arange(n_cells(order), dtype=np.int64)
    cap = 2 * ns * (ns - 1)
    south = p >= 12 * ns * ns - cap
    q = np.where(south, 12 * ns * ns - 1 - p, p)
    ring = ((1 + np.sqrt(1 + 2.0 * q)) / 2).astype(np.int64)
    ring -= 2 * ring * (ring - 1) > q
    ring += 2 * ring * (ring + 1) <= q
    at = q - 2 * ring * (ring - 1)
    polar = q < cap
    row = (p - cap) // (4 * ns) + ns
    shift = np.where((row - ns) % 2 == 0, 0.5, 0.0)
    z = np.where(polar, 1 - ring**2 / (3.0 * ns * ns), (2.0 * ns - row) * 2 / (3.0 * ns))
    z = np.where(south & polar, -z, z)
    steps = np.where(south, 4 * ring - 1 - at, at)
    ra = np.where(polar, 90.0 * (steps + 0.5) / np.maximum(ring, 1), 90.0 * ((p - cap) % (4 * ns) + shift) / ns)
    return ang2pix_np(order, ra, np.degrees(np.arcsin(z)))


def touching_np(order: int, cell, directions: int = 16) -> np.ndarray:
    """Cells that touch each cell, its own included: array (n, 4 * directions) with repeats.

    Every neighbour shares a vertex with the cell, so the cells met on a tiny circle round each of
    the four vertices are all of them.
    """
    ra, dec = boundary_np(order, cell, 1)
    v = xyz_np(ra, dec)
    pole = np.where(np.abs(v[..., 2:3]) < 0.9, np.array([0.0, 0.0, 1.0]), np.array([1.0, 0.0, 0.0]))
    e = np.cross(pole, v)
    e /= np.linalg.norm(e, axis=-1, keepdims=True)
    n = np.cross(v, e)
    t = (np.arange(directions) + 0.5) * 2 * np.pi / directions
    size = 0.05 / (1 << order)
    around = v[..., None, :] + size * (np.cos(t)[:, None] * e[..., None, :] + np.sin(t)[:, None] * n[..., None, :])
    a, d = radec_np(around)
    return ang2pix_np(order, a.ravel(), d.ravel()).reshape(v.shape[0], -1)


def neighbours(order: int, cell: int) -> list[int]:
    """The up to eight cells that share an edge or a vertex with ``cell``, ascending."""
    return sorted(set(touching_np(order, [cell])[0].tolist()) - {int(cell)})


def margin_ring(order: int, cell: int, delta: int) -> np.ndarray:
    """Cells of order ``order + delta`` that touch ``cell`` from outside, ascending."""
    n = 1 << delta
    k = np.arange(n)
    edge = np.unique(np.concatenate([spread_np(k), spread_np(k) + (np.int64(n * n) - np.int64(1) - spread_np(np.array([n - 1]))), spread_np(k) << 1, (spread_np(k) << 1) + spread_np(np.array([n - 1]))]))
    first = np.int64(cell) << (2 * delta)
    near = np.unique(touching_np(order + delta, first + edge))
    return near[(near >> (2 * delta)) != cell]


def complement(pixels: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The coarsest cells that cover the sky outside of ``pixels``, in sky order."""
    if not pixels:
        return [(0, p) for p in range(12)]
    taken = set(pixels)
    above = {(o, p >> (2 * (order - o))) for order, p in pixels for o in range(order)}
    out, todo = [], [(0, p) for p in range(11, -1, -1)]
    while todo:
        order, p = todo.pop()
        if (order, p) in taken:
            continue
        if (order, p) in above:
            todo += [(order + 1, 4 * p + k) for k in (3, 2, 1, 0)]
        else:
            out.append((order, p))
    return out
