"""Counts per cell and the adaptive set of partitions made from them.

A histogram is a sparse table (cell, n) at one mapping order.  An alignment is a table (cell, Norder, Npix, n):
the partition each non-empty cell goes to and that partition's count.  Neither is collected.  The rows of a catalog are
aligned without a shuffle: the sorted list of partitions goes to the tasks, which look each cell up by binary search.
Up to PLACE_LIMIT partitions (17 bytes each) are sent; beyond it the rows are joined with the alignment on the cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.healpix import MAX_ORDER, ancestor, dir_of, has_position, n_cells, with_cell
from starmill.session import written

#: Most partitions whose list is sent to the tasks, some 70 MB.
PLACE_LIMIT = 4_000_000
#: The cell under which a histogram of all rows counts those without a position.
NOWHERE = -1


def histogram(df: DataFrame, ra: str, dec: str, order: int) -> DataFrame:
    """(cell, n) of the rows with a position; only the two columns are read."""
    rows = df.select(ra, dec).where(has_position(F.col(ra), F.col(dec)))
    return with_cell(rows, ra, dec, order, "cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def histogram_of_index(df: DataFrame, index: str, order: int) -> DataFrame:
    """(cell, n) of the rows with a spatial index of order 29."""
    return df.select(ancestor(F.col(index), MAX_ORDER, order).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def histogram_of_all(df: DataFrame, order: int, ra: str = "ra", dec: str = "dec", index: str | None = None) -> DataFrame:
    """(cell, n) of all rows, those without a position (or an index within the sky) under NOWHERE; one pass."""
    if index is not None:
        i = F.col(index)
        cells = df.select(F.when(i.between(0, n_cells(MAX_ORDER) - 1), ancestor(i, MAX_ORDER, order)).otherwise(NOWHERE).alias("cell"))
    else:
        cells = with_cell(df.select(ra, dec), ra, dec, order, "cell").select(F.when(has_position(F.col(ra), F.col(dec)), F.col("cell")).otherwise(NOWHERE).alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """The sum of histograms of one order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("cell").agg(F.sum("n").alias("n"))


def pixel_totals(hist: DataFrame, mapping_order: int, lowest: int) -> DataFrame:
    """(Norder, Npix, n) for every order from ``lowest`` to the mapping order: a roll-up over the ancestors."""
    up = F.explode(F.sequence(F.lit(lowest), F.lit(mapping_order))).alias("Norder")
    each = hist.select("cell", "n", up).select("Norder", F.expr(f"shiftright(cell, 2 * ({mapping_order} - Norder))").alias("Npix"), "n")
    return each.groupBy("Norder", "Npix").agg(F.sum("n").alias("n"))


def adaptive_partitions(hist: DataFrame, mapping_order: int, lowest: int, threshold: int, keep_overfull: bool = False) -> DataFrame:
    """(Norder, Npix, n): the coarsest pixels of at most ``threshold`` rows, none coarser than ``lowest``.

    A pixel is one if its total is within the threshold and its parent's is not.  A cell of the mapping order that
    alone exceeds the threshold is in none, see ``overfull``; with keep_overfull it is a partition of its own.
    """
    totals = pixel_totals(hist, mapping_order, lowest)
    parents = totals.where((F.col("n") > threshold) & (F.col("Norder") < mapping_order)).select((F.col("Norder") + 1).alias("Norder"), F.col("Npix").alias("parent"))
    fits = F.col("n") <= threshold
    fit = totals.where(fits | (F.col("Norder") == mapping_order) if keep_overfull else fits).withColumn("parent", F.shiftright("Npix", 2))
    split = fit.where(F.col("Norder") > lowest).join(parents, ["Norder", "parent"], "left_semi")
    return fit.where(F.col("Norder") == lowest).select("Norder", "Npix", "n").unionByName(split.select("Norder", "Npix", "n"))


def overfull(hist: DataFrame, threshold: int) -> DataFrame:
    """Cells above the threshold, which no partition of at most that many rows can hold; importing stops if there are any."""
    return hist.where(F.col("n") > threshold)


def align_cells(hist: DataFrame, partitions: DataFrame, mapping_order: int, lowest: int) -> DataFrame:
    """(cell, Norder, Npix, n) of each cell that lies in a partition."""
    up = F.explode(F.sequence(F.lit(lowest), F.lit(mapping_order))).alias("Norder")
    each = hist.select("cell", up).withColumn("Npix", F.expr(f"shiftright(cell, 2 * ({mapping_order} - Norder))"))
    return each.join(partitions, ["Norder", "Npix"]).select("cell", "Norder", "Npix", "n")


def drop_empty_siblings(alignment: DataFrame, mapping_order: int) -> DataFrame:
    """Move each partition down to the finest pixel that still holds all its cells; their number stays."""
    shrunk = alignment.groupBy("Norder", "Npix", "n").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    differ = F.col("lo").bitwiseXOR(F.col("hi"))
    down = F.when(differ == 0, 0).otherwise(F.floor((F.length(F.bin(differ)) + 1) / 2)).cast("int")
    moved = shrunk.select("Norder", "Npix", (F.lit(mapping_order) - down).alias("to_order"), F.expr("lo").alias("lo"), down.alias("down"))
    moved = moved.withColumn("to_pix", F.expr("shiftright(lo, 2 * down)"))
    return alignment.join(moved, ["Norder", "Npix"]).select("cell", F.col("to_order").alias("Norder"), F.col("to_pix").alias("Npix"), "n")


def align(hist: DataFrame, mapping_order: int, lowest: int = 0, threshold: int = 1_000_000, constant: bool = False, no_empty_siblings: bool = False, keep_overfull: bool = False) -> DataFrame:
    """The alignment of a histogram.

    constant: every non-empty cell is its own partition and the threshold does not matter; so it is if lowest
    and mapping order are one.  keep_overfull: a cell above the threshold is its own partition too, so that no row is
    lost; without it such cells have none, and the caller has to ask for ``overfull`` first.
    """
    if constant or lowest == mapping_order:
        return hist.select("cell", F.lit(mapping_order).alias("Norder"), F.col("cell").alias("Npix"), "n")
    out = align_cells(hist, adaptive_partitions(hist, mapping_order, lowest, threshold, keep_overfull), mapping_order, lowest)
    return drop_empty_siblings(out, mapping_order) if no_empty_siblings else out


def partitions_of(alignment: DataFrame) -> DataFrame:
    """(Norder, Npix, n), one row a partition."""
    return alignment.select("Norder", "Npix", "n").distinct()


def partition_counts(alignment: DataFrame, hist: DataFrame) -> DataFrame:
    """(Norder, Npix, n): the rows each partition of an alignment gets, counted by its cells."""
    return alignment.select("cell", "Norder", "Npix").join(hist, "cell").groupBy("Norder", "Npix").agg(F.sum("n").alias("n"))


def place_rows(df: DataFrame, partitions: list[tuple[int, int]], mapping_order: int, cell: str = "cell") -> DataFrame:
    """``df`` with Norder, Dir, Npix of the partition (order, pixel) that holds its cell, in place of any it had.

    Partitions do not overlap and are not finer than the mapping order.  Rows in none, or without a cell, are dropped.
    """
    order = np.array([o for o, _ in partitions], dtype=np.int8)
    start = np.array([p << (2 * (mapping_order - o)) for o, p in partitions], dtype=np.int64)
    at = np.argsort(start)
    shared = df.sparkSession.sparkContext.broadcast((start[at], order[at]))

    @F.pandas_udf("int")
    def order_of(cells: pd.Series) -> pd.Series:
        starts, orders = shared.value
        c = cells.fillna(NOWHERE).to_numpy(np.int64)
        if not len(starts):
            return pd.Series(np.full(len(c), -1, dtype=np.int32))
        k = np.maximum(np.searchsorted(starts, c, side="right") - 1, 0)
        down = 2 * (mapping_order - orders[k].astype(np.int64))
        return pd.Series(np.where((c >> down) == (starts[k] >> down), orders[k], -1).astype(np.int32))

    # called non-deterministic, so that no filter on it is pushed through the projections of the cell and inlined
    found = df.drop("Norder", "Dir", "Npix").withColumn("Norder", order_of.asNondeterministic()(F.col(cell))).where("Norder >= 0")
    pixel = F.expr(f"shiftright(`{cell}`, 2 * ({mapping_order} - Norder))")
    return found.withColumns({"Dir": dir_of(pixel), "Npix": pixel})


def align_rows(df: DataFrame, alignment: DataFrame, mapping_order: int, cell: str = "cell", limit: int = PLACE_LIMIT) -> DataFrame:
    """``df`` with Norder, Dir, Npix of each row's partition, in place of any it had; rows without one are dropped.

    The alignment is computed now, once; both ways give the same rows.
    """
    alignment = written(alignment, "alignment")
    parts = partitions_of(alignment)
    if parts.count() <= limit:
        return place_rows(df, [(int(r.Norder), int(r.Npix)) for r in parts.toLocalIterator()], mapping_order, cell)
    a = alignment.select(F.col("cell").alias("__aligned"), "Norder", "Npix")
    joined = df.drop("Norder", "Dir", "Npix").join(a, F.col(cell) == F.col("__aligned")).drop("__aligned", "Npix")
    return joined.withColumn("Npix", F.expr(f"shiftright(`{cell}`, 2 * ({mapping_order} - Norder))")).withColumn("Dir", dir_of(F.col("Npix")))


def sky_fraction(partitions: DataFrame) -> DataFrame:
    """One row (moc_sky_fraction): the share of the sky that the partitions cover."""
    return partitions.agg(F.sum(1.0 / (12.0 * F.pow(F.lit(4.0), F.col("Norder").cast("double")))).alias("moc_sky_fraction"))


def suggest_threshold(n_rows: int, n_bytes: int, ideal_bytes: int = 500_000_000) -> int:
    """Rows a partition so that a leaf takes about ``ideal_bytes``, judged by a sample."""
    return max(1, int(ideal_bytes / max(n_bytes, 1) * n_rows))
