"""Margins: the rows that lie just outside of each partition.

A margin pair (partition_order, partition_pixel, margin_pixel) says that a cell of the margin order touches a
partition from outside.  Rows are joined to the pairs on their cell, which replicates only rows near edges, and
then filtered by their distance to the partition's boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.geometry import near_boundary
from starmill.functions.healpix import complement, dir_of, has_position, margin_ring, with_cell

#: Most margin pixels that are sent to the tasks to drop rows far from every edge, 8 bytes each.
EDGE_LIMIT = 4_000_000


def with_negatives(spark: SparkSession, partitions: DataFrame) -> DataFrame:
    """(Norder, Npix) of the partitions and of the coarsest pixels without rows, so that these get margins too.

    The partitions of one catalog are listed on the driver, as its partition_info file is.
    """
    pixels = [(int(r.Norder), int(r.Npix)) for r in partitions.select("Norder", "Npix").distinct().toLocalIterator()]
    return spark.createDataFrame(sorted(pixels) + complement(pixels), "Norder int, Npix bigint")


def margin_pairs(partitions: DataFrame, margin_order: int, ordered: bool = True) -> DataFrame:
    """The pairs of all partitions (Norder, Npix); every partition is coarser than ``margin_order``.

    ordered: by margin pixel; a sort finds its ranges by making the pairs once more, so joins do without.
    """

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for order, pixel in zip(b.Norder.tolist(), b.Npix.tolist(), strict=True):
                ring = margin_ring(order, pixel, margin_order - order)
                yield pd.DataFrame({"partition_order": order, "partition_pixel": pixel, "margin_pixel": ring}).astype({"partition_order": "int32"})

    found = partitions.select("Norder", "Npix").mapInPandas(rings, "partition_order int, partition_pixel bigint, margin_pixel bigint")
    return found.orderBy("margin_pixel", "partition_order", "partition_pixel") if ordered else found


def at_edges(cells: DataFrame, pairs: DataFrame, cell: str, limit: int = EDGE_LIMIT) -> DataFrame:
    """The rows whose cell is a margin pixel, without a shuffle: the sorted margin pixels are sent to the tasks.

    Only a filter ahead of the join: beyond ``limit`` pixels all rows stay.
    """
    edge = pairs.select("margin_pixel").where("margin_pixel IS NOT NULL").distinct()
    pixels = edge.limit(limit + 1).toArrow().column(0).to_numpy()
    if len(pixels) > limit:
        return cells
    shared = cells.sparkSession.sparkContext.broadcast(np.sort(pixels))

    @F.pandas_udf("boolean")
    def known(c: pd.Series) -> pd.Series:
        edges, c = shared.value, c.to_numpy(np.int64)
        k = np.searchsorted(edges, c)
        return pd.Series((k < len(edges)) & (edges[np.minimum(k, len(edges) - 1)] == c) if len(edges) else np.zeros(len(c), dtype=bool))

    # a non-deterministic column first: a filter on the call itself would be pushed through the projections of the cell
    return cells.withColumn("__edge", known.asNondeterministic()(F.col(cell))).where("__edge").drop("__edge")


def margin_candidates(df: DataFrame, pairs: DataFrame, ra: str, dec: str, margin_order: int) -> DataFrame:
    """Rows with each partition whose ring they lie in, as margin_target_order and margin_target_pixel.

    Pairs are made distinct first, so a row comes once a partition; rows without a position are dropped, and those
    in no margin pixel before anything is shuffled.
    """
    cells = at_edges(with_cell(df.where(has_position(F.col(ra), F.col(dec))), ra, dec, margin_order, "__cell"), pairs, "__cell")
    p = pairs.distinct().select(F.col("margin_pixel").alias("__cell"), F.col("partition_order").alias("margin_target_order"), F.col("partition_pixel").alias("margin_target_pixel"))
    return cells.join(p, "__cell").drop("__cell")


def margin_rows(df: DataFrame, pairs: DataFrame, ra: str, dec: str, margin_order: int, threshold_arcsec: float, fine: bool = True, samples: int | None = None) -> DataFrame:
    """The margin table of catalog rows that have Norder, Dir, Npix.

    Norder, Dir, Npix become the partition a row is a margin for; margin_Norder, margin_Dir, margin_Npix the one it
    lies in.  fine: only rows within the threshold of the boundary; samples see near_boundary.
    """
    found = margin_candidates(df, pairs, ra, dec, margin_order)
    if fine:
        found = found.where(near_boundary(F.col(ra), F.col(dec), F.col("margin_target_order"), F.col("margin_target_pixel"), threshold_arcsec, samples))
    found = found.withColumnsRenamed({c: f"margin_{c}" for c in ("Norder", "Dir", "Npix")})
    rest = [c for c in df.columns if c not in ("Norder", "Dir", "Npix", "_healpix_29")]
    index = ["_healpix_29"] if "_healpix_29" in df.columns else []
    return found.select(*rest, F.col("margin_target_order").cast("int").alias("Norder"), dir_of(F.col("margin_target_pixel")).alias("Dir"), F.col("margin_target_pixel").alias("Npix"), "margin_Norder", "margin_Dir", "margin_Npix", *index)
