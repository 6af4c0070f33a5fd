"""Association of sources with objects: which object partition holds the matches of which source partition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.healpix import MAX_ORDER, descendant_range, dir_of, neighbours


def overlapping_partitions(a: DataFrame, b: DataFrame, prefix: str = "join_") -> DataFrame:
    """(Norder, Npix, join_Norder, join_Npix) of partitions of ``a`` and ``b`` (Norder, Npix) that overlap.

    Of two cells one holds the other or they are apart; so each is joined to the other side by equality, on the
    ancestors of the finer one.
    """
    up = lambda df: df.select("Norder", "Npix", F.explode(F.sequence(F.lit(0), F.col("Norder"))).alias("o")).withColumn("p", F.expr("shiftright(Npix, 2 * (Norder - o))"))
    a, b = a.select("Norder", "Npix").distinct(), b.select("Norder", "Npix").distinct()
    bb = b.select(F.col("Norder").alias(f"{prefix}Norder"), F.col("Npix").alias(f"{prefix}Npix"))
    within = up(a).join(bb, (F.col("o") == F.col(f"{prefix}Norder")) & (F.col("p") == F.col(f"{prefix}Npix"))).drop("o", "p")
    inside = up(b).where("o < Norder").select(F.col("Norder").alias(f"{prefix}Norder"), F.col("Npix").alias(f"{prefix}Npix"), "o", "p")
    around = a.join(inside, (F.col("Norder") == F.col("o")) & (F.col("Npix") == F.col("p"))).drop("o", "p")
    return within.unionByName(around)


def candidate_pairs(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Partition pairs that may hold matches: overlapping, or the object partition covers a neighbour of the source pixel."""

    def ring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, p, o, q) for o, p in zip(b.Norder.tolist(), b.Npix.tolist(), strict=True) for q in neighbours(o, p)]
            yield pd.DataFrame(rows, columns=["join_Norder", "join_Npix", "Norder", "Npix"]).astype({"join_Norder": "int32", "Norder": "int32", "join_Npix": "int64", "Npix": "int64"})

    around = sources.select("Norder", "Npix").distinct().mapInPandas(ring, "join_Norder int, join_Npix bigint, Norder int, Npix bigint")
    held = overlapping_partitions(around.select("Norder", "Npix"), objects, "o_")
    beside = around.join(held, ["Norder", "Npix"]).select(F.col("o_Norder").alias("Norder"), F.col("o_Npix").alias("Npix"), "join_Norder", "join_Npix")
    return overlapping_partitions(objects, sources).unionByName(beside).distinct()


PAIR = ["Norder", "Npix", "join_Norder", "join_Npix"]


def association_counts(objects: DataFrame, sources: DataFrame, object_id: str, source_object_id: str, pairs: DataFrame | None = None) -> DataFrame:
    """(Norder, Dir, Npix, join_Norder, join_Dir, join_Npix, num_rows) of the pairs with matches.

    Sources are counted by (id, partition) before the join, so an id that holds a third of all sources is one row
    a partition.  Null ids match null ids, NaN matches NaN.  pairs: only these partition pairs count.
    """
    src = sources.groupBy(F.col(source_object_id).alias("__sid"), F.col("Norder").alias("join_Norder"), F.col("Npix").alias("join_Npix")).agg(F.count(F.lit(1)).alias("m"))
    obj = objects.groupBy(F.col(object_id).alias("__oid"), "Norder", "Npix").agg(F.count(F.lit(1)).alias("k"))
    joined = src.join(obj, F.col("__sid").eqNullSafe(F.col("__oid")))
    counts = joined.groupBy(*PAIR).agg(F.sum(F.col("m") * F.col("k")).alias("num_rows"))
    if pairs is not None:
        counts = counts.join(pairs, PAIR, "left_semi")
    return counts.select("Norder", dir_of(F.col("Npix")).alias("Dir"), "Npix", "join_Norder", dir_of(F.col("join_Npix")).alias("join_Dir"), "join_Npix", "num_rows")


def unmatched_sources(objects: DataFrame, sources: DataFrame, object_id: str, source_object_id: str, pairs: DataFrame | None = None) -> DataFrame:
    """(join_Norder, join_Dir, join_Npix, num_rows): sources without an object, by source partition.

    pairs: only objects in these partition pairs count, as in association_counts, so that a source whose object lies in
    a partition too far away is unmatched.  Distinct (id, partition) are compared, so no hot id is shuffled.
    """
    src = sources.groupBy(F.col(source_object_id).alias("__sid"), F.col("Norder").alias("join_Norder"), F.col("Npix").alias("join_Npix")).agg(F.count(F.lit(1)).alias("m"))
    if pairs is None:
        obj = objects.select(F.col(object_id).alias("__oid")).distinct()
        lost = src.join(obj, F.col("__sid").eqNullSafe(F.col("__oid")), "left_anti")
    else:
        obj = objects.select(F.col(object_id).alias("__oid"), "Norder", "Npix").distinct()
        near = src.drop("m").join(obj, F.col("__sid").eqNullSafe(F.col("__oid"))).join(pairs, PAIR, "left_semi")
        found = near.select("__oid", F.col("join_Norder").alias("__o"), F.col("join_Npix").alias("__p")).distinct()
        lost = src.join(found, F.col("__sid").eqNullSafe(F.col("__oid")) & (F.col("join_Norder") == F.col("__o")) & (F.col("join_Npix") == F.col("__p")), "left_anti")
    return lost.groupBy("join_Norder", dir_of(F.col("join_Npix")).alias("join_Dir"), "join_Npix").agg(F.sum("m").alias("num_rows"))


def association_leaf(objects: DataFrame, sources: DataFrame, object_id: str, source_object_id: str, source_id: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(object_id, source_id, Norder, Dir, Npix, join_Norder, join_Dir, join_Npix), distinct rows.

    source_id: the join key itself if none is given.  Each side is made distinct on what is kept of it before
    the join.
    """
    src = sources.select(F.col(source_object_id).alias("__sid"), F.col(source_id or source_object_id).alias("source_id"), F.col("Norder").alias("join_Norder"), F.col("Npix").alias("join_Npix")).distinct()
    obj = objects.select(F.col(object_id).alias("object_id"), "Norder", "Npix").distinct()
    joined = src.join(obj, F.col("__sid").eqNullSafe(F.col("object_id")))
    if pairs is not None:
        joined = joined.join(pairs, PAIR, "left_semi")
    return joined.select("object_id", "source_id", "Norder", dir_of(F.col("Npix")).alias("Dir"), "Npix", "join_Norder", dir_of(F.col("join_Npix")).alias("join_Dir"), "join_Npix").distinct()


def partition_totals(counts: DataFrame) -> DataFrame:
    """Matches by object partition."""
    return counts.where((F.col("Norder") != -1) & (F.col("num_rows") > 0)).groupBy("Norder", "Dir", "Npix").agg(F.sum("num_rows").alias("num_rows"))


def combine_counts(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial counts as (join info, unmatched, totals): Norder -1 marks unmatched sources; zero rows are dropped."""
    matched = parts.where((F.col("Norder") != -1) & (F.col("num_rows") > 0))
    return matched, parts.where((F.col("Norder") == -1) & (F.col("num_rows") > 0)), partition_totals(parts)


def in_sky_order(df: DataFrame, order: str = "Norder", pixel: str = "Npix") -> DataFrame:
    """Sorted along the sky across orders, coarser first."""
    return df.orderBy(descendant_range(F.col(pixel), F.col(order), MAX_ORDER)[0], order)
