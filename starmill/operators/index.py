"""Secondary index: a table sorted by a non-spatial column that tells where its rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_rows(df: DataFrame, column: str, extra: list[str] | None = None, include_healpix_29: bool = True, include_order_pixel: bool = True, drop_duplicates: bool = True) -> DataFrame:
    """(_healpix_29, extra..., Norder, Dir, Npix, column); distinct rows if asked for."""
    if not (include_healpix_29 or include_order_pixel):
        raise ValueError("one of include_healpix_29 and include_order_pixel is needed")
    names = (["_healpix_29"] if include_healpix_29 else []) + list(dict.fromkeys(extra or [])) + (["Norder", "Dir", "Npix"] if include_order_pixel else [])
    missing = [c for c in [*names, column] if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    out = df.select(*[n for n in dict.fromkeys(names) if n != column], column)
    return out.distinct() if drop_duplicates else out


def bucket_of(column: str, divisions: list) -> Column:
    """Number of the division a value falls in: divisions are the ascending lower ends after the first."""
    out = F.lit(0)
    for d in divisions[1:-1]:
        out = out + F.when(F.col(column) >= F.lit(d), 1).otherwise(0)
    return out


def index_partitions(rows: DataFrame, column: str, n_partitions: int, divisions: list | None = None) -> DataFrame:
    """Range-partitioned by ``column`` and sorted within; nulls come first.

    divisions: ends of the ranges, used if there are more than two; else the ranges are sampled by the engine, over
    the column and then the place, so that the rows of one hot value are spread over several partitions in order.
    """
    if divisions is not None and len(divisions) > 2:
        n = len(divisions) - 1
        return rows.withColumn("__bucket", bucket_of(column, divisions)).repartitionById(n, F.col("__bucket").cast("int")).drop("__bucket").sortWithinPartitions(column)
    place = [c for c in ("_healpix_29", "Norder", "Npix") if c in rows.columns and c != column]
    return rows.repartitionByRange(max(1, n_partitions), column, *place).sortWithinPartitions(column, *place)
