"""Continuous counting and appending, as Structured Streaming over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starmill.functions.healpix import has_position, with_cell


def streaming_histogram(stream: DataFrame, ra: str, dec: str, order: int, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, cell, n) of a stream of positions; rows later than ``late`` are left out by the watermark."""
    rows = stream.where(has_position(F.col(ra), F.col(dec))).withWatermark(time, late)
    return with_cell(rows, ra, dec, order, "cell").groupBy(F.window(time, window), "cell").agg(F.count(F.lit(1)).alias("n"))


def append_cells(stream: DataFrame, ra: str, dec: str, order: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream with their cell to a parquet table, each micro-batch once.

    A batch is written to a folder of its own number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        with_cell(batch.where(has_position(F.col(ra), F.col(dec))), ra, dec, order, "cell").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
