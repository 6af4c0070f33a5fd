"""Records of raw delimited files in which a quoted field may hold line ends.

Where a record begins depends on all quotes before it, so a file cannot simply be cut at line ends.  Each chunk of
bytes is read by a task of its own, which gives the map from every possible state at its start to the state at its
end; the maps of a file's chunks, a few bytes each, are composed in order; then every chunk, its start state
known, emits the records that begin in it and reads on to the end of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions import tokenizer as tk
from starmill.sources.layout import filesystem

CHUNK_BYTES = 64 << 20


def _classes(sep: str) -> np.ndarray:
    c = tk.classes(sep)
    c[ord("\n")] = tk.END
    return c


def raw_records(spark: SparkSession, paths: list[str], sep: str = ",", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, at, record): each record without its line end, and the byte offset where it begins.

    A broken record ends at its line end; a quote left open takes all to the end of the file into its record, which a
    task has to hold: it is one record by the rules of quoting, however long.
    Empty files have no record; a last line end starts none.
    """
    table, cls = tk.stream_table(), _classes(sep)
    sizes = {}
    for p in paths:
        fs, q = filesystem(p)
        sizes[p] = fs.get_file_info(q).size
    plan = [(p, k, a, min(a + chunk_bytes, n)) for p, n in sizes.items() for k, a in enumerate(range(0, n, chunk_bytes))]
    schema = "path string, k int, a bigint, z bigint"
    if not plan:
        return spark.createDataFrame([], "path string, at bigint, record string")
    chunks = spark.createDataFrame(plan, schema).repartition(min(len(plan), 10_000), "path", "k")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, a, z in zip(b.path, b.a, b.z, strict=True):
                fs, q = filesystem(path)
                with fs.open_input_file(q) as f:
                    data = np.frombuffer(f.read_at(z - a, a), dtype=np.uint8)
                out.append(tk.transition_map(table, cls[data]).astype(int).tolist())
            yield b.assign(map=out)

    mapped = chunks.mapInPandas(maps, f"{schema}, map array<int>")
    # the maps of a file before each chunk, composed: as many small rows as the file has chunks
    listed = mapped.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "a", "z", "map"))).alias("c"))
    start = F.struct(F.lit(int(tk.START)).alias("state"), F.array().cast("array<int>").alias("starts"))
    states = F.aggregate("c", start, lambda acc, x: F.struct(F.get(x["map"], acc["state"]).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts")), lambda acc: acc["starts"])
    begun = listed.select("path", F.explode(F.arrays_zip(F.col("c"), states.alias("s"))).alias("e")).select("path", "e.c.a", "e.c.z", F.col("e.s").alias("state"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, a, z, state in zip(b.path, b.a, b.z, b.state, strict=True):
                yield _chunk_records(path, int(a), int(z), int(state), sizes[path], table, cls, chunk_bytes)

    return begun.repartition(min(len(plan), 10_000), "path", "a").mapInPandas(emit, "path string, at bigint, record string")


def _chunk_records(path: str, a: int, z: int, state: int, size: int, table: np.ndarray, cls: np.ndarray, more: int) -> pd.DataFrame:
    fs, q = filesystem(path)
    with fs.open_input_file(q) as f:
        data = f.read_at(z - a, a)
        before_first = a == 0 or f.read_at(1, a - 1) == b"\n"
        # a record begins after a line end that was not within quotes
        labels, end = tk.label(table, cls[np.frombuffer(data, dtype=np.uint8)], state)
        bytes_ = np.frombuffer(data, dtype=np.uint8)
        cuts = np.flatnonzero((bytes_ == 10) & (labels != tk.QUOTED))
        starts = (cuts + 1).tolist()
        if before_first and state == tk.START:
            starts.insert(0, 0)
        starts = [s for s in starts if a + s < size and s < len(data)]
        if not starts:
            return pd.DataFrame({"path": [], "at": [], "record": []}).astype({"path": str, "at": "int64", "record": str})
        ends = [*[s - 1 for s in starts[1:]]]
        # the last record may go on beyond the chunk
        tail_end = None
        if len(cuts) and cuts[-1] >= starts[-1]:
            tail_end = int(cuts[-1])
        at, step, blocks = z, 1 << 16, [data]
        while tail_end is None and at < size:
            block = f.read_at(min(step, size - at), at)
            labels, end = tk.label(table, cls[np.frombuffer(block, dtype=np.uint8)], end)
            hit = np.flatnonzero((np.frombuffer(block, dtype=np.uint8) == 10) & (labels != tk.QUOTED))
            if len(hit):
                tail_end = at - a + int(hit[0])
            blocks.append(block)
            at, step = at + len(block), min(step * 2, more)
        data = b"".join(blocks)
        ends.append(len(data) if tail_end is None else tail_end)
    return pd.DataFrame({"path": path, "at": [a + s for s in starts], "record": [data[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends, strict=True)]})
