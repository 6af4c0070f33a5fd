"""The catalog on disk: one sorted parquet file a partition, and the files that describe them.

    <catalog>/properties, partition_info.csv
    <catalog>/dataset/Norder=k/Dir=d/Npix=n.parquet, _metadata, _common_metadata

Rows come to the sink partitioned by pixel and sorted; a task writes pixel after pixel, row group by row group, each
to a temporary name that is renamed when complete, so a lost or repeated task leaves no half file and a leaf that is
there is whole.  What comes back from the tasks is one row a file.
"""

from __future__ import annotations

import csv
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.healpix import ring_to_nested_np

PIXEL = ("Norder", "Dir", "Npix")
UNSIGNED = {"Norder": pa.uint8(), "Dir": pa.uint64(), "Npix": pa.uint64(), "margin_Norder": pa.uint8(), "margin_Dir": pa.uint64(), "margin_Npix": pa.uint64(), "join_Norder": pa.uint8(), "join_Dir": pa.uint64(), "join_Npix": pa.uint64()}
SIGNED = {"Norder": pa.int8(), "Dir": pa.int64(), "Npix": pa.int64()}


#: Keys of the properties file, and the index column of the older layout.
KEYS = {
    "builder": "hats_builder", "creation_date": "hats_creation_date", "estsize": "hats_estsize", "release_date": "hats_release_date", "version": "hats_version", "nrows": "hats_nrows", "col_ra": "hats_col_ra", "col_dec": "hats_col_dec",
    "cols_sort": "hats_cols_sort", "max_rows": "hats_max_rows", "order": "hats_order", "primary_table_url": "hats_primary_table_url", "margin_threshold": "hats_margin_threshold", "index_column": "hats_index_column",
    "index_extra_column": "hats_index_extra_column", "col_assn_primary": "hats_col_assn_primary", "col_assn_primary_assn": "hats_col_assn_primary_assn", "assn_join_table_url": "hats_assn_join_table_url",
    "col_assn_join": "hats_col_assn_join", "col_assn_join_assn": "hats_col_assn_join_assn", "assn_leaf_files": "hats_assn_leaf_files",
}
OLD_INDEX = "_hipscat_index"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_text(path: str) -> str | None:
    fs, p = filesystem(path)
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(p) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    fs, p = filesystem(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(text.encode())


def remove(path: str) -> None:
    fs, p = filesystem(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def leaf_path(base: str, order: int, pixel: int) -> str:
    return f"{base}/Norder={order}/Dir={pixel // 10000 * 10000}/Npix={pixel}.parquet"


#: Bytes of rows (in memory) after which a leaf starts a new row group.
ROW_GROUP_BYTES = 128 << 20


def _runs(table: pa.Table, names: list[str]) -> list[tuple[int, int]]:
    """Spans of rows in which ``names``, whole numbers without nulls, do not change."""
    new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for name in names:
        values = table[name].to_numpy()
        new |= values[1:] != values[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
    return list(zip(cuts, cuts[1:], strict=False))


class _File:
    """A parquet file in the making: rows are held back until a row group is full or its key changes."""

    def __init__(self, fs: pafs.FileSystem, base: str, final: str, schema: pa.Schema, aim: int | None):
        self.fs, self.final, self.aim = fs, final, aim
        self.temporary = f"{base}/_temporary/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/_temporary", recursive=True)
        fs.create_dir(final.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(self.temporary)
        self.writer = pq.ParquetWriter(self.out, schema)
        self.held: list[pa.Table] = []
        self.bytes = self.rows = 0
        self.group: tuple | None = None

    def add(self, piece: pa.Table, group: tuple | None = None) -> None:
        if group != self.group:
            self.flush()
            self.group = group
        self.held.append(piece)
        self.bytes += piece.nbytes
        self.rows += piece.num_rows
        if self.aim is not None and self.bytes >= self.aim:
            self.flush()

    def flush(self) -> None:
        if self.held:
            whole = pa.concat_tables(self.held)
            self.writer.write_table(whole, row_group_size=whole.num_rows)
        self.held, self.bytes = [], 0

    def close(self) -> int:
        self.flush()
        self.writer.close()
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.rows


def _stored(batch: pa.RecordBatch, types: dict[str, pa.DataType]) -> pa.Table:
    table = pa.Table.from_batches([batch])
    return table.cast(pa.schema([pa.field(f.name, types.get(f.name, f.type)) for f in table.schema]))


def write_leaves(df: DataFrame, dataset: str, sort: list[str | Column], types: dict[str, pa.DataType] | None = None, split_groups_by: list[str] | None = None, n_tasks: int = 0) -> DataFrame:
    """Write rows with Norder, Dir, Npix; (Norder, Npix, n_rows) of the files, when the result is run.

    sort: columns or expressions within a file, nulls last. types: storage types of columns, unsigned pixels by default.
    A row group ends after ROW_GROUP_BYTES, or, with split_groups_by, where one of these whole numbers changes and
    nowhere else. n_tasks: tasks of the shuffle, 0 as the session says. Running the result twice writes the same files.
    """
    types = UNSIGNED if types is None else types
    by = split_groups_by or []
    placed = (df.repartition(n_tasks, "Norder", "Npix") if n_tasks else df.repartition("Norder", "Npix")).sortWithinPartitions("Norder", "Npix", *[F.asc_nulls_last(c) for c in sort])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(dataset)
        done: list[tuple[int, int, int]] = []
        current, leaf = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _stored(batch, types)
            for a, z in _runs(table, ["Norder", "Npix", *by]):
                piece = table.slice(a, z - a)
                pixel = (int(piece["Norder"][0].as_py()), int(piece["Npix"][0].as_py()))
                if pixel != current:
                    if leaf is not None:
                        done.append((*current, leaf.close()))
                    current, leaf = pixel, _File(fs, base, leaf_path(base, *pixel), table.schema, None if by else ROW_GROUP_BYTES)
                leaf.add(piece, tuple(piece[c][0].as_py() for c in by))
        if leaf is not None:
            done.append((*current, leaf.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["Norder", "Npix", "n_rows"])

    return placed.mapInArrow(run, "Norder int, Npix bigint, n_rows bigint")


def write_parts(df: DataFrame, dataset: str, folder: str, types: dict[str, pa.DataType] | None = None) -> DataFrame:
    """Write each partition of ``df`` as <dataset>/<folder>/part.<number>.parquet; (part, n_rows), when the result is run.

    Partitions without rows write no file.
    """
    types = UNSIGNED if types is None else types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = filesystem(dataset)
        number, part = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows:
                table = _stored(batch, types)
                part = part or _File(fs, base, f"{base}/{folder}/part.{number}.parquet", table.schema, ROW_GROUP_BYTES)
                part.add(table)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part.close()], pa.int64())], names=["part", "n_rows"])

    return df.mapInArrow(run, "part int, n_rows bigint")


def footers(spark: SparkSession, dataset: str, files: list[str]) -> DataFrame:
    """(at, n_rows, footer) of each file below ``dataset``, read by tasks; files that are not there are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(dataset)
        for batch in batches:
            out = []
            for at, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{file}").type != pafs.FileType.File:
                    continue
                with fs.open_input_file(f"{base}/{file}") as f:
                    footer = pq.read_metadata(f)
                footer.set_file_path(file)
                held = pa.BufferOutputStream()
                footer.write_metadata_file(held)
                out.append((at, footer.num_rows, held.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["at", "n_rows", "footer"])

    plan = spark.createDataFrame(list(enumerate(files)), "at bigint, file string")
    return plan.repartition(max(1, min(len(files) // 64, 10_000)), "at").mapInArrow(read, "at bigint, n_rows bigint, footer binary")


def write_metadata(spark: SparkSession, dataset: str, files: list[str]) -> int:
    """_metadata and _common_metadata of files (paths below ``dataset``, in this order); the rows they hold.

    Tasks read the footers; the driver joins them one by one to the file it writes.  Without files nothing is written.
    """
    remove(f"{dataset}/_temporary")
    whole, rows = None, 0
    for r in footers(spark, dataset, files).orderBy("at").toLocalIterator() if files else ():
        footer = pq.read_metadata(pa.BufferReader(r.footer))
        rows += footer.num_rows
        if whole is None:
            whole = footer
        else:
            whole.append_row_groups(footer)
    if whole is not None:
        fs, base = filesystem(dataset)
        with fs.open_output_stream(f"{base}/_metadata") as f:
            whole.write_metadata_file(f)
        with fs.open_output_stream(f"{base}/_common_metadata") as f:
            pq.write_metadata(whole.schema.to_arrow_schema(), f)
    return rows


def stored_schema(df: DataFrame, types: dict[str, pa.DataType] | None = None) -> pa.Schema:
    """The schema rows of ``df`` have in a leaf."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = UNSIGNED if types is None else types
    return pa.schema([pa.field(f.name, types.get(f.name, f.type)) for f in to_arrow_schema(df.schema)])


def write_schema(dataset: str, schema: pa.Schema) -> None:
    """_metadata and _common_metadata of a dataset without rows."""
    fs, base = filesystem(dataset)
    fs.create_dir(base, recursive=True)
    for name in ("_metadata", "_common_metadata"):
        with fs.open_output_stream(f"{base}/{name}") as f:
            pq.write_metadata(schema, f)


def leaf_names(pixels: list[tuple[int, int]]) -> list[str]:
    """Leaf paths below the dataset, in sky order."""
    ordered = sorted(pixels, key=lambda p: (p[1] << (2 * (29 - p[0])), p[0]))
    return [leaf_path("", o, p).lstrip("/") for o, p in ordered]


def write_csv(path: str, names: list[str], rows: list[tuple]) -> None:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(names)
    w.writerows(rows)
    write_text(path, out.getvalue())


def write_properties(path: str, values: dict[str, object], note: str = "catalog") -> None:
    """``key=value`` lines, keys by their short names of KEYS or in full; colons of values are escaped."""
    lines = [f"#{note}"]
    for k, v in ((KEYS.get(k, k), v) for k, v in values.items()):
        if v is None:
            continue
        text = " ".join(map(str, v)) if isinstance(v, list | tuple) else str(v)
        lines.append(f"{k}={text.replace(':', chr(92) + ':')}")
    write_text(f"{path}/properties", "\n".join(lines) + "\n")


def read_properties(path: str) -> dict[str, str] | None:
    text = read_text(f"{path}/properties")
    if text is None:
        return None
    return {k.strip(): v.strip().replace("\\:", ":") for k, _, v in (line.partition("=") for line in text.splitlines() if line.strip() and not line.startswith("#"))}


@dataclass
class Catalog:
    """An opened catalog: its path, properties and partitions [(order, pixel), ...]."""

    path: str
    properties: dict[str, str]
    pixels: list[tuple[int, int]]

    @classmethod
    def open(cls, path: str) -> Catalog:
        """Needs properties, and partition_info.csv or _metadata."""
        properties = read_properties(path)
        info = read_text(f"{path}/partition_info.csv")
        if properties is None:
            raise ValueError(f"{path} is not a valid catalog: it has no properties")
        if info is not None:
            pixels = [(int(r["Norder"]), int(r["Npix"])) for r in csv.DictReader(io.StringIO(info))]
        else:
            fs, p = filesystem(f"{path}/dataset/_metadata")
            if fs.get_file_info(p).type != pafs.FileType.File:
                raise ValueError(f"{path} is not a valid catalog: it has no partition_info.csv and no _metadata")
            with fs.open_input_file(p) as f:
                m = pq.read_metadata(f)
            paths = {m.row_group(k).column(0).file_path for k in range(m.num_row_groups)}
            pixels = [(int(x.split("Norder=")[1].split("/")[0]), int(x.split("Npix=")[1].split(".")[0])) for x in paths]
        return cls(path, properties, sorted(set(pixels)))

    @property
    def highest_order(self) -> int:
        return max((o for o, _ in self.pixels), default=0)

    def overlapping(self, wanted: list[tuple[int, int]]) -> Catalog:
        """Only the partitions that overlap the given pixels, at any order; none is an error."""
        span = lambda o, p: (p << (2 * (29 - o)), (p + 1) << (2 * (29 - o)))
        spans = [span(*w) for w in wanted]
        kept = [x for x in self.pixels if any(a < span(*x)[1] and span(*x)[0] < b for a, b in spans)]
        if not kept:
            raise ValueError("the pixel list does not overlap the catalog")
        return Catalog(self.path, self.properties, kept)

    def read(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        """The leaves of the partitions; pixel columns are signed numbers."""
        paths = [f"{self.path}/dataset/{leaf}" for leaf in leaf_names(self.pixels)]
        # the paths are leaves of one layout: what the folders say is in the files too
        df = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
        kinds = {"Norder": "int", "Dir": "bigint", "Npix": "bigint"}
        df = df.withColumns({p + c: F.col(p + c).cast(t) for p in ("", "margin_", "join_") for c, t in kinds.items() if p + c in df.columns})
        return df.select(*columns) if columns else df

    def column_names(self) -> list[str] | None:
        """Names of the columns of the leaves; None if there is neither _common_metadata nor _metadata."""
        for name in ("_common_metadata", "_metadata"):
            fs, p = filesystem(f"{self.path}/dataset/{name}")
            if fs.get_file_info(p).type == pafs.FileType.File:
                with fs.open_input_file(p) as f:
                    return pq.read_schema(f).names
        return None

    def partitions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pixels, "Norder int, Npix bigint")


def sky_fraction(pixels: list[tuple[int, int]]) -> float:
    return sum(1 / (12 * 4**o) for o, _ in pixels)


def _fits_header(n: int, size: int, order: int) -> bytes:
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    cards = [card("SIMPLE", "T"), card("BITPIX", 8 * size), card("NAXIS", 1), card("NAXIS1", n), card("PIXTYPE", "'HEALPIX '"), card("ORDERING", "'NESTED  '"), card("COORDSYS", "'CEL     '"), card("NSIDE", 1 << order), "END".ljust(80)]
    head = "".join(cards)
    return head.ljust(-(-len(head) // 2880) * 2880).encode()


def write_fits_map(path: str, data: np.ndarray, order: int) -> None:
    """Values of all cells in nested order as a FITS image, in celestial coordinates."""
    body = data.astype(data.dtype.newbyteorder(">")).tobytes()
    fs, p = filesystem(path)
    with fs.open_output_stream(p) as f:
        f.write(_fits_header(len(data), data.dtype.itemsize, order) + body + b"\0" * (-len(body) % 2880))


#: Cells of a point map that one task lays out, as a power of two.
MAP_BLOCK = 18


def write_point_map(path: str, hist: DataFrame, order: int) -> None:
    """The histogram (cell, n) as a map of 64-bit counts, of any order.

    Tasks lay out blocks of cells; the driver writes one block after the other and never holds the map.
    """
    n = 12 << (2 * order)
    size = min(n, 1 << MAP_BLOCK)

    def dense(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(size, dtype=">i8")
        np.add.at(data, pdf.cell.to_numpy(np.int64) % size, pdf.n.to_numpy(np.int64))
        return pd.DataFrame({"block": [key[0]], "data": [data.tobytes()]})

    blocks = hist.where(F.col("cell").between(0, n - 1)).groupBy(F.floor(F.col("cell") / size).cast("bigint").alias("block")).applyInPandas(dense, "block bigint, data binary").orderBy("block")
    fs, p = filesystem(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    empty, at = bytes(8 * size), 0
    with fs.open_output_stream(p) as f:
        f.write(_fits_header(n, 8, order))
        for r in blocks.toLocalIterator():
            for _ in range(at, r.block):
                f.write(empty)
            f.write(bytes(r.data))
            at = r.block + 1
        for _ in range(at, n // size):
            f.write(empty)
        f.write(b"\0" * (-8 * n % 2880))


def read_fits_map(path: str) -> tuple[np.ndarray, bool] | None:
    """Values of a FITS image of all cells, and whether they are in ring order; None if there is no such file."""
    fs, p = filesystem(path)
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(p) as f:
        raw = f.read()
    header: dict[str, str] = {}
    for k in range(0, len(raw), 80):
        text = raw[k : k + 80].decode("ascii", "replace")
        if text[:8].strip() == "END":
            start = -(-(k + 80) // 2880) * 2880
            break
        header[text[:8].strip()] = text[10:].split("/")[0].strip().strip("'").strip()
    kind = {"8": "u1", "16": ">i2", "32": ">i4", "64": ">i8", "-32": ">f4", "-64": ">f8"}[header["BITPIX"]]
    n = int(header["NAXIS1"]) * int(header.get("NAXIS2", 1))
    return np.frombuffer(raw, dtype=kind, count=n, offset=start), header.get("ORDERING", "").upper() == "RING"


def convert_point_map(source: str, target: str) -> bool:
    """A map of the older layout in nested order as 32-bit counts; False if there is none."""
    found = read_fits_map(source)
    if found is None:
        return False
    values, ring = found
    order = round(math.log2(len(values) / 12) / 2)
    data = np.zeros(len(values), dtype=np.int32)
    data[ring_to_nested_np(order) if ring else np.arange(len(values))] = values.astype(np.int32)
    write_fits_map(target, data, order)
    return True
