"""FITS binary tables, read without outside libraries (FITS standard 4.0, section 7.3)."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from starmill.sources.layout import filesystem
from starmill.sources.readers import InputReader, check_file

BLOCK, CARD = 2880, 80
#: Format letters of binary tables, as numpy type and column type.
FORMATS = {"L": ("S1", "boolean"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "A": ("S", "string"), "E": (">f4", "float"), "D": (">f8", "double")}
ROWS_A_TASK = 500_000


def _header(f) -> dict[str, object] | None:
    cards: dict[str, object] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            return cards or None
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return cards
            if card[8:10] == "= ":
                text = card[10:]
                if text.lstrip().startswith("'"):
                    m = re.match(r"\s*'((?:[^']|'')*)'", text)
                    cards[name] = m[1].replace("''", "'").rstrip() if m else ""
                else:
                    raw = text.split("/")[0].strip()
                    cards[name] = raw == "T" if raw in ("T", "F") else float(raw) if re.search(r"[.ED]", raw) else int(raw) if raw else None


@dataclass(frozen=True)
class TableInfo:
    """Where the first binary table of a file lies, and its columns as (name, numpy type, repeat, type, null)."""

    start: int
    row_bytes: int
    rows: int
    columns: tuple


def table_info(path: str) -> TableInfo:
    check_file(path)
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        while (h := _header(f)) is not None:
            size = abs(int(h.get("BITPIX", 8))) // 8 * math.prod(int(h.get(f"NAXIS{k}", 0)) for k in range(1, int(h.get("NAXIS", 0)) + 1)) if h.get("NAXIS") else 0
            size += int(h.get("PCOUNT", 0) or 0)
            if h.get("XTENSION") == "BINTABLE":
                columns = []
                for k in range(1, int(h["TFIELDS"]) + 1):
                    m = re.match(r"(\d*)([LBIJKAED])", str(h[f"TFORM{k}"]))
                    if not m:
                        raise ValueError(f"column format {h[f'TFORM{k}']} is not supported")
                    repeat = int(m[1] or 1)
                    kind, sql = FORMATS[m[2]]
                    columns.append((str(h[f"TTYPE{k}"]), f"S{repeat}" if m[2] == "A" else kind, 1 if m[2] == "A" else repeat, sql, h.get(f"TNULL{k}")))
                return TableInfo(f.tell(), int(h["NAXIS1"]), int(h["NAXIS2"]), tuple(columns))
            f.seek(math.ceil(size / BLOCK) * BLOCK, os.SEEK_CUR)
    raise ValueError(f"no binary table in {path}")


@dataclass
class FitsReader(InputReader):
    """The first binary table of each file; one task reads a slice of rows.

    column_names keeps, skip_column_names drops; read_columns goes before either. Text is decoded and stripped;
    columns of several numbers become arrays. Columns are those of any file, null where a file lacks them; a column
    of two types is an error. Paths may be of any file system.
    """

    column_names: list[str] | None = None
    skip_column_names: list[str] | None = None
    rows_a_task: int = ROWS_A_TASK

    def read(self, spark: SparkSession, paths: list[str], read_columns: list[str] | None = None) -> DataFrame:
        if self.column_names and self.skip_column_names:
            raise ValueError("column_names and skip_column_names exclude each other")
        infos = {p: table_info(p) for p in paths}
        kinds: dict[str, tuple[str, int]] = {}
        for p, info in infos.items():
            for c in info.columns:
                if kinds.setdefault(c[0], (c[3], c[2])) != (c[3], c[2]):
                    raise ValueError(f"column {c[0]} of {p} is of another type than in an earlier file")
        names = read_columns or self.column_names or [c for c in kinds if c not in (self.skip_column_names or [])]
        schema = T.StructType.fromDDL(", ".join(f"`{n}` " + (kinds[n][0] if kinds[n][1] == 1 else f"array<{kinds[n][0]}>") for n in names))
        slices = [(p, a, min(a + self.rows_a_task, i.rows)) for p, i in infos.items() for a in range(0, i.rows, self.rows_a_task)]

        def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, a, z in zip(b.path, b.a, b.z, strict=True):
                    info = infos[path]
                    dtype = np.dtype([(c[0], c[1]) if c[2] == 1 else (c[0], c[1], (c[2],)) for c in info.columns])
                    fs, q = filesystem(path)
                    with fs.open_input_file(q) as f:
                        rows = np.frombuffer(f.read_at(int(z - a) * info.row_bytes, info.start + int(a) * info.row_bytes), dtype=dtype)
                    out = {}
                    for name, kind, repeat, sql, null in info.columns:
                        if name not in names:
                            continue
                        v = rows[name]
                        if kind.startswith("S") and sql == "string":
                            out[name] = pd.Series([x.decode("utf-8", "replace").rstrip("\0 ") for x in v.tolist()], dtype=object)
                        elif sql == "boolean":
                            out[name] = pd.Series([None if x in (b"\0", b"") else x == b"T" for x in v.ravel().tolist()], dtype=object)
                        else:
                            v = v.astype(v.dtype.newbyteorder("="))
                            out[name] = pd.Series(v) if repeat == 1 else pd.Series(list(v))
                            if null is not None and repeat == 1:
                                out[name] = out[name].astype("Int64").mask(out[name] == null)
                    lacking = {n: pd.Series([None] * len(rows), dtype=object) for n in names if n not in out}
                    yield pd.DataFrame(out | lacking)[list(names)]

        if not slices:
            return spark.createDataFrame([], schema)
        plan = spark.createDataFrame(slices, "path string, a bigint, z bigint").repartition(len(slices))
        return plan.mapInPandas(load, schema)
