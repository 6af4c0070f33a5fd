"""Readers of catalog input: each turns paths into one lazy DataFrame.

A reader is a callable object with ``read(spark, paths, read_columns=None) -> DataFrame``.  User readers follow the
same protocol; a plain function does too.  Schemas are never inferred file by file: a schema file, column names,
a type map or one inference over the whole set decides.
"""

from __future__ import annotations

import ast
import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.sources.layout import filesystem, read_text

#: Type names of side files and type maps.
TYPE_NAMES = {
    "int64": "bigint", "Int64": "bigint", "int32": "int", "Int32": "int", "int16": "smallint", "Int16": "smallint", "int8": "tinyint", "Int8": "tinyint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "float64": "double", "Float64": "double", "float32": "float", "float": "double", "int": "bigint", "str": "string", "string": "string", "object": "string", "bool": "boolean", "boolean": "boolean",
}


def spark_type(name: Any) -> str:
    text = getattr(name, "__name__", None) or str(name)
    if text not in TYPE_NAMES and text not in TYPE_NAMES.values():
        raise ValueError(f"unknown type {text}")
    return TYPE_NAMES.get(text, text)


def check_file(path: str) -> None:
    """A single input file has to be a file, in whatever file system."""
    fs, p = filesystem(path)
    kind = fs.get_file_info(p).type
    if kind != pafs.FileType.File:
        raise FileNotFoundError(f"{path} is a folder where a file is needed" if kind == pafs.FileType.Directory else f"{path} is not there")


def read_index_file(path: str) -> list[str]:
    """The paths listed in a text file, one a line; blank lines are skipped.

    Relative paths that do not exist are taken from the index file's folder.
    """
    check_file(path)
    names = [line.strip() for line in (read_text(path) or "").splitlines() if line.strip()]
    here = os.path.dirname(os.path.abspath(path))
    return [n if os.path.isabs(n) or "://" in n or n.startswith("file:") or os.path.exists(n) else os.path.join(here, n) for n in names]


def find_input_paths(input_path: str | None = None, pattern: str = "**/*.*", input_file_list: list[str] | None = None) -> list[str]:
    """Sorted input files: of a folder by pattern, or as listed; exactly one of both."""
    import glob

    if (input_path is None) == (input_file_list is None):
        raise ValueError("exactly one of input_path and input_file_list is required")
    if input_file_list is not None:
        if not input_file_list:
            raise ValueError("input_file_list is empty")
        return list(input_file_list)
    if not os.path.exists(input_path):
        raise FileNotFoundError(f"input_path not found: {input_path}")
    found = sorted(p for p in glob.glob(os.path.join(input_path, pattern), recursive=True) if os.path.isfile(p))
    if not found:
        raise FileNotFoundError(f"No input files found in {input_path}")
    return found


def schema_of_file(path: str) -> T.StructType:
    """Schema of a parquet file without rows."""
    return T.StructType.fromDDL(", ".join(f"`{f.name}` {_arrow_ddl(f.type)}" for f in pq.read_schema(path) if f.name != "__index_level_0__"))


def _arrow_ddl(kind: Any) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def _narrow(df: DataFrame, read_columns: list[str] | None, keep: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """read_columns before keep before skip."""
    if read_columns:
        return df.select(*read_columns)
    if keep:
        return df.select(*keep)
    return df.drop(*skip) if skip else df


def strict(c: Column, kind: T.DataType | str, name: str) -> Column:
    """The text as a value of a type; a text that is none stops the read, with the column and the text."""
    value = c.try_cast(kind)
    wrong = F.concat(F.lit(f"column {name} holds a value that is no {kind if isinstance(kind, str) else kind.simpleString()}: "), c)
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(wrong).cast(kind)).otherwise(value)


@dataclass
class InputReader:
    """Base of readers; ``read`` gives one lazy DataFrame over all paths."""

    def read(self, spark: SparkSession, paths: list[str], read_columns: list[str] | None = None) -> DataFrame:
        raise NotImplementedError

    def provenance_info(self) -> dict[str, Any]:
        return {"input_reader_type": type(self).__name__, **{k: v for k, v in vars(self).items() if isinstance(v, str | int | float | list | dict | bool | None)}}


@dataclass
class FunctionReader(InputReader):
    """A user's function (spark, paths) -> DataFrame as a reader."""

    function: Callable[[SparkSession, list[str]], DataFrame] = None

    def read(self, spark, paths, read_columns=None):
        return _narrow(self.function(spark, paths), read_columns)


#: What a text has to look like to count as a value of a type, narrowest type first.
_FORMS = {"bigint": r"^\s*[+-]?[0-9]+\s*$", "double": r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+|inf|infinity)(e[+-]?[0-9]+)?\s*$", "boolean": r"(?i)^(true|false)$"}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "double")


def _fused_schema(text: DataFrame, given: T.StructType | None) -> T.StructType:
    """The narrowest types that hold every value of ``text`` and of a table of the schema ``given``.

    One pass over all rows. A type given is kept if all values fit it; of two types that do not fit each other the
    column becomes text. Columns without a value are of the type given, or double.
    """
    kinds = {f.name: f.dataType.simpleString() for f in given} if given is not None else {}
    sums = []
    for k, name in enumerate(text.columns):
        c = F.col(f"`{name}`")
        fits = {t: c.rlike(form) & c.try_cast(t).isNotNull() for t, form in _FORMS.items()} | {"digits": c.rlike(_FORMS["bigint"])}
        if (own := kinds.get(name)) is not None:
            # a cast may cut (a time of day to a date), so that the value has to come back as it was
            back = c.try_cast(own)
            fits["given"] = F.lit(True) if own == "string" else fits["boolean"] if own == "boolean" else c.rlike(_FORMS["bigint" if own.startswith("decimal") else "double"]) & back.isNotNull() if own in _NUMBERS or own.startswith("decimal") else back.isNotNull() & (F.length(c) >= 10) & (back.cast("timestamp") == c.try_cast("timestamp"))
        sums += [F.count(c).alias(f"{k} n")] + [F.count_if(F.coalesce(ok, F.lit(False))).alias(f"{k} {t}") for t, ok in fits.items()]
    found = text.agg(*sums).first().asDict()

    def kind(k: int, name: str) -> str:
        n, own = found[f"{k} n"], kinds.get(name)
        if own is not None and found[f"{k} given"] == n:
            return own
        best = next((t for t in _FORMS if found[f"{k} {t}"] == n), "string") if n else "double"
        if best == "double" and n and found[f"{k} digits"] == n:  # whole numbers beyond bigint would lose digits
            best = "string"
        if own is None:
            return best
        return max(best, own, key=_NUMBERS.index) if best in _NUMBERS and own in _NUMBERS else "string"

    return T.StructType([T.StructField(name, T._parse_datatype_string(kind(k, name))) for k, name in enumerate(text.columns)])


@dataclass
class CsvReader(InputReader):
    """Delimited text, plain, .gz or .zip.

    header: True (first line of each file) or False. column_names before names of the schema file; type_map
    before types of the schema file; columns of neither are inferred once over the whole set. usecols and
    read_columns narrow the result.  A value that is none of its type, a row of a wrong width and a file whose header
    differs from the first one's stop the read; options={"mode": "PERMISSIVE"} makes nulls of bad values instead.
    """

    sep: str = ","
    header: bool = True
    comment: str | None = None
    schema_file: str | None = None
    column_names: list[str] | None = None
    type_map: dict[str, Any] | None = None
    usecols: list[str] | None = None
    options: dict[str, str] = field(default_factory=dict)

    def _paths(self, paths: list[str]) -> list[str]:
        return paths

    def _header_of(self, spark: SparkSession, path: str) -> list[str]:
        """The names in the first line of a file, or of a file of a folder."""
        if path.endswith(".zip"):
            return self._zip_columns(path)
        options = {"sep": self.sep, "header": "true", "escape": '"', "quote": '"', **self.options} | ({"comment": self.comment} if self.comment else {})
        return spark.read.options(**options).csv(path).columns

    def _zip_columns(self, path: str) -> list[str]:
        fs, p = filesystem(path)
        with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
            first = pd.read_csv(z.open(z.namelist()[0]), sep=self.sep, comment=self.comment, header=0 if self.header else None, nrows=1)
        return [str(c) for c in first.columns]

    def schema(self, spark: SparkSession, paths: list[str]) -> T.StructType | None:
        """The schema to read with, or None if the types have to be inferred."""
        side = schema_of_file(self.schema_file) if self.schema_file else None
        names = self.column_names or (side.names if side is not None and not self.header else None) or (self._header_of(spark, paths[0]) if self.header and paths else None)
        types = {f.name: f.dataType.simpleString() for f in side} if side is not None else {}
        types |= {k: spark_type(v) for k, v in (self.type_map or {}).items()}
        if names is None or not types:
            return None
        return T.StructType.fromDDL(", ".join(f"`{n}` {types.get(n, 'string')}" for n in names))

    def read(self, spark, paths, read_columns=None):
        paths = self._paths(list(paths))
        zipped = [p for p in paths if p.endswith(".zip")]
        plain = [p for p in paths if not p.endswith(".zip")]
        schema = self.schema(spark, paths)
        options = {"sep": self.sep, "header": str(self.header).lower(), "enforceSchema": "false" if self.header else "true", "escape": '"', "quote": '"', "mode": "FAILFAST", **self.options}
        if self.comment:
            options["comment"] = self.comment
        reader = spark.read.options(**options)
        parts = []
        if plain:
            df = reader.schema(schema).csv(plain) if schema is not None else reader.option("inferSchema", "true").csv(plain)
            parts.append(df if not self.column_names or schema is not None else df.toDF(*self.column_names))
        if zipped:
            text = self._zip_text(spark, zipped, schema or (parts[0].schema if parts else None))
            if schema is None:
                fused = _fused_schema(text, parts[0].schema if parts else None)
                if parts and fused != parts[0].schema:
                    parts = [spark.read.options(**options).schema(fused).csv(plain)]
                schema = fused
            parts.append(text.select(*[strict(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in schema]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return _narrow(out, read_columns, self.usecols)

    def _zip_text(self, spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
        """The rows of all members as text, one archive a task."""
        sep, comment, header, names = self.sep, self.comment, self.header, self.column_names
        if schema is None:
            columns = names or self._zip_columns(paths[0])
        else:
            columns = schema.names

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for content in b.content:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            for chunk in pd.read_csv(z.open(name), sep=sep, comment=comment, header=0 if header else None, names=None if header else columns, chunksize=500_000, dtype=str, keep_default_na=True):
                                yield chunk[columns]

        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(members, text)


@dataclass
class IndexedCsvReader(CsvReader):
    """Paths are index files that list the delimited files; small files are packed into tasks by the engine."""

    def _paths(self, paths):
        return [q for p in paths for q in read_index_file(p)]


@dataclass
class ParquetReader(InputReader):
    """Parquet files of one schema or of several that merge; read_columns before column_names.

    Unsigned and decimal(20,0) pixel columns become signed.  A named index of pandas is a column like others, first in
    the table as pandas shows it; an unnamed one is dropped.  merge_schema=False takes the schema of one file for all and
    saves the look at every footer.
    """

    column_names: list[str] | None = None
    merge_schema: bool = True

    def _paths(self, paths: list[str]) -> list[str]:
        return paths

    def read(self, spark, paths, read_columns=None):
        paths = self._paths(list(paths))
        df = spark.read.options(recursiveFileLookup="true", mergeSchema=str(self.merge_schema).lower()).parquet(*paths)
        index = self._pandas_index(paths[0])
        df = df.drop("__index_level_0__")
        df = df.select(*[c for c in index if c in df.columns], *[c for c in df.columns if c not in index])
        names = {"Norder": "int", "Dir": "bigint", "Npix": "bigint"}
        df = df.withColumns({c: F.col(c).cast(t) for c, t in names.items() if c in df.columns and df.schema[c].dataType.simpleString() not in ("int", "bigint", "tinyint")})
        return _narrow(df, read_columns, self.column_names)


    def _pandas_index(self, path: str) -> list[str]:
        """Names of the index columns in the pandas metadata of a file; none for a folder."""
        fs, p = filesystem(path)
        if fs.get_file_info(p).type != pafs.FileType.File:
            return []
        with fs.open_input_file(p) as f:
            held = pq.read_schema(f).pandas_metadata or {}
        return [c for c in held.get("index_columns", []) if isinstance(c, str) and not c.startswith("__index_level_")]


@dataclass
class IndexedParquetReader(ParquetReader):
    """Paths are index files that list the parquet files."""

    def _paths(self, paths):
        return [q for p in paths for q in read_index_file(p)]


@dataclass
class EcsvReader(InputReader):
    """Enhanced CSV 1.0: a YAML header in comment lines gives names and types; arrays are JSON in text.

    Each file is read by its own header; the result has the columns of all, null where a file lacks one.  A value that is
    none of its type stops the read.  Paths may be of any file system.
    """

    def read(self, spark, paths, read_columns=None):
        groups: dict[str, list[str]] = {}
        for path in paths:
            groups.setdefault(self._head(path), []).append(path)
        parts = [self._read_alike(spark, head, alike) for head, alike in groups.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return _narrow(out, read_columns)

    def _head(self, path: str) -> str:
        """The comment lines a file begins with."""
        check_file(path)
        fs, p = filesystem(path)
        head = []
        with fs.open_input_stream(p) as raw:
            for line in io.TextIOWrapper(raw, encoding="utf-8"):
                if not line.startswith("#"):
                    break
                head.append(line[1:].removeprefix(" ").rstrip("\r\n"))
        if not head or not head[0].startswith("%ECSV"):
            raise ValueError(f"{path} has no ECSV header")
        return "\n".join(x for x in head[1:] if x != "---")

    def _read_alike(self, spark: SparkSession, head: str, paths: list[str]) -> DataFrame:
        import yaml

        # tags such as !astropy.table carry no meaning here
        loader = type("Plain", (yaml.SafeLoader,), {})
        loader.add_multi_constructor("!", lambda ld, _, node: ld.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else ld.construct_sequence(node, deep=True))
        meta = yaml.load(head, Loader=loader)  # noqa: S506
        columns = meta["datatype"]
        text = T.StructType([T.StructField(c["name"], T.StringType()) for c in columns])
        df = spark.read.options(sep=meta.get("delimiter", " "), header="true", comment="#", escape='"', quote='"', nullValue="", mode="FAILFAST").schema(text).csv(paths)
        out = []
        for c in columns:
            sub, value = c.get("subtype"), F.col(f"`{c['name']}`")
            if c["datatype"] == "string" and sub:
                out.append(F.from_json(value, f"array<{spark_type(sub.split('[')[0])}>", {"allowNonNumericNumbers": "true", "mode": "FAILFAST"}).alias(c["name"]))
            else:
                out.append(strict(value, spark_type(c["datatype"]), c["name"]).alias(c["name"]))
        return df.select(*out)


_READERS: dict[str, type[InputReader]] = {"csv": CsvReader, "ecsv": EcsvReader, "parquet": ParquetReader, "indexed_csv": IndexedCsvReader, "indexed_parquet": IndexedParquetReader}


def get_file_reader(file_format: str, **kwargs: Any) -> InputReader:
    """Reader of a format by name."""
    if file_format == "fits":
        from starmill.sources.fits import FitsReader

        return FitsReader(**kwargs)
    if file_format not in _READERS:
        raise NotImplementedError(f"there is no reader of {file_format}")
    return _READERS[file_format](**kwargs)


def literal(text: str) -> Any:
    """A Python literal or JSON value of a properties file."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text
