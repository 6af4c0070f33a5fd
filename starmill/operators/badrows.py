"""Rows that fail to parse: typed rows on one side, reason and offset on the other.

``tokenize_lines`` runs the finite-state tokenizer over Arrow batches of raw lines: one pass, no shuffle.
Checks of the fields' values are column expressions.  A bad row has its reason and the byte offset in the
record where the tokenizer broke (quoting) or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions.tokenizer import tokenize
from starmill.functions.values import bigint_of, double_of, trimmed


def tokenize_lines(df: DataFrame, line: str, sep: str, dialect: str = "csv") -> DataFrame:
    """Append ``fields`` array<string>, ``broken_at`` bigint (null if sound) to the rows of ``df``.

    Null lines give null fields; an empty line has one empty field.  In dialect ``csv`` blanks round fields
    are cut and quotes are taken off; in ``parity`` fields stay as they are.  Columns of ``df`` pass
    unchanged, whatever their types; fields, broken_at must not be among them.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("broken_at", T.LongType())])
    at = df.columns.index(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
            data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
            first, starts, ends, error, _ = tokenize(data, offsets, sep, dialect)
            base = np.repeat(offsets[:-1], np.diff(first))
            whole = data.tobytes()
            words = [whole[a:b] for a, b in zip((base + starts).tolist(), (base + ends).tolist(), strict=True)]
            if dialect == "csv":
                words = [w.strip(b" \t") if b'"' not in w else unquoted(w) for w in words]
            fields = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words, pa.binary()).cast(pa.string()))
            fields = pa.array(fields.to_pylist(), pa.list_(pa.string()), mask=batch.column(at).is_null().to_numpy(zero_copy_only=False)) if batch.column(at).null_count else fields
            yield pa.RecordBatch.from_arrays([*batch.columns, fields, pa.array(error, pa.int64(), mask=error < 0)], names=[*batch.schema.names, "fields", "broken_at"])

    return df.mapInArrow(run, schema)


def unquoted(w: bytes) -> bytes:
    w = w.strip(b" \t")
    return w[1:-1].replace(b'""', b'"') if w[:1] == b'"' and w[-1:] == b'"' and len(w) > 1 else w


def split_bad(df: DataFrame, width: int, checks: Column) -> DataFrame:
    """Append ``reason``: the first that holds of quoting, column_count, invalid_value, else null.

    df has fields and broken_at; ``checks`` is true where a value is invalid.
    """
    reason = F.when(F.col("broken_at").isNotNull(), "quoting").when(F.size("fields") != width, "column_count").when(F.coalesce(checks, F.lit(True)), "invalid_value")
    return df.withColumn("reason", reason)


# ---------------------------------------------------------------- the two formats

GAIA = ("solution_id", "designation", "ra", "dec", "phot_g_mean_flux", "phot_bp_mean_flux", "phot_rp_mean_flux", "libname_gspphot")


def parse_gaia(df: DataFrame) -> DataFrame:
    """(file_no, line_no, reason, broken_at, and the eight typed fields) of comma separated lines ``c0``.

    Comment, blank, header and null lines are no data and give no row.  Of a bad row the typed fields are null.
    Columns of ``df`` other than file_no, line_no, c0 are dropped.
    """
    line = F.regexp_replace(F.regexp_replace("c0", "^\\uFEFF", ""), "\\r$", "")
    lines = df.select("file_no", "line_no", line.alias("line"))
    lead = F.regexp_replace("line", "^[ \\t\\x0B\\f\\r\\n]+", "")
    lines = lines.where(F.col("line").isNotNull() & (lead != "") & ~lead.startswith("#") & (F.col("line") != ",".join(GAIA)))
    t = tokenize_lines(lines, "line", ",")
    f = lambda k: F.get("fields", F.lit(k))
    t = t.withColumns({"v0": bigint_of(f(0)), "v1": f(1), **{f"v{k}": double_of(f(k)) for k in (2, 3, 4, 5, 6)}, "v7": f(7)})
    bad = F.col("v0").isNull() | (trimmed(F.col("v1")) == "") | ~((F.col("v2") >= 0.0) & (F.col("v2") < 360.0)) | F.col("v2").isNull() | ~F.col("v3").between(-90.0, 90.0) | F.col("v3").isNull()
    for k in (4, 5, 6):
        bad = bad | ((f(k) != "") & F.col(f"v{k}").isNull())
    out = split_bad(t, len(GAIA), bad)
    good = F.col("reason").isNull()
    return out.select("file_no", "line_no", "reason", "broken_at", *[F.when(good, F.col(f"v{k}")).alias(name) for k, name in enumerate(GAIA)])


def parse_pipe(df: DataFrame) -> DataFrame:
    """(file_no, line_no, reason, broken_at, letters, ints, empty, numeric) of the rows cut at bars in c0..c4.

    The raw record is put together again up to its first missing field, and tokenized.
    """
    line = F.concat_ws("|", "c0", "c1", "c2", "c3", "c4")
    t = tokenize_lines(df.select("file_no", "line_no", line.alias("line")), "line", "|", "parity")
    f = lambda k: trimmed(F.get("fields", F.lit(k)))
    t = t.withColumns({"v0": F.get("fields", F.lit(0)), "v1": bigint_of(f(1)), "v2": f(2), "v3": double_of(f(3))})
    out = split_bad(t, 4, F.col("v1").isNull() | (F.col("v2") != "") | F.col("v3").isNull())
    good = F.col("reason").isNull()
    return out.select(
        "file_no", "line_no", "reason", "broken_at", F.when(good, F.col("v0")).alias("letters"), F.when(good, F.col("v1")).alias("ints"),
        F.when(good & (F.col("v2") != ""), F.col("v2")).alias("empty"), F.when(good, F.col("v3")).alias("numeric"),
    )
