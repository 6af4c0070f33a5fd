import csv
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starmill.functions import tokenizer as tk
from starmill.functions.values import bigint_of, double_of
from starmill.operators.badrows import parse_gaia, parse_pipe, tokenize_lines, unquoted


def fields_of(lines, sep=",", dialect="csv"):
    data = [x.encode() for x in lines]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    joined = np.frombuffer(b"".join(data), dtype=np.uint8)
    first, starts, ends, error, _ = tk.tokenize(joined, offsets, sep, dialect)
    return [None if error[k] >= 0 else [data[k][a:z].decode() for a, z in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])] for k in range(len(lines))], error


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab ",é', max_size=9), min_size=1, max_size=5), min_size=1, max_size=6), st.sampled_from([1, 3, 128]))
def test_written_fields_come_back(rows, chunk):
    lines = [",".join('"' + f.replace('"', '""') + '"' for f in row) for row in rows]
    old, tk.CHUNK = tk.CHUNK, chunk
    try:
        got, _ = fields_of(lines)
    finally:
        tk.CHUNK = old
    assert [[unquoted(f.encode()).decode() for f in row] for row in got] == rows
    assert rows == [next(csv.reader(io.StringIO(x))) if x else [""] for x in lines]


def test_broken_quotes_and_offsets():
    got, error = fields_of(['a,"b', 'a,"b"c', 'a,b"c', ' "a" , b ', "", 'x,"y ""z"""'])
    assert [g is None for g in got] == [True, True, True, False, False, False]
    assert error.tolist()[:3] == [4, 5, 3] and got[4] == [""]


def test_states_compose_across_chunks():
    rng = np.random.default_rng(0)
    table, cls = tk.csv_table(), rng.integers(0, 5, 500).astype(np.uint8)
    whole = tk.transition_map(table, cls)
    assert (tk.compose(tk.transition_map(table, cls[:123]), tk.transition_map(table, cls[123:])) == whole).all()
    _, end = tk.label(table, cls)
    assert end == whole[tk.START]


def test_numbers(spark):
    cases = ["1", "+1", "-01", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1.", ".5", ".", "1e5", "1e", "nan", "inf", "１", "", "0" * 40 + "7", "--1", "1_0", "1d", "1f", " 1", None]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [tuple(r) for r in df.select(bigint_of(F.col("c")), double_of(F.col("c"))).collect()]
    assert [g[0] for g in got] == [1, 1, -1, 2**63 - 1, None, -(2**63), None, None, None, None, None, None, None, None, None, 7, None, None, None, None, None, None]
    assert [k for k, g in enumerate(got) if g[1] is not None] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 15]


G = '73,"Q ""x"" 1",1.5,-2,1,,3,'


def test_gaia(spark):
    lines = ["﻿" + G, G + "\r", "# c", "  # d", "", "  ", None, "solution_id,designation,ra,dec,phot_g_mean_flux,phot_bp_mean_flux,phot_rp_mean_flux,libname_gspphot", G + ",", G.replace("1.5", "360"), G.replace("73", "7x"), G.replace('"Q ""x"" 1"', '" "'), G.replace("-2", "-90.01"), G.replace(",3,", ",x,"), 'a,"b', G.replace("1.5", ' "1.5" ')]
    df = spark.createDataFrame([(1, k, x, "z") for k, x in enumerate(lines)], "file_no bigint, line_no bigint, c0 string, reason string")
    got = {r.line_no: r for r in parse_gaia(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {0: None, 1: None, 8: "column_count", 9: "invalid_value", 10: "invalid_value", 11: "invalid_value", 12: "invalid_value", 13: "invalid_value", 14: "quoting", 15: None}
    assert got[0].designation == 'Q "x" 1' and got[0].phot_bp_mean_flux is None and got[15].ra == 1.5 and got[14].broken_at == 4


def test_pipe(spark):
    rows = [("a", " 7\t", "", "1e2", None), ("a", "7", "", "1", ""), ("a", "7", None, None, None), ("a", '7"', "", "1", None), ('"a"', "7", " ", ".5", None), ("a", "7", "x", "1", None), ("a", "７", "", "1", None), (None, None, None, None, None), ("a", "7", "", "1", 'x"|"y')]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "file_no bigint, line_no bigint, c0 string, c1 string, c2 string, c3 string, c4 string")
    got = {r.line_no: r for r in parse_pipe(df).collect()}
    assert [got[k].reason for k in range(9)] == [None, "column_count", "column_count", "quoting", None, "invalid_value", "invalid_value", "column_count", "quoting"]
    assert got[0].ints == 7 and got[0].numeric == 100.0
    assert parse_pipe(df.where("false")).collect() == []


@pytest.mark.parametrize("n", [200_000])
def test_long_line_and_empty_batches(spark, n):
    df = spark.createDataFrame([("x," * n,), (None,), ("",)], "c string")
    got = tokenize_lines(df, "c", ",").collect()
    assert [None if r.fields is None else len(r.fields) for r in got] == [n + 1, None, 1]
