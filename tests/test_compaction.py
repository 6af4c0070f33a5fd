import glob
from datetime import datetime as dt

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from starmill.functions.hilbert import hilbert_np
from starmill.operators import compaction
from starmill.operators.compaction import audit_files, compact, consolidate, digests, plan_layout, unique_records
from starmill.session import scratch_path

SCHEMA = "file_no bigint, count_id bigint, Norder int, Dir bigint, Npix bigint, join_Norder int, join_Dir bigint, join_Npix bigint, num_rows bigint, counted_at timestamp"
T = dt(2024, 1, 1)


def test_hilbert_is_a_bijection_of_neighbours():
    for dims, bits in ((2, 4), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        code = hilbert_np(grid, bits)
        assert sorted(code.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(code)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_audit(spark):
    rows = [
        (1, 1, 5, 10000, 10819, 6, 0, 55, 5000, T), (2, 1, 5, 10000, 10819, 6, 0, 55, 5000, T), (3, 2, 5, 0, 10819, 6, 0, 55, -4, T), (3, 3, 5, 10000, 10819, 6, 0, 55, None, T),
        (4, 4, -1, 77, 10819, 6, 0, 55, 1999, T), (5, None, None, None, None, None, None, None, 2000, T), (6, 4, -1, 77, 10819, 6, 9, 55, 1, T), (6, 5, 1, 0, 2, 6, 0, 55, 3000, T),
    ]
    files = spark.createDataFrame([(k,) for k in range(1, 9)], "file_no bigint")
    records = spark.createDataFrame(rows, SCHEMA)
    moved, compared = consolidate(records, scratch_path(spark, "t"), 2)
    assert all(r.same for r in compared.collect()) and moved.count() == 6
    got = sorted(tuple(r) for r in audit_files(records, files, moved, 2000).collect())
    assert got == [(2, "repeat"), (3, "misfiled"), (3, "small"), (4, "small"), (6, "misfiled"), (7, "empty"), (8, "empty")]
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_files(empty, files.where("false"), consolidate(empty, scratch_path(spark, "t"), 2)[0], 2000).collect() == []


@pytest.mark.parametrize("tasks", [10_000, 3])
def test_layout_is_even_whole_and_compared(spark, monkeypatch, tasks):
    monkeypatch.setattr(compaction, "MOST_TASKS", tasks)
    rng = np.random.default_rng(0)
    rows = [(int(k % 40), int(k % 5000), 5, int(rng.integers(0, 2)) * 10000, int(p), 6, 0, int(p) * 4, int(k % 7), T) for k, p in enumerate(rng.integers(9000, 12000, 5500))]
    # a third of the records lie in one cell
    rows = [(*r[:4], 11111, *r[5:7], 44444, *r[8:]) if r[1] % 3 == 0 else r for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    first = unique_records(df)
    assert first.count() == 5000 and first.where("Dir <> floor(Npix / 10000) * 10000").count() == 0
    sizes = plan_layout(df, 200).groupBy("Dir", "target_file").count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 270 and min(r["count"] for r in sizes) >= 130
    path = scratch_path(spark, "t")
    report = compact(df, path, 200).collect()
    assert all(r.same and r.in_order for r in report) and sum(r.n_rows for r in report) == 5000
    assert all(r.n_files == -(-r.n_rows // 200) for r in report)
    # one file a (directory, number), its rows in the order of the code
    names = glob.glob(f"{path}/**/*.parquet", recursive=True)
    assert len(names) == sum(r.n_files for r in report)
    codes = [pq.read_table(n, columns=["code"], partitioning=None)["code"].to_pylist() for n in names]
    assert all(c == sorted(c) for c in codes)
    assert compact(df.where("false"), scratch_path(spark, "t"), 300).collect() == []


def test_other_columns_are_carried(spark):
    row = (1, 1, 5, 10000, 10819, 6, 0, 55, 5, T)
    df = spark.createDataFrame([row, (2, *row[1:])], SCHEMA).withColumns({"n": F.lit("x"), "r": F.lit(2), "c": F.lit(3), "before": F.lit(4)})
    got = plan_layout(df, 10).collect()
    assert len(got) == 1 and (got[0].n, got[0].r, got[0].c, got[0].before, got[0].target_file) == ("x", 2, 3, 4, 0)


def test_digest_sees_a_change(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 3, "y")], "k int, v int, w string")
    b = a.withColumn("v", F.coalesce("v", F.lit(0)))
    assert digests(a, a.columns).first() == digests(a.orderBy(F.desc("k")), a.columns).first() != digests(b, b.columns).first()
