import pandas as pd

from starmill.functions import healpix as hp
from starmill.streaming.append import append_cells, streaming_histogram


def test_batches_equal_the_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = pd.DataFrame({"ra": [1.0, 2.0, 200.0, None], "dec": [1.0, 2.0, -50.0, 3.0], "t": pd.to_datetime(["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02"]).astype("datetime64[us]")})
    rows[:2].to_parquet(tmp_path / "in/a.parquet")
    rows[2:].to_parquet(tmp_path / "in/b.parquet")
    schema = "ra double, dec double, t timestamp"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_cells(stream(), "ra", "dec", 3, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = sorted(r.cell for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(hp.ang2pix_np(3, [1, 2, 200], [1, 2, -50]).tolist())
    q = streaming_histogram(stream(), "ra", "dec", 0, "t").writeStream.format("memory").queryName("h").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from h").collect()) == [1, 2] or sum(r.n for r in spark.sql("select n from h").collect()) == 3
