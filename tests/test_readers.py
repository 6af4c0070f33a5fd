import gzip
import struct
import zipfile

import pandas as pd
import pytest

from starmill.sources import readers as rd
from starmill.sources.fits import FitsReader, table_info

CSV = "id,ra,dec,note\n1,10.5,-3,a\n2,11.25,4,\n3,12,5,\"c, d\"\n"


def test_csv_plain_gz_zip_and_projection(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(CSV)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", CSV)
    types = {"id": "int64", "ra": float, "dec": "float64", "note": "str"}
    df = rd.CsvReader(type_map=types).read(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv.gz", "c.zip")])
    assert df.dtypes == [("id", "bigint"), ("ra", "double"), ("dec", "double"), ("note", "string")]
    assert df.count() == 9 and df.where("note is null").count() == 3 and df.where("note = 'c, d'").count() == 3
    assert rd.CsvReader().read(spark, [str(tmp_path / "a.csv")], ["dec", "ra"]).columns == ["dec", "ra"]


def test_types_of_archives_hold_every_value(spark, tmp_path):
    """A value after the first 10,000 rows, in another member, archive or plain file widens its column."""
    late = "".join(f"{k},{k},{k},{k},{k},true\n" for k in range(10_001))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.csv", "id,late,member,archive,big,flag\n" + late + "10001,0.5,1,1,1,false\n")
        z.writestr("2.csv", "id,late,member,archive,big,flag\n10002,1,1.25,1,9007199254740993,\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("1.csv", "id,late,member,archive,big,flag\n10003,1,1,x7,,true\n")
    got = rd.CsvReader().read(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")])
    assert got.dtypes == [("id", "bigint"), ("late", "double"), ("member", "double"), ("archive", "string"), ("big", "bigint"), ("flag", "boolean")]
    assert [tuple(r)[1:] for r in got.where("id > 10000").orderBy("id").collect()] == [(0.5, 1.0, "1", 1, False), (1.0, 1.25, "1", 9007199254740993, None), (1.0, 1.0, "x7", None, True)]
    (tmp_path / "p.csv").write_text("id,late,member,archive,big,flag\n-1,7,1,2,3,007\n")
    both = rd.CsvReader().read(spark, [str(tmp_path / "p.csv"), str(tmp_path / "a.zip"), str(tmp_path / "b.zip")])
    assert both.count() == 10_005 and dict(both.dtypes) | {"id": ""} == dict(got.dtypes) | {"id": "", "flag": "string"}
    assert tuple(both.where("id = -1").first()) == (-1, 7.0, 1.0, "2", 3, "007")
    assert both.where("id = 10003").first().archive == "x7" and both.where("flag = 'true'").count() == 10_002


def test_whole_numbers_of_archives_keep_their_digits(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d.csv", "n\n99999999999999999999\n1\n")
    assert sorted(r.n for r in rd.CsvReader().read(spark, [str(tmp_path / "a.zip")]).collect()) == ["1", "99999999999999999999"]
    (tmp_path / "p.csv").write_text("n\n99999999999999999999\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("d.csv", "n\n1.5\n")
    assert "1.5" in [str(r.n) for r in rd.CsvReader().read(spark, [str(tmp_path / "p.csv"), str(tmp_path / "b.zip")]).collect()]


def test_times_of_archives_are_not_cut_to_dates(spark, tmp_path):
    (tmp_path / "p.csv").write_text("day\n2020-01-01\n")
    for name, value in (("same", "2020-01-02"), ("time", "2020-01-02 03:04:05")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("d.csv", f"day\n{value}\n")
        got = rd.CsvReader().read(spark, [str(tmp_path / "p.csv"), str(tmp_path / f"{name}.zip")])
        assert sorted(str(r.day) for r in got.collect()) == ["2020-01-01", value]


def test_pipes_without_header_comments_and_schema_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "p.csv").write_text("# made by\nAA|7||3.5\nBB|8||4\n")
    pq.write_table(pa.table({"letters": pa.array([], pa.string()), "ints": pa.array([], pa.int64()), "empty": pa.array([], pa.int64()), "numeric": pa.array([], pa.float64())}), tmp_path / "s.parquet")
    r = rd.CsvReader(sep="|", header=False, comment="#", schema_file=str(tmp_path / "s.parquet"))
    got = r.read(spark, [str(tmp_path / "p.csv")])
    assert got.dtypes == [("letters", "string"), ("ints", "bigint"), ("empty", "bigint"), ("numeric", "double")]
    assert [tuple(x) for x in got.orderBy("ints").collect()] == [("AA", 7, None, 3.5), ("BB", 8, None, 4.0)]
    named = rd.CsvReader(sep="|", header=False, comment="#", column_names=list("abcd"), type_map={"b": "Int32"})
    assert named.read(spark, [str(tmp_path / "p.csv")]).dtypes[1] == ("b", "int")


def test_indexed_and_discovery(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(CSV)
        pd.DataFrame({"id": [k], "Npix": pd.Series([5], dtype="uint64")}).to_parquet(tmp_path / f"q{k}.parquet")
    (tmp_path / "list.txt").write_text("f0.csv\n\n f1.csv \n")
    (tmp_path / "plist.txt").write_text("q0.parquet\nq1.parquet\n")
    assert rd.get_file_reader("indexed_csv").read(spark, [str(tmp_path / "list.txt")]).count() == 6
    p = rd.get_file_reader("indexed_parquet").read(spark, [str(tmp_path / "plist.txt")])
    assert p.count() == 2 and dict(p.dtypes)["Npix"] == "bigint"
    assert rd.get_file_reader("parquet", column_names=["id"]).read(spark, [str(tmp_path / "q2.parquet")]).columns == ["id"]
    assert len(rd.find_input_paths(str(tmp_path), "**/*.csv")) == 3
    with pytest.raises(ValueError, match="empty"):
        rd.find_input_paths(input_file_list=[])
    with pytest.raises(ValueError):
        rd.find_input_paths(str(tmp_path), input_file_list=["a"])
    with pytest.raises(FileNotFoundError):
        rd.find_input_paths(str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="folder"):
        rd.check_file(str(tmp_path))
    with pytest.raises(NotImplementedError):
        rd.get_file_reader("unicorns")
    own = rd.FunctionReader(function=lambda s, paths: s.read.csv(paths, header=True))
    assert own.read(spark, [str(tmp_path / "f0.csv")], ["ra"]).columns == ["ra"]


def test_ecsv(spark, tmp_path):
    head = ["%ECSV 1.0", "---", "delimiter: ','", "datatype:", "- {name: id, datatype: int64}", "- {name: n, datatype: int16}", "- {name: flux, datatype: string, subtype: 'float64[null]'}", "- {name: ok, datatype: string, subtype: 'bool[null]'}", "meta: !!omap", "- {a: 1}"]
    body = 'id,n,flux,ok\n1,2,"[1.5,null,3]","[true,false]"\n2,,"[]",""\n'
    (tmp_path / "e.ecsv").write_text("".join(f"# {x}\n" for x in head) + body)
    got = rd.get_file_reader("ecsv").read(spark, [str(tmp_path / "e.ecsv")])
    assert got.dtypes == [("id", "bigint"), ("n", "smallint"), ("flux", "array<double>"), ("ok", "array<boolean>")]
    assert tuple(got.orderBy("id").first()) == (1, 2, [1.5, None, 3.0], [True, False])


def card(k, v):
    return f"{k:<8}= {v!s:>20}".ljust(80)


def fits_file(path, rows):
    block = lambda cards: ("".join(c.ljust(80) for c in [*cards, "END"])).ljust(-(-(len(cards) + 1) * 80 // 2880) * 2880).encode()
    form = [("id", "K"), ("ra", "D"), ("name", "6A"), ("mag", "3E"), ("flag", "L")]
    cards = ["XTENSION= 'BINTABLE'", card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 8 + 8 + 6 + 12 + 1), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(form))]
    for k, (n, f) in enumerate(form, 1):
        cards += [f"TTYPE{k:<3}= '{n}'", f"TFORM{k:<3}= '{f}'"]
    data = b"".join(struct.pack(">qd6s3fc", i, ra, name.encode(), *mag, b"T" if flag else b"F") for i, ra, name, mag, flag in rows)
    path.write_bytes(block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(cards) + data + b"\0" * (-len(data) % 2880))


def test_fits(spark, tmp_path):
    rows = [(k, k / 7, f"é{k}", (k, k + 1, k + 2), k % 2 == 0) for k in range(25)]
    fits_file(tmp_path / "t.fits", rows)
    assert table_info(str(tmp_path / "t.fits")).rows == 25
    got = FitsReader(rows_a_task=10).read(spark, [str(tmp_path / "t.fits")]).orderBy("id").collect()
    assert [(r.id, r.ra, r.name, tuple(r.mag), r.flag) for r in got] == rows
    assert FitsReader(skip_column_names=["mag"]).read(spark, [str(tmp_path / "t.fits")], None).columns == ["id", "ra", "name", "flag"]
    assert FitsReader(column_names=["name"]).read(spark, [str(tmp_path / "t.fits")], ["ra"]).columns == ["ra"]
    with pytest.raises(ValueError):
        FitsReader(column_names=["id"], skip_column_names=["ra"]).read(spark, [str(tmp_path / "t.fits")])


@pytest.mark.parametrize("zipped", [False, True])
def test_bad_values_stop_the_read(spark, tmp_path, zipped):
    """No value is lost without a word, at whatever row it stands."""
    text = "id,v\n" + "".join(f"{k},{k}\n" for k in range(12_000)) + "12000,abc\n"
    path = tmp_path / ("a.zip" if zipped else "a.csv")
    if zipped:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("a.csv", text)
    else:
        path.write_text(text)
    reader = rd.CsvReader(type_map={"id": "int64", "v": "int64"})
    with pytest.raises(Exception, match="v|MALFORMED"):
        reader.read(spark, [str(path)]).agg({"v": "sum"}).collect()
    assert rd.CsvReader().read(spark, [str(path)]).where("v = 'abc'").count() == 1


def test_headers_that_differ_stop_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.csv").write_text("v,id\n1,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        rd.CsvReader(type_map={"id": "int64", "v": "int64"}).read(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()


def test_ecsv_files_have_headers_of_their_own(spark, tmp_path):
    head = "# %ECSV 1.0\n# ---\n# delimiter: ','\n# datatype:\n"
    (tmp_path / "a.ecsv").write_text(head + "# - {name: id, datatype: int64}\n# - {name: x, datatype: string, subtype: 'int64[null]'}\nid,x\n1,\"[1,null]\"\n")
    (tmp_path / "b.ecsv").write_text(head + "# - {name: y, datatype: float64}\n# - {name: id, datatype: int64}\ny,id\n2.5,2\n")
    got = rd.EcsvReader().read(spark, [str(tmp_path / "a.ecsv"), f"file://{tmp_path}/b.ecsv"]).orderBy("id").collect()
    assert [(r.id, r.x, r.y) for r in got] == [(1, [1, None], None), (2, None, 2.5)]
    (tmp_path / "c.ecsv").write_text(head + "# - {name: id, datatype: int64}\nid\nabc\n")
    with pytest.raises(Exception, match="abc"):
        rd.EcsvReader().read(spark, [str(tmp_path / "c.ecsv")]).collect()
    with pytest.raises(ValueError, match="no ECSV header"):
        rd.EcsvReader().read(spark, [str(tmp_path / "../nothing.csv")]) if (tmp_path / "../nothing.csv").write_text("a\n") else None


def test_parquet_schemas_merge_and_a_named_index_comes_first(spark, tmp_path):
    pd.DataFrame({"v": [1], "i": ["a"]}).set_index("i").to_parquet(tmp_path / "a.parquet")
    pd.DataFrame({"v": [2], "w": [3.0], "i": ["b"]}).set_index("i").to_parquet(tmp_path / "b.parquet")
    df = rd.ParquetReader().read(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
    assert df.columns == ["i", "v", "w"] and [tuple(r) for r in df.orderBy("v").collect()] == [("a", 1, None), ("b", 2, 3.0)]
    pd.DataFrame({"v": [1, 2]}, index=[5, 9]).to_parquet(tmp_path / "c.parquet")
    assert rd.ParquetReader().read(spark, [str(tmp_path / "c.parquet")]).columns == ["v"]
