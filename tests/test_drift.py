from starmill.operators.drift import appearing_alternatives, drift_report, fused_table

FIELDS = {"id": "bigint", "ra": "double", "comment": "string", "code": "bigint"}


def tables(spark):
    files = spark.createDataFrame([(1, "id,ra,comment,code"), (2, "id,ra,Remark ,code"), (3, "code,id,comment,CODE,extra1"), (4, None), (5, "id,ra,comment,code,#id")], "file_no bigint, header string")
    aliases = spark.createDataFrame([("remark", "comment"), ("flag", "code"), ("x", "nothing"), (None, "id")], "alias string, field_name string")
    rows = spark.createDataFrame([
        (1, 1, "1", "2.5", "NaN", "7", None), (1, 2, " 2 ", "3", None, "n/a", None),
        (2, 1, "1", "00:12", None, "+3", '{"Remark ": " hello "}'), (2, 2, "99999999999999999999", "1e3", None, "x1", '{"Remark ": "NA"}'),
        (3, 1, "5", None, "c", "4", '{"CODE": "zz", "extra1": "q"}'), (9, 1, "1", None, None, None, "not json"),
        (5, 1, "1", "1", "a", "1.5", '{"#id": "q"}'),
    ], "file_no bigint, row_no bigint, id string, ra string, comment string, code string, extra string")
    return files, aliases, rows


def test_report(spark):
    files, aliases, rows = tables(spark)
    got = {tuple(r) for r in drift_report(files, rows, aliases, FIELDS).collect()}
    assert got == {
        (2, "renamed", "comment", "Remark "), (2, "retyped", "ra", "string"), (2, "retyped", "id", "double"), (2, "retyped", "code", "string"),
        (3, "added", "CODE", "CODE"), (3, "added", "extra1", "extra1"), (3, "removed", "ra", ""),
        (4, "removed", "id", ""), (4, "removed", "ra", ""), (4, "removed", "comment", ""), (4, "removed", "code", ""),
        (5, "added", "#id", "#id"), (5, "retyped", "code", "double"),
    }


def test_fused_table_keeps_every_row_and_value(spark):
    files, aliases, rows = tables(spark)
    target = spark.createDataFrame([(1, 1.0, None, 3), (1, 1.0, None, 3)], "id bigint, ra double, comment string, code bigint")
    t = fused_table(target, files, rows, aliases, FIELDS)
    out = {(r.file_no, r.row_no): r for r in t.where("source = 'drifting'").collect()}
    assert t.count() == 2 + 7
    assert out[2, 1].comment == "hello" and out[2, 1].ra is None and out[2, 1].ra_string == "00:12" and out[2, 1].code == 3
    assert out[2, 2].comment is None and out[2, 2].id is None and out[2, 2].id_double == 99999999999999999999.0 and out[2, 2].id_string is None and out[2, 2].ra == 1000.0
    assert out[1, 2].id == 2 and out[1, 2].code is None and out[1, 2].code_double is None and out[1, 2].code_string is None
    assert out[5, 1].code is None and out[5, 1].code_double == 1.5 and out[2, 2].code_string == "x1" and out[2, 2].code_double is None
    assert t.columns == ["source", "file_no", "row_no", "id", "id_double", "id_string", "ra", "ra_string", "comment", "code", "code_double", "code_string"]
    assert drift_report(files.where("false"), rows.where("false"), aliases.where("false"), FIELDS).collect() == []


def test_appearing_alternatives_by_delivery(spark):
    files, aliases, rows = tables(spark)
    days = {1: 5, 2: 3, 3: None, 5: 4}
    files = files.join(spark.createDataFrame(list(days.items()), "file_no bigint, at int"), "file_no", "left").selectExpr("file_no", "header", "make_date(2024, 1, at) AS delivered_at")
    got = {(r.field_name, r.alternative): (r.declared, r.first_file, r.n_files, r.n_values) for r in appearing_alternatives(files, rows, aliases, FIELDS).collect()}
    assert got == {
        ("id", "bigint"): (True, 2, 4, 5), ("id", "double"): (False, 2, 1, 1), ("ra", "bigint"): (False, 5, 2, 2), ("ra", "double"): (True, 2, 2, 2), ("ra", "string"): (False, 2, 1, 1),
        ("comment", "string"): (True, 2, 3, 3), ("code", "bigint"): (True, 2, 3, 3), ("code", "double"): (False, 5, 1, 1), ("code", "string"): (False, 2, 1, 1), ("CODE", "string"): (False, 3, 1, 1), ("extra1", "string"): (False, 3, 1, 1), ("#id", "string"): (False, 5, 1, 1),
    }
