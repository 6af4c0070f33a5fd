"""Schemas that drift between files: one consistent table and a report of each change.

Tagged-union inference.  Every field of a file is a path; every value under it is tagged with the narrowest
alternative (bigint, double, string) that holds it; the union of a path is the set of its tags.  Unions of
files are fused tag by tag, so that alternatives are kept instead of widened away: in the fused table a field
keeps its canonical type, and values of another alternative go to a typed branch column beside it.

Work per value is a column expression; what is shuffled is one row a (file, path) after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.functions.values import DOUBLE, INTEGER, bigint_of, double_of, is_value, trimmed

#: Alternatives from narrow to wide.
ALTERNATIVES = ("bigint", "double", "string")


def canonical_name(c: Column) -> Column:
    """Names are alike if these agree: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")


def tag(value: Column) -> Column:
    """Rank of the narrowest alternative that holds a trimmed value; null if it is no value.

    Only whole numbers of more than 18 digits have to be cast to tell.
    """
    whole = F.when(value.rlike("^[+-]?[0-9]{1,18}$"), 0).when(value.rlike(INTEGER), F.when(bigint_of(value).isNotNull(), 0).otherwise(1))
    return F.when(is_value(value), whole.when(value.rlike(DOUBLE), 1).otherwise(2))


def header_paths(files: DataFrame, aliases: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(file_no, name, role, field_name): what each name of a file's header stands for.

    role is ``field`` (one of the fields by name), ``renamed`` (like a field whose own name is missing, or like
    one of its aliases) or ``added``.  A null header has no names.  A name like no field is added; so is one
    like a field that is there by its own name.  Aliases without a known field count not.
    """
    known = [(name, name) for name in fields]
    spark = files.sparkSession
    own = spark.createDataFrame(known, "alias string, field_name string")
    alike = own.unionByName(aliases.where(F.col("field_name").isin(*fields)).select("alias", "field_name")).select(canonical_name(F.col("alias")).alias("canon"), "field_name").where("canon <> ''")
    # as many entries as there are fields and aliases, by canonical name; one field a name, the first in alphabet
    alike = alike.groupBy("canon").agg(F.min("field_name").alias("like"))
    names = files.select("file_no", F.split("header", ",", -1).alias("names")).where("names is not null")
    names = names.withColumn("name", F.explode(F.array_distinct("names"))).withColumn("canon", canonical_name(F.col("name")))
    names = names.join(alike, "canon", "left")
    is_field = F.col("name").isin(*fields)
    renamed = ~is_field & F.col("like").isNotNull() & ~F.array_contains("names", F.col("like"))
    role = F.when(is_field, "field").when(renamed, "renamed").otherwise("added")
    field = F.when(is_field | renamed, F.when(is_field, F.col("name")).otherwise(F.col("like"))).otherwise(F.col("name"))
    return names.select("file_no", "name", role.alias("role"), field.alias("field_name"))


def value_unions(rows: DataFrame, fields: dict[str, str], extra: str = "extra", key: str = "file_no") -> DataFrame:
    """(key, name, n_0, n_1, n_2): values of each alternative under each path of each file.

    Paths are the typed columns and the keys of the JSON object in ``extra``; JSON that cannot be read counts
    as empty.
    """
    # trimmed before the rows are multiplied, and counted by one evaluation of the tag
    plain = F.array(*[F.struct(F.lit(n).alias("name"), trimmed(F.col(n).cast("string")).alias("value")) for n in fields])
    loose = F.transform(F.map_entries(F.from_json(extra, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), trimmed(e["value"]).alias("value")))
    value = rows.select(key, F.explode(F.when(F.col(extra).isNull(), plain).otherwise(F.concat(plain, F.coalesce(loose, F.array().cast("array<struct<name:string,value:string>>"))))).alias("e"))
    value = value.select(key, "e.name", "e.value").where(is_value(F.col("value")))
    kind = tag(F.col("value"))
    return value.groupBy(key, "name").agg(*[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in range(3)])


def drift_report(files: DataFrame, rows: DataFrame, aliases: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(file_no, drift, field_name, seen_as): each change of each file against ``fields``.

    drift is renamed, added, removed or retyped.  Files without rows are checked by their header alone; rows of
    unknown files are not reported.  Two names of one missing field are both renamed, and its union is theirs.
    """
    paths = header_paths(files, aliases, fields)
    named = paths.where("role <> 'field'").select("file_no", F.col("role").alias("drift"), "field_name", F.col("name").alias("seen_as"))
    every = files.select("file_no").distinct().withColumn("field_name", F.explode(F.array(*[F.lit(f) for f in fields])))
    present = paths.where("role <> 'added'")
    removed = every.join(present.select("file_no", "field_name"), ["file_no", "field_name"], "left_anti").select("file_no", F.lit("removed").alias("drift"), "field_name", F.lit("").alias("seen_as"))
    unions = present.join(value_unions(rows, fields), ["file_no", "name"]).groupBy("file_no", "field_name").agg(F.max(F.when(F.col("n_2") > 0, 2).when(F.col("n_1") > 0, 1).otherwise(0)).alias("widest"))
    declared = F.create_map(*[x for name, kind in fields.items() for x in (F.lit(name), F.lit(ALTERNATIVES.index(kind)))])
    names = F.array(*[F.lit(a) for a in ALTERNATIVES])
    retyped = unions.where(F.col("widest") > declared[F.col("field_name")]).select("file_no", F.lit("retyped").alias("drift"), "field_name", F.get(names, F.col("widest")).alias("seen_as"))
    return named.unionByName(removed).unionByName(retyped)


def appearing_alternatives(files: DataFrame, rows: DataFrame, aliases: DataFrame, fields: dict[str, str], delivered: str = "delivered_at") -> DataFrame:
    """(field_name, alternative, declared, first_file, first_delivered, n_files, n_values): every alternative that appears.

    In order of delivery (then of number) each alternative of each field, and of each added name, is reported with the
    file it first appears in; declared: it is the field's own type.  Files without a delivery come last.  Values of
    files or names that no header tells of are left out.
    """
    paths = header_paths(files, aliases, fields).select("file_no", "name", "field_name")
    counts = F.array(*[F.struct(F.lit(a).alias("alternative"), F.col(f"n_{k}").alias("n")) for k, a in enumerate(ALTERNATIVES)])
    seen = paths.join(value_unions(rows, fields), ["file_no", "name"]).select("file_no", "field_name", F.explode(counts).alias("c")).select("file_no", "field_name", "c.*").where("n > 0")
    seen = seen.groupBy("field_name", "alternative", "file_no").agg(F.sum("n").alias("n"))
    times = files.where("file_no is not null").groupBy("file_no").agg(F.min(delivered).alias("at"))
    first = F.min(F.struct(F.col("at").isNull().alias("unknown"), "at", "file_no")).alias("first")
    found = seen.join(times, "file_no").groupBy("field_name", "alternative").agg(first, F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_values"))
    declared = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])[F.col("field_name")]
    return found.select("field_name", "alternative", F.coalesce(declared == F.col("alternative"), F.lit(False)).alias("declared"), F.col("first.file_no").alias("first_file"), F.col("first.at").alias("first_delivered"), "n_files", "n_values")


def branches(name: str, kind: str) -> list[tuple[str, str]]:
    """(column, alternative) of the typed branches beside a field: the alternatives wider than its type."""
    return [(f"{name}_{a}", a) for a in ALTERNATIVES[ALTERNATIVES.index(kind) + 1 :]]


def fused_table(target: DataFrame, files: DataFrame, rows: DataFrame, aliases: DataFrame, fields: dict[str, str]) -> DataFrame:
    """All rows of ``target`` and of ``rows`` under the fields' own names and types.

    Columns: source, file_no, row_no, then each field in its declared type, its canonical form, and a branch for each
    wider alternative, of that alternative's own type: a value is in the narrowest of them that holds it, a bigint field
    has ``<field>_double`` and ``<field>_string``, a double field ``<field>_string``.  Narrower values are converted to
    the canonical form; integers are doubles as well, all are strings; no value is null.  A value under a renamed path
    comes to its field; of several names of one field the first that has a value counts.  Repeated rows stay, as they are
    in the input.  Paths are the names of the header; nested JSON in ``extra`` is a string.
    """
    paths = header_paths(files, aliases, fields).where("role = 'renamed'").groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("field_name", "name"))).alias("renames"))
    t = rows.select("file_no", "row_no", *fields, "extra").join(paths, "file_no", "left").withColumn("loose", F.from_json("extra", "map<string,string>"))
    out = []
    for name, kind in fields.items():
        seen = F.transform(F.filter("renames", lambda r: r["field_name"] == F.lit(name)), lambda r: F.element_at("loose", r["name"]))
        held = F.filter(seen, lambda v: is_value(trimmed(v)))
        t = t.withColumn(f"__{name}", trimmed(F.coalesce(F.col(name).cast("string"), F.get(held, F.lit(0)))))
        value = F.when(is_value(F.col(f"__{name}")), F.col(f"__{name}"))
        as_kind = {"bigint": bigint_of, "double": double_of, "string": lambda c: c}
        held = as_kind[kind](value)
        out.append(held.alias(name))
        for column, alternative in branches(name, kind):
            typed = F.when(held.isNull(), as_kind[alternative](value))
            out.append(typed.alias(column))
            held = F.coalesce(held.cast("string"), typed.cast("string"))
    own = ["source", "file_no", "row_no", *[c for name, kind in fields.items() for c in (name, *(b for b, _ in branches(name, kind)))]]
    moved = t.select(F.lit("drifting").alias("source"), "file_no", "row_no", *out).select(*own)
    kept = target.select(F.lit("target").alias("source"), *[F.lit(None).cast("bigint").alias(c) for c in ("file_no", "row_no")], *[F.col(n).cast(kind).alias(n) for n, kind in fields.items()], *[F.lit(None).cast(a).alias(b) for n, kind in fields.items() for b, a in branches(n, kind)])
    return kept.select(*own).unionByName(moved)
