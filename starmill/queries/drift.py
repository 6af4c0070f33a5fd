"""Problem 4: files that drift from the schema of input_01."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmill.operators.drift import appearing_alternatives, drift_report, fused_table
from starmill.queries import table


def target_fields(target: DataFrame) -> dict[str, str]:
    return dict(target.dtypes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = target_fields(table(spark, sf_dir, "input_01"))
    return drift_report(table(spark, sf_dir, "input_files"), table(spark, sf_dir, "input_02"), table(spark, sf_dir, "field_aliases"), fields)


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "input_01")
    return fused_table(target, table(spark, sf_dir, "input_files"), table(spark, sf_dir, "input_02"), table(spark, sf_dir, "field_aliases"), target_fields(target))


def p4_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type a field was ever seen in, and the delivery it first appeared in."""
    fields = target_fields(table(spark, sf_dir, "input_01"))
    return appearing_alternatives(table(spark, sf_dir, "input_files"), table(spark, sf_dir, "input_02"), table(spark, sf_dir, "field_aliases"), fields)


QUERIES = {"p4_found": p4_found, "p4_table": p4_table, "p4_alternatives": p4_alternatives}

_FIELDS = {"id": 0, "ra": 1, "dec": 1, "ra_error": 0, "dec_error": 0, "comment": 2, "code": 0}
_LIST = ", ".join(f"'{f}'" for f in _FIELDS)
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_INT, _DBL = r"'[+-]?[0-9]+'", r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"
_CTE = f"""WITH alike AS (SELECT canon, min(field_name) AS field_name FROM (SELECT regexp_replace(lower(alias), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS canon, field_name FROM field_aliases UNION ALL SELECT replace(f, '_', ''), f FROM (SELECT unnest([{_LIST}]) AS f)) WHERE canon <> '' GROUP BY canon),
 n0 AS (SELECT DISTINCT file_no, names, unnest(names) AS name FROM (SELECT file_no, string_split(header, ',') AS names FROM input_files)),
 n AS (SELECT file_no, name, CASE WHEN name IN ({_LIST}) THEN 'field' WHEN field_name IS NOT NULL AND NOT list_contains(names, field_name) THEN 'renamed' ELSE 'added' END AS kind, CASE WHEN name IN ({_LIST}) OR field_name IS NULL OR list_contains(names, field_name) THEN name ELSE field_name END AS field
  FROM n0 LEFT JOIN alike ON regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') = canon),
 v AS ({" UNION ALL ".join(f"SELECT file_no, row_no, '{f}' AS name, {f} AS v FROM input_02" for f in _FIELDS)} UNION ALL SELECT file_no, row_no, k, json_extract_string(extra, '$."' || k || '"') FROM (SELECT file_no, row_no, extra, unnest(json_keys(extra)) AS k FROM input_02 WHERE extra IS NOT NULL)),
 w AS (SELECT file_no, row_no, name, {_TRIM.format("v")} AS v FROM v WHERE lower({_TRIM.format("v")}) NOT IN ('', 'null', 'na', 'n/a', 'nan')),
 x AS (SELECT n.file_no, field, kind, CASE WHEN regexp_full_match(v, {_INT}) AND TRY_CAST(v AS BIGINT) IS NOT NULL THEN 0 WHEN regexp_full_match(v, {_DBL}) THEN 1 ELSE 2 END AS tag FROM n JOIN w ON n.file_no = w.file_no AND n.name = w.name),
 u AS (SELECT file_no, field, max(tag) AS widest FROM x WHERE kind <> 'added' GROUP BY 1, 2)"""
_KIND = {"id": "BIGINT", "ra": "DOUBLE", "dec": "DOUBLE", "ra_error": "BIGINT", "dec_error": "BIGINT", "comment": "VARCHAR", "code": "BIGINT"}
_IS = "lower({0}) NOT IN ('', 'null', 'na', 'n/a', 'nan')"
_TYPED = {"BIGINT": f"CASE WHEN regexp_full_match({{0}}, {_INT}) THEN TRY_CAST({{0}} AS BIGINT) END", "DOUBLE": f"CASE WHEN regexp_full_match({{0}}, {_DBL}) THEN TRY_CAST({{0}} AS DOUBLE) END", "VARCHAR": "{0}"}
_NAME = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}


def _wide(f: str, kind: str) -> str:
    """The field and its branches: each wider type takes what no narrower one holds."""
    out, known = [f"{_TYPED[kind].format('v_' + f)} AS {f}"], f"({_TYPED[kind].format('v_' + f)}) IS NOT NULL"
    for k in list(_NAME)[list(_NAME).index(kind) + 1 :]:
        out.append(f"CASE WHEN NOT ({known}) THEN {_TYPED[k].format('v_' + f)} END AS {f}_{_NAME[k]}")
        known += f" OR ({_TYPED[k].format('v_' + f)}) IS NOT NULL"
    return ", ".join(out)


_WIDE = ", ".join(_wide(f, k) for f, k in _KIND.items())
_PLAIN = ", ".join(", ".join([f"CAST({f} AS {k}) AS {f}"] + [f"CAST(NULL AS {w}) AS {f}_{_NAME[w]}" for w in list(_NAME)[list(_NAME).index(k) + 1 :]]) for f, k in _KIND.items())
_TABLE = f"""{_CTE}, r AS (SELECT row_number() OVER () AS rid, * FROM input_02),
 alt AS (SELECT rid, field, min_by(v, name) AS v FROM (SELECT rid, field, name, {_TRIM.format("json_extract_string(extra, '$.\"' || name || '\"')")} AS v FROM r JOIN n ON r.file_no = n.file_no AND kind = 'renamed') WHERE {_IS.format("v")} GROUP BY 1, 2),
 own AS (SELECT r.file_no, row_no, {", ".join(f"{_TRIM.format(f'coalesce({f}, (SELECT v FROM alt WHERE alt.rid = r.rid AND field = {chr(39)}{f}{chr(39)}))')} AS t_{f}" for f in _KIND)} FROM r),
 val AS (SELECT file_no, row_no, {", ".join(f"CASE WHEN {_IS.format('t_' + f)} THEN t_{f} END AS v_{f}" for f in _KIND)} FROM own)
 SELECT 'target' AS source, CAST(NULL AS BIGINT) AS file_no, CAST(NULL AS BIGINT) AS row_no, {_PLAIN} FROM input_01 UNION ALL SELECT 'drifting', file_no, row_no, {_WIDE} FROM val"""
SQL = {
    "p4_found": f"""{_CTE} SELECT file_no, kind AS drift, field AS field_name, name AS seen_as FROM n WHERE kind <> 'field'
 UNION ALL SELECT no, 'removed', f, '' FROM (SELECT DISTINCT file_no AS no FROM input_files) CROSS JOIN (SELECT unnest([{_LIST}]) AS f) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file_no = no AND field = f AND kind <> 'added')
 UNION ALL SELECT file_no, 'retyped', field, CASE widest WHEN 1 THEN 'double' ELSE 'string' END FROM u WHERE widest > CASE {" ".join(f"WHEN field = '{f}' THEN {k}" for f, k in _FIELDS.items())} END""",
    "p4_table": _TABLE,
    "p4_alternatives": f"""{_CTE}, y AS (SELECT x.file_no, field, tag, count(*) AS m, any_value(came) AS came FROM x JOIN (SELECT file_no, min(delivered_at) AS came FROM input_files GROUP BY 1) t ON t.file_no = x.file_no GROUP BY 1, 2, 3),
 z AS (SELECT *, row_number() OVER (PARTITION BY field, tag ORDER BY came NULLS LAST, file_no) AS k FROM y)
 SELECT field AS field_name, CASE tag WHEN 0 THEN 'bigint' WHEN 1 THEN 'double' ELSE 'string' END AS alternative, coalesce(tag = CASE {" ".join(f"WHEN field = '{f}' THEN {k}" for f, k in _FIELDS.items())} END, FALSE) AS declared,
 max(file_no) FILTER (k = 1) AS first_file, max(came) FILTER (k = 1) AS first_delivered, count(*) AS n_files, CAST(sum(m) AS BIGINT) AS n_values FROM z GROUP BY field, tag""",
}
