"""Queries of problems 3, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm import quantile_queries
from starmill.llm.bpe import decode_column, encode_column
from starmill.llm.leakage import build_index, leaks, search_near
from starmill.llm.pii import find_personal, redact
from starmill.queries import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts that the ids give back: null and empty texts are both empty."""
    return decode_column(p8_ids(spark, sf_dir), ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n_chars"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).selectExpr("doc AS doc_id", "item AS item_id")


def p9_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many consecutive words of the item the document holds at most."""
    return _leaks(spark, sf_dir).selectExpr("doc AS doc_id", "item AS item_id", "n_words")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve consecutive words of an item within eighteen words, in whatever order."""
    index = build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return search_near(index, table(spark, sf_dir, "eval_items"), "item_id", "text").selectExpr("doc AS doc_id", "item AS item_id", "n_words AS n_stretch")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), "doc_id", "text").selectExpr("doc AS doc_id", "kind", "found AS found_text").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redact(docs, "doc_id", "text", find_personal(docs, "doc_id", "text"))


QUERIES = {**quantile_queries.QUERIES, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_lengths": p9_lengths, "p9_near": p9_near, "p10_found": p10_found, "p10_redacted": p10_redacted}
_FULL = "".join(chr(0xFF41 + k) for k in range(26))


def _words_sql(text: str) -> str:
    """Words of a text; of compatibility forms those that are in the tables (full-width letters, a ligature, sharp s, micro)."""
    plain = f"translate(lower(nfc_normalize(regexp_replace({text}, '[\\x{{00AD}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'))), '{_FULL}\u00b5', 'abcdefghijklmnopqrstuvwxyz\u03bc')"
    return f"regexp_extract_all(replace(replace({plain}, '\u00df', 'ss'), '\ufb01', 'fi'), '[\\p{{L}}\\p{{N}}]+')"


_GRAMS = f"""d AS MATERIALIZED (SELECT doc_id, {_words_sql("text")} AS w FROM documents), i AS MATERIALIZED (SELECT item_id, {_words_sql("text")} AS w FROM eval_items),
 g AS MATERIALIZED (SELECT item_id, k, array_to_string(w[k:k+11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
 h AS MATERIALIZED (SELECT doc_id, j, array_to_string(w[j:j+11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS j FROM d)),
 m AS (SELECT DISTINCT doc_id, item_id, j - k AS delta, k FROM g JOIN h USING (gram)), n AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, delta ORDER BY k) AS island FROM m)"""
SQL: dict[str, str] = {
    **quantile_queries.SQL,
    "p9_found": f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM m",
    "p9_lengths": f"WITH {_GRAMS} SELECT doc_id, item_id, CAST(max(c) + 11 AS INT) AS n_words FROM (SELECT doc_id, item_id, count(*) AS c FROM n GROUP BY doc_id, item_id, delta, island) GROUP BY 1, 2",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM documents",
}
