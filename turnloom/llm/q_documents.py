"""Queries of problems 7 and 9: leaked evaluation passages and equal-looking documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.leakage import leaked_passages, remove_leaked
from turnloom.llm.visual import equal_looking_pairs, form_classes, mapping, with_consistent_text
from turnloom.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "source", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_looking_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_classes(table(spark, sf_dir, "documents"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_consistent_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "consistent_text", (~F.col("text").eqNullSafe(F.col("consistent_text"))).alias("changed"))


QUERIES = {
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p7_clean_documents": p7_clean_documents,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_documents": p9_documents,
}


def sql() -> dict[str, str]:
    """SQL twins: texts taken apart into characters, each replaced by its entry of the table, and put together again."""
    entry = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({ord(k)}, {entry(v)})" for k, v in sorted(mapping().items()) if len(k) == 1 and k != "\0")
    form = lambda source, key: f"""(SELECT {key}, nfc_normalize(coalesce(string_agg(coalesce(m.dst, c.ch), '' ORDER BY c.pos), '')) AS form FROM (
  SELECT {key}, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), '')) AS ch, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), ''), 1) AS pos FROM (SELECT DISTINCT {key}, text FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL)) c
  LEFT JOIN map m ON c.ch <> '' AND ord(c.ch) = m.src GROUP BY {key})"""  # noqa: E731
    head = f"WITH map(src, dst) AS (SELECT * FROM (VALUES {rows}) v(src, dst)), f AS {form('documents', 'doc_id')}, d AS (SELECT doc_id, text, form FROM documents JOIN f USING (doc_id))"
    grams = lambda source, key: f"""(SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (
  SELECT {key}, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}) WHERE len(w) >= 13))"""  # noqa: E731
    leaks = f"{head}, e AS {form('eval_items', 'item_id')}, x AS {grams('f', 'doc_id')}, y AS {grams('e', 'item_id')}"
    return {
        "p9_found": f"{head} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
        "p9_classes": f"{head}, c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT doc_id) AS n_documents, count(DISTINCT text) AS n_stored FROM d GROUP BY form) SELECT DISTINCT doc_id, class_id, n_documents, n_stored FROM d JOIN c USING (form)",
        "p9_documents": f"{head} SELECT o.doc_id, f.form AS consistent_text, NOT (o.text IS NOT DISTINCT FROM f.form) AS changed FROM documents o LEFT JOIN f ON o.doc_id = f.doc_id AND o.text IS NOT NULL",
        "p7_found": f"{leaks} SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)",
        "p7_clean_documents": f"{leaks} SELECT doc_id, source, text FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM x JOIN y USING (g))",
    }
