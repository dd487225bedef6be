"""Queries of the training-data problems 8 to 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import forms_sql, leakage, lookalike, packing
from millrace.session import written
from millrace.util import spread, table


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf, "documents")), "doc_id", "text")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of room left unused."""
    return packing.fill_report(p8_pack(spark, sf))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_spans(spread(table(spark, sf, "documents")), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of words to remove, per document and item."""
    return _spans(spark, sf).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "last_word")


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonical(spread(table(spark, sf, "documents")), "doc_id", "text")


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    keys = written(_canonical(spark, sf).select("id", "raw_hi", "raw_lo", "key_hi", "key_lo"), "looks")
    return lookalike.look_classes(keys)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_look_pairs(written(_classes(spark, sf), "look-classes"))


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document whose look has several spellings, with the class of its look and that of its spelling."""
    return _classes(spark, sf).select(F.col("id").alias("doc_id"), F.col("look").alias("look_id"), F.col("spelling").alias("spelling_id"))


def p10_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text is not in its one form, with what was repaired and what stayed undecided."""
    return _canonical(spark, sf).filter(F.col("changed")).select(F.col("id").alias("doc_id"), "repaired", "undecided")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_pack, p8_fill, p9_found, p9_spans, p10_found, p10_classes, p10_repairs)}
_N = leakage.MIN_WORDS
#: Leaks by a join of all runs of words, looks by the shapes of whole texts.  The others hang on the tokenizer or on
#: the vocabulary; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "p9_found": f"WITH {forms_sql.leaks(_N)} SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_spans": f"""WITH {forms_sql.leaks(_N)}, s AS (SELECT *, CAST(pos > lag(pos) OVER w + {_N} AS INT) AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY pos)),
r AS (SELECT *, sum(coalesce(fresh, 1)) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS run FROM s)
SELECT doc_id, item_id, min(pos) AS first_word, max(pos) + {_N - 1} AS last_word FROM r GROUP BY doc_id, item_id, run""",
    "p10_found": f"WITH {forms_sql.looks()} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM look a JOIN look b ON a.key = b.key AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": f"""WITH {forms_sql.looks()}, c AS (SELECT key FROM look GROUP BY key HAVING count(DISTINCT text) > 1)
SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS look_id, min(doc_id) OVER (PARTITION BY key, text) AS spelling_id FROM look WHERE key IN (SELECT key FROM c)""",
}
