"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, textual
from ..sources.tables import table
from .registry import query

# Signals of relevance, each with its weight, and what lowers it.
SIGNALS = {
    "event": (r"(?i)\b(contract|tender|merger|trial|delivery)", 15), "category": (r"(?i)\b(armour|drone|radar|munition|gearbox)", 25), "value": (r"(\$|€|USD|Rs\.) ?[0-9]", 10), "own": (r"(?i)all rights in this bulletin", -20),
}


@query("""
SELECT doc_id, CASE WHEN regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, ''), '(?i)\\b(contract|tender|merger|trial|delivery)') THEN 15 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, ''), '(?i)\\b(armour|drone|radar|munition|gearbox)') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, ''), '(\\$|€|USD|Rs\\.) ?[0-9]') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, ''), '(?i)all rights in this bulletin') THEN -20 ELSE 0 END AS score FROM documents""")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "title", "text")
    return rows.select("doc_id", textual.relevance(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), SIGNALS).alias("score"))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z]{1,4}-[0-9]{1,4})\\b', 1)) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS docs FROM documents WHERE text IS NOT NULL)
SELECT w, count(*) AS n, count(DISTINCT doc_id) AS df, count(DISTINCT doc_id) <= any_value(docs) * 0.02 AS designator FROM t, n GROUP BY w""")
def designator_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of designators; those in more than two of a hundred texts tell nothing."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    words = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])([A-Z]{1,4}-[0-9]{1,4})(?![A-Za-z0-9_])"), F.lit(1))).alias("w"))
    per_doc = words.groupBy("w", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    by = per_doc.groupBy("w").agg(F.sum("k").cast("long").alias("n"), F.count(F.lit(1)).alias("df"))
    docs = rows.agg(F.count(F.lit(1)).alias("docs"))
    return by.crossJoin(F.broadcast(docs)).select("w", "n", "df", (F.col("df") <= F.col("docs") * 0.02).alias("designator"))


@query()
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return textual.tokens(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query()
def document_values(spark: SparkSession, d: str) -> DataFrame:
    return textual.merge_spans(textual.value_spans(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")


@query()
def value_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many words and numbers of each language lie in value spans: an overlap join summed by language."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    words = textual.tokens(docs, "doc_id", "text").where("kind != 'punct'").select("doc_id", "i", F.col("start_c").alias("ts"), F.col("end_c").alias("te"))
    spans = textual.value_spans(docs, "doc_id", "text").select("doc_id", F.col("start_c").alias("vs"), F.col("end_c").alias("ve"))
    covered = joins.overlap_join(words, spans, ["doc_id"], ("ts", "te"), ("vs", "ve")).select("doc_id", "i").distinct().withColumn("hit", F.lit(1))
    by_doc = words.join(covered, ["doc_id", "i"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("hit").alias("covered"))
    return docs.select("doc_id", "lang").join(by_doc, "doc_id").groupBy("lang").agg(F.sum("words").cast("long").alias("words"), F.sum("covered").cast("long").alias("covered")).withColumn(
        "share", F.when(F.col("words") > 0, F.round(F.col("covered") * 100.0 / F.col("words"), 2)).otherwise(0.0)
    )


@query("SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\\n]+'), lambda x: regexp_matches(x, '[a-zA-Z0-9]'))) AS lines, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers FROM documents")
def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(F.regexp_extract_all(t, F.lit(r"([^\n]+)"), F.lit(1)), lambda x: x.rlike("[a-zA-Z0-9]")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", lines.cast("long").alias("lines"), F.size(F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))).cast("long").alias("numbers"))


@query("SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '\\b((?:19|20)[0-9]{2})\\b', 1), lambda x: CAST(x AS INT)), 'max') AS newest FROM documents WHERE text IS NOT NULL")
def newest_year(spark: SparkSession, d: str) -> DataFrame:
    years = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])"), F.lit(1))
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.array_max(F.transform(years, lambda x: x.cast("int"))).alias("newest"))


@query("""
SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{M}\\p{N}_])contract([^\\p{L}\\p{M}\\p{N}_]|$)') AND regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{M}\\p{N}_])covers([^\\p{L}\\p{M}\\p{N}_]|$)') AS found FROM documents""")
def all_words_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts of any script that have all words asked for."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", (text.has_word(low, "contract") & text.has_word(low, "covers")).alias("found"))


@query()
def quote_locations(spark: SparkSession, d: str) -> DataFrame:
    """Titles of documents found again, word for word, anywhere in texts of any language."""
    docs = table(spark, d, "extracted_document", "document_id", "text").where("text is not null")
    titles = table(spark, d, "extracted_document", F.col("document_id").alias("of"), "title").where("char_length(title) >= 20").distinct()
    return textual.quotes(docs, titles, "document_id", "text", "of", "title")


@query()
def evidence_fragments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("quote", F.explode(F.filter(F.split("text", r"\n+"), lambda x: F.trim(x) != "")))
    return rows.groupBy(F.coalesce(textual.fragment_kind(F.col("quote")), F.lit("statement")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
