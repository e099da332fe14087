"""Queries on reading, filtering, queueing, choosing and checking rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flows, joins
from ..sources.tables import table
from .registry import query


@query("SELECT doc_id, source, n_chars, text FROM documents WHERE source = (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AND n_chars BETWEEN 200 AND 900")
def two_phase_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Small columns first; the bodies are read for the chosen keys only."""
    small = table(spark, d, "documents", "doc_id", "source", "n_chars")
    largest = small.where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").limit(1).select("source")
    chosen = small.join(F.broadcast(largest), "source").where("n_chars between 200 and 900")
    return flows.fetch_bodies(chosen, table(spark, d, "documents", "doc_id", "text"), "doc_id").select("doc_id", "source", "n_chars", "text")


@query("SELECT doc_id, fetched_at FROM documents WHERE fetched_at >= (SELECT max(fetched_at) - INTERVAL 14 DAY FROM documents)")
def read_since(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "fetched_at")
    newest = rows.agg((F.max("fetched_at") - F.expr("interval 14 days")).alias("since"))
    return flows.since(rows, "fetched_at", newest).select("doc_id", "fetched_at")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND event_type = 'click' ORDER BY event_id LIMIT 50")
def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    """The next page behind a cursor, under the filters that are given: user is left open."""
    rows = table(spark, d, "events", "event_id", "user_id", "event_type")
    return flows.page_after(flows.matching(rows, {"event_type": "click", "user_id": None}), "event_id", 100, 50)


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000")
def optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    return flows.matching(rows, {"s_nationkey": None}).where(F.col("s_acctbal").between(0, 5000)).select("s_suppkey", "s_nationkey")


@query("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'BRASS') AS brass FROM part WHERE len(list_intersect(string_split(p_type, ' '), ['PROMO', 'BRASS'])) > 0 OR p_brand = ANY(['Brand#11', 'Brand#23'])")
def tags_and_membership(spark: SparkSession, d: str) -> DataFrame:
    """Any of some tags of a blank-separated list, or a value of a list."""
    tags = F.split("p_type", " ")
    rows = table(spark, d, "part", "p_partkey", "p_type", "p_brand")
    return rows.where(F.arrays_overlap(tags, F.array(F.lit("PROMO"), F.lit("BRASS"))) | F.col("p_brand").isin("Brand#11", "Brand#23")).select("p_partkey", F.array_contains(tags, "BRASS").alias("brass"))


@query("""
WITH h AS (SELECT document_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www[.]', '') AS host FROM extracted_document WHERE url IS NOT NULL),
 b AS (SELECT host AS blocked FROM h GROUP BY host HAVING count(*) >= 3)
SELECT document_id, host FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE h.host = blocked OR h.host LIKE '%.' || blocked)""")
def unblocked_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose host and parent domains are not blocked; here frequent hosts serve as the list."""
    from ..functions import text

    rows = table(spark, d, "extracted_document", "document_id", "url").where("url is not null").select("document_id", text.host(F.col("url")).alias("host"))
    blocked = rows.groupBy("host").count().where("count >= 3").select(F.col("host").alias("blocked"))
    return flows.without_hosts(rows, "host", blocked, "blocked")


@query("SELECT doc_id, source, fetched_at FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC NULLS LAST, doc_id) <= 10")
def newest_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "source", "fetched_at").where("source is not null")
    return flows.first_per_key(rows, ["source"], [F.col("fetched_at").desc_nulls_last(), F.col("doc_id")], 10)


@query("""
WITH a AS (SELECT DISTINCT lower(trim(surface)) AS alias FROM extracted_entity_alias WHERE regexp_full_match(surface, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+|[A-Za-z]+ [A-Za-z]+')),
 t AS (SELECT document_id, ' ' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') || ' ' AS words FROM extracted_document WHERE title IS NOT NULL)
SELECT DISTINCT document_id, alias FROM t, a WHERE contains(words, ' ' || alias || ' ')""")
def aliases_in_titles(spark: SparkSession, d: str) -> DataFrame:
    """Whole-word matches of names of two and three words, by phrases of a title: an equality join, no product."""
    alias = table(spark, d, "extracted_entity_alias", "surface").where(F.col("surface").rlike("^[A-Za-z]+ [A-Za-z]+( [A-Za-z]+)?$")).select(F.lower("surface").alias("alias")).distinct()
    titles = table(spark, d, "extracted_document", "document_id", "title").where("title is not null")
    words = F.regexp_extract_all(F.lower("title"), F.lit("([a-z0-9]+)"), F.lit(1))
    return joins.phrase_matches(titles.select("document_id", words.alias("words")), "words", alias, "alias", (2, 3)).select("document_id", "alias")


@query("""
SELECT id, coalesce(meta, '') AS meta, ord <= 20 AS taken FROM (SELECT DISTINCT ON (id) id, meta, row_number() OVER (ORDER BY ms DESC NULLS LAST, id) AS ord FROM (SELECT DISTINCT id, meta, ms FROM stage_run WHERE ok IS FALSE QUALIFY row_number() OVER (PARTITION BY id ORDER BY ms DESC NULLS LAST, meta) = 1))""")
def update_top_k(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE … WHERE id IN (SELECT … LIMIT 20): the k first are chosen by a top-k, and marked by a semi-join."""
    rows = flows.first_per_key(table(spark, d, "stage_run", "id", "meta", "ms", "ok").where("ok = false"), ["id"], [F.col("ms").desc_nulls_last(), F.col("meta")], 1)
    top = rows.orderBy(F.col("ms").desc_nulls_last(), "id").limit(20).select("id", F.lit(True).alias("top"))
    return rows.join(F.broadcast(top), "id", "left").select("id", F.coalesce("meta", F.lit("")).alias("meta"), F.coalesce("top", F.lit(False)).alias("taken"))


@query("""
WITH q AS (SELECT doc_id, n_chars, fetched_at, percent_rank() OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars) AS pct, (SELECT max(fetched_at) FROM documents) AS now FROM documents WHERE n_chars IS NOT NULL AND fetched_at IS NOT NULL)
SELECT doc_id, CASE WHEN fetched_at <= now - INTERVAL 24 HOUR THEN 'P3' WHEN pct >= 0.75 THEN 'P0' WHEN pct >= 0.40 THEN 'P1' ELSE 'P2' END AS class, CASE WHEN n_chars < 200 THEN 'parked' WHEN fetched_at <= now - INTERVAL 30 DAY THEN 'deferred' ELSE 'ready' END AS state FROM q""")
def queue_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of a queued row by age and its rank in its cohort, and its state with what keeps it back."""
    rows = table(spark, d, "documents", "doc_id", "source", "n_chars", "fetched_at").where("n_chars is not null and fetched_at is not null")
    now = table(spark, d, "documents", "fetched_at").agg(F.max("fetched_at").alias("now"))
    ranked = flows.cohort_rank(rows.withColumn("cohort", F.coalesce("source", F.lit(""))), "cohort", "n_chars", "pct").crossJoin(F.broadcast(now))  # one row
    return ranked.select("doc_id", flows.queue_class(F.col("fetched_at"), F.col("now"), F.col("pct")).alias("class"), flows.queue_state(F.col("n_chars"), F.col("fetched_at"), F.col("now")).alias("state"))


@query("""
SELECT document_id, n_chars FROM extracted_document e WHERE n_chars > 300 AND NOT EXISTS (SELECT 1 FROM stage_run s WHERE s.doc_id = e.document_id AND s.ok AND s.stage = (SELECT min(stage) FROM stage_run))""")
def enqueue_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a stage has not done: an anti-join with the rows it has."""
    rows = table(spark, d, "extracted_document", "document_id", "n_chars").where("n_chars > 300")
    runs = table(spark, d, "stage_run", "stage", "doc_id", "ok")
    first = runs.agg(F.min("stage").alias("stage"))
    seen = runs.join(F.broadcast(first), "stage").where("ok and doc_id is not null").select(F.col("doc_id").alias("document_id")).distinct()
    return rows.join(seen, "document_id", "left_anti")


@query("""
SELECT id, CASE WHEN ended_at IS NULL AND started_at < (SELECT max(started_at) FROM stage_run) - INTERVAL 2 DAY THEN 'expired' WHEN ended_at IS NULL THEN 'leased' ELSE 'done' END AS state FROM (SELECT id, max(started_at) AS started_at, max(ended_at) AS ended_at FROM stage_run GROUP BY id)""")
def reap_leases(spark: SparkSession, d: str) -> DataFrame:
    """Leases by row; those older than two days count as expired."""
    rows = table(spark, d, "stage_run", "id", "started_at", "ended_at")
    per = rows.groupBy("id").agg(F.max("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))
    now = rows.agg(F.max("started_at").alias("now"))
    old = F.col("started_at") < F.col("now") - F.expr("interval 2 days")
    return per.crossJoin(F.broadcast(now)).select("id", F.when(F.col("ended_at").isNotNull(), "done").when(old, "expired").otherwise("leased").alias("state"))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    """The next 100 of a queue: class first, then first in, first out."""
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus").where("o_orderstatus = 'O'")
    return rows.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("""
SELECT doc_id, score FROM (SELECT doc_id, round(coalesce(n_chars, 0) / 100.0 / (1 + coalesce(n_chars, 0) / 8000.0) * CASE WHEN source IS NULL THEN 0.5 ELSE 1 END, 6) AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 200""")
def worklist_by_cost(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce("n_chars", F.lit(0))
    score = F.round(n / 100.0 / (1 + n / 8000.0) * F.when(F.col("source").isNull(), 0.5).otherwise(1.0), 6)
    return table(spark, d, "documents", "doc_id", "n_chars", "source").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)


@query("""
SELECT p_partkey, CASE WHEN p_type LIKE '%POLISHED BRASS%' THEN 'fine' WHEN p_type LIKE '%POLISHED%' THEN 'polished' WHEN p_type LIKE '%BRASS%' THEN 'brass' END AS category FROM part""")
def longest_keyword(spark: SparkSession, d: str) -> DataFrame:
    """The category of the longest keyword found."""
    return table(spark, d, "part", "p_partkey", "p_type").select("p_partkey", flows.longest_keyword(F.col("p_type"), {"POLISHED BRASS": "fine", "POLISHED": "polished", "BRASS": "brass"}).alias("category"))


@query("""
SELECT stage, n, string_agg(doc_id, ',' ORDER BY doc_id) AS exemplars FROM (SELECT stage, doc_id, count(*) OVER (PARTITION BY stage) AS n, row_number() OVER (PARTITION BY stage ORDER BY doc_id) AS r FROM (SELECT DISTINCT stage, doc_id FROM stage_run WHERE ok IS FALSE AND doc_id IS NOT NULL)) WHERE r <= 5 GROUP BY stage, n""")
def alarm_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Each stage's failed documents: how many, and the first five as a text."""
    rows = table(spark, d, "stage_run", "stage", "doc_id", "ok").where("ok = false and doc_id is not null").select("stage", "doc_id").distinct()
    counts = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    few = flows.first_per_key(rows, ["stage"], [F.col("doc_id")], 5).groupBy("stage").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("exemplars"))
    return counts.join(few, "stage").select("stage", "n", "exemplars")


@query("""
SELECT 'by count' AS rollup, rn, event_type, n FROM (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY event_type)
UNION ALL SELECT 'by name', rn, event_type, n FROM (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY event_type) AS rn FROM events GROUP BY event_type)""")
def two_rollups(spark: SparkSession, d: str) -> DataFrame:
    """One aggregate in two orders; the window sees one row a type."""
    by = table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = lambda name, *order: by.withColumn("rn", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("rollup"), "rn", "event_type", "n")
    return ranked("by count", F.desc("n"), "event_type").unionByName(ranked("by name", "event_type"))


@query("SELECT count(DISTINCT comp_id) AS firms, count(DISTINCT country) AS countries, count(DISTINCT sector) AS sectors, count(*) FILTER (WHERE srcs IS NULL OR srcs IN ('', '[]')) AS without_sources FROM serving_competitors")
def badge_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_competitors", "comp_id", "country", "sector", "srcs")
    return rows.agg(*(F.count_distinct(c).alias(n) for c, n in (("comp_id", "firms"), ("country", "countries"), ("sector", "sectors"))), F.count_if(F.col("srcs").isNull() | F.col("srcs").isin("", "[]")).alias("without_sources"))


@query("""
SELECT run_id, stage, count(*) AS n, coalesce(sum(n_items), 0) AS items, coalesce(sum(n_tokens), 0) AS tokens, round(avg(ms), 4) AS mean_ms, count(*) FILTER (WHERE ended_at IS NULL) AS open_rows FROM stage_run GROUP BY run_id, stage""")
def run_details(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_run", "run_id", "stage", "n_items", "n_tokens", "ms", "ended_at")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("n"), total("n_items").alias("items"), total("n_tokens").alias("tokens"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.count_if(F.col("ended_at").isNull()).alias("open_rows"))


@query("""
SELECT area, count(*) FILTER (WHERE granted IS NOT NULL AND trim(granted) <> '') AS granted, count(*) FILTER (WHERE granted IS NULL OR trim(granted) = '') AS pending, count(*) AS filed FROM (SELECT DISTINCT pub_no, area, granted FROM serving_patent) GROUP BY area""")
def granted_and_pending(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_patent", "pub_no", "area", "granted").distinct()
    given = F.col("granted").isNotNull() & (F.trim("granted") != "")
    return rows.groupBy("area").agg(F.count_if(given).alias("granted"), F.count_if(~given).alias("pending"), F.count(F.lit(1)).alias("filed"))


@query("SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice * 1000000 - l_linenumber) AS dearest, arg_min(l_linenumber, l_extendedprice * 1000000 + l_linenumber) AS cheapest FROM lineitem GROUP BY l_orderkey")
def arg_max_and_min(spark: SparkSession, d: str) -> DataFrame:
    """The row of the greatest and of the least value, ties to the lower number; two aggregates, no sort."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.groupBy("l_orderkey").agg(
        F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("dearest"), F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("cheapest")
    )


@query("SELECT source, length(text) AS n, min(doc_id) AS doc_id, count(*) AS rows_merged FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source, length(text), lower(text)")
def first_wins_by_folded_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows of equal folded key are one; the first by id stands for them."""
    rows = table(spark, d, "documents", "doc_id", "source", "text").where("text is not null and source is not null")
    return rows.groupBy("source", F.char_length("text").alias("n"), F.lower("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows_merged")).select("source", "n", "doc_id", "rows_merged")


@query("""
SELECT family, initial, count(DISTINCT canonical_name) AS spellings, min(canonical_name) AS first_name FROM (SELECT canonical_name, regexp_extract(canonical_name, '^([A-Z])[a-z]+ ([A-Z][a-z]+)$', 1) AS initial, regexp_extract(canonical_name, '^([A-Z])[a-z]+ ([A-Z][a-z]+)$', 2) AS family FROM extracted_entity WHERE entity_type = 'Person') WHERE family <> '' GROUP BY family, initial""")
def persons_by_initial(spark: SparkSession, d: str) -> DataFrame:
    """Persons of one family name and first letter."""
    part = lambda i: F.regexp_extract("canonical_name", "^([A-Z])[a-z]+ ([A-Z][a-z]+)$", i)
    rows = table(spark, d, "extracted_entity", "canonical_name", "entity_type").where("entity_type = 'Person'").select("canonical_name", part(1).alias("initial"), part(2).alias("family")).where("family != ''")
    return rows.groupBy("family", "initial").agg(F.count_distinct("canonical_name").alias("spellings"), F.min("canonical_name").alias("first_name"))


@query("""
SELECT s_nationkey, list_sort(list_distinct(flatten(list([s_name, regexp_replace(s_name, '#0+', '')])))) AS names FROM supplier GROUP BY s_nationkey""")
def list_union(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier", "s_nationkey", "s_name").select("s_nationkey", F.explode(F.array("s_name", F.regexp_replace("s_name", "#0+", ""))).alias("x")).distinct()
    return rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("x")).alias("names"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE greatest(0, date_diff('day', (SELECT max(o_orderdate) FROM orders), o_orderdate + INTERVAL 60 DAY)) END AS days_left FROM orders""")
def days_left(spark: SparkSession, d: str) -> DataFrame:
    """Calendar days to a deadline sixty days after the order; none for closed ones."""
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    today = rows.agg(F.max("o_orderdate").alias("today"))
    left = F.greatest(F.lit(0), F.datediff(F.date_add("o_orderdate", 60), F.col("today")))
    return rows.crossJoin(F.broadcast(today)).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(left).alias("days_left"))


@query("""
SELECT pub_no, ord, CASE WHEN regexp_matches(filed, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(regexp_replace(substring(filed, 1, 10), '-', '', 'g') AS INT) WHEN regexp_matches(filed, '[0-9]{4}') THEN CAST(regexp_extract(filed, '([0-9]{4})', 1) AS INT) * 10000 ELSE 0 END AS sort_key FROM serving_patent""")
def sortable_dates(spark: SparkSession, d: str) -> DataFrame:
    """A number to sort mixed printed dates by: whole dates first, then years, then nothing."""
    f = F.col("filed")
    key = F.when(f.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.regexp_replace(F.substring(f, 1, 10), "-", "").cast("int")).when(f.rlike("[0-9]{4}"), F.regexp_extract(f, "([0-9]{4})", 1).cast("int") * 10000).otherwise(0)
    return table(spark, d, "serving_patent", "pub_no", "ord", "filed").select("pub_no", "ord", key.alias("sort_key"))


@query("SELECT doc_id, source, CASE WHEN fetched_at IS NULL THEN false ELSE fetched_at >= (SELECT max(fetched_at) FROM documents) - INTERVAL 30 DAY END AS recent FROM documents")
def rolling_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the last thirty days; a row without a date is outside where a window is set."""
    rows = table(spark, d, "documents", "doc_id", "source", "fetched_at")
    now = rows.agg(F.max("fetched_at").alias("now"))
    return rows.crossJoin(F.broadcast(now)).select("doc_id", "source", F.coalesce(F.col("fetched_at") >= F.col("now") - F.expr("interval 30 days"), F.lit(False)).alias("recent"))


@query("""
SELECT l_suppkey, share, CASE WHEN share IS NULL THEN 'insufficient' WHEN share >= 58 THEN 'ahead' WHEN share >= 42 THEN 'level' ELSE 'behind' END AS verdict FROM (SELECT l_suppkey, CASE WHEN count(*) >= 5 THEN round(100.0 * count(*) FILTER (WHERE l_returnflag = 'N') / count(*), 6) END AS share FROM lineitem GROUP BY l_suppkey)""")
def verdict_bands(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("w"))
    share = F.when(F.col("n") >= 5, F.round(F.col("w") * 100.0 / F.col("n"), 6))
    return by.select("l_suppkey", share.alias("share")).withColumn("verdict", flows.banded(F.col("share"), [(58, "ahead"), (42, "level")], "behind", "insufficient"))


@query("SELECT p_partkey, round(1 - exp(-0.05 * p_size), 9) AS p FROM part")
def change_chances(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import measures

    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.round(measures.change_probability(F.lit(0.05), F.col("p_size")), 9).alias("p"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN NULL ELSE round(length(regexp_replace(text, '[ -~\\s]', '', 'g')) * 1.0 / length(text), 6) END AS foreign_share FROM documents WHERE text IS NOT NULL AND text <> ''")
def foreign_letters(spark: SparkSession, d: str) -> DataFrame:
    """The share of signs outside plain Latin, null for texts without Latin letters."""
    t = F.col("text")
    share = F.round(F.char_length(F.regexp_replace(t, r"[ -~\s]", "")) * 1.0 / F.char_length(t), 6)
    return table(spark, d, "documents", "doc_id", "text").where("text is not null and text != ''").select("doc_id", F.when(t.rlike("[A-Za-z]"), share).alias("foreign_share"))


@query("""
SELECT stage, max(started_at) AS last_at, count(*) FILTER (WHERE ended_at IS NULL) AS open_rows, max(started_at) < (SELECT max(started_at) FROM stage_run) - INTERVAL 6 HOUR AND count(*) FILTER (WHERE ended_at IS NULL) > 0 AS stalled FROM stage_run GROUP BY stage""")
def stalled_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages with open rows that have been quiet for six hours."""
    rows = table(spark, d, "stage_run", "stage", "started_at", "ended_at")
    now = rows.agg(F.max("started_at").alias("now"))
    by = rows.groupBy("stage").agg(F.max("started_at").alias("last_at"), F.count_if(F.col("ended_at").isNull()).alias("open_rows"))
    return by.crossJoin(F.broadcast(now)).select("stage", "last_at", "open_rows", ((F.col("last_at") < F.col("now") - F.expr("interval 6 hours")) & (F.col("open_rows") > 0)).alias("stalled"))


@query("SELECT (SELECT count(*) FROM extracted_document) - (SELECT count(DISTINCT doc_id) FROM stage_run WHERE stage = (SELECT max(stage) FROM stage_run) AND ok) AS lag")
def stage_lag(spark: SparkSession, d: str) -> DataFrame:
    """How many documents the last stage has not done."""
    runs = table(spark, d, "stage_run", "stage", "doc_id", "ok")
    last = runs.agg(F.max("stage").alias("stage"))
    done = runs.join(F.broadcast(last), "stage").where("ok").agg(F.count_distinct("doc_id").alias("done"))
    return table(spark, d, "extracted_document", "document_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(done)).select((F.col("n") - F.col("done")).alias("lag"))


@query("SELECT count(*) AS n, (count(*) FILTER (WHERE n_chars IS NULL) + count(*) FILTER (WHERE n_chars < 500) + count(*) FILTER (WHERE n_chars >= 500)) = count(*) AS whole, count(DISTINCT doc_id) = count(*) AS unique_ids FROM documents")
def partition_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a partition make the whole, and ids are unique."""
    n = F.col("n_chars")
    parts = F.count_if(n.isNull()) + F.count_if(n < 500) + F.count_if(n >= 500)
    return table(spark, d, "documents", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n"), (parts == F.count(F.lit(1))).alias("whole"), (F.count_distinct("doc_id") == F.count(F.lit(1))).alias("unique_ids"))


@query("""
SELECT e.entity_id, e.canonical_name AS name, 'canonical' AS kind FROM extracted_entity e WHERE canonical_name IS NOT NULL
UNION SELECT a.entity_id, a.surface, coalesce(a.alias_kind, 'alias') FROM extracted_entity_alias a JOIN extracted_entity e USING (entity_id) WHERE a.surface <> e.canonical_name""")
def canonical_and_alias_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_entity", "entity_id", "canonical_name")
    a = table(spark, d, "extracted_entity_alias", "entity_id", "surface", "alias_kind").join(e, "entity_id").where("surface != canonical_name")
    own = e.where("canonical_name is not null").select("entity_id", F.col("canonical_name").alias("name"), F.lit("canonical").alias("kind"))
    return own.union(a.select("entity_id", "surface", F.coalesce("alias_kind", F.lit("alias")))).distinct()


@query("""
WITH p AS (SELECT a.entity_id AS a, b.entity_id AS b, a.canonical_name AS x, b.canonical_name AS y, a.entity_type = b.entity_type AS same_type FROM extracted_entity a JOIN extracted_entity b ON a.redirects_to = b.entity_id),
 s AS (SELECT a, b, same_type, len(list_intersect(string_split(lower(x), ' '), string_split(lower(y), ' '))) * 1.0 / len(list_distinct(string_split(lower(x), ' ') || string_split(lower(y), ' '))) AS surface FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND x <> '' AND y <> '')
SELECT a, b, round(0.85 * surface + 0.15 * CASE WHEN same_type THEN 1 ELSE 0 END, 6) AS score FROM s""")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """A blended score of proposed pairs; what is missing takes no weight."""
    e = table(spark, d, "extracted_entity", "entity_id", "canonical_name", "entity_type", "redirects_to")
    l, r = e.alias("l"), e.alias("r")
    pairs = l.join(r, F.col("l.redirects_to") == F.col("r.entity_id")).where("l.canonical_name != '' and r.canonical_name != ''")
    x, y = F.split(F.lower("l.canonical_name"), " "), F.split(F.lower("r.canonical_name"), " ")
    surface = F.size(F.array_intersect(x, y)) * 1.0 / F.size(F.array_union(x, y))
    same = F.when(F.col("l.entity_type") == F.col("r.entity_type"), 1.0).otherwise(0.0)
    return pairs.select(F.col("l.entity_id").alias("a"), F.col("r.entity_id").alias("b"), F.round(flows.blended([(surface, 0.85), (same, 0.15)]), 6).alias("score"))


@query("SELECT doc_id, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS least_chunks FROM documents WHERE text IS NOT NULL AND text <> ''")
def least_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null and text != ''")
    return rows.select("doc_id", F.ceil(F.char_length("text") / 1000.0).alias("least_chunks"))


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts in chunks of whole lines of at most 1000 characters, lines longer than that for themselves."""
    return flows.chunks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 1000)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, json_extract_string('{\"a\": [' || n_nationkey || ', 7], \"b\": {\"name\": \"' || n_name || '\"}}', '$.b.name') AS name, CAST(json_array_length('[' || n_nationkey || ', 7]') AS BIGINT) AS n FROM nation")
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    """Values out of nested JSON by path and by schema."""
    doc = F.format_string('{"a": [%s, 7], "b": {"name": "%s"}}', F.col("n_nationkey"), F.col("n_name"))
    rows = table(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("k"), F.from_json(doc, "a array<int>, b struct<name: string>").alias("j"))
    return rows.select("k", "j.b.name", F.size("j.a").cast("long").alias("n"))
