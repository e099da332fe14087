"""Queries on selections, gates, votes and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, select as S, textual
from ..sources.tables import table
from .registry import query


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN url IS NULL THEN 'no_url' WHEN title IS NULL OR title = '' THEN 'no_title' WHEN language IS NULL OR language = 'und' THEN 'unlabelled' WHEN n_chars < 400 THEN 'short' ELSE 'passed' END AS reason FROM extracted_document) GROUP BY reason""")
def refusal_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", "url", "title", "language", "n_chars")
    checks = {"no_url": F.col("url").isNull(), "no_title": F.col("title").isNull() | (F.col("title") == ""), "unlabelled": F.col("language").isNull() | (F.col("language") == "und"), "short": F.col("n_chars") < 400}
    return S.tally(rows.withColumn("reason", S.first_reason(checks)), "reason")


@query("""
WITH c AS (SELECT surface, min(entity_id) AS e, count(DISTINCT entity_id) AS n FROM extracted_entity_alias WHERE entity_id IS NOT NULL GROUP BY surface)
SELECT a.alias_id, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' END AS reason FROM extracted_entity_alias a LEFT JOIN c ON c.surface = a.surface WHERE a.entity_id IS NULL""")
def unique_alias_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entity_alias", "alias_id", "entity_id", "surface")
    return S.unique_match(rows.where("entity_id is null").drop("entity_id"), "alias_id", rows.where("entity_id is not null").select("surface", "entity_id"), ["surface"], "entity_id")


@query("""
SELECT name, country, votes FROM (SELECT name, country, votes, row_number() OVER (PARTITION BY name ORDER BY votes DESC, x DESC, country) AS rn FROM (SELECT name, country, count(*) AS votes, max(CAST(length(country) = 2 AS INT)) AS x FROM serving_competitors WHERE country IS NOT NULL AND name IS NOT NULL GROUP BY ALL)) WHERE rn = 1""")
def country_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_competitors", "name", "country").where("name is not null").withColumn("exact", F.char_length("country") == 2)
    return S.vote(rows, "name", "country", "exact")


@query()
def budgeted_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, newest first, while they fit a budget of characters."""
    rows = table(spark, d, "documents", "source", "doc_id", F.col("n_chars").cast("double").alias("cost"))
    return S.budgeted(rows, "source", ["doc_id"], "cost", 20_000.0)


@query("SELECT comp_id, c AS column, FROM (SELECT comp_id, unnest(['sector', 'hq', 'site', 'srcs', 'starting_year']) AS c, unnest([sector, hq, site, srcs, CAST(starting_year AS VARCHAR)]) AS v FROM serving_competitors) WHERE v IS NULL OR trim(v) IN ('', '[]', 'null')".replace("column, FROM", "column FROM"))
def declared_gaps(spark: SparkSession, d: str) -> DataFrame:
    return S.gaps(table(spark, d, "serving_competitors", "comp_id", "sector", "hq", "site", "srcs", "starting_year"), "comp_id", ["sector", "hq", "site", "srcs", "starting_year"])


@query("""
WITH n AS (SELECT max(started_at) AS now FROM stage_run), m AS (SELECT doc_id, max(started_at) AS last FROM stage_run WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT d.document_id FROM extracted_document d LEFT JOIN m ON m.doc_id = d.document_id, n WHERE m.last IS NULL OR date_diff('day', CAST(m.last AS DATE), CAST(now AS DATE)) >= 90""")
def due_for_scan(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "stage_run", F.col("doc_id").alias("document_id"), "started_at")
    now = runs.agg(F.max("started_at").alias("now"))
    docs = table(spark, d, "extracted_document", "document_id").crossJoin(F.broadcast(now))  # one row
    return S.due(docs, runs.where("document_id is not null"), ["document_id"], "started_at", F.col("now"), 90).select("document_id")


@query("""
SELECT source, host, document_id FROM (SELECT source_id AS source, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, document_id, row_number() OVER (PARTITION BY source_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY first_seen, document_id) AS rn FROM extracted_document WHERE url IS NOT NULL) WHERE rn = 1""")
def one_per_domain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", F.col("source_id").alias("source"), "url", "document_id", "first_seen").where("url is not null")
    h = text.host(F.col("url"))
    return S.one_representative(rows, ["source"], h, [F.col("first_seen"), F.col("document_id")]).select("source", h.alias("host"), "document_id")


@query("""
WITH h AS (SELECT 'document' AS kind, document_id AS id, title AS text FROM extracted_document WHERE contains(lower(title), 'plant') UNION ALL SELECT 'patent', pub_no, title FROM serving_patent WHERE contains(lower(title), 'plant') UNION ALL SELECT 'firm', comp_id, assess FROM serving_competitors WHERE contains(lower(assess), 'plant'))
SELECT kind, id, text, total FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM h) WHERE rn <= 20""")
def grouped_search(spark: SparkSession, d: str) -> DataFrame:
    """A report: the first twenty of each kind, with the true counts."""
    views = {
        "document": (table(spark, d, "extracted_document", "document_id", "title"), "document_id", "title"),
        "patent": (table(spark, d, "serving_patent", "pub_no", "title"), "pub_no", "title"),
        "firm": (table(spark, d, "serving_competitors", "comp_id", "assess"), "comp_id", "assess"),
    }
    return S.grouped_search(views, ["plant"], 20).select("kind", "id", "text", "total")


@query()
def word_majority(spark: SparkSession, d: str) -> DataFrame:
    """The class word that most documents have within forty characters of a designator."""
    tok = textual.tokens(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    spans = textual.value_spans(docs, "doc_id", "text").where("kind = 'identifier'").select("doc_id", F.col("start_c").alias("at"), F.col("value").alias("item"))
    words = tok.where(F.lower("token").isin("gearboxes", "drone", "radar", "armour", "munitions", "crankshafts")).select("doc_id", F.col("start_c").alias("word_at"), F.lower("token").alias("label"))
    return S.majority_by_distance(spans, words.withColumn("source", F.col("doc_id")), ["doc_id"], "at", "word_at", "item", "label", "source")


@query("SELECT comp_id, name, k AS pub_no FROM (SELECT DISTINCT c.comp_id, c.name, p.pub_no AS k FROM serving_competitors c JOIN serving_patent p ON p.assignee = c.name UNION SELECT DISTINCT c.comp_id, c.name, p.pub_no FROM serving_competitors c JOIN serving_patent p ON lower(p.assignee) = lower(c.name) WHERE NOT EXISTS (SELECT 1 FROM serving_patent q WHERE q.assignee = c.name))")
def fallback_match(spark: SparkSession, d: str) -> DataFrame:
    """Exact names first; folded ones only for rows without an exact match."""
    c = table(spark, d, "serving_competitors", "comp_id", "name").where("name is not null").withColumn("fold", F.lower("name")).distinct()
    p = table(spark, d, "serving_patent", "pub_no", "assignee").where("assignee is not null").withColumn("fold", F.lower("assignee")).distinct()
    got = S.unmatched_refold(c, p, F.col("l.name") == F.col("r.assignee"), "comp_id", ["fold"])
    return got.select("comp_id", "name", F.col("r_pub_no").alias("pub_no")).distinct()


@query("SELECT CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars < 500 THEN 'short' WHEN n_chars < 1500 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM documents) + 0.5) AS BIGINT) AS pct FROM documents GROUP BY 1")
def bucket_split(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.measures import js_round

    n = F.col("n_chars")
    by = table(spark, d, "documents", "n_chars").groupBy(F.when(n.isNull(), "none").when(n < 500, "short").when(n < 1500, "middle").otherwise("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("bucket", "n", js_round(F.col("n") * 100.0 / F.col("all")).alias("pct"))


@query("""
WITH w AS (SELECT comp_id, unnest(string_split(lower(name), ' ')) AS w FROM serving_competitors), v AS (SELECT DISTINCT assignee, unnest(string_split(lower(assignee), ' ')) AS w FROM serving_patent),
df AS (SELECT w FROM v GROUP BY w HAVING count(DISTINCT assignee) * 20 <= (SELECT count(DISTINCT assignee) FROM v)), s AS (SELECT assignee, comp_id, count(DISTINCT v.w) AS n FROM v JOIN df USING (w) JOIN w USING (w) WHERE v.w <> '' GROUP BY ALL)
SELECT assignee, comp_id, n FROM (SELECT *, row_number() OVER (PARTITION BY assignee ORDER BY n DESC, comp_id) AS rn FROM s) WHERE rn = 1""")
def best_token_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each assignee goes to the firm that shares most telling words (those of at most a twentieth of the assignees)."""
    w = table(spark, d, "serving_competitors", "comp_id", "name").select("comp_id", F.explode(F.split(F.lower("name"), " ")).alias("w")).where("w != ''").distinct()
    v = table(spark, d, "serving_patent", "assignee").distinct().select("assignee", F.explode(F.array_distinct(F.split(F.lower("assignee"), " "))).alias("w")).where("w != ''")
    every = table(spark, d, "serving_patent", "assignee").agg(F.count_distinct("assignee").alias("all"))
    telling = v.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(every)).where("df * 20 <= all").select("w").join(w.select("w").distinct(), "w", "left_semi")  # one row
    sets = lambda df, key: df.join(telling, "w").groupBy(key).agg(F.sort_array(F.collect_set("w")).alias("ws"))
    return S.most_shared(sets(v, "assignee"), sets(w, "comp_id"), "assignee", "comp_id", "ws")
