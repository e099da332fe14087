"""Queries for writes expressed as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml
from ..sources.tables import table
from .registry import query

_LATEST = "SELECT pub_no, status, country, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY pub_no ORDER BY updated_at DESC NULLS LAST, ord) AS rn FROM serving_patent) WHERE rn = 1"
_FIRST = "SELECT pub_no, status, country, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY pub_no ORDER BY updated_at, ord) AS rn FROM serving_patent) WHERE rn = 1"


def _patents(spark: SparkSession, d: str, newest: bool) -> DataFrame:
    rows = table(spark, d, "serving_patent", "pub_no", "status", "country", "updated_at", "ord")
    order = [F.col("updated_at").desc_nulls_last(), F.col("ord")] if newest else [F.col("updated_at"), F.col("ord")]
    return dml.latest(rows, ["pub_no"], order).drop("ord")


@query(f"WITH o AS ({_FIRST}), n AS ({_LATEST}) SELECT coalesce(o.pub_no, n.pub_no) AS pub_no, coalesce(n.status, o.status) AS status, coalesce(n.country, o.country) AS country, coalesce(n.updated_at, o.updated_at) AS updated_at FROM o FULL JOIN n ON o.pub_no = n.pub_no")
def carry_forward_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered rows with a null status must not clear the known one."""
    return dml.upsert(_patents(spark, d, False), _patents(spark, d, True), ["pub_no"])


@query("SELECT entity_id AS id, canonical_name AS name FROM extracted_entity UNION ALL SELECT alias_id, surface FROM (SELECT DISTINCT alias_id, surface FROM extracted_entity_alias) WHERE alias_id NOT IN (SELECT entity_id FROM extracted_entity)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "extracted_entity", F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"))
    new = table(spark, d, "extracted_entity_alias", F.col("alias_id").alias("id"), F.col("surface").alias("name")).distinct()
    return dml.insert_ignore(old, new, ["id"])


@query("""
WITH r AS (SELECT comp_id, sector, nullif(hq, '') AS hq FROM serving_competitors WHERE origin = 'pipeline'), b AS (SELECT name, min(sector) AS sector, min(nullif(hq, '')) AS hq FROM serving_competitors WHERE origin = 'reference' GROUP BY name)
SELECT c.comp_id, coalesce(nullif(c.sector, ''), b.sector) AS sector, coalesce(nullif(c.hq, ''), b.hq) AS hq FROM serving_competitors c LEFT JOIN b ON c.name = b.name WHERE c.origin = 'pipeline'""")
def carry_forward_blanks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_competitors", "comp_id", "name", "sector", "hq", "origin")
    before = rows.where("origin = 'reference' and name is not null").groupBy("name").agg(F.min("sector").alias("sector"), F.min(F.nullif("hq", F.lit(""))).alias("hq"))
    return dml.carry_forward(rows.where("origin = 'pipeline'"), before, ["name"], ["sector", "hq"]).select("comp_id", "sector", "hq")


@query("SELECT comp_id, name, origin FROM serving_competitors WHERE origin IS DISTINCT FROM 'reference' UNION ALL SELECT comp_id, upper(name), 'reference' FROM serving_competitors WHERE origin = 'reference'")
def replace_owned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_competitors", "comp_id", "name", "origin")
    return dml.replace_owned(rows, rows.where("origin = 'reference'").withColumn("name", F.upper("name")), "origin", "reference")


@query("SELECT document_id, coalesce(json_extract_string(meta, '$.set'), 'none') AS set_name, 'seen' AS state, json_extract_string(meta, '$.found_by') AS found_by FROM extracted_document")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object merged with new keys keeps what it had."""
    rows = table(spark, d, "extracted_document", "document_id", "meta")
    merged = rows.withColumn("m", dml.merge_json(F.lit('{"set": "none"}'), dml_meta(F.col("meta"))))
    return merged.select("document_id", F.col("m")["set"].alias("set_name"), F.col("m")["state"].alias("state"), F.col("m")["found_by"].alias("found_by"))


def dml_meta(meta):
    return F.to_json(dml.merge_json(meta, F.lit('{"state": "seen"}')))


@query("SELECT alias_id, surface FROM extracted_entity_alias WHERE NOT coalesce(regexp_matches(lower(surface), '^(the|messrs\\.?) '), false)")
def conditional_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entity_alias", "alias_id", "surface")
    return dml.deleted(rows, F.lower("surface").rlike(r"^(the|messrs\.?) "))


@query("SELECT pub_no, max(updated_at) AS updated_at FROM serving_patent GROUP BY pub_no")
def ledger_union(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_patent", "pub_no", "updated_at")
    return dml.union_ledger(rows.where("pub_no < 'XM'"), rows, ["pub_no"], "updated_at")
