"""The pN_ queries: each callable takes (spark, directory of the tables) and returns a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import languages, lexicon, linking
from . import mixing
from . import near_duplicates as nd
from . import personal, representative, sentences, tokens


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    members, _ = nd.near_duplicates(table(spark, directory, "extracted_document", "document_id", "text"))
    return nd.duplicate_pairs(members)


def p1_classes(spark: SparkSession, directory: str) -> DataFrame:
    return nd.duplicate_classes(*nd.near_duplicates(table(spark, directory, "extracted_document", "document_id", "text")))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return sentences.split(table(spark, directory, "extracted_document", "document_id", "text"))


def p3_segments(spark: SparkSession, directory: str) -> DataFrame:
    return languages.segmented(table(spark, directory, "extracted_document", "document_id", "text", "language"), table(spark, directory, "language_ref"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return languages.questionable(p3_segments(spark, directory))


def _survivors(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "serving_competitors")
    words = lexicon.learn(table(spark, directory, "extracted_entity", "entity_id", "canonical_name"), table(spark, directory, "extracted_entity_alias", "entity_id", "surface"))
    return representative.winners(rows, representative.grouped(rows, words))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return _survivors(spark, directory).select("group_id", "field", "comp_id")


def p4_records(spark: SparkSession, directory: str) -> DataFrame:
    return representative.records(_survivors(spark, directory))


def _names(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, directory, "extracted_entity", "entity_id", "canonical_name", "redirects_to"),
        table(spark, directory, "extracted_entity_alias", "alias_id", "entity_id", "surface"),
        table(spark, directory, "serving_patent", "pub_no", "assignee"),
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return linking.linked(*_names(spark, directory))


def p5_members(spark: SparkSession, directory: str) -> DataFrame:
    return linking.members(*_names(spark, directory))


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.encoded(table(spark, directory, "documents", "doc_id", "text"))


def p6_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """The texts again; null texts come back empty."""
    return tokens.decoded(p6_ids(spark, directory))


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mixed(table(spark, directory, "documents"), table(spark, directory, "source_mix"))[0]


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.shares(*mixing.mixed(table(spark, directory, "documents"), table(spark, directory, "source_mix")))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return personal.located(table(spark, directory, "documents", "doc_id", "text"))


def p8_redacted(spark: SparkSession, directory: str) -> DataFrame:
    kinds = {r.kind: r.placeholder for r in table(spark, directory, "pii_kind", "kind", "placeholder").collect()}  # a row a kind
    return personal.rewritten(table(spark, directory, "documents", "doc_id", "text"), kinds)


def p8_surrogates(spark: SparkSession, directory: str) -> DataFrame:
    """With the key of the session's setting tessella.key; a fixed one of these tables' own where none is set, for invented texts only."""
    key = spark.conf.get("tessella.key", "key for invented texts")
    return personal.rewritten(table(spark, directory, "documents", "doc_id", "text"), key=key.encode())


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p3_found, p3_segments, p4_found, p4_records, p5_found, p5_members, p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_redacted, p8_surrogates)}
SQL: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
