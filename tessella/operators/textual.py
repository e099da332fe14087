"""Text analytics on documents: tokens with exact offsets, value spans, coverage, relevance, evidence, quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Designators and calibres ("T-90", "5.56x45mm") are one word.
_TOKEN = re.compile(r"(?P<word>\d+(?:[.,]\d+)*[^\W\d_][^\W_]*|[^\W\d_][^\W_]*(?:['’-][^\W_]+)*)|(?P<number>\d+(?:[.,]\d+)*)|(?P<punct>[^\w\s])")
# Value kinds, earlier ones before later ones where they overlap.
VALUE_PATTERNS = (
    ("url", r"\b(?:https?://|www\.)[^\s<>\"]+[^\s<>\".,;:!?)]"), ("date", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("money", r"(?:USD|EUR|GBP|Rs\.|\$|€|£) ?\d[\d.,]*\d?(?: ?(?:million|billion|crore|m|bn)\b)?|\b\d[\d.,]*\d? ?(?:million|billion|Millionen|Mio\.) ?(?:€|USD|EUR)"), ("percent", r"\b\d+(?:[.,]\d+)? ?(?:%|percent\b)"),
    ("measurement", r"\b\d[\d.,]* ?(?:kg|km/h|km|mm|cm|m|tonnes|tons|t|hp|kW|square metres)\b"), ("duration", r"\b\d[\d.,]* ?(?:hours|days|weeks|months|years)\b"), ("identifier", r"\b[A-Z]{1,4}-\d{1,4}\b"), ("count", r"\b\d{1,3}(?:,\d{3})+\b|\b\d+\b"),
)
_VALUES = [(kind, re.compile(p)) for kind, p in VALUE_PATTERNS]


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, start_c, end_c, token, kind) of each word, number and mark, in code points of the unchanged text.

    Python counts code points, the JVM UTF-16 units; therefore this runs in Arrow batches. Null texts have no tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = [(r, i, m.start(), m.end(), m[0], m.lastgroup) for r, t in enumerate(part.column(1).to_pylist()) if t for i, m in enumerate(_TOKEN.finditer(t))]
                columns = [pa.array([x[j] for x in out], k) for j, k in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.string()), (5, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([x[0] for x in out], pa.int32())), *columns], names=[key, "i", "start_c", "end_c", "token", "kind"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, i int, start_c int, end_c int, token string, kind string")


def value_spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_c, end_c, kind, value) of each value; where two overlap the earlier kind of `VALUE_PATTERNS` stays."""
    def find(t: str) -> list[tuple[int, int, str]]:
        taken: list[tuple[int, int, str]] = []
        mask = bytearray(len(t))
        for kind, pattern in _VALUES:
            for m in pattern.finditer(t):
                a, e = m.span()
                if 1 not in mask[a:e]:
                    mask[a:e] = b"\1" * (e - a)
                    taken.append((a, e, kind))
        return sorted(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                out = [(r, a, e, k, t[a:e]) for r, t in enumerate(texts) if t for a, e, k in find(t)]
                columns = [pa.array([x[j] for x in out], k) for j, k in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([x[0] for x in out], pa.int32())), *columns], names=[key, "start_c", "end_c", "kind", "value"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, start_c int, end_c int, kind string, value string")


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Of overlapping spans of a document the longest stays (then the earlier, then the smaller kind); one that lies within
    kept ones stays too if it has three or more characters and a kind that none of them has.

    Greedy by document: `applyInPandas` over the document's own spans, of which there are as many as its text is long.
    """
    kind = spans.schema[key].dataType.simpleString()

    def merge(pdf):
        kept: list[tuple] = []
        for r in sorted(pdf.itertuples(index=False), key=lambda r: (r.start_c - r.end_c, r.start_c, r.kind)):
            clash = [k for k in kept if r.start_c < k.end_c and k.start_c < r.end_c]
            nested = all(k.start_c <= r.start_c and r.end_c <= k.end_c for k in clash)
            if not clash or nested and r.end_c - r.start_c >= 3 and all(k.kind != r.kind for k in clash):
                kept.append(r)
        return type(pdf)(kept, columns=pdf.columns)

    return spans.select(key, "start_c", "end_c", "kind", "value").distinct().groupBy(key).applyInPandas(merge, f"`{key}` {kind}, start_c int, end_c int, kind string, value string")


def relevance(title: Column, body: Column, weights: dict[str, tuple[str, int]]) -> Column:
    """The sum of the weights of the patterns that a text's title or body matches."""
    hay = F.concat_ws("\n", title, body)
    total = F.lit(0)
    for pattern, weight in weights.values():
        total = total + F.when(hay.rlike(pattern), weight).otherwise(0)
    return total


def fragment_kind(quote: Column) -> Column:
    """Why a quote is no statement: short, a list, a label with a value, a run of menu words; null where it is one."""
    words = F.size(F.split(F.trim(quote), r"\s+"))
    capital = F.size(F.regexp_extract_all(quote, F.lit(r"(?:^|\s)(\p{Lu}\S*)"), F.lit(1)))
    return (
        F.when(F.char_length(F.trim(quote)) < 20, "short").when(quote.rlike(r"(?m)^\s*[-*•].*\n\s*[-*•]"), "list").when(quote.rlike(r"^[^.!?:]{1,30}:\s*\S+(\s\S+){0,4}$"), "label")
        .when((words >= 5) & (capital >= words * 0.8) & ~quote.rlike("[.!?]"), "menu")
    )


def _even(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"\s+", " ")


def quote_at(text: str, quote: str) -> Column:
    """Position (from 0) of the quote column in the text column, with blanks of any width as one; -1 where it is not there."""
    return F.when(F.col(quote).isNull() | F.col(text).isNull(), -1).otherwise(F.position(_even(F.col(quote)), _even(F.col(text))) - 1)


def _least_runs(value: str, run: int, window: int, first: bool) -> np.ndarray:
    """The least hash of the runs of `run` characters in each window of `window` runs, or in the first one only."""
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(code) - run + 1
    if n < window:
        return np.empty(0, dtype=np.int64)
    n = window if first else n
    h = np.zeros(n, dtype=np.uint64)
    for i in range(run):
        h = (h + code[i : n + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    width = 1
    while width < window:  # least of ever wider windows, in log(window) steps
        step = min(width, window - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    return np.unique(h).view(np.int64)


def _anchors(rows: DataFrame, value: str, size: int, first: bool) -> DataFrame:
    """rows with `anchor`: what a text of `size` characters or more and every text that contains it have in common."""
    run = max(size // 2, min(size, 8))
    window = size - run + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [_least_runs(v, run, window, first) for v in part.column(part.num_columns - 1).to_pylist()]
                rows_of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_of), pa.array(np.concatenate(found), pa.int64())], names=["key", "anchor"])

    return rows.select(F.col("key"), F.col(value)).mapInArrow(pick, f"key {rows.schema['key'].dataType.simpleString()}, anchor long")


def quotes(docs: DataFrame, wanted: DataFrame, key: str, text: str, quote_key: str, quote: str) -> DataFrame:
    """(key, quote_key, at) of each quote in each text, wherever it stands, `at` as by `quote_at`; each once.

    Quotes are taken by classes of length. In a class a quote is known by the least hash of the runs in its first
    characters; a text that contains it has those characters in one of its windows and so the same least hash. The join on
    it proposes pairs, which are then looked at exactly. Null texts, null and empty quotes give nothing.
    """
    evened = docs.select(F.col(key).alias("key"), _even(F.col(text)).alias("hay")).where("hay is not null")
    asked = wanted.select(F.col(quote_key).alias("quote_key"), _even(F.col(quote)).alias("key")).where("key != ''").distinct()
    needles = asked.select("key").distinct().withColumn("hay", F.col("key")).withColumn("size", F.pow(F.lit(2), F.floor(F.log2(F.least(F.char_length("key"), F.lit(64))))).cast("int"))
    pairs = None
    for (size,) in sorted(needles.select("size").distinct().collect()):  # seven at most
        known = _anchors(needles.where(F.col("size") == size).select("key", "hay"), "hay", size, True).withColumnRenamed("key", "quote")
        met = _anchors(evened, "hay", size, False).join(known, "anchor").select("key", "quote")
        pairs = met if pairs is None else pairs.union(met)
    if pairs is None:
        pairs = evened.select("key", F.col("hay").alias("quote")).limit(0)
    hit = pairs.distinct().alias("p").join(evened.alias("e"), F.col("p.key").eqNullSafe(F.col("e.key"))).select("e.key", "hay", "quote")
    placed = hit.withColumn("at", F.position(F.col("quote"), F.col("hay")) - 1).where("at >= 0").join(asked.select("quote_key", F.col("key").alias("quote")), "quote")
    return placed.select(F.col("key").alias(key), F.col("quote_key").alias(quote_key), "at").distinct()
