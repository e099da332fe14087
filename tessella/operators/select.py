"""Selections and gates with reasons: budgets, worklists, votes, ambiguous matches refused, gaps and due work."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize


def first_reason(checks: dict[str, Column]) -> Column:
    """The name of the first check that holds, in order; null where none does."""
    out = None
    for name, test in checks.items():
        out = F.when(F.coalesce(test, F.lit(False)), name) if out is None else out.when(F.coalesce(test, F.lit(False)), name)
    return out


def tally(rows: DataFrame, reason: str) -> DataFrame:
    """How often each reason was given; null reasons are the rows that passed."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def unique_match(rows: DataFrame, key: str, candidates: DataFrame, on: list[str], value: str) -> DataFrame:
    """(key, value, reason): the value where exactly one candidate matches; `none` and `ambiguous` refuse."""
    by = candidates.groupBy(*on).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n"))
    joined = rows.join(by, on, "left")
    reason = F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "ambiguous")
    return joined.select(key, F.when(F.col("_n") == 1, F.col(value)).alias(value), reason.alias("reason"))


def vote(rows: DataFrame, key: str, value: str, exact: str) -> DataFrame:
    """The value with most votes, then the one seen exactly, then the least: (key, value, votes)."""
    by = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.max(F.col(exact).cast("int")).alias("_x"))
    return by.groupBy(key).agg(F.expr(f"min_by(struct({value}, votes), struct(-votes, -_x, {value}))").alias("w")).select(key, F.col(f"w.{value}").alias(value), "w.votes")


def budgeted(rows: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Greedy within each group: items in order while they fit what is left; one that does not fit is skipped, and cheaper
    ones behind it may still fit. A running sum cannot tell this, so the fold runs over sorted rows and holds one number."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator) -> Iterator:
        current, left = object(), 0.0
        for pdf in batches:
            keep = []
            for g, c in zip(pdf[group], pdf[cost]):
                if g != current:
                    current, left = g, budget
                ok = c is not None and c == c and c <= left
                left -= c if ok else 0
                keep.append(ok)
            yield pdf[keep]

    ordered = rows.where(F.col(group).isNotNull()).repartition(F.col(group)).sortWithinPartitions(group, *order)
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def gaps(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) for each declared column that is null, empty or an empty list."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])
    return rows.select(key, F.explode(pairs).alias("x")).where("x.value is null or x.value in ('', '[]', 'null')").select(key, "x.column")


def due(work: DataFrame, marks: DataFrame, on: list[str], scanned: str, now: Column, days: int) -> DataFrame:
    """Work that was never scanned or last scanned `days` ago or earlier."""
    last = marks.groupBy(*on).agg(F.max(scanned).alias("_last"))
    return work.join(last, on, "left").where(F.col("_last").isNull() | (F.datediff(now, F.col("_last")) >= days)).drop("_last")


def unmatched_refold(left: DataFrame, right: DataFrame, first: Column, key: str, fallback: list[str]) -> DataFrame:
    """Matches under `first`; only rows without any are matched again by equality on `fallback`."""
    one = left.alias("l").join(right.alias("r"), first).select("l.*", *[F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns])
    rest = left.join(one.select(key).distinct(), key, "left_anti")
    two = rest.alias("l").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in fallback]).select("l.*", *[F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns])
    return one.unionByName(two)


def majority_by_distance(mentions: DataFrame, words: DataFrame, on: list[str], at: str, word_at: str, item: str, label: str, source: str, reach: int = 40, least: int = 2) -> DataFrame:
    """(item, label, sources): the label that most distinct sources have within `reach` of the item, if at least `least`
    and more than half of them do."""
    from .joins import near_join

    near = near_join(mentions, words, on, at, word_at, reach).select(item, label, source).distinct()
    by = near.groupBy(item, label).agg(F.count(F.lit(1)).alias("sources"))
    w = Window.partitionBy(item)
    ranked = by.withColumn("_all", F.sum("sources").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col("sources").desc(), label)))
    return ranked.where((F.col("_rn") == 1) & (F.col("sources") >= least) & (F.col("sources") * 2 > F.col("_all"))).select(item, label, "sources")


def one_representative(rows: DataFrame, key: list[str], domain: Column, order: list[Column]) -> DataFrame:
    """One row for each key and domain, the first by order."""
    w = Window.partitionBy(*key, domain).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def grouped_search(views: dict[str, tuple[DataFrame, str, str]], words: list[str], limit: int) -> DataFrame:
    """Rows of several tables whose text has every word: (kind, id, text, total, place), `limit` of each kind for display,
    with the true count beside them. views: kind to (frame, id column, text column)."""
    parts = None
    for kind, (df, key, text) in views.items():
        test = F.lit(True)
        for w in words:
            test = test & F.contains(F.lower(F.col(text)), F.lit(w.lower()))
        hit = df.where(test).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
        parts = hit if parts is None else parts.unionByName(hit)
    total = parts.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    return parts.withColumn("place", place).where(F.col("place") <= limit).join(total, "kind")


#: Words of a set up to which all its subsets are listed.
SUBSETS = 8


def most_shared(left: DataFrame, right: DataFrame, key: str, item: str, words: str) -> DataFrame:
    """(key, item, n) of the item of `right` that shares most words with each key of `left`, ties to the least item.

    Both hold arrays of distinct words without blanks, sorted. Equal sets are looked up once. A set of few words is looked up by
    each of its subsets, of which the right keeps the least item only, so the rows do not grow with the items that share a
    frequent word; sets of more than `SUBSETS` words meet by single words.
    """
    name = F.array_join(words, " ").alias("set")
    keys = materialize(left.where(F.size(words) > 0).select(key, words, name))
    asked = keys.select("set", words).distinct()
    known = materialize(right.where(F.size(words) > 0).groupBy(words).agg(F.min(item).alias(item)).select(words, name.alias("other"), item))
    few = F.size(words) <= SUBSETS
    bit = lambda m, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1
    every = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1)
    part = F.explode(F.transform(every, lambda m: F.filter(words, lambda _, i: bit(m, i)))).alias("part")
    listed = lambda df, *more: df.where(few).select(*more, part).withColumn("n", F.size("part").cast("long")).withColumn("part", F.array_join("part", " "))
    best = listed(known, item).groupBy("part").agg(F.min(item).alias(item))
    found = listed(asked, "set").join(best, "part").select("set", item, "n")
    each = lambda df, *more: df.select(*more, F.explode(words).alias("word"))
    for a, b in ((asked.where(~few), known), (asked.where(few), known.where(~few))):
        met = each(a, "set").join(each(b, "other", item), "word")
        found = found.unionByName(met.groupBy("set", "other").agg(F.min(item).alias(item), F.count(F.lit(1)).alias("n")).drop("other"))
    won = found.groupBy("set").agg(F.min_by(F.struct(item, "n"), F.struct(-F.col("n"), F.col(item).isNull(), item)).alias("b"))
    return keys.join(won, "set").select(key, f"b.{item}", "b.n")
