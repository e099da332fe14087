"""Words of lines of business and given names, learned from names that are known to mean the same.

A word of very many entities (`ROOT` of them) is a root: a line of business or a given name, since own words and family
names recur in few. Roots that stand together in one name nearly always ("forge works") are one class. Where an alias has
another word in place of a root of its entity's own name, the word is exchanged for the root; a word that is exchanged for one
class in most of its entities is a translation, abbreviation or pet form of it. Words that differ by a slip (an edit or
two) are taken out first, so that a misspelt own word is not held for a form of what the other name has beside it. Classes
seen with legal forms are lines of business, the others given names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize, release
from .names import Lexicon, split

#: Share of all entities that must have a word for it to be a root (six at least). At most a bag's words over this are roots.
ROOT = 1.5e-3
#: Share of all entities that must have a word for it to be a form of a root; it bounds what the driver and workers hold.
FORM = 5e-5
#: Part of a word's entities in which it must be exchanged for its class.
MOST = 0.25


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, words, legal) of each name."""
    for batch in batches:
        names = [split(n) for n in batch.column(1).to_pylist()]
        words = [sorted({w for w in ws if len(w) > 1}) for ws, _, _ in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array([bool(f) for _, f, _ in names], pa.bool_())], names=["entity", "words", "legal"])


def _exchanges(own: DataFrame, other: DataFrame, roots: list[str]) -> DataFrame:
    """(entity, word, other): words that stand in place of a root in another name of the entity with which they share a word."""
    known = F.array(*[F.lit(w) for w in roots])
    plain = lambda w: ~F.array_contains(known, w)

    def left(one, two):  # slips of words that are no roots taken out
        slip = lambda a: F.exists(F.array_except(two, one), lambda b: plain(b) & (F.levenshtein(a, b) <= 2))
        return F.filter(F.array_except(one, two), lambda a: ~(plain(a) & (F.length(a) > 3) & slip(a)))

    both = own.select("entity", F.col("words").alias("one")).join(other.select("entity", F.col("words").alias("two")), "entity").where(F.arrays_overlap("one", "two"))
    both = both.select("entity", left(F.col("one"), F.col("two")).alias("l"), left(F.col("two"), F.col("one")).alias("r"))
    turn = lambda x, y: both.select("entity", F.explode(x).alias("word"), F.array_intersect(y, known).alias("y")).select("entity", "word", F.explode("y").alias("other"))
    return turn("l", "r").unionByName(turn("r", "l"))


def learn(entities: DataFrame, aliases: DataFrame, pets: dict[str, str] | None = None) -> Lexicon:
    """A lexicon from `entities` (entity_id, canonical_name) and `aliases` (entity_id, surface).

    Null names and ids say nothing; repeated rows count once, since entities are counted. An entity with very many aliases costs
    one comparison an alias. Empty tables give an empty lexicon.
    """
    schema = "entity string, words array<string>, legal boolean"
    own = entities.select(F.col("entity_id").alias("entity"), F.col("canonical_name").alias("name")).where("entity is not null and name is not null").mapInArrow(_words, schema)
    other = aliases.select(F.col("entity_id").alias("entity"), F.col("surface").alias("name")).where("entity is not null and name is not null").mapInArrow(_words, schema)
    every = materialize(own.withColumn("own", F.lit(True)).unionByName(other.withColumn("own", F.lit(False))).distinct())
    per = every.select("entity", "legal", F.explode("words").alias("word")).groupBy("word", "entity").agg(F.max("legal").alias("legal"))
    counts = materialize(per.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("legal").alias("legal")))
    total = every.where("own").agg(F.count_distinct("entity")).first()[0]
    root, form = max(6, math.ceil(total * ROOT)), max(1, math.ceil(total * FORM))
    found = {r.word: (r.n, r.legal) for r in counts.where(F.col("n") >= root).collect()}  # bounded by ROOT
    exchanged: dict[str, Counter] = defaultdict(Counter)
    together: dict[tuple[str, str], int] = {}
    size = dict(found)
    if found:
        roots = sorted(found)
        pairs = _exchanges(every.where("own"), every.where("not own"), roots)
        tally = pairs.groupBy("word", "other").agg(F.count_distinct("entity").alias("k")).join(counts, "word").where(F.col("n") >= form)
        for r in tally.select("word", "other", "k", "n", "legal").collect():  # bounded by FORM: words of a bag over it, times the roots each is exchanged for
            size[r.word] = (r.n, r.legal)
            exchanged[r.word][r.other] = r.k
        mine = every.select("entity", F.array_intersect("words", F.array(*[F.lit(w) for w in roots])).alias("mine")).where(F.size("mine") > 1)
        beside = mine.select("entity", "mine", F.explode("mine").alias("word")).select("entity", "word", F.explode("mine").alias("other")).where("word < other")
        for r in beside.groupBy("word", "other").agg(F.count_distinct("entity").alias("k")).collect():  # pairs of roots
            together[(r.word, r.other)] = together[(r.other, r.word)] = r.k
    release(counts)
    release(every)
    return Lexicon(*_classes(found, size, exchanged, together), pets)


def _classes(found: dict[str, tuple[int, int]], size: dict[str, tuple[int, int]], exchanged: dict[str, Counter], together: dict[tuple[str, str], int]) -> tuple[dict[str, str], dict[str, str]]:
    """(words of lines of business, given names), each with the name of its class."""
    head = {w: w for w in found}

    def top(w: str) -> str:
        while head[w] != w:
            w = head[w]
        return w

    for w in sorted(found, key=lambda w: (-found[w][0], w)):
        for v in found:  # a phrase: mostly in one name
            if v != w and together.get((w, v), 0) >= 0.4 * found[w][0] and together.get((v, w), 0) >= 0.4 * found[v][0] and top(v) != top(w):
                head[max(top(v), top(w))] = min(top(v), top(w))
    for w in sorted(found, key=lambda w: (found[w][0], w)):  # a root that is a form of a more frequent one
        sums: Counter = Counter()
        for v, k in exchanged.get(w, {}).items():
            if v in found and (found[v][0], v) > (found[w][0], w):
                sums[top(v)] = max(sums[top(v)], k)
        for v, k in sums.most_common(1):
            if k >= MOST * found[w][0] and v != top(w):
                head[top(w)] = v
    classes = {w: top(w) for w in found}
    for w, others in exchanged.items():
        if w in found:
            continue
        sums = Counter()
        for v, k in others.items():
            sums[classes[v]] = max(sums[classes[v]], k)
        c, k = sums.most_common(1)[0]
        trade = found[c][1] > 0.1 * found[c][0]
        if k >= MOST * size[w][0] and k >= (2 if trade else 1) and len(w) > 1:
            classes[w] = c
    business = {w: c for w, c in classes.items() if found[c][1] > 0.1 * found[c][0]}
    return business, {w: c for w, c in classes.items() if w not in business}
