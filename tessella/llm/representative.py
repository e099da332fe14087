"""One record for each firm from its several rows, field by field.

Rows are tied to firms by identity of name and line of business (linking.py) and by the host of their site. The fields
are unpivoted to long rows (row, field, value); values that say nothing are dropped. Each row votes for its normalised value
with its source's trust times its evidence and recency, and votes are summed by value; the value of the greatest sum wins
(max_by) and the winners are pivoted back to one record.

The task wants the value of the best row, however many weaker rows agree on another one. A row's vote is therefore a power
of a base greater than the number of rows: its exponent is the row's level among the levels (trust, distinct URLs, time of
update) of its group. In such a base a sum is a number whose digits are the votes by level, so the sum of all lower rows
stays below one vote of a level, and sums are compared by their leading digit, which is what is kept of them: the highest
level that voted for the value, and how many of its rows did. No sum is ever rounded, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.materialize import materialize, tidied
from .linking import answers, identities, parsed, questions, targets, with_point
from .names import Lexicon, split

FIELDS = ("name", "sector", "hq", "site", "country", "starting_year", "company_size")
# Entries that say nothing, in lower case without blanks and signs at their ends.
NOTHING = (
    "", "na", "n/a", "n.a", "none", "null", "nil", "tbd", "tba", "tbc", "unknown", "not known", "undisclosed", "not disclosed", "not available", "not applicable",
    "not specified", "unspecified", "undefined", "missing", "no data", "no information", "to be determined", "to be confirmed", "various", "other", "see above", "xxx", "x",
)
#: Years outside these are impossible; the later one is for rows without a time of update.
EARLIEST_YEAR, LATEST_YEAR = 1500, 2100
#: Trust in a source by origin; others have `ELSE`.
TRUST, ELSE = {"pipeline": 1.0, "reference": 0.5}, 0.25
#: Share of all rows that must have a sector for its words to be a line of business; it bounds the words held.
SECTOR = 5e-3


def tidy(value: Column) -> Column:
    """A value in lower case, single blanks, without signs and blanks at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)\s+", " "), r"(?U)^[\W_]+|[^\w+)]+$", "")


def usable(field: Column, value: Column, year: Column) -> Column:
    """Whether a value says something; a year lies between `EARLIEST_YEAR` and the year its row was updated in."""
    plain = tidy(value)
    says = value.isNotNull() & ~plain.isin(*NOTHING) & value.rlike(r"(?U)\w")
    number = value.try_cast("int")
    possible = number.between(F.lit(EARLIEST_YEAR), F.coalesce(year, F.lit(LATEST_YEAR)))
    return says & F.when(field == "starting_year", F.coalesce(possible, F.lit(False))).otherwise(True)


def distinct_urls(srcs: Column) -> Column:
    """How many different URLs stand in a JSON text of any shape; 0 for null."""
    plain = F.regexp_replace(F.coalesce(srcs, F.lit("")), r"\\/", "/")
    return F.size(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(https?://[^\s\"\\]+)"), F.lit(1))))


def host(site: Column) -> Column:
    """The host of a site without www., null where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(site, F.lit(""))), r"^\s*(?:https?://)?(?:www\.)?([^/\s:?#]+\.[^/\s:?#]+)", 1)
    return F.when(found != "", found)


def phonetic_column(word: Column) -> Column:
    """names.phonetic of an already folded word, as an expression."""
    for pattern, by in (("c(?!h)", "k"), ("w", "v"), ("ph", "f"), ("q", "k"), ("x", "ks")):
        word = F.regexp_replace(word, pattern, by)
    return word


def sector_words(rows: DataFrame) -> Lexicon:
    """A lexicon of the words of frequent sectors, each the line of business it is written in; for rows without other names."""
    said = tidy(F.col("sector"))
    counts = rows.select(said.alias("sector")).where(F.col("sector").isNotNull() & ~F.col("sector").isin(*NOTHING)).groupBy("sector").count()
    total = rows.count()
    words: dict[str, str] = {}
    for r in counts.where(F.col("count") >= max(2.0, total * SECTOR)).orderBy("count", "sector").collect():  # at most 1 / SECTOR
        words |= {w: r.sector for w in split(r.sector)[0] if len(w) > 2}
    return Lexicon(words)


@tidied
def grouped(rows: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """(comp_id, group_id, n_rows) for each row of non-null comp_id; group_id is the least comp_id of its firm.

    A row's line of business comes from its name, else from its sector. Rows tie to their (business, name) identity and to
    their host. Rows of which no row with the same host has a line of business go to the one firm whose names answer best; where several firms
    answer equally well, or none, a row stays alone (or with rows of the same bare name that are alone too). `words` is a
    lexicon learned from names (lexicon.py); without one the words of frequent sectors serve.
    """
    words = sector_words(rows) if words is None else words
    base = rows.where("comp_id is not null").select("comp_id", "name", "sector", "site").distinct()
    # a sector names a line of business where most of its words are of one
    known = F.create_map(*[F.lit(x) for pair in sorted(words.business.items()) for x in pair]) if words.business else F.create_map().cast("map<string,string>")
    # the sector's words as names are folded; a business word may stand with others ("steel industries")
    folded = F.transform(F.split(tidy(F.coalesce("sector", F.lit(""))), "[^a-z0-9]+"), phonetic_column)
    codes = F.array_distinct(F.filter(F.transform(folded, lambda w: F.element_at(known, w)), lambda c: c.isNotNull()))
    code = F.when(F.size(codes) == 1, codes[0])
    names = parsed(base.select(F.col("comp_id").alias("key"), F.concat_ws("\t", code, F.lower(host(F.col("site")))).alias("owner"), F.coalesce(code, F.lit("")).alias("role"), "name"), words)
    named = names.withColumn("business", F.when(F.col("business") != "", F.col("business")).otherwise(F.col("role"))).withColumn("kind", F.when(F.col("kind").isin("p", "i"), "f").otherwise(F.col("kind")))
    read = materialize(with_point(named.drop("owner").join(base.select(F.col("comp_id").alias("key"), host(F.col("site")).alias("host")), "key")))
    full = read.join(identities(read), ["space", "word"])
    mine = F.concat(F.lit("r|"), "key")
    edges = full.select(mine.alias("a"), F.col("identity").alias("b")).union(read.where("host is not null").select(mine.alias("a"), F.concat(F.lit("s|"), "host").alias("b")))
    first = materialize(components(edges))
    labelled = materialize(read.withColumn("node", mine).join(first, "node", "left").withColumn("label", F.col("component")))
    sure = labelled.where("space is not null").select("label").distinct()
    known = labelled.join(sure, "label", "left_semi")
    lone = materialize(labelled.join(sure, "label", "left_anti"))  # also rows that only share a host with such rows
    settled = answers(questions(lone), targets(known)).select(F.concat(F.lit("r|"), "key").alias("a"), F.col("label").alias("b"))
    loose = lone.join(settled.select(F.col("a").alias("node")), "node", "left_anti").where("head != ''")
    alike = loose.select(F.col("node").alias("a"), F.concat(F.lit("h|"), "head").alias("b"))
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(settled).union(alike))
    group = base.select("comp_id").distinct().withColumn("node", F.concat(F.lit("r|"), "comp_id")).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = group.groupBy("component").agg(F.min("comp_id").alias("group_id"), F.count(F.lit(1)).alias("n_rows"))
    return group.join(least, "component").select("comp_id", "group_id", "n_rows")


def _backwards(text: Column) -> Column:
    """A text that sorts the other way round."""
    return F.concat(F.translate(F.hex(F.encode(text, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def winners(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, field, comp_id, value, votes, share) for each group of two or more rows and field with a usable value.

    votes is how many rows of the winner's level voted for its normalised value, share their part of all votes of that level.
    Ties between values go to the one with more votes in all, then to the least comp_id; of the rows of a value and level the
    least comp_id stands for it. Rows are counted before they meet, so a group with a third of all rows is no list anywhere.
    """
    rows = rows.select("comp_id", *FIELDS, "srcs", "origin", F.col("updated_at").cast("timestamp").alias("updated_at"))
    trust = F.coalesce(*[F.when(F.col("origin") == o, F.lit(t)) for o, t in TRUST.items()], F.lit(ELSE))
    weighed = rows.join(groups.where("n_rows > 1").select("comp_id", "group_id"), "comp_id").withColumns({
        "level": F.struct(trust.alias("trust"), distinct_urls(F.col("srcs")).alias("urls"), F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))).alias("at")),
        "year": F.year("updated_at"),
    })
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS])
    long = weighed.select("group_id", "comp_id", "level", "year", F.explode(pairs).alias("x")).select("group_id", "comp_id", "level", "year", "x.field", "x.value")
    good = long.where(usable(F.col("field"), F.col("value"), F.col("year"))).withColumn("plain", tidy(F.col("value")))
    digits = good.groupBy("group_id", "field", "plain", "level").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("comp_id", "value")).alias("row"))
    sums = digits.groupBy("group_id", "field", "plain").agg(F.max_by(F.struct("level", "votes", "row"), F.struct("level", "votes")).alias("lead"), F.sum("votes").alias("all"))
    order = F.struct("lead.level", "lead.votes", "all", _backwards(F.col("lead.row.comp_id")))
    won = sums.groupBy("group_id", "field").agg(F.max_by("lead", order).alias("w"))
    level = digits.groupBy("group_id", "field", "level").agg(F.sum("votes").alias("of_level"))
    same = (F.col("won.group_id") == F.col("l.group_id")) & (F.col("won.field") == F.col("l.field")) & (F.col("won.w.level") == F.col("l.level"))
    return won.alias("won").join(level.alias("l"), same).select("won.group_id", "won.field", "w.row.comp_id", "w.row.value", "w.votes", (F.col("w.votes") / F.col("of_level")).alias("share"))


def records(won: DataFrame) -> DataFrame:
    """One row for each group: the winning value of each field, null where no row has a usable one."""
    return won.groupBy("group_id").pivot("field", list(FIELDS)).agg(F.first("value"))
