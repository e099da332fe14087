from __future__ import annotations

from datetime import datetime

from tessella.llm import representative as R
from tessella.llm.names import Lexicon

WORDS = Lexicon({"optiks": "optiks", "optik": "optiks", "robotiks": "robotiks"})

COLUMNS = "comp_id string, name string, sector string, hq string, site string, country string, starting_year int, company_size string, srcs string, origin string, updated_at timestamp, group_id int"


def firm(i, name, sector=None, hq=None, site=None, country=None, year=None, size=None, srcs=None, origin="pipeline", day=1):
    return (i, name, sector, hq, site, country, year, size, srcs, origin, datetime(2026, 1, day), 0)


ROWS = [
    firm("a", "Bakodruno Optics Ltd", "optics", "N/A", "http://bakodruno.example", "FR", 9999, "-", '["https://x.example/1"]'),
    firm("b", "BAKODRUUNO OPTIK", "TBD", "Lifo", None, "France", 1990, "40+", '[{"url": "https://x.example/1"}, "https://x.example/2", {"url": "https://x.example/2"}]', day=2),
    firm("c", "Bakodruno", None, "Nadon", "www.bakodruno.example/en", None, 1991, None, None, "reference", 3),
    firm("d", "Bakodruno Robotics", "robotics", None, "bakodruno-robot.example", "FR", 1980, "5", "[]"),
    firm("e", None), firm("f", "", "optics"), firm("b", "BAKODRUUNO OPTIK", "TBD", "Lifo", None, "France", 1990, "40+", '[{"url": "https://x.example/1"}, "https://x.example/2", {"url": "https://x.example/2"}]', day=2),
]


def test_winners(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    groups = R.grouped(df, WORDS)
    assert {(r.comp_id, r.group_id) for r in groups.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f")}
    won = {(r.group_id, r.field): (r.comp_id, r.value) for r in R.winners(df, groups).collect()}
    assert won == {("a", "name"): ("b", "BAKODRUUNO OPTIK"), ("a", "sector"): ("a", "optics"), ("a", "hq"): ("b", "Lifo"), ("a", "site"): ("a", "http://bakodruno.example"), ("a", "country"): ("b", "France"), ("a", "starting_year"): ("b", "1990"), ("a", "company_size"): ("b", "40+")}
    record = R.records(R.winners(df, groups)).first()
    assert record.group_id == "a" and record.country == "France"
    none = df.limit(0)
    assert R.winners(none, R.grouped(none)).count() == 0


def test_votes(spark):
    """However many weaker rows agree, the best row's value wins; at one level the value with more rows does; in a hot group too."""
    many = [firm(f"w{i:05d}", "Bakodruno Optics", hq="Weak", srcs="[]") for i in range(3000)]
    level = [firm(i, "Bakodruno Optics", hq=h, srcs='["https://x.example/1"]', day=5) for i, h in (("k1", "One"), ("k2", "two"), ("k3", " Two "))]
    df = spark.createDataFrame(many + level, COLUMNS)
    groups = df.selectExpr("comp_id", "'g' AS group_id", "3003 AS n_rows")
    won = {r.field: r for r in R.winners(df, groups).collect()}
    assert (won["hq"].comp_id, won["hq"].votes, round(won["hq"].share, 3)) == ("k2", 2, 0.667)


def test_usable(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hq", x) for x in (None, "", " ", "-", "n/a", "N.A.", "TBD", "unknown", "?", "Oslo", "東京")] + [("starting_year", x) for x in ("0", "9999", "2027", "1901", "x")], "f string, v string")
    assert [r.v for r in df.where(R.usable(F.col("f"), F.col("v"), F.lit(2026))).collect()] == ["Oslo", "東京", "1901"]
