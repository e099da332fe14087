"""String functions as column expressions; only Unicode folding, for which Spark has no function, runs in Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Trailing words of legal forms, and a boundary that knows letters of all scripts.
LEGAL_TAIL = r"(?:\s+(?:ltd|limited|inc|incorporated|corp|corporation|co|company|gmbh|ag|kg|sa|sas|sl|srl|spa|oy|oyj|ab|as|bv|nv|plc|llc|pvt|ltda))+$"
_B, _E = r"(?U)(?<!\w)", r"(?!\w)"


@F.arrow_udf(T.StringType())
def unicode_fold(values: pa.Array) -> pa.Array:
    """Decomposed, without combining marks, composed again (Hangul stays whole), caseless. Null stays null."""
    def one(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x and x.lower()
        kept = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return unicodedata.normalize("NFC", kept).casefold()

    return pa.array([one(x) for x in values.to_pylist()], pa.string())


def squeeze(value: Column) -> Column:
    """Punctuation as blanks, single blanks, trimmed; letters and digits of every script stay."""
    return F.trim(F.regexp_replace(value, r"(?U)[\W_]+", " "))


def company_key(folded: Column) -> Column:
    """A folded firm name without legal form; kept whole where nothing else would be left."""
    plain = squeeze(F.regexp_replace(F.regexp_replace(folded, "&", " and "), r"\.", ""))
    bare = F.regexp_replace(plain, LEGAL_TAIL, "")
    return F.when(bare == "", plain).otherwise(bare)


def has_word(text: Column, word: str) -> Column:
    """Whether a word stands in the text between non-word characters of any script; the word is taken literally."""
    return text.rlike(_B + r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E" + _E)


def grams(value: Column, n: int = 3) -> Column:
    """The distinct n-grams of a text padded with one blank at each end; none for null or empty texts."""
    padded = F.concat(F.lit(" "), value, F.lit(" "))
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
    return F.when(F.length(value) > 0, F.array_distinct(F.transform(at, lambda i: F.substring(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct items; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def host(url: Column) -> Column:
    """The host of a URL in small letters without www.; null where the URL has none."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www[.]", ""), F.lit(""))


def url_key(url: Column) -> Column:
    """A URL's identity: host and path without language segments, index files, query, fragment and closing slash."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/index\.[a-z]+$", "")
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: (p != "") & ~p.rlike("^[a-z]{2}(-[a-z]{2})?$"))
    return F.concat_ws("/", host(url), F.array_join(parts, "/"))


def is_listing(url: Column, title: Column) -> Column:
    """Whether a page only lists others: no path, a listing segment at the end, a page parameter, or an index title."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    index_title = F.lower(F.coalesce(title, F.lit(""))).rlike(r"^[^|–-]*\b(news|archive|press releases|all articles)\s*([|–-]|$)")
    return path.rlike(r"^/*$|/(news|tag|tags|category|archive|search|press)/*$") | query.rlike(r"(^|&)(page|paged|p)=[0-9]+(&|$)") | index_title


def clip(value: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(value) > n, F.concat(F.rtrim(F.substring(value, 1, n - 1)), F.lit("…"))).otherwise(value)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def initialism(value: Column, least: int = 3) -> Column:
    """First letters of a name of `least` or more words of letters only; null otherwise."""
    words = F.filter(F.split(F.trim(value), r"\s+"), lambda w: w.rlike(r"(?U)^[^\W\d_]+$"))
    return F.when(F.size(words) >= least, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def unescape(value: Column) -> Column:
    """The five named entities and the no-break blank, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def strip_tags(value: Column) -> Column:
    return squeeze_blanks(F.regexp_replace(value, "<[^>]*>", " "))


def squeeze_blanks(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def language_code(value: Column, known: list[str], default: str = "en") -> Column:
    """The first two letters of a label if they name a known language."""
    code = F.substring(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z]", ""), 1, 2)
    return F.when(code.isin(*known), code).otherwise(default)


def scripts(value: Column) -> Column:
    """The scripts whose letters occur, in alphabetical order."""
    # Script names of the regular expression engine.
    names = ["Arabic", "Cyrillic", "Devanagari", "Han", "Hangul", "Hiragana", "Katakana", "Latin", "Thai"]
    return F.array_compact(F.array(*[F.when(value.rlike(rf"\p{{Is{n}}}"), F.lit(n)) for n in names]))


def contains_run(a: Column, b: Column) -> Column:
    """Whether one list of words stands in the other in one run."""
    x, y = (F.concat(F.lit(" "), squeeze_blanks(c), F.lit(" ")) for c in (a, b))
    return F.contains(x, y) | F.contains(y, x)
