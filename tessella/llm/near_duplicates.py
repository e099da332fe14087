"""Groups of rows that carry nearly the same text, by an inverted index over positional bytes with a count filter.

A text is decomposed (NFKD), lower-cased and kept to letters and digits; its features are the distinct runs of `RUN`
characters. Each text gets a signature of `ENTRIES` positions. A position holds bytes made of the least values of `WIDTH`
keyed hashes over the features, so two texts of likeness J hold the same bytes at a position with probability J**WIDTH.
The index has one posting for each (position, bytes). One byte alone would put a 256th of all rows into each posting,
which makes the tally quadratic; the bytes of a position are therefore 7 wide.

Rows of one posting are paired by a join on it. Two count filters follow: the positions' low bits, packed into two longs,
must agree often enough (`BITS` of 128, checked inside the join before anything is shuffled), and pairs must share at
least `LEAST` positions. For likeness 0.5 the two lose about one pair in a thousand together, and less above; rows tied
by a chain usually have further pairs. What is left is verified exactly on the feature sets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.materialize import materialize, tidied

RUN = 12
ENTRIES, WIDTH = 80, 3
BITS, LEAST = 79, 2
#: Postings above this are paired in blocks of about so many rows each.
HOT = 2000
SEED = 20240229

_DROP = re.compile(r"[\W_]+")
_MIX, _ROLL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Only the letters and digits of the decomposed text, in lower case."""
    return _DROP.sub("", unicodedata.normalize("NFKD", text).lower())


def features(letters: str, run: int = RUN) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `run` characters; a shorter text is one run."""
    if not letters:
        return np.empty(0, dtype=np.uint64)
    code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = max(1, len(code) - run + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(run, len(code))):
        h = h * _ROLL + code[i : n + i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _keys(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def signature(found: np.ndarray, keys: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The entries (position in the highest byte, 7 bytes below it) and two longs of the low bits of the least values."""
    least = np.full(len(keys), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):  # bounded memory for very long texts
        part = (found[None, at : at + 2048] * keys[:, None]) >> np.uint64(17)
        np.minimum(least, part.min(axis=1), out=least)
    cells = least.reshape(-1, width)
    h = np.zeros(len(cells), dtype=np.uint64)
    for i in range(width):
        h = (h ^ cells[:, i]) * _MIX
        h ^= h >> np.uint64(31)
    entries = (np.arange(len(cells), dtype=np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    mixed = least[:128] * _ROLL
    bits = np.packbits((mixed >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64)
    return entries.view(np.int64), bits


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = _keys(ENTRIES * WIDTH)
    for batch in batches:
        ids, rids, sizes, parts, entries, one, two = [], [], [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            letters = plain(text) if text else ""
            if not letters or i is None:
                continue
            found = features(letters)
            e, bits = signature(found, keys)
            ids.append(i)
            rids.append(int.from_bytes(hashlib.blake2b(letters.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
            sizes.append(len(found))
            parts.append((found >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())  # sorted, 40 bits each
            entries.append(e)
            one.append(bits[0])
            two.append(bits[1])
        flat = pa.array(np.concatenate(entries) if entries else np.empty(0, dtype=np.int64), pa.int64())
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * ENTRIES, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(rids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
            names=["id", "rid", "size", "hashes", "entries", "s1", "s2"],
        )


def _opened(part: bytes) -> np.ndarray:
    """The sorted 40-bit hashes of a text's features."""
    wide = np.zeros((len(part) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(part, dtype=np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(rid: int, part: bytes) -> np.ndarray:
        if rid in kept:
            kept.move_to_end(rid)
            return kept[rid]
        kept[rid] = _opened(part)
        if len(kept) > 200:
            kept.popitem(last=False)
        return kept[rid]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        like = []
        for ra, rb, ta, tb in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = of(ra, ta), of(rb, tb)
            both = len(np.intersect1d(x, y))
            like.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], names=["a", "b", "likeness"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of `texts` (rid, size, hashes) whose likeness reaches `threshold`; a pair of sizes too far apart cannot.

    Feature hashes travel, not texts, cut to 40 bits: in a text of 10,000 runs about one in 20,000 meets another by chance.
    """
    left, right = (texts.select(F.col("rid").alias(x), F.col("size").alias(f"n{x}"), F.col("hashes").alias(f"h{x}")) for x in "ab")
    sized = pairs.join(left.drop("ha"), "a").join(right.drop("hb"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1).select("a", "b")
    full = sized.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").sortWithinPartitions("b")
    return full.mapInArrow(_verify, "a long, b long, likeness double").where(F.col("likeness") >= threshold)


def _pairs(left: DataFrame, right: DataFrame, also: Column | None = None) -> DataFrame:
    """Pairs of one posting whose low bits agree often enough; `also` is a further condition on the sides l and r."""
    agree = 128 - F.bit_count(F.col("l.s1").bitwiseXOR(F.col("r.s1"))) - F.bit_count(F.col("l.s2").bitwiseXOR(F.col("r.s2")))
    same = F.col("l.entry") == F.col("r.entry")
    both = left.alias("l").join(right.alias("r"), (same if also is None else same & also) & (F.col("l.rid") < F.col("r.rid")) & (agree >= BITS))
    return both.select(F.col("l.rid").alias("a"), F.col("r.rid").alias("b"), F.col("l.entry").alias("entry"))


def _blocks(warm: DataFrame) -> DataFrame:
    """The pairs of full postings (`warm` has the rows n of each): every row is sent to the cells of its block with each block."""
    count = F.ceil(F.col("n") / HOT).cast("int")
    cut = warm.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("count")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    rows = cut.select("rid", "s1", "s2", "entry", "block", every.alias("other"))
    left = rows.select("rid", "s1", "s2", "entry", F.col("block").alias("one"), F.col("other").alias("two"))
    right = rows.select("rid", "s1", "s2", "entry", F.col("other").alias("one"), F.col("block").alias("two"))
    return _pairs(left, right, (F.col("l.one") == F.col("r.one")) & (F.col("l.two") == F.col("r.two")))


@tidied
def near_duplicates(rows: DataFrame, id_column: str = "document_id", text_column: str = "text", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has `id`, `rid` (its distinct normalised text) and `class_id` (the least rid tied to it by
    links, or its own); links has `a`, `b` (rids) and their likeness.

    Rows of null, empty or blank text, or without letters and digits, or of null id, are in neither. Texts that are equal
    once normalised share one rid and are compared once; a repeated id stands as often as it was given. Other columns are
    ignored, whatever their names. Texts shorter than a run have themselves as their only feature.

    A posting of more than `HOT` rows is cut into blocks by a hash of the row, and each two blocks are paired by a task of
    their own, so links are whole at every size: their number grows with the square of a class of differing texts.
    """
    source = rows.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    signed = materialize(source.mapInArrow(_sign, "id string, rid long, size int, hashes binary, entries array<long>, s1 long, s2 long"))
    one = signed.select("rid", "entries", "s1", "s2").dropDuplicates(["rid"])
    index = materialize(one.select("rid", "s1", "s2", F.explode("entries").alias("entry")))
    hot = materialize(index.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT))
    texts = signed.select("rid", "size", "hashes").dropDuplicates(["rid"])
    if hot.isEmpty():
        tally = _pairs(index, index)
    else:
        cold = index.join(hot, "entry", "left_anti")
        tally = _pairs(cold, cold).union(_blocks(index.join(hot, "entry")))
    shared = tally.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    links = materialize(verified(shared.select("a", "b"), texts, threshold))
    classes = components(links).withColumnRenamed("node", "rid")
    members = signed.select("id", "rid").join(classes, "rid", "left").select("id", "rid", F.coalesce("component", "rid").alias("class_id"))
    return members, links


def duplicate_pairs(members: DataFrame) -> DataFrame:
    """Each two different ids of one class, once, the smaller first."""
    ids = members.select("class_id", "id").distinct()
    return (
        ids.alias("l").join(ids.alias("r"), (F.col("l.class_id") == F.col("r.class_id")) & (F.col("l.id") < F.col("r.id")))
        .select(F.col("l.id").alias("document_id_a"), F.col("r.id").alias("document_id_b"))
    )


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each id: its class (the least id of it), the rows of the class and the links of its text to other texts."""
    ends = links.select(F.col("a").alias("rid")).union(links.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    named = members.groupBy("class_id").agg(F.min("id").alias("class_document_id"), F.count(F.lit(1)).alias("n_rows"))
    return (
        members.join(named, "class_id").join(ends, "rid", "left")
        .select(F.col("id").alias("document_id"), "class_document_id", "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
