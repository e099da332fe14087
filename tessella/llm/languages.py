"""Languages of texts and of their stretches, by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a character model of order `ORDER` with absolute discounting: the highest order on counts, the lower ones
on the number of different characters before an n-gram, the lowest mixed with an even spread. Languages of one script share
a table for each order: sorted 64-bit hashes of the n-grams of any of them, beside a row of log-probabilities and a row of
back-off weights with a column for each language. A sentence is scored on the letters of its own script; a cost for each
change of language cuts a text into stretches, and a stretch has the language of the lowest cross-entropy a character.

A fifth of the labelled sample is held out. It gives each language the cross-entropy beyond which a sentence is rejected:
rejected sentences have no say in the language of their text, unless all of it is rejected. It also scales the confidence, so
that of answers with confidence c about the part c is right.

The models are fitted on a bounded sample of the labelled rows (`SAMPLE` different texts for each language, `PIECES` pieces of
each); as labels are partly wrong, the sample's pieces are relabelled by the models and the models fitted again.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import opening_words, sentences

ORDER, SAMPLE, PIECES = 5, 300, 100
#: Every so manieth text of the sample is held out; part of a language's own held-out sentences that are rejected.
HELD, SHARE = 5, 0.002
#: Orders of the models of each pass over the sample; low ones cannot learn wrongly labelled pieces by heart.
ORDERS = (2, 3, 3, 3, ORDER)
#: Cost of a change of language between sentences, and the characters beyond which confidence grows no more.
CHANGE, ENOUGH = 7.0, 60
#: Weight of pieces in which capitals do not tell names from words.
UNSURE = 0.25
# Letters of each script but Latin, with the weight of one letter against one Latin letter.
SCRIPTS = {
    "Cyrl": ("Ѐ-ԯ", 1.0), "Arab": ("؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿", 1.2), "Deva": ("ऀ-ॿ", 1.2), "Thai": ("฀-๿", 1.0),
    "Hang": ("ᄀ-ᇿ㄰-㆏가-힯", 2.0), "Kana": ("぀-ヿㇰ-ㇿ", 2.0), "Han": ("㐀-䶿一-鿿豈-﫿", 3.0),
}
# The script of the models for each script name of the reference table.
MODEL_OF = {"Latn": "Latn", "Cyrl": "Cyrl", "Arab": "Arab", "Deva": "Deva", "Thai": "Thai", "Kore": "Hang", "Jpan": "Kana", "Hans": "Han", "Hant": "Han", "Hani": "Han"}
# Bibliographic three-letter codes beside the terminological ones.
ALSO = {"ger": "de", "fre": "fr", "dut": "nl", "chi": "zh", "per": "fa"}
CASED = ("Latn", "Cyrl")
_FIND = {k: re.compile(f"[{v[0]}]") for k, v in SCRIPTS.items()}
_KEEP = {
    "Latn": re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*"), **{k: re.compile(f"[{SCRIPTS['Han'][0]}{SCRIPTS['Kana'][0]}]+") for k in ("Han", "Kana")},
    **{k: re.compile(f"[{SCRIPTS[k][0]}\u200c]+") for k in ("Cyrl", "Arab", "Deva", "Thai", "Hang")},
}
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def script_of(piece: str) -> str:
    """The script a piece is written in; names in Latin letters within another script count little."""
    if piece.isascii():
        return "Latn"
    weight = {k: len(f.findall(piece)) * SCRIPTS[k][1] for k, f in _FIND.items()}
    if weight["Kana"] >= 4.0 or weight["Kana"] and not weight["Han"]:
        weight["Kana"] += weight.pop("Han")
    best = max(weight, key=weight.__getitem__)
    latin = sum(len(w) if w[0].islower() else 0.15 * len(w) for w in _LATIN.findall(piece))
    return best if weight[best] > 0 and weight[best] >= 0.25 * latin else "Latn"


def letters(piece: str, script: str) -> str:
    """The piece as its model sees it: composed, small, the letters of the script, one blank between words.

    In scripts with capitals only words that begin small count where there are enough, since the others are mostly names.
    """
    words = _KEEP[script].findall(unicodedata.normalize("NFC", piece))
    if script in CASED:
        small = [w for w in words if w[0].islower()]
        if sum(map(len, small)) >= 8:
            words = small
    return " " + " ".join(words).lower() + " "


def _grams(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order the hashes of the n-grams that end at each position, where there is room for one (else 0)."""
    out = []
    mixed = (code + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    h = mixed.copy()
    out.append(h)
    for n in range(1, order):
        h = np.zeros_like(code)
        h[n:] = (out[-1][:-1] if n > 0 else code)[n - 1 :] * _MUL + mixed[n:]
        out.append(h)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each begins."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return code, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, dtype=np.int64)


def _depth(n: int, begin: np.ndarray, order: int) -> np.ndarray:
    """How many characters of its own text stand up to each position, at most `order`."""
    at = np.arange(n)
    first = np.zeros(n, dtype=np.int64)
    first[begin[begin < n]] = begin[begin < n]
    return np.minimum(at - np.maximum.accumulate(first) + 1, order)


def _fit(texts: list[str], order: int) -> list[dict]:
    """Counts of one language by order: hash, count (continuations below the highest order), context and suffix hashes."""
    code, begin = _codes(texts)
    grams, depth = _grams(code, order), _depth(len(code), begin, order)
    out: list[dict] = [{} for _ in range(order)]
    for n in range(order, 0, -1):
        at = np.nonzero(depth >= n)[0]
        keys, index, count = np.unique(grams[n - 1][at], return_index=True, return_counts=True)
        where = at[index]
        if n < order:
            up = out[n]
            if len(up["key"]):
                suffix, continuations = np.unique(up["suffix"], return_counts=True)
                got = np.searchsorted(suffix, keys).clip(max=len(suffix) - 1)
                count = np.where(suffix[got] == keys, continuations[got], 1)
        out[n - 1] = {"key": keys, "count": count.astype(np.float64), "context": grams[n - 2][where - 1] if n > 1 else np.zeros(len(keys), dtype=np.uint64), "suffix": grams[n - 2][where] if n > 1 else None}
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted).clip(max=max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


class Table:
    """The models of the languages of one script."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages = sorted(texts)
        fitted = [_fit(texts[x], order) for x in self.languages]
        width = len(self.languages)
        alphabet = len(np.unique(np.concatenate([f[0]["key"] for f in fitted]))) + 1
        self.floor = -np.log(alphabet + 50.0)
        self.keys, self.prob, self.back = [], [], []
        for n in range(order):
            total = np.concatenate([f[n]["key"] for f in fitted])
            weight = np.concatenate([f[n]["count"] for f in fitted])
            keys, inverse = np.unique(total, return_inverse=True)
            if n >= 3:  # n-grams seen once are left to the lower orders
                keys = keys[np.bincount(inverse, weights=weight) > 1]
            prob = np.zeros((len(keys), width), dtype=np.float32)
            back = np.zeros((len(self.keys[n - 1]) if n else 1, width), dtype=np.float32)
            for column, f in enumerate(fitted):
                part = f[n]
                count, context = part["count"], part["context"]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                groups, which = np.unique(context, return_inverse=True)
                sums, kinds = np.bincount(which, weights=count), np.bincount(which)
                gamma = discount * kinds / np.maximum(sums, 1e-9)
                if n:
                    at, hit = _find(groups, self.keys[n - 1])
                    back[hit, column] = np.log(np.maximum(gamma[at[hit]], 1e-9))
                elif len(gamma):
                    back[0, column] = np.log(max(gamma[0], 1e-9))
                own, mine = _find(part["key"], keys)
                part["direct"] = np.where(mine, np.maximum(count[own] - discount, 0) / np.maximum(sums[which[own]], 1e-9), 0.0)
            # lower orders and back-off of every key, by the suffix and context of any language that has it
            suffix, context = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
            if n:
                for f in fitted:
                    at, hit = _find(f[n]["key"], keys)
                    suffix[hit], context[hit] = f[n]["suffix"][at[hit]], f[n]["context"][at[hit]]
                low, has = _find(self.keys[n - 1], suffix)
                lower = np.where(has[:, None], self.prob[n - 1][low], self.floor)
                at, hit = _find(self.keys[n - 1], context)
                weight_of = np.where(hit[:, None], back[at], 0.0)
            else:
                lower, weight_of = np.full((len(keys), width), self.floor), np.broadcast_to(back[0], (len(keys), width))
            for column, f in enumerate(fitted):
                prob[:, column] = np.log(np.maximum(f[n]["direct"] + np.exp(weight_of[:, column] + lower[:, column]), 1e-12))
            self.keys.append(keys)
            self.prob.append(prob)
            if n:
                self.back.append(back)
            else:
                self.even = back[0]
        self.limit = np.full(width, np.inf)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text under each language, and its length."""
        width, order = len(self.languages), len(self.keys)
        code, begin = _codes(texts)
        total = np.zeros((len(code), width), dtype=np.float32)
        grams, depth = _grams(code, order), _depth(len(code), begin, order)
        todo = np.arange(len(code))
        for n in range(order, 0, -1):
            if not len(todo):
                break
            can = depth[todo] >= n
            at, hit = _find(self.keys[n - 1], grams[n - 1][todo])
            hit &= can
            total[todo[hit]] += self.prob[n - 1][at[hit]]
            todo, can = todo[~hit], can[~hit]
            if n > 1:
                fall = todo[can]
                at, has = _find(self.keys[n - 2], grams[n - 2][fall - 1])
                total[fall[has]] += self.back[n - 2][at[has]]
        total[todo] += self.floor + self.even
        sizes = np.diff(np.append(begin, len(code)))
        return np.add.reduceat(total, begin, axis=0) if len(begin) else np.zeros((0, width), dtype=np.float32), sizes

    def calibrate(self, held: list[tuple[str, str]], share: float = SHARE) -> None:
        """Sets each language's limit so that `share` of its held-out pieces (language, letters) of 20 letters or more lie beyond it."""
        for column, language in enumerate(self.languages):
            own = [t for x, t in held if x == language and len(t) >= 20]
            if len(own) >= 20:
                scores, sizes = self.score(own)
                self.limit[column] = np.quantile(-scores[:, column] / sizes, 1 - share) * 1.02


class Identifier:
    """Tables by script; scripts of a single language need none."""

    def __init__(self, samples: dict[str, list[list[str]]], scripts: dict[str, str], orders: tuple[int, ...] = ORDERS):
        """samples: texts, each as its pieces, by (noisy) language label; scripts: the model script of each language."""
        self.only: dict[str, str] = {}
        self.tables: dict[str, Table] = {}
        #: Factor of the margin in the confidence, held-out pieces, the part of them that is named rightly, and (confidence, rightness) by bands.
        self.scale, self.held, self.accuracy, self.reliability = 1.0, 0, 1.0, []
        margins: list[tuple[float, bool]] = []
        by_script = defaultdict(list)
        for language, script in sorted(scripts.items()):
            by_script[script].append(language)
        for script, languages in by_script.items():
            if len(languages) == 1:
                self.only[script] = languages[0]
                continue
            docs = [(x, [t for p in doc if script_of(p) == script and len(t := letters(p, script)) >= 8]) for x in languages for doc in samples.get(x, [])]
            docs = [(x, ts) for x, ts in docs if ts]
            kept, docs = docs[::HELD], [d for i, d in enumerate(docs) if i % HELD]
            table = self._table(docs, languages, orders[0])
            for order in orders[1:3]:  # whole texts first
                scores = [table.score([" ".join(ts)])[0][0] for _, ts in docs]
                docs = [(table.languages[int(s.argmax())], ts) for s, (_, ts) in zip(scores, docs)]
                table = self._table(docs, languages, order)
            pieces = [(x, [t]) for x, ts in docs for t in ts]
            for order in orders[3:]:
                scores, _sizes = table.score([ts[0] for _, ts in pieces]) if pieces else ([], [])
                pieces = [(table.languages[int(s.argmax())], ts) for s, (_, ts) in zip(scores, pieces)]
                table = self._table(pieces, languages, order)
            self.tables[script] = table
            if not kept:
                continue
            # the language of a held-out text is that of its whole; its pieces are then named one by one
            scores, _sizes = table.score([" ".join(ts) for _, ts in kept])
            held = [(table.languages[int(s.argmax())], t) for s, (_, ts) in zip(scores, kept) for t in ts]
            table.calibrate(held)
            scores, sizes = table.score([t for _, t in held])
            for (x, _), row, n in zip(held, scores, sizes):
                first, second = np.sort(row)[::-1][:2]
                margins.append(((first - second) / n * min(n, ENOUGH), table.languages[int(row.argmax())] == x))
            # the limits stand; the models are fitted once more on the whole sample
            final = self._table(pieces + [(x, [t]) for x, t in held], languages, orders[-1])
            final.limit = table.limit
            self.tables[script] = final
        self._settle(margins)

    def _settle(self, margins: list[tuple[float, bool]]) -> None:
        """The factor of the margin under which the held-out answers are likeliest."""
        if not margins:
            return
        m, right = np.array([x for x, _ in margins]), np.array([y for _, y in margins])
        self.held, self.accuracy = len(m), float(right.mean())

        def loss(k: float) -> float:
            p = 1 / (1 + np.exp(-np.clip(k * m, 0, 30)))
            return float(-np.log(np.where(right, p, 1 - p).clip(1e-6)).mean())

        self.scale = min((0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
        p = 1 / (1 + np.exp(-np.clip(self.scale * m, 0, 30)))
        for low, high in ((0.5, 0.7), (0.7, 0.9), (0.9, 0.99), (0.99, 1.01)):
            here = (p >= low) & (p < high)
            if here.any():
                self.reliability.append((round(float(p[here].mean()), 3), round(float(right[here].mean()), 3), int(here.sum())))

    @staticmethod
    def _table(docs: list[tuple[str, list[str]]], languages: list[str], order: int) -> Table:
        texts: dict[str, list[str]] = {x: [] for x in languages}
        for x, ts in docs:
            texts[x] += ts
        return Table({x: ts or [f" {x} "] for x, ts in texts.items()}, order)

    def pieces(self, pieces: list[str]) -> list[tuple[str, dict[str, float], int]]:
        """(script, log-probability by language, letters) of each piece; no languages where nothing is known of its script.

        `refused` then has the pieces whose lowest cross-entropy is rejected."""
        out: list[tuple[str, dict[str, float], int]] = [("", {}, 0)] * len(pieces)
        groups = defaultdict(list)
        refused = self.refused = set()
        for i, p in enumerate(pieces):
            groups[script_of(p)].append(i)
        for script, which in groups.items():
            texts = [letters(pieces[i], script) for i in which]
            sure = [script not in CASED or sum(len(w) for w in _KEEP[script].findall(pieces[i]) if w[0].islower()) >= 8 for i in which]
            if script in self.only:
                for i, t in zip(which, texts):
                    out[i] = (script, {self.only[script]: 0.0}, max(0, len(t) - 2))
            elif script in self.tables:
                table = self.tables[script]
                scores, sizes = table.score(texts)
                for i, row, n, certain in zip(which, scores.tolist(), sizes.tolist(), sure):
                    best = max(range(len(row)), key=row.__getitem__)
                    if self.rejected(script, table.languages[best], row[best], n - 2):
                        refused.add(i)
                    row = row if certain else [x * UNSURE for x in row]
                    out[i] = (script, dict(zip(table.languages, row)), max(0, n - 2))
        return out

    def rejected(self, script: str, language: str, logp: float, n: int) -> bool:
        """Whether a cross-entropy lies beyond what the language's own pieces reach."""
        table = self.tables.get(script)
        return bool(table) and n > 0 and -logp / (n + 2) > table.limit[table.languages.index(language)]


def label_code(label: str | None, codes: dict[str, str]) -> str | None:
    """The reference code a label names; a region is no matter. None for null, undetermined and unknown labels."""
    if not label:
        return None
    return codes.get(re.split(r"[-_]", label.strip().lower(), maxsplit=1)[0])


def stretches(spans: list[tuple[int, int]], scored: list[tuple[str, dict[str, float], int]], change: float = CHANGE) -> list[tuple[int, int, str, float, int]]:
    """(first, last span, language, log-probability margin, letters) of the longest stretches in one language.

    The path over all spans with the greatest total log-probability less `change` for each change of language is taken;
    a span without letters, or of a script without languages, goes with its neighbours.
    """
    every = sorted({x for _, s, n in scored if n for x in s})
    if not every:
        return []
    total = {x: 0.0 for x in every}
    back: list[dict[str, str]] = []
    for _, s, n in scored:
        top = max(total, key=total.__getitem__)
        step, came = {}, {}
        for x in every:
            stay, move = total[x], total[top] - change
            came[x] = x if stay >= move else top
            gain = 0.0
            if n and s:
                gain = s[x] - max(s.values()) if x in s else -4.0 * min(n, 12)
            step[x] = max(stay, move) + gain
        total = step
        back.append(came)
    x = max(total, key=total.__getitem__)
    path = []
    for came in reversed(back):
        path.append(x)
        x = came[x]
    path.reverse()
    out: list[tuple[int, int, str, float, int]] = []
    for i, x in enumerate(path):
        _, s, n = scored[i]
        others = [v for y, v in s.items() if y != x]
        margin = (s.get(x, 0.0) - max(others)) if others and n else 10.0 * (n > 0)
        if out and out[-1][2] == x:
            out[-1] = (out[-1][0], i, x, out[-1][3] + margin, out[-1][4] + n)
        else:
            out.append((i, i, x, margin, n))
    return out


def fit(rows: DataFrame, reference: DataFrame, text_column: str = "text", label_column: str = "language", sample: int = SAMPLE) -> tuple[Identifier, dict[str, str]]:
    """An identifier from a bounded sample of labelled rows (about `sample` for each language), and the codes of labels."""
    names = reference.select("code", "code3", "script").collect()  # one row a language
    codes = {r.code: r.code for r in names} | {r.code3: r.code for r in names if r.code3}
    codes |= {k: v for k, v in ALSO.items() if v in set(codes.values())}
    scripts = {r.code: MODEL_OF.get(r.script, "Latn") for r in names}
    mapping = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    labelled = rows.select(F.col(text_column).alias("text"), mapping[F.split(F.lower(F.trim(F.col(label_column))), "[-_]")[0]].alias("code")).where("code is not null and text is not null")
    different = labelled.withColumn("h", F.xxhash64("text"))
    counts = different.groupBy("code").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counts:
        return Identifier({}, scripts), codes
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.code, min(1.0, 1.1 * sample / max(r.n, 1)))])[F.col("code")]
    # drawn by hash and counted once however often a text is repeated; only pieces travel
    drawn = different.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000_007)) < share * 1_000_000_007).groupBy("code", "h").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [[p[:2000] for p in _PIECE.split(t) if len(p) >= 12] for t in batch.column(1).to_pylist()]
            few = [ps if len(ps) <= PIECES else ps[:: -(-len(ps) // PIECES)] for ps in pieces]  # spread over the text
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(few, pa.list_(pa.string()))], names=["code", "pieces"])

    pieces = defaultdict(list)
    for r in drawn.select("code", "text").mapInArrow(cut, "code string, pieces array<string>").collect():  # SAMPLE texts a language, PIECES pieces of 2000 characters a text
        pieces[r.code].append(r.pieces)
    return Identifier({k: sorted(v) for k, v in pieces.items()}, scripts), codes


_PIECE = re.compile(r"[\r\n]{2,}|(?<=[.!?])\s+|(?<=[。！？।])\s*")


def segmented(rows: DataFrame, reference: DataFrame, id_column: str = "document_id", text_column: str = "text", label_column: str = "language") -> DataFrame:
    """One row for each stretch of each text: id, start_c, end_c, language, confidence, rejected, main (the language with
    most characters of the text), n_languages and label (the code the row's label names, or null).

    Null, empty and blank texts, and texts without letters of a known script, have no stretches. Repeated rows repeat
    theirs. Confidence is the logistic of the stretch's margin per letter over the next language, for at most `ENOUGH`
    letters, scaled on the held-out sample; rejected stretches still name the nearest language.
    """
    identifier, codes = fit(rows, reference, text_column, label_column)
    openers = opening_words(rows, text_column)
    packed = rows.sparkSession.sparkContext.broadcast(pickle.dumps((identifier, codes, openers)))  # bounded by the sample, and the words by their share of texts
    kept: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(pickle.loads(packed.value))
        model, names, opening = kept[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts, labels = part.column(1).to_pylist(), part.column(2).to_pylist()
                spans = [sentences(t, opening) for t in texts]
                flat = model.pieces([t[a:e] for t, ss in zip(texts, spans) for a, e in ss])
                refused = model.refused
                out: dict[str, list] = {k: [] for k in ("which", "start", "end", "language", "confidence", "rejected", "main", "n", "label")}
                done = 0
                for i, ss in enumerate(spans):
                    scored = flat[done : done + len(ss)]
                    said = [("", {}, 0) if done + j in refused else x for j, x in enumerate(scored)]
                    if any(k and x for _, x, k in said):
                        scored = said
                    done += len(ss)
                    found = stretches(ss, scored)
                    size: dict[str, int] = defaultdict(int)
                    for first, last, x, _, _ in found:
                        size[x] += sum(e - a for a, e in ss[first : last + 1])
                    for first, last, x, margin, n in found:
                        logp = sum(s.get(x, 0.0) for _, s, k in scored[first : last + 1] if k)
                        script = next((sc for sc, s, k in scored[first : last + 1] if x in s), "")
                        out["which"].append(i)
                        out["start"].append(ss[first][0])
                        out["end"].append(ss[last][1])
                        out["language"].append(x)
                        out["confidence"].append(float(1 / (1 + np.exp(-np.clip(model.scale * margin / max(n, 1) * min(n, ENOUGH), -30, 30)))))
                        out["rejected"].append(model.rejected(script, x, logp, n))
                        out["main"].append(max(sorted(size), key=size.__getitem__))
                        out["n"].append(len(size))
                        out["label"].append(label_code(labels[i], names))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.int32(), pa.string())
                columns = [pa.array(v, k) for v, k in zip([*out.values()][1:], kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(out["which"], pa.int32())), *columns], names=[id_column, "start_c", "end_c", "language", "confidence", "rejected", "main", "n_languages", "label"])

    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, start_c int, end_c int, language string, confidence double, rejected boolean, main string, n_languages int, label string"
    return rows.select(id_column, text_column, label_column).mapInArrow(run, schema)


def questionable(stretched: DataFrame, id_column: str = "document_id") -> DataFrame:
    """The stretches of rows whose label is missing or does not name their main language, or that mix languages."""
    return stretched.where((~F.col("label").eqNullSafe(F.col("main"))) | (F.col("n_languages") > 1)).select(id_column, "start_c", "language")
