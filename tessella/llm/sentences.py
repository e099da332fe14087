"""Sentences of a text in any script, by semi-Markov dynamic programming over whole sentence spans.

A text falls into blocks at blank lines. In a block every place where a sentence may end is a candidate: closing marks
with what closes behind them, line ends, and blanks between words of a script without sentence marks. Dynamic programming
chooses the spans between candidates with the best total of span scores. A span's score joins the evidence of its last
mark and closing word (abbreviation, initial, ordinal, legal form), of the next span's opening word (case, digit, a word
that opens sentences elsewhere in the corpus), of its length, and of its quotation marks and brackets: what opens in a
span must close in it, and a bare quotation is tied to the words that name its source.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks, each kind together.
STRONG, WEAK, WIDE = "!?؟।॥۔‼⁇⁈⁉", ".", "。！？｡．"
OPEN, CLOSE = "«‹「『《〈（([{【〔", "»›」』》〉）)]}】〕"
QUOTES = '"“”„‟'
PAIR = dict(zip(CLOSE, OPEN))
BULLETS = "-–—•*·‣▪◦●○■□►▶→✓"
# Words before a full stop that do not end a sentence, and such that may, of some languages; lower case. Others are learned.
NEVER = set(
    "mr mrs ms dr prof gen lt capt col maj sgt cpl st ste rev hon no nos fig figs p pp vol ch sec art approx ca cca vs cf e.g i.e eg ie al jan feb mar apr jun jul aug sep sept oct nov "
    "dec rs mk sp dept est cmdr adm sen rep gov pres mt ft ave nr hr fr z b d u bzw vgl fa mio mrd inkl ggf str bd abs ing dipl frl zb "
    "m mm mme mlle mlles me env av ex sr sra srta sres dra dña núm núms num aprox ej pág págs ee uu n.º n.ª nº exmo sig sig.ra sigg dott dott.ssa avv ad es pag "
    "dhr mevr mw ir drs bijv blz nl inż mgr np ok ul godz tzn m.in tys pkt str tel sn vb yy bkz cad sok "
    "г т е д дж ок им ул тыс стр рис см проф гр д-р бл м р ім вул тис напр डॉ सं श्री श्रीमती प्रो कु د أ م".split()
)
MAY = set("ltd inc corp co ltda s.a s.l s.p.a a.ş a.s o.o g.m.b.h b.v n.v etc usw a.m p.m руб млн млрд proc mln mld mrd jr bros plc llc kg km".split())
# Words between which and a noun a German ordinal stands.
ORDINAL = set("am dem der den des die das vom zum zur beim bis ab seit im und oder nach vor jeder jedem jedes jeden ihr ihrem sein seinem kein jede".split())
_LINES = str.maketrans(dict.fromkeys("\r\x0b\x0c\x85  ", "\n"))
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_CLOSERS = "".join(re.escape(c) for c in CLOSE + QUOTES + "’'")
_ENDS = re.compile(rf"(?:[{STRONG}{WIDE}.…]+|(?<=\s)\|(?=\s|$))(?:[^\S\n]?[»›](?!\w)|[{_CLOSERS}])*")
_BEFORE = re.compile(r"[^\s(«“\"„\[:،,’'/]+$")
_NEXT = re.compile(rf"\s*([{re.escape(OPEN + QUOTES)}¿¡'‘]*)\s*([{re.escape(BULLETS)}…]*)\s*([{re.escape(OPEN + QUOTES)}¿¡'‘]*)\s*(\w[\w'’]*)?")
_THAI = re.compile("[฀-໿က-႟ក-៿]")
_ASIAN = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_ITEM = re.compile(rf"(?:[{re.escape(BULLETS)}]|\(?\d{{1,3}}\)|\d{{1,2}}\.(?!\s*[a-z])|\(?[a-z]\)|\(?[ivxIVX]{{1,4}}\))\s+(?=\S)")
_TRIM = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            ​    ⁠　﻿"
NO = -50.0
#: Characters looked at behind a mark, and before one: for signs and words beside it.
AHEAD, BACK = 400, 200
#: A word is an abbreviation where so much of its occurrences have a full stop behind them, and so few of those end a block.
STOPPED, ENDING = 0.7, 0.02


def _depths(s: str, at: int, end: int) -> dict[int, int]:
    """The closing mark of each matched opening mark between at and end."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for m in _MARKS.finditer(s, at, end):
        c, i = m[0], m.start()
        if c in PAIR:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == PAIR[c]:
                    pairs[stack[k][1]] = i
                    del stack[k:]
                    break
        elif c in QUOTES:
            kinds = {'"': '"', "”": "“„‟", "“": "„", "‟": "", "„": ""}[c]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in kinds and kinds:
                    pairs[stack[k][1]] = i
                    del stack[k:]
                    break
            else:
                if c != "”":
                    stack.append((c, i))
        else:
            stack.append((c, i))
    return pairs


_MARKS = re.compile(rf"[{re.escape(OPEN + CLOSE + QUOTES)}]")


def _opening(word: str, openers: dict[str, float], small: bool) -> float:
    """Evidence that a word opens a sentence; small: the text has only small letters or only capitals."""
    known = openers.get(word, 0.0) or openers.get(word.capitalize(), 0.0)
    c = word[0]
    if small:
        return known + 0.5
    if c.islower():
        return -12.0 if known <= 0 else -9.0
    if c.isdigit():
        return known - 0.5
    if c.isupper():
        return known + 1.0
    return known - 0.3


class Words(dict):
    """Evidence of each word for opening a sentence; `never` and `may`: words before a full stop that do not end one, or may not."""

    def __init__(self, openers: dict[str, float] | None = None, never: frozenset[str] = frozenset(NEVER), may: frozenset[str] = frozenset(MAY)):
        super().__init__(openers or {})
        self.never, self.may = never, may

    def __reduce__(self):
        return Words, (dict(self), self.never, self.may)


def _weak_end(before: str, ahead: str, after: str, openers: Words, small: bool) -> float:
    """Evidence of the word before a full stop, given the words ahead of it and after it."""
    if before[-1:].isascii() or before[-1:] < "ɐ":
        tail = _LATIN.search(before)[0] or before
        if len(tail) < len(before) and before[-len(tail) - 1].isdigit() and tail.isalpha():
            return 3.0  # a unit behind its number
        before = tail
    low = before.lower().rstrip(".")
    known = openers.get(after, 0.0)
    if not low:
        return 2.0
    if len(low) == 1 and low.isalpha():
        if before.isupper() or not ahead[-1:].isdigit():
            return -7.0
        return 1.0
    if low in openers.never or low.split("-")[-1] in openers.never and not low.isascii():
        return -9.0
    if low in openers.may:
        if small or after and not after[0].isdigit() and after[0].lower() == after[0].upper():
            return 2.8 if known > 0.5 else -4.0
        return 3.2
    if low.isdigit() and len(low) <= 2:
        return (-4.0 if known <= 0.5 else 0.5) if ahead.lower() in ORDINAL else 3.0
    if re.fullmatch(r"(?:\w\.)+\w", low):
        return -1.0 if known >= 0 else -4.0
    return 4.0


def _block(s: str, at: int, end: int, openers: Words, wrap: int, small: bool) -> list[tuple[int, int]]:
    """The spans of one block; wrap: the usual length of broken lines, 0 where lines are paragraphs, small: the text has only small letters or only capitals."""
    pairs = _depths(s, at, end)
    opener_of = {c: o for o, c in pairs.items()}
    breaks = [at - 1, *_finditer("\n", s, at, end)]
    ends: dict[int, float] = {}
    for m in _ENDS.finditer(s, at, end):
        e = m.end()
        while e - 1 > m.start() and (e - 1 in pairs or s[e - 1].isspace()):
            e -= 1
        if e >= end:
            continue
        mark = s[m.start() : e]
        wide = any(c in WIDE for c in mark)
        gap = s[e].isspace()
        if not gap and not wide and not any(c in "।॥؟" for c in mark):
            if not _JOINED.match(s, max(at, m.start() - 2)):
                continue
        core = mark.rstrip(CLOSE + QUOTES + "’' \xa0 ")
        closed = len(core) < len(mark)
        line = breaks[bisect_left(breaks, m.start()) - 1] + 1
        if core == "." and e - line < 40 and _ITEM.fullmatch(s[line : e + 1].lstrip() + "x"[:0]) and s[line:e].strip().rstrip(".)").isalnum():
            continue
        if core == "." and m.start() - line < 40 and _ITEM.match(s[line : min(end, line + AHEAD)].lstrip()) and s[line : m.start()].strip().strip("(").isalnum() and len(s[line : m.start()].strip()) <= 3:
            continue
        nx = _NEXT.match(s, e)
        first = nx[4] or ""
        rest = s[e : min(end, e + AHEAD)].lstrip()
        if not first:
            score = 1.0 if any(c in STRONG + WIDE for c in core) else 0.5
        else:
            score = _opening(first, openers, small)
        if nx[1] or nx[3]:
            score = max(score, 0.5) + 1.0 if not (first[:1].islower() and not small) or any(c in STRONG + WIDE for c in core) else score
        if rest[:1] in ",;:،、，；：)—–" or (nx[2] and nx[2][0] in "—–-" and "\n" not in s[e : nx.start(2)]):
            score -= 14.0
        if set(core) <= set("….") and len(core) > 1 or "…" in core and not any(c in STRONG + WIDE for c in core):
            score += 1.5 if gap and first[:1].isupper() else -8.0
        elif core.endswith(".") and not wide:
            before = _BEFORE.search(s, max(at, m.start() - 30), m.start())
            word = before[0] if before else ""
            ahead = s[max(at, m.start() - len(word) - 15) : m.start() - len(word)].split()
            if len(word) == 1 and ahead and ahead[-1][-1] in "'’":
                word, ahead = ahead[-1] + word, ahead[:-1]
            score += 4.0 if "’" in word or "'" in word and len(word) > 3 else _weak_end(word, ahead[-1] if ahead else "", first, openers, small)
        elif wide:
            score = max(score, 0.0) + 5.0 if not closed else 5.0
        else:
            score += 5.0 if not (first[:1].islower() and not small) else 2.0
        if closed:
            opener = opener_of.get(e - 1)
            if opener is None:
                opener = min((opener_of[c] for c in range(m.start() + 1, e) if c in opener_of), default=None)
            if opener is not None and s[opener] in QUOTES + "«‹「『《〈":
                lead = s[max(at, opener - BACK) : opener].rstrip(_TRIM)
                if lead[-1:] and lead[-1] in ":：,،，":
                    score += 2.0
                elif wide:
                    score -= 20.0 if lead and lead[-1] not in STRONG + WIDE + ".\n" else 8.0
        if "\n" in s[e : nx.end()] and score > -8:
            score += 0.5
        ends[e] = score
    cut = at
    for i in _finditer("\n", s, at, end):
        left = s[cut:i].rstrip(_TRIM)
        e = cut + len(left)
        following = s[i + 1 : min(end, i + 1 + AHEAD)].lstrip(_TRIM)
        cut = i + 1
        if not left or not following or e in ends and ends[e] > 0:
            continue
        item = bool(_ITEM.match(following)) and (not wrap or len(left) <= 0.72 * wrap or left[-1] in STRONG + WIDE + ".:;" + CLOSE + QUOTES)
        if item:
            score = 6.0
        elif _ASIAN.search(left[-1:] + following[:1]):
            score = 5.0 if left[-1] not in ",、，；;：:" else -4.0
        elif _ASIAN.search(left[-60:]) and _ASIAN.search(following[:40]):
            score = -6.0
        elif _THAI.search(left[-6:]) or _THAI.search(following[:40].split("\n")[0]) and _THAI.search(left):
            score = 6.0
        else:
            fits = len(left) <= 0.72 * wrap or not wrap
            score = 4.0 if fits else -6.0
            first = _NEXT.match(following)[4] or ""
            if fits and first[:1].islower() and not small:
                score = -6.0
            if left[-1] in ",;:،":
                score = min(score, -4.0)
        if e in ends:
            ends[e] = score if item else (ends[e] if not score > 0 or ends[e] < -6 else max(ends[e], score - 3.0))
        else:
            ends[e] = score
    if _THAI.search(s, at, end):
        for m in _GAP.finditer(s, at, end):
            if m.start() > at and m.end() < end and m.start() not in ends:
                left = s[max(at, s.rfind(" ", at, m.start()), s.rfind("\n", at, m.start())) : m.start()]
                right = re.match(r"\S+", s[m.end() : end])
                if _THAI.search(left) and right and _THAI.search(right[0]):
                    ends[m.start()] = 6.0
    stops = [at, *sorted(e for e in ends if at < e < end), end]
    ends[end] = 0.0
    starts = []
    for x in stops:
        while x < end and s[x] in _TRIM:
            x += 1
        starts.append(x)
    # a place is inside where an opening mark before it has its closing mark at or behind it
    opened = sorted(pairs)
    reach = list(accumulate((pairs[o] for o in opened), max))

    def inside(x: int) -> bool:
        k = bisect_left(opened, x)
        return k > 0 and reach[k - 1] >= x

    cut_in = [inside(x) for x in starts]
    order = [(0.0, 0)]  # the totals so far with their stops, the best last
    best = [0.0] + [-math.inf] * (len(stops) - 1)
    back = [0] * len(stops)
    for j in range(1, len(stops)):
        e = stops[j]
        b = ends[e]
        if b <= NO:
            continue
        cut = inside(e)
        for total, i in reversed(order):
            if total + b - 40.0 * cut < best[j]:  # all other penalties only lower what is left
                break
            a = starts[i]
            if a >= e:
                continue
            score = total + b + (_length(e - a) - 40.0 if cut or cut_in[i] else _span(s, a, e, end, pairs))
            if score > best[j] or score == best[j] and i > back[j]:
                best[j], back[j] = score, i
        if best[j] > -math.inf:
            insort(order, (best[j], j))
    out = []
    j = len(stops) - 1
    while j > 0:
        i = back[j]
        a, e = starts[i], stops[j]
        while e > a and s[e - 1] in _TRIM:
            e -= 1
        if e > a:
            out.append((a, e))
        j = i
    return out[::-1]


_JOINED = re.compile(r"[a-zß-öø-ÿа-яёіїє]{2}[.!?][»”\"]?(?=[A-ZÀ-ÖØ-ÞА-ЯЁІЇЄ][a-zß-öø-ÿа-яёіїє]*[\s’'])")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ.]*$|\d*$")
_GAP = re.compile(r"(?<=\S)[^\S\n]+(?=\S)")


def _finditer(c: str, s: str, at: int, end: int) -> Iterator[int]:
    i = s.find(c, at, end)
    while i >= 0:
        yield i
        i = s.find(c, i + 1, end)


def _length(n: int) -> float:
    """The penalty of a span's length where it is long; longer spans never have less."""
    return -0.3 * math.log(n / 400) if n > 400 else 0.0


def _span(s: str, a: int, e: int, end: int, pairs: dict[int, int]) -> float:
    """Length and bare quotations of a span that cuts no quotation or bracket."""
    n = e - a
    score = _length(n) - (0.4 * (12 - n) / 4 if n < 12 else 0.0)
    if a in pairs and s[a] in QUOTES + "«‹「『《〈" and e < end:
        c = pairs[a]
        if not s[c + 1 : e].strip("., \xa0" + STRONG + WIDE):
            nx = _NEXT.match(s, e)
            score -= 3.0 if nx and nx[1] else 16.0
    return score


def sentences(text: str | None, openers: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points of the unchanged text; none for null, empty or blank texts."""
    if not text:
        return []
    openers = openers if isinstance(openers, Words) else Words(openers)
    s = text.replace("\r\n", " \n").translate(_LINES)
    lines = s.split("\n")
    inner = sorted(len(x.rstrip()) for x, y in zip(lines, lines[1:]) if x.strip() and y.strip())
    wrap = 0
    if inner and 45 <= inner[len(inner) // 2] <= 100 and sum(len(x) > 105 for x in lines) * 12 <= len(inner):
        wrap = inner[len(inner) * 3 // 4]
    letters = sum(map(str.isupper, s)), sum(map(str.islower, s))
    small = min(letters) * 100 < max(letters)
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_BLANK.finditer(s), None]:
        end = m.start() if m else len(s)
        while at < end and s[at] in _TRIM:
            at += 1
        while end > at and s[end - 1] in _TRIM:
            end -= 1
        if at < end:
            out += _block(s, at, end, openers, wrap, small)
        at = m.end() if m else end
    return out


_SURE = re.compile(rf"(?:\n[^\S\n]*\n\s*|[{STRONG}{WIDE}][{_CLOSERS}]*\s+)[{re.escape(QUOTES + OPEN)}¿¡]*(\w[\w'’]*)")
_WORDS = re.compile(r"\w[\w'’]*")


_STOP = re.compile(r"\.(?=[\s,;:)]|$)")
_ENDWORD = re.compile(r"(?<![\w.])[^\W\d_][\w.]{0,11}$")


def opening_counts(text: str) -> tuple[Counter, Counter]:
    """How often each word that does not begin small stands at a sure beginning, and at all."""
    s = text.replace("\r\n", " \n").translate(_LINES)
    return Counter(w for w in _SURE.findall("\n\n" + s) if not w[0].islower()), Counter(w for w in _WORDS.findall(s) if not w[0].islower())


def stop_counts(text: str) -> tuple[Counter, Counter, Counter, Counter]:
    """How often each short word, in lower case, stands at all, before a full stop, there at the end of a block, and there before
    a small letter, a digit or a comma."""
    s = text.replace("\r\n", " \n").translate(_LINES)
    stops, ends, runs = Counter(), Counter(), Counter()
    for m in _STOP.finditer(s):
        i = m.start()
        word = _ENDWORD.search(s, max(0, i - 13), i)
        if not word:
            continue
        low = word[0].lower()
        stops[low] += 1
        rest = s[i + 1 : i + 40]
        nx = rest.lstrip()[:1]
        if not nx or rest[: len(rest) - len(rest.lstrip())].count("\n") > 1:
            ends[low] += not nx and i + 41 > len(s) or rest.count("\n") > 1
        elif nx in ",;:" or nx.isdigit() or nx.islower():
            runs[low] += 1
    every = Counter(s.lower().split())
    return Counter({w: every[w] + every[w + ","] + n for w, n in stops.items()}) + Counter({w: n for w, n in every.items() if len(w) <= 12 and w not in stops and w[0].isalpha()}), stops, ends, runs


def opening_words(rows: DataFrame, text_column: str = "text", least: float = 2e-5, listed: bool = True) -> Words:
    """What is learned of words, from all texts: the evidence of each for opening a sentence, the log of its share of sure
    beginnings over a tenth; and abbreviations: short words that mostly have a full stop behind them and rarely end a
    block with it (`STOPPED`, `ENDING`), of five letters and more only if small letters, digits or commas follow too. With `listed` the abbreviations known of some languages are added.

    Kept are words seen in at least `least` of all texts (and in 5 texts), so there are at most as many as an average text has
    words over `least`; the table's size does not grow with the corpus.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[Counter]] = {"o": [Counter() for _ in range(4)], "s": [Counter() for _ in range(5)]}
            for text in batch.column(0).to_pylist():
                if text:
                    for kind, found in (("o", opening_counts(text)), ("s", stop_counts(text))):
                        for total, more in zip(sums[kind], found):
                            total.update(more)
                        sums[kind][-1].update(found[1].keys())  # texts
            for kind, cs in sums.items():
                words = [*cs[1]] if kind == "o" else [w for w in {**cs[0], **cs[1]} if cs[1][w] or cs[0][w] > 1]
                a, b, c, d = (cs[0], cs[1], Counter(), Counter()) if kind == "o" else cs[:4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(words), pa.string()), pa.array(words, pa.string()), *(pa.array([x[w] for w in words], pa.int64()) for x in (a, b, c, d, cs[-1]))],
                    names=["kind", "word", "a", "b", "c", "d", "texts"],
                )

    texts = rows.select(text_column)
    sums = texts.mapInArrow(count, "kind string, word string, a long, b long, c long, d long, texts long").groupBy("kind", "word").agg(*(F.sum(x).alias(x) for x in ("a", "b", "c", "d", "texts")))
    floor = max(5, math.ceil(least * texts.count()))
    openers, never, may = {}, set(NEVER if listed else ()), set(MAY if listed else ())
    for r in sums.where(F.col("texts") >= floor).collect():
        if r.kind == "o":
            openers[r.word] = max(-3.0, min(3.0, math.log(10 * (r.a + 0.5) / (r.b + 5))))
        elif r.b >= STOPPED * r.a and r.c <= ENDING * r.b and r.d >= (0.0 if len(r.word) <= 4 else 0.05 if len(r.word) == 5 else 0.3) * r.b and r.word not in may:
            never.add(r.word)
        elif r.d >= 0.1 * r.b and r.c <= 0.1 * r.b and r.word not in never:
            may.add(r.word)
    return Words(openers, frozenset(never), frozenset(may))


def split(rows: DataFrame, id_column: str = "document_id", text_column: str = "text", openers: Words | None = None) -> DataFrame:
    """(id, start_c, end_c) of each sentence of each row.

    Offsets count code points of the unchanged text, ends are exclusive, blanks around a sentence are left out. Rows of null,
    empty or blank text have no sentences; repeated rows repeat theirs. Other columns are ignored, whatever their names.
    `openers` is learned from the same rows where it is not given.
    """
    model = rows.sparkSession.sparkContext.broadcast(opening_words(rows, text_column) if openers is None else openers)  # bounded where it is learned
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                which, start, end = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for a, e in sentences(text, model.value):
                        which.append(i)
                        start.append(a)
                        end.append(e)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[id_column, "start_c", "end_c"])

    return rows.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, start_c int, end_c int")
