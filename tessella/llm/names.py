"""Parts of the names of firms and persons: head, line of business, given name, initials, family name, short form."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts and letters without a decomposition, in Latin.
LETTERS = str.maketrans({
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "e", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "ø": "o", "ı": "i", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "’": "'", "‘": "'",
})

# Legal forms and words around names that tell nothing, folded, without stops.
LEGAL = set(
    "ltd limited ltda limitada inc incorporated corp corporation co company gmbh gesmbh ag kg sa sas sarl sl slu spa srl oy oyj as "
    "pvt private plc llc llp bv nv ab spzoo spolka zoo oo societe anonyme anonim sirketi sociedad anonima sociedade gesellschaft the messrs".split()
)
TITLES = set("dr prof col gen lt capt maj mr mrs ms miss sir eng ing dipl herr frau sr sra dott ret".split())

# The same legal form in its spellings, by the word that tells it.
FORM = {
    "limitada": "ltda", "ltda": "ltda", "sociedad": "sl", "sl": "sl", "spzoo": "spzoo", "spolka": "spzoo", "spa": "spa", "gmbh": "gmbh", "gesmbh": "gmbh",
    "sa": "sa", "anonyme": "sa", "oy": "oy", "oyj": "oy", "as": "as", "anonim": "as", "sirketi": "as", "pvt": "pvt", "private": "pvt", "inc": "inc",
    "incorporated": "inc", "corp": "inc", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd",
}
_FORM_ORDER = ["sl", "ltda", "spzoo", "spa", "gmbh", "sa", "oy", "as", "pvt", "inc", "co", "ltd"]

def phonetic(word: str) -> str:
    """Spelling differences between scripts taken out: c as k (not in ch), w as v, doubled forms of the same sound."""
    return re.sub("c(?!h)", "k", word).replace("w", "v").replace("ph", "f").replace("q", "k").replace("x", "ks")


def fold(text: str) -> str:
    """Lower-case Latin letters without marks."""
    low = unicodedata.normalize("NFC", text).lower().replace("дж", "j").translate(LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).translate(LETTERS)


_LEGAL, _TITLES = {phonetic(w) for w in LEGAL} | LEGAL, {phonetic(w) for w in TITLES} | TITLES
#: Digits read for letters.
_READ = str.maketrans("015384", "oiseba")

_SHORT = re.compile(r"\(([A-Z]{2,6})\)\s*$|,\s*([A-Z]{2,6})\s+for short\s*$|\s[-–]\s([A-Z]{2,6})\s*$")
_FORMS = [
    (re.compile(r"\bm\s*/\s*s\b\.?"), " "),
    (re.compile(r"\bjean\W?lu[kc]\b"), "jeanluc"),
    (re.compile(r"\bsp(?:olka|\.)?\s*z\.?\s*o\.?\s*o\b\.?"), " spzoo "),
    (re.compile(r"\(\s*p\s*\)\s*(?=ltd)"), " pvt "),
    (re.compile(r"\bges\.?\s?m\.\s?b\.\s?h\b\.?"), " gesmbh "),
    (re.compile(r"\bg\.\s?m\.\s?b\.\s?h\b\.?"), " gmbh "),
    (re.compile(r"\bs\.\s?p\.\s?a\b\.?"), " spa "),
    (re.compile(r"(?<![a-z])s\.\s?a\.(?![a-z])"), " sa "),
    (re.compile(r"(?<![a-z])s\.\s?l\.(?![a-z])"), " sl "),
    (re.compile(r"(?<![a-z])a\.\s?s\.(?![a-z])"), " as "),
]
_WORD = re.compile(r"[a-z0-9]+")


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two words is `most` at most."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class Lexicon:
    """Words that many names have: those of a line of business and given names, each with the class they belong to.

    Nothing here is a list of the library: the classes are learned (lexicon.py) from names known to mean the same. `pets` adds
    short forms of given names from a table of the caller's.
    """

    def __init__(self, business: dict[str, str] | None = None, given: dict[str, str] | None = None, pets: dict[str, str] | None = None):
        self.business = business or {}
        self.given = {phonetic(fold(k)): phonetic(fold(v)) for k, v in (pets or {}).items()} | (given or {})
        self._long_given = [w for w in self.given if len(w) >= 5]
        self._long_business = [w for w in self.business if len(w) >= 7]
        self._seen: dict[tuple[str, bool], str | None] = {}

    def _like(self, word: str, trade: bool) -> str | None:
        if trade:
            return next((self.business[w] for w in self._long_business if near(word, w, 1)), None) if len(word) >= 6 else None
        if len(word) >= 4:
            for w in self._long_given:
                if w[0] == word[0] and near(word, w, 2 if len(w) >= 8 else 1):
                    return self.given[w]
            for w in self._long_given:  # neighbours exchanged
                if len(w) == len(word) and sorted(w) == sorted(word) and near(word, w, 2):
                    return self.given[w]
        return None

    def like(self, word: str, trade: bool) -> str | None:
        """The class of a misspelt word."""
        key = (word, trade)
        if key not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[key] = self._like(word, trade)
        return self._seen[key]


def split(name: str | None) -> tuple[list[str], list[str], str]:
    """The folded, phonetic words of a name without legal forms and titles, its legal words, and its short form."""
    if not name or not name.strip():
        return [], [], ""
    text = re.sub(r"\s+", " ", name.replace("\xa0", " ")).strip()
    short = ""
    if m := _SHORT.search(text):
        word = m[1] or m[2] or m[3]
        if word.lower() not in LEGAL:
            short, text = word, text[: m.start()]
    if re.fullmatch(r"[A-Z]{2,6}", text) and text.lower() not in LEGAL:
        return [], [], text
    low = fold(text)
    for pattern, by in _FORMS:
        low = pattern.sub(by, low)
    low = re.sub(r"(?<=[a-z])[-'](?=[a-z])", "", low)
    words = [phonetic(w.translate(_READ) if not w.isdigit() else w) for w in _WORD.findall(low)]
    return [w for w in words if w not in _LEGAL and w not in _TITLES], [w for w in words if w in _LEGAL], short


def parse(name: str | None, lexicon: Lexicon) -> dict:
    """kind: 'f' firm, 'p' person, 'i' initials and one word (either), 'a' short form only, '' nothing usable.

    head: a firm's own words without blanks, or a person's family name; tail: a firm's last own word where there are two;
    bag: the own words in alphabetical order where there are two or more and no word of the lexicon tells what they are;
    business, given, initials, short, legal: as far as they are in the name. Everything is folded and phonetic.
    """
    out = {"kind": "", "head": "", "tail": "", "bag": "", "business": "", "given": "", "initials": "", "short": "", "legal": ""}
    words, legal, out["short"] = split(name)
    if not words and not legal:
        return out | ({"kind": "a"} if out["short"] else {})
    forms = {FORM[w] for w in FORM if phonetic(w) in legal}
    out["legal"] = next((f for f in _FORM_ORDER if f in forms), "")
    codes = [lexicon.business[w] for w in words if w in lexicon.business]
    rest = [w for w in words if w not in lexicon.business]
    long = [w for w in rest if len(w) > 1]
    if not codes and len(long) > 1:
        for w in long:
            if w not in lexicon.given and (code := lexicon.like(w, True)):
                codes.append(code)
                rest.remove(w)
                break
        long = [w for w in rest if len(w) > 1]
    if codes:
        out["business"] = max(codes, key=lambda c: (codes.count(c), -codes.index(c)))
    if not codes and len(long) > 1:
        given = next(((w, lexicon.given[w]) for w in long if w in lexicon.given), None)
        if not given and not legal:
            given = next(((w, g) for w in long if (g := lexicon.like(w, False))), None)
        if given:
            family = [w for w in long if w != given[0]] or [given[0]]
            out |= {"kind": "p", "given": given[1], "head": "".join(family), "initials": "".join(sorted(w for w in rest if len(w) == 1))}
            return out
    single = [w for w in rest if len(w) == 1]
    if not long:
        return out | ({"kind": "a"} if out["short"] else {})
    if single and not codes and not legal and len(long) == 1:
        return out | {"kind": "i", "head": long[0], "initials": "".join(single)}
    out |= {"kind": "f", "head": "".join(long), "tail": long[-1] if len(long) > 1 else "", "bag": "".join(sorted(long)) if len(long) > 1 and not codes else ""}
    if single and len(long) == 1:
        out |= {"initials": single[0]}
    return out
