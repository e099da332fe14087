"""Personal information in free text: its places, typed placeholders, and keyed surrogates.

E-mail addresses, telephone numbers, numbers issued to persons and postal addresses are found by their forms, ambiguous
numbers by check digits or the nearest telling word before them. Names of persons are found by given names, initials and
titles beside a family name; a family name that stands alone is taken where the text has it in a fuller form, or where the
characters around it are such as full names have around them.

No names are listed here. Given names are learned from all distinct texts: words that stand between a title and another
capitalised word often enough, before many different words. So are the words that end names of firms, the words that are
common, and the characters around full names.

Each place can be replaced by the placeholder of its kind, or by a surrogate (surrogates.py).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize, release
from .names import fold, phonetic
from .surrogates import Surrogates

#: Share of the distinct texts that surroundings must stand with full names in to be known, four at least. It bounds what the
#: driver and the workers hold; up to 100,000 distinct texts four are enough.
LEAST = 4e-5
#: Surroundings counted in a task before they are handed on.
HELD = 200_000
#: Share of the distinct texts learned from in which a capitalised word that is no family name there counts as common.
OFTEN = 0.005
#: A given name stands behind titles in so many distinct texts at least (a share of all texts, four at least), before so many
#: different words.
TITLED, FAMILIES = 2e-5, 4
#: A word ends names of firms where it stands in this share of the texts, mostly behind another capitalised word.
ENDING, ENDING_PART = 2e-3, 0.6
KINDS = ("email", "phone", "id_number", "address", "person_name")
# The decimal digits and signs of other scripts, each as its plain form.
PLAIN = {ord(c): str(unicodedata.digit(c)) for c in map(chr, range(0x660, 0x110000)) if unicodedata.category(c) == "Nd" and unicodedata.digit(c, -1) >= 0}
PLAIN |= {ord(a): b for a, b in zip("＋－（）／．＠，：−‐‑", "+-()/.@,:---")}
# Titles before a person's name; words that show a number to be a person's, and such that show it is not.
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Gen|Lt|Col|Capt|Maj|Herr|Frau|Mme|Mlle|Sr|Sra|Dra|Don|Doña|Sig|Dott|Ing|Inż|Dhr|Mevr|Ir|Sn|Инженер|Інженер)\.?|M\.|डॉ\.|श्री|श्रीमती|السيدة|السيد|د\.|خانم|آقای|دکتر"
PERSONAL = [
    "passport", "ssn", "driving licence", "driver's license", "führerschein", "permis de conduire", "identity card", "id card", "identity no", "id no", "tax card", "tax no", "national insurance", "social security", "ausweis", "reisepass", "steuer", "passeport", "pièce d", "identité",
    "dni", "pasaporte", "identidad", "passaporto", "passaporte", "codice personale", "codice fiscale", "carta d", "paspoort", "identiteit", "dowod", "dowód", "pesel", "paszport", "kimlik", "pasaport",
    "паспорт", "инн", "снилс", "посвідчення", "ідентифікаці", "личност", "护照", "身份证", "旅券", "個人番号", "여권", "주민", "جواز", "هوية", "کد ملی", "گذرنامه", "شناسنامه", "पहचान", "पासपोर्ट", "หนังสือเดินทาง", "ประจำตัว", "บัตรประชาชน",
]
BUSINESS_NO = [
    "tender", "invoice", "contract", "serial", "lot ", "ticket", "range number", "parts list", "list ", "order no", "ausschreibung", "los ", "vertrag nr", "rechnung", "teileliste", "appel d", "licitaci", "lote", "factura", "facture", "contrato n",
    "gara", "lotto", "fattura", "aanbesteding", "partij", "factuur", "przetarg", "partia", "faktur", "ihale", "parti", "fatura", "тендер", "парти", "счет", "счёт", "рахунок", "лот", "招标", "批次", "发票", "合同", "入札", "ロット", "請求", "입찰", "로트", "송장",
    "المناقصة", "الدفعة", "فاتورة", "مناقصه", "محموله", "فاکتور", "निविदा", "लॉट", "चालान", "ประกวดราคา", "ล็อต", "ใบแจ้งหนี้", "concurso", "firmware", "version", "model",
]

_L = "A-Za-zÀ-ÖØ-öø-ɏ̀-ͯ"
_U = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽȘȚ"
_C, _CU = "а-яёіїєґø", "А-ЯЁІЇЄҐ"
_W = rf"(?:[{_U}][̀-ͯ]?[{_L}]*(?:['’][{_U}][{_L}]+)?|[{_CU}][{_C}{_CU}]*)"
_NAME = rf"{_W}(?:-{_W})*"
_S = r"[ \t\xa0]*(?:\r?\n)?[ \t\xa0]*"
_SP = r"(?:[ \t\xa0]+|[ \t\xa0]*\r?\n[ \t\xa0]*)"
_TOWN = rf"(?:(?:Upper|Lower|New|Old|North|South|East|West|Port|Fort|St\.|Saint|Bad|Нев|Уппер|Порт|Форт){_SP})?{_W}"
_STREET = "Street|St\\.|Road|Rd\\.|Lane|Ln\\.|Close|Crescent|Avenue|Ave\\.|Drive|Way|Court|Place|Square|Terrace|Boulevard|Blvd\\.|Row|Gardens|Hill|Grove|Mews"
_CODE = rf"(?:{_SP}(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_SP}\d[A-Z]{{2}}|(?:-{_SP})?\d{{5,6}}))?"
_ROOM = r"(?:Flat|Unit|Apt\.?|Apartment|Suite)"
_FIVE = rf"\d{{5}}{_SP}{_TOWN}"
_COMMA = rf",{_SP}"
_POST = re.compile(r",\s{1,3}\d{5}\s")
ADDRESSES = [
    (re.compile(rf"(?:{_STREET})(?=,)"), rf"(?:{_ROOM}{_SP}\w+{_COMMA})?\b\d{{1,5}}[a-zA-Z]?{_SP}(?:[NSEW]\.{_SP})?{_W}(?:{_SP}{_W})?{_SP}(?:{_STREET})(?:{_COMMA}{_ROOM}{_SP}\w+)?{_COMMA}{_TOWN}{_CODE}"),
    (re.compile("Plot", re.I), rf"Plot{_SP}(?:No\.{_SP})?\d+{_COMMA}(?:{_W}{_SP}Industrial{_SP}Estate|Sector{_SP}\d+){_COMMA}{_TOWN}(?:{_SP}-)?{_SP}\d{{5,6}}"),
    (re.compile(r"Box|Postfach|B\.P\.|postale|Apartado|Postbus|ostal|poczt|P\.K\.|а/я", re.I), rf"(?:P\.?{_S}O\.?{_SP}Box|Postfach|Boîte postale|B\.P\.|Apartado(?: de Correos)?|Casella postale|Postbus|Caixa [Pp]ostal|[Ss]krytka pocztowa|skr\. poczt\.|P\.K\.|а/я){_SP}(?:n\.?[ºo°]{_SP})?\d+{_COMMA}(?:\d{{5}}{_SP})?{_TOWN}(?:{_SP}\d{{5}})?"),
    (_POST, rf"\b\d{{1,4}}(?:{_SP}(?:bis|ter|quater))?{_COMMA}(?:rue|avenue|place|boulevard|chemin|allée|quai|impasse|cours|route|via|viale|piazza|corso|largo|vicolo){_SP}(?:(?:de la|de|du|des){_SP}|d[’'])?{_W}{_COMMA}{_FIVE}"),
    (_POST, rf"\b(?:via|viale|piazza|corso|largo|vicolo){_SP}(?:\d+{_SP}{_W}|{_W}(?:,?{_SP}\d+)){_COMMA}{_FIVE}"),
    (_POST, rf"\b(?:Calle|C/|Av\.|Avda\.|Avenida|Plaza|Paseo|Rua|Praça|Travessa|Largo|Rue|Via){_SP}(?:d[aeo]s?{_SP})?{_W}{_COMMA}(?:n\.[ºo°]{_SP})?\d+(?:{_COMMA}\d+\.?[ºª]{_SP}?[A-Z]?)?{_COMMA}{_FIVE}"),
    (re.compile(r"(?:ул|вул|пр|просп|пер|наб|пл|бул|ш)\.", re.I), rf"(?:(?:г|м)\.{_SP}{_TOWN}{_COMMA})?\b(?:ул|вул|пр|просп|пер|наб|пл|бул|ш)\.{_SP}{_W}{_COMMA}(?:д|буд)\.{_SP}\d+[а-я]?(?:{_COMMA}(?:кв|корп|оф)\.{_SP}\d+)*(?:{_COMMA}(?:(?:г|м)\.{_SP})?{_TOWN})?"),
    (_POST, rf"(?:\b(?:ul|al|pl|os|Cad|Sok|Mah|Bulv)\.{_SP}|\b(?:Am|An der|Im|Zum|Zur|Auf dem|In der|Unter den|Laan|Plein|Weg|Straat){_SP})?{_W}(?:{_SP}(?:Cad|Sok|Mah|Bulv)\.|{_SP}(?:Caddesi|Sokağı|Sokak|Mahallesi))?{_SP}(?:No:?{_SP}|Nr\.?{_SP})?\d{{1,4}}{_S}?[a-zA-Z]?{_COMMA}{_FIVE}"),
]
# For each pattern, small strings of which its texts hold one.
_HINTS = [("street", "st.", "road", "rd.", "lane", "ln.", "close", "crescent", "ave", "drive", "way", "court", "place", "square", "terrace", "boul", "blvd", "row", "gardens", "hill", "grove", "mews"), ("plot",),
          ("box", "postfach", "b.p.", "postal", "apartado", "postbus", "poczt", "p.k.", "а/я"), (",",), (",",), (",",), ("ул.", "пр.", "просп.", "пер.", "наб.", "пл.", "бул.", "ш."), (",",)]
ADDRESSES = [(h, gate, re.compile(p), re.compile(p, re.I)) for h, (gate, p) in zip(_HINTS, ADDRESSES)]

_LOCAL, _DOMAIN = r"[\w.+%-]*\w", r"\w[\w-]*"
_AT = r"(?:\s?[\[({]\s?(?:at|AT|At|ät|arroba|a|@)\s?[\])}]\s?|\s(?:at|AT|At|ät|arroba)\s|\s?@\s?)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT|Dot|punkt|punto|point)\s?[\])}]\s?|\s(?:dot|DOT|Dot|punkt|punto|point)\s|\.)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9_.+%-])(?P<l>[A-Za-z0-9_.+%-]*[A-Za-z0-9_])(?P<a>{_AT})(?P<d>[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,12}})(?![A-Za-z0-9_@])")
_LOCAL_END = re.compile(r"[A-Za-z0-9_.+%-]*[A-Za-z0-9_]\s?$")
_EMAIL_GATE = re.compile(r"@|[\[({]\s?(?:at|AT|At|ät|arroba|a)\s?[\])}]|\s(?:at|AT|At|ät|arroba)\s(?=[A-Za-z][\w-]*(?:\s(?:dot|DOT|Dot|punkt|punto|point)\s|\.[A-Za-z]))")
PHONE = re.compile(
    r"(?<![A-Za-z0-9+./-])(?:\+\d{1,3}[ \xa0.-]?(?:\(\d{1,4}\)[ \xa0.-]?)?\d{1,4}(?:[ \xa0\n./-]{1,2}\d{2,7}){1,5}|\+\d{1,3}\s?\(\d{2,4}\)\s?\d{3}[ .-]\d{4}"
    r"|\(\d{3}\)\s?\d{3}[ .-]\d{4}|\d{3}([-.])\d{3}\1\d{4}|00\d{1,3}\s\d{1,3}/\d{5,8}|0\d{2,4}-\d{3}\s\d{2}\s\d{2}|0\d{2,4}/\d{5,8}|0\d{2}\s\d{4}\s\d{4}|0\d{3}\s\d{3}\s\d{4})(?![A-Za-z0-9/-]|\.\d)"
)
OWN_ID = re.compile(r"(?<![A-Za-z0-9/-])(?:[A-Z]{5}\d{4}[A-Z]|\d{8}[A-Z]|\d{8}-[\dA-Za-z])(?![A-Za-z0-9/-])")
ANY_ID = re.compile(r"(?<![A-Za-z0-9/.-])(?:[A-Z]{2}\d{7}|\d{3}-\d{2}-\d{4}|\d{4}[ \xa0]\d{4}[ \xa0]\d{4}|\d{4}-\d{4}-\d{4}|\d{9,11})(?![A-Za-z0-9/-])")

_CAPS = re.compile(rf"{_W}")
_SEQ = re.compile(rf"(?:(?:[{_U}]|[{_CU}](?:ж)?)\.(?:-?(?:[{_U}]|[{_CU}](?:ж)?)\.)?[ \xa0-]{{0,2}}(?:\r?\n)?)*(?:{_NAME})")
_INITIAL = rf"(?:[{_U}][̀-ͯ]?|[{_CU}]ж?)\."
_GIVEN_THEN = re.compile(rf"{_S}((?:{_SP}|-)?(?:{_INITIAL}(?:-?{_INITIAL})?(?:{_SP}|-))*)({_NAME})")
_BEFORE_GIVEN = re.compile(rf"({_NAME})(,?{_SP})$")
_INITIAL_FAMILY = re.compile(rf"((?:[{_U}](?<![{_L}.].)[̀-ͯ]?|[{_CU}](?<![{_C}{_CU}.].)ж?)\.(?:{_SP}|-)?(?:{_INITIAL}(?:{_SP}|-)?)?)({_NAME})")
_FAMILY_INITIAL = re.compile(rf"({_NAME}),{_SP}((?:{_INITIAL}){{1,2}})(?![{_L}])")
_TITLED = re.compile(rf"(?:{TITLE}){_SP}((?:{_INITIAL}{_SP})*{_NAME})")
_SONS = re.compile(r"\s*(?:&|und|et|y|e|en|i|ve|и|та)\s+(?:Sons?|Söhne|Fils|Hijos|Figli|Zonen|Filhos|Synowie|Oğulları|сыновья|сини|Co|Bros|Brothers|Daughters)\b")
# Titles by the gender they tell.
_SHE, _HE = set("Mrs Ms Frau Mme Mlle Sra Dra Doña Mevr श्रीमती السيدة خانم".split()), set("Mr Herr Don Dhr M Sig श्री السيد آقای".split())
_TITLE_WORDS = set("Mr Mrs Ms Dr Prof Gen Lt Col Capt Maj Herr Frau Mme Mlle Sr Sra Dra Don Doña Sig Dott Ing Inż Dhr Mevr Ir Sn Инженер Інженер M".split())


class Known:
    """What is learned of a corpus: given names (with 'f', 'm' or ''), words that end names of firms, common words, small words
    of texts without letter case, and the log-odds of a name for the characters around it."""

    def __init__(self, given: dict[str, str] | None = None, endings: frozenset[str] = frozenset(), common: frozenset[str] = frozenset(), small: frozenset[str] = frozenset(), around: dict | None = None):
        self.given = {phonetic(fold(w)): g for w, g in (given or {}).items()}
        self.endings, self.common, self.small, self.around = endings, common, small, around or {}
        self._seen: dict[str, bool] = {}

    def is_given(self, word: str) -> bool:
        """Whether a word is a known given name, in any script and letter case."""
        if word not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[word] = phonetic(fold(word)) in self.given
        return self._seen[word]

    def ends_firm(self, word: str) -> bool:
        return word in self.endings or word.capitalize() in self.endings

    def no_name(self, word: str) -> bool:
        return word in self.common or word in self.endings or word in _TITLE_WORDS


_WIDE = re.compile(r"[^\D0-9]|[＋－（）／．＠，：−‐‑]")


def plain(text: str) -> str:
    """The text with digits and signs of other scripts as plain ones, of the same length."""
    return text.translate(PLAIN) if not text.isascii() and _WIDE.search(text) else text


def _overlaps(spans: list[tuple[int, int, str]], a: int, e: int) -> bool:
    return any(a < y and x < e for x, y, _ in spans)


def _numbers(s: str, low: str, odd: bool) -> list[tuple[int, int, str]]:
    """E-mail addresses, telephone numbers, personal numbers and postal addresses."""
    spans: list[tuple[int, int, str]] = []
    done = 0
    for at in _EMAIL_GATE.finditer(s):
        if at.start() < done:
            continue
        local = _LOCAL_END.search(s, max(done, at.start() - 70), at.start())
        for m in filter(None, [local and EMAIL.match(s, local.start(), at.end() + 100)]):
            if not m.start("a") <= at.start() < m.end("a"):
                continue
            spaced = m["a"].strip(" \xa0").isalpha()
            if spaced and not re.search(r"\b(?:dot|punkt|punto|point)\b|\.(?:example|test|invalid|com|org|net|[a-z]{2})\b", m["d"], re.I):
                continue
            a, e = m.span()
            tail = re.search(r"\.(?=[A-Z][a-z]+$)", m["d"])
            if tail and not m["d"].isupper() and m["d"][: tail.start()].count(".") + len(re.findall(_DOT, m["d"][: tail.start()])) and m["d"][: tail.start()].islower():
                e = m.start("d") + tail.start()
            if not _overlaps(spans, a, e):
                spans.append((a, e, "email"))
            done = e
            break
    last = -1
    for island in _ISLAND.finditer(s):
        size = island.end() - island.start()
        if size > 18 and (m := CARD.search(s, island.start(), island.end())) and luhn(re.sub(r"\D", "", m[0])) or (
            s[max(0, island.start() - 2) : island.start()].isupper() and (m := IBAN.match(s, island.start() - 2)) and iban(m[0])
        ):
            if not _overlaps(spans, *m.span()):
                spans.append((*m.span(), "id_number"))
        if size < 4 or (size < 7 or sum(map(str.isdigit, island[0])) < 7) and not s[island.end() : island.end() + 1].isalpha():
            continue
        from_, to = max(last, island.start() - 6, 0), island.end() + 4
        last = island.end()
        for m in OWN_ID.finditer(s, from_, to):
            if not _overlaps(spans, *m.span()):
                spans.append((*m.span(), "id_number"))
        for m in ANY_ID.finditer(s, from_, to):
            a, e = m.span()
            if e < len(s) and (s[e].isascii() and s[e].isalnum() or s[e] in "/-") or _overlaps(spans, a, e):
                continue
            back = max(0, a - 110)
            stop = max(s.rfind("\n\n", back, a), s.rfind(". ", back, max(back, a - 3)), s.rfind("。", back, a), s.rfind("|", back, a), s.rfind(";", back, a))
            near = low[max(back, stop - 3 if stop > 0 else back) : a]
            good = max((near.rfind(k) for k in PERSONAL), default=-1)
            if good >= 0 and good > max((near.rfind(k) for k in BUSINESS_NO), default=-1):
                spans.append((a, e, "id_number"))
        for m in PHONE.finditer(s, from_, to):
            a, e = m.span()
            if not _overlaps(spans, a, e) and not (e < len(s) and s[e].isascii() and (s[e].isalnum() or s[e] in "/-")):
                spans.append((a, e, "phone"))
    posts: list[re.Match] | None = None
    for hints, anchor, pattern, anycase in ADDRESSES if "0" in low else ():  # an address has a number, here as 0
        done = 0
        if anchor is _POST:
            anchors = posts = [*_POST.finditer(s)] if posts is None else posts
        elif any(h in low for h in hints):
            anchors = anchor.finditer(s)
        else:
            continue
        for at in anchors:
            if at.start() < done:
                continue
            for m in (anycase if odd else pattern).finditer(s, max(done, at.start() - 75), at.end() + 110):
                a, e = m.span()
                if not _overlaps(spans, a, e) and a <= at.start() < e:
                    spans.append((a, e, "address"))
                    done = e
                    break
    return spans


IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:[ \xa0]?[A-Z0-9]{4}){2,7}(?:[ \xa0]?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\d-])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\d-])")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of cards."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an account number hold."""
    plain_ = re.sub(r"\s", "", text)
    return int("".join(str(int(c, 36)) for c in plain_[4:] + plain_[:4])) % 97 == 1


_ISLAND = re.compile(r"[+(]?\d[\d \xa0\r\n().+/-]*\d")


def _even(s: str) -> str:
    """The `plain` text small, digits as 0 and blanks as one kind, of the same length."""
    low = s.lower()
    if len(low) != len(s):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    if low.isascii():
        return low.translate(_EVENED)
    for c in "123456789":  # a search for each is cheaper than a look at each letter
        low = low.replace(c, "0")
    for c in _BLANKS:
        low = low.replace(c, " ")
    return low


#: All blanks of the regular expressions' \\s but the plain one.
_BLANKS = "\t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_EVENED = {i: "0" for i in range(48, 58)} | {i: " " for i in range(128) if chr(i).isspace()}


def _fuller(s: str, taken: bytearray, odd: bool, known: Known, tokens: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """Names with a given name: (start, end, family words)."""
    found: list[tuple[int, int, list[str]]] = []
    done, given = -1, known.is_given
    for a, e, w in tokens:
        if a < done or e - a < 3:
            continue
        if not given(w):
            first = w
            while "-" in first and not given(first):
                first = first.rpartition("-")[0]
            if len(first) < 3 or not given(first):
                continue
            e = a + len(first)
        start, end, family = a, e, []
        after = (_ODD_THEN if odd else _GIVEN_THEN).match(s, e)
        if after and given(after[2]) and not after[1].strip(" -\xa0\r\n"):  # two given names
            e = after.end(2)
            after = (_ODD_THEN if odd else _GIVEN_THEN).match(s, e)
        before = _BEFORE_GIVEN.search(s, max(0, a - 40), a)
        if after and e < after.start(2) and not known.ends_firm(after[2].split("-")[0]) and not given(after[2]) and (not odd or after[2].lower() not in known.small) and "\n\n" not in s[e : after.start(2)]:
            end, family = after.end(2), [after[2]]
        if not family and before and not known.no_name(before[1].split("-")[0]) and not given(before[1]):
            if before[2].strip() == "," or before[1].isupper() and len(before[1]) > 3:
                start, end, family = before.start(1), e, [before[1]]
                tail = _TAIL.match(s, e)
                if tail and before[2].strip() == ",":
                    end = e + len(s[e : tail.end(1)].rstrip())
        if family and 1 not in taken[start:end]:
            found.append((start, end, family))
            done = end
    return found


_TAIL = re.compile(rf"{_SP}((?:{_INITIAL}{_S})+|[{_U}](?![{_L}.]))")
_ANYWORD = re.compile(rf"[{_L}]+(?:-[{_L}]+)?|[{_C}{_CU}]+(?:-[{_C}{_CU}]+)?")
_ODD_THEN = re.compile(rf"{_S}((?:{_SP}|-)?(?:(?:[{_L}]|[{_C}{_CU}]ж?)\.(?:{_SP}|-))*)([{_L}]{{3,}}(?:-[{_L}]{{3,}})*|[{_C}{_CU}]{{3,}}(?:-[{_C}{_CU}]{{3,}})*)")


def _odd(s: str, tokens: list[tuple[int, int, str]]) -> bool:
    """Whether letter case tells nothing, by the whole text and its capitalised words."""
    if tokens and sum(e - a > 3 and w.isupper() for a, e, w in tokens) < 5:
        return not _SMALL_RUN.search(s)
    small, capital = len(_SMALL_RUN.findall(s)), len(_CAPITAL_RUN.findall(s))
    return capital > 5 * small or small > 20 and not tokens


def _words(s: str, odd: bool) -> list[tuple[int, int, str]]:
    return [(*m.span(), m[0]) for m in (_ANYWORD if odd else _ONE).finditer(s)]


class Counts:
    """What stands around full names: counts of the characters on both sides, of full names and of any capitalised words."""

    def __init__(self, known: Known) -> None:
        self.known = known
        self.name: Counter = Counter()
        self.every: Counter = Counter()

    def learn(self, text: str) -> None:
        s = plain(text)
        every, name = self.every, self.name
        tokens = _words(s, False)
        if _odd(s, tokens):
            every.update({"s" + w.lower() for _, _, w in _words(s, True)})
            return
        even = _even(s)
        mask = bytearray(len(s))
        families: set[str] = set()
        for a, e, more in _fuller(s, mask, False, self.known, tokens):
            mask[a:e] = b"\1" * (e - a)
            families.update(p for f in more for p in [f, *f.split("-")])
            left, right = even[max(0, a - 8) : a], even[e : e + 5]
            keys = "l" + left, "r" + right, "b" + left[-6:] + "\0" + right
            name.update(keys)
            every.update(keys)
        keys, at, words, behind, given = [], -1, set(), set(), self.known.is_given
        for i, (a, e, w) in enumerate(tokens):
            words.add(w)
            if i and tokens[i - 1][1] == a - 1 and s[a - 1] in _GAPS and not given(tokens[i - 1][2]):
                behind.add(w)
            if a < at or mask[a]:
                continue
            j = i  # the run of words that begins here
            while j + 1 < len(tokens) and s[tokens[j][1] : tokens[j + 1][0]] in _GAPS:
                j += 1
            at = e = tokens[j][1]
            left, right = even[max(0, a - 8) : a], even[e : e + 5]
            keys += ["l" + left, "r" + right, "b" + left[-6:] + "\0" + right]
        every.update(keys)
        every.update(["w" + w for w in words - families])
        every.update(["e" + w for w in behind - families])

    def settle(self, least: int, often: float, small: float, ending: float) -> Known:
        """What is known, with the log-odds of a name for each surrounding seen with full names often enough."""
        base = (sum(self.name.values()) + 1) / (sum(n for k, n in self.every.items() if k[0] in "lrb") + 2)
        prior = math.log(base / (1 - base))
        around = {}
        for key, n in self.every.items():
            k = self.name[key]
            if key[0] in "lrb" and (k >= least or n >= 4 * least):
                p = (k + 0.5) / (n + 1)
                around[key] = math.log(p / (1 - p)) - prior
        of = lambda side, floor: frozenset(k[1:] for k, n in self.every.items() if k[0] == side and n >= floor)
        endings = frozenset(w for w in of("e", ending) if self.every["e" + w] >= ENDING_PART * self.every["w" + w])
        new = Known(None, endings, of("w", often), of("s", small), around)
        new.given = self.known.given
        return new


_GAPS = (" ", "\xa0")


def names(s: str, taken: list[tuple[int, int, str]], known: Known, odd: bool, even: str, tokens: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Places of persons' names."""
    around, common, given = known.around, known.common, known.is_given
    full = bytearray(len(s))
    for a, e, _ in taken:
        full[a:e] = b"\1" * (e - a)
    found = _fuller(s, full, odd, known, tokens)
    spans: list[tuple[int, int]] = []
    families = {p for _, _, fs in found for f in fs for p in [f, *f.split("-")] if len(p) > 3}

    def add(a: int, e: int) -> None:
        spans.append((a, e))
        full[a:e] = b"\1" * (e - a)

    for a, e, _ in found:
        add(a, e)

    def firm(e: int) -> bool:
        nxt = _NEXT_WORD.match(s, e)
        return bool(nxt) and known.ends_firm(nxt[1]) or bool(_SONS.match(s, e))

    def score(a: int, e: int) -> float:
        left, right = even[max(0, a - 8) : a], even[e : e + 5]
        both = around.get("b" + left[-6:] + "\0" + right)
        one, two = around.get("l" + left, 0.0), around.get("r" + right, 0.0)
        return one + two if both is None else max(both * 1.2, one + two) if both > 0 else one + two + both

    if not odd:
        for m in _INITIAL_FAMILY.finditer(s):
            a, e = m.span()
            w = m[2]
            if e - m.start(2) < 4 or 1 in full[a:e] or known.no_name(w) or firm(e) or s[max(0, a - 2) : a].rstrip(" ").endswith("-"):
                continue
            if w in families or score(a, e) > -1.0:
                add(a, e)
                families |= {p for p in [w, *w.split("-")] if len(p) > 3}
        if _COMMA_INITIAL.search(s):
            for m in _FAMILY_INITIAL.finditer(s):
                a, e = m.span()
                if not 1 in full[a:e] and not known.no_name(m[1]) and len(m[1]) > 3 and (m[1] in families or m[1].isupper() or score(a, e) > 0.0):
                    add(a, e)
                    families.add(m[1])
        titled = [m for a, _, w in tokens if w in _TITLE_WORDS and (m := _TITLED.match(s, a))]
        if not s.isascii():
            titled += _OTHER_TITLED.finditer(s)
        for m in titled:
            a, e = m.span(1)
            before = s[m.start() - 1 : m.start()]
            if e - a > 3 and not before.isalnum() and not 1 in full[a:e] and m[1].split()[-1] not in common and not firm(e):
                more = _MORE_NAME.match(s, e)  # a given name that is not known, and the family name
                if more and not known.no_name(more[1]) and not firm(more.end()) and "." not in m[1]:
                    e = more.end()
                    families.add(more[1])
                add(a, e)
                families.add(m[1].split()[-1])
    elif _CAPS.search(s):  # of capitals: the surroundings must be known
        for m in _INITIAL_FAMILY.finditer(s):
            a, e = m.span()
            if e - m.start(2) >= 4 and 1 not in full[a:e] and not firm(e) and score(a, e) > 1.5:
                add(a, e)
                families.add(m[2])
        for a, e, w in tokens:
            if e - a < 4 or full[a]:
                continue
            left, right = even[max(0, a - 8) : a], even[e : e + 5]
            if 1 not in full[a:e] and "b" + left[-6:] + "\0" + right in around and score(a, e) > 4.0 and not given(w) and not firm(e):
                add(a, e)
    fold_of = {f.lower() for f in families}
    for i, (a, e, w) in enumerate(tokens):
        if e - a < 4 or full[a] or w in known.endings:
            continue
        low = w.lower()
        if low in fold_of or "-" in w and low.split("-")[0] in fold_of:
            if 1 not in full[a:e] and not firm(e) and s[max(0, a - 1) : a] not in ("@", ".", "-", "_"):
                add(a, e)
        elif not odd and w not in common:
            if i + 1 < len(tokens) and tokens[i + 1][0] == e + 1 and s[e] in _GAPS:
                continue
            if i and tokens[i - 1][1] == a - 1 and s[a - 1] in _GAPS and tokens[i - 1][2] not in common:
                continue
            if score(a, e) > 3.2 and not given(w) and not firm(e):
                add(a, e)
                fold_of.add(low)
    return [(a, e, "person_name") for a, e in spans]


_NEXT_WORD = re.compile(rf"[ \xa0]*\n?[ \xa0]*({_W})")
_COMMA_INITIAL = re.compile(rf",\s{{1,3}}{_INITIAL}")
_ONE = re.compile(_NAME)
_MORE_NAME = re.compile(rf"[ \xa0]({_NAME})")
_OTHER_TITLED = re.compile(rf"(?:डॉ\.|श्री|श्रीमती|السيدة|السيد|د\.|خانم|آقای|دکتر){_SP}((?:{_INITIAL}{_SP})*{_NAME})")


def find(text: str | None, known: Known) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each place, in code points, in order and without overlaps."""
    if not text:
        return []
    s = plain(text)
    even, tokens = _even(s), _words(s, False)
    if odd := _odd(s, tokens):
        tokens = _words(s, True)
    spans = _numbers(s, even, odd)
    spans += names(s, spans, known, odd, even, tokens)
    return sorted(spans)


_SMALL_RUN, _CAPITAL_RUN = re.compile(rf"[a-zß-öø-ÿ{_C}]{{3,}}"), re.compile(rf"[A-ZÀ-ÖØ-Þ{_CU}]{{4,}}")


_ANY_TITLE = re.compile(r"(?:" + "|".join(sorted(_TITLE_WORDS | _SHE | _HE, key=len, reverse=True)) + r"|डॉ|د|دکتر)(?=[. \xa0])")  # begins with letters, for a fast search
_INSIDE = re.compile(r"\w")
#: Behind a title, in letters that tell what stands there (`_shape`).
_SHAPE = re.compile(r"\.?_{1,2}(U[l']+(?:['-]?Ul+)*(?:_U[l']+(?:['-]?Ul+)*){1,2})")
_SIGNS = {".": ".", " ": "_", "\xa0": "_", "’": "'", "'": "'", "-": "-"}


def _shape(text: str) -> str:
    """A letter for each: U capital, l small or a mark, _ blank, signs of names as they are, else x."""
    kinds = {"Lu": "U", "Ll": "l", "Mn": "l", "Mc": "l", "Me": "l"}
    return "".join(_SIGNS.get(c) or kinds.get(unicodedata.category(c), "x") for c in text)


def titled(text: str) -> list[tuple[str, list[str]]]:
    """Each title before two or three capitalised words, with these words."""
    found, done = [], 0
    for m in _ANY_TITLE.finditer(text):
        at, size = m.end(), 80
        if m.start() < done or m.start() and _INSIDE.match(text, m.start() - 1) or not text[at : at + 3].lstrip(". \xa0")[:1].isupper():
            continue
        while (words := _SHAPE.match(_shape(text[at : at + size]))) and words.end() > size - 2 and at + size < len(text):
            size *= 2
        if not words and size < len(text) - at and " " not in text[at + 3 : at + size] and "\xa0" not in text[at + 3 : at + size]:  # one very long word
            words = _SHAPE.match(_shape(text[at:]))
        if words:
            found.append((m[0], re.split("[ \xa0]", text[at + words.start(1) : at + words.end(1)])))
            done = at + words.end()
    return found


def given_names(texts: DataFrame, total: int) -> dict[str, str]:
    """Given names, with the gender most of their titles tell, of `total` distinct `texts` (column text).

    A given name is a word between a title and another capitalised word. Every text is read; what comes to the driver is bounded
    by the share `TITLED`, since a text has few titles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, title, w, ws[-1]) for i, t in enumerate(batch.column(1).to_pylist()) for title, ws in titled(t) for w in ws[:-1]]
            columns = [pa.array([x[j] for x in out], pa.string()) for j in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in out], pa.int32())), *columns], names=["t", "title", "word", "last"])

    each = texts.select(F.xxhash64("text").alias("t"), "text").mapInArrow(run, "t long, title string, word string, last string")
    she, he = (F.count_if(F.col("title").isin(*sorted(x))) for x in (_SHE, _HE))
    counts = each.groupBy("word").agg(F.count_distinct("t").alias("n"), she.alias("she"), he.alias("he"), F.approx_count_distinct("last").alias("families"))
    kept = counts.where((F.col("n") >= max(4, math.ceil(total * TITLED))) & (F.col("families") >= FAMILIES))
    return {r.word: "f" if r.she > r.he else "m" if r.he > r.she else "" for r in kept.collect()}


def fit(rows: DataFrame, text_column: str = "text") -> Known:
    """What is to be known of a corpus, counted over all its distinct texts."""
    texts = materialize(rows.select(F.col(text_column).alias("text")).where("text is not null and text != ''").distinct())
    total = texts.count()
    begun = Known(given_names(texts, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Counts(begun)

        def counts() -> pa.RecordBatch:
            keys = [*model.every]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([model.name[k] for k in keys], pa.int64()), pa.array([model.every[k] for k in keys], pa.int64())],
                names=["key", "named", "n"],
            )

        for batch in batches:
            for t in batch.column(0).to_pylist():
                model.learn(t)
                if len(model.every) > HELD:
                    yield counts()
                    model = Counts(begun)
        yield counts()

    sums = materialize(texts.mapInArrow(run, "key string, named long, n long").groupBy("key").agg(F.sum("named").alias("named"), F.sum("n").alias("n")))
    model, least, often = Counts(begun), max(4, math.ceil(total * LEAST)), max(40, total * OFTEN)
    small, ending = max(3, total * OFTEN / 25), max(8, total * ENDING)
    side = F.substring("key", 1, 1)
    floor = F.when(side == "w", min(often, ending)).when(side == "s", small).when(side == "e", ending).otherwise(4 * least)
    kept = (F.col("n") >= floor) | (F.col("named") >= least)
    for r in sums.where(kept).collect():  # bounded by the shares
        model.name[r.key], model.every[r.key] = r.named, r.n
    release(sums)
    release(texts)
    return model.settle(least, often, small, ending)


def _shared(rows: DataFrame, known: Known):
    """What is known, broadcast: its size is bounded by the shares of the texts that its entries must stand in."""
    return rows.sparkSession.sparkContext.broadcast(known)


def located(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: Known | None = None) -> DataFrame:
    """(id, start_c, end_c, kind) of each place. Null, empty and blank texts have none; repeated rows repeat theirs; other
    columns are ignored, whatever their names. `known` is learned from the same rows where it is not given."""
    shared = _shared(rows, fit(rows, text_column) if known is None else known)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = [(i, a, e, k) for i, t in enumerate(part.column(1).to_pylist()) for a, e, k in find(t, shared.value)]
                columns = [part.column(0).take(pa.array([x[0] for x in out], pa.int32())), *(pa.array([x[j] for x in out], pa.int32()) for j in (1, 2)), pa.array([x[3] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start_c", "end_c", "kind"])

    return rows.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, start_c int, end_c int, kind string")


def rewritten(rows: DataFrame, placeholders: dict[str, str] | None = None, key: bytes | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, n_found): each text with its places replaced, by `placeholders` (kind to text) or, without them, by
    surrogates under `key`, of which one must be given then. All else is kept to the letter; null texts stay null."""
    if placeholders is None and not key:
        raise ValueError("surrogates need a key")
    shared = _shared(rows, fit(rows, text_column))
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        made = Surrogates(key, known.given) if placeholders is None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, counts = [], []
                for t in part.column(1).to_pylist():
                    spans = find(t, known)
                    counts.append(len(spans))
                    if not spans:
                        texts.append(t)
                    elif placeholders is None:
                        texts.append(made.rewrite(t, spans))
                    else:
                        bits, here = [], 0
                        for a, e, k in spans:
                            bits += [t[here:a], placeholders.get(k, f"[{k.upper()}]")]
                            here = e
                        texts.append("".join([*bits, t[here:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[id_column, "text", "n_found"])

    return rows.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, text string, n_found int")
