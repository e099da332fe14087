"""Keyed surrogates of personal values: other values of the same kind, script and format, one to one over any corpus.

A word is a number in a mixed base: each letter a digit among the letters of its kind (vowels, consonants, letters of one
script block, decimal digits). A keyed permutation of all numbers of that base (a Feistel network with cycle walking, used
to conjugate a keyed shift, so that no number stays where it is) gives the surrogate. It is a function of key and folded
word alone: equal words get equal surrogates in every text, so references stay together, and as it is a permutation
different words of one pattern never meet. Words of different patterns differ in their patterns. No table of
values is kept, and nothing has to be looked up or drawn again.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

from .names import fold, phonetic

_VOWELS, _CONSONANTS, _DIGITS = "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789"
# A Cyrillic letter for each Latin one.
_CYRILLIC = dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопщрстувшэызж"))
_CYRILLIC |= {"j": "ж", "p": "п", "q": "щ", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "ш", "x": "э", "y": "ы", "z": "з"}
# First and last letters of blocks of scripts whose letters have no case.
_BLOCKS = [(0x0627, 0x064A), (0x0904, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
#: Endings of surrogate given names by gender; no ending is the same for two of them.
_ENDING = {"f": "a", "m": "o", "": "e"}
# Words of addresses that are kept.
_KEEP = set("street st road rd lane ln close crescent avenue ave drive way court place square terrace boulevard blvd row gardens hill flat unit apt apartment suite plot no nr industrial estate sector box p o po b upper lower new old north south east west port fort calle av rua via rue cad sok am laan postfach ul ул вул г м д кв корп оф буд".split())
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CYR = re.compile("[Ѐ-ӿ]")


def _letters(c: str) -> str | range | None:
    """The letters a letter may become; None for signs."""
    if c in _VOWELS:
        return _VOWELS
    if c in _CONSONANTS:
        return _CONSONANTS
    if c.isdecimal():
        return _DIGITS
    return next((range(a, e + 1) for a, e in _BLOCKS if a <= ord(c) <= e), None)


class Surrogates:
    """Keyed, type-consistent replacements; `given` are known given names (folded) with 'f', 'm' or ''."""

    def __init__(self, key: bytes, given: dict[str, str] | None = None):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.given = given or {}
        self._word = functools.lru_cache(maxsize=200_000)(self._word_of)

    def _round(self, kind: str, i: int, size: int, value: int, bits: int) -> int:
        data = f"{kind}|{i}|{size}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") & ((1 << bits) - 1)

    def _permute(self, n: int, size: int, kind: str, back: bool) -> int:
        """A permutation of 0 .. size - 1, or its inverse."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        rounds = range(7, -1, -1) if back else range(8)
        while True:
            left, right = n >> half, n & ((1 << half) - 1)
            for i in rounds:
                if back:
                    left, right = right ^ self._round(kind, i, size, left, half), left
                else:
                    left, right = right, left ^ self._round(kind, i, size, right, half)
            n = left << half | right
            if n < size:
                return n

    def number(self, n: int, size: int, kind: str) -> int:
        """Another number of 0 .. size - 1, one to one."""
        if size < 2:
            return n
        shift = 1 + self._round(kind, 99, size, 0, 200) % (size - 1)
        return self._permute((self._permute(n, size, kind, False) + shift) % size, size, kind, True)

    def shaped(self, text: str, kind: str) -> str:
        """Other letters and digits in the places of small letters and digits, all else kept."""
        sets = [_letters(c) for c in text]
        n, size = 0, 1
        for c, letters in zip(text, sets):
            if letters is not None:
                digit = ord(c) - letters.start if isinstance(letters, range) else unicodedata.decimal(c) if letters is _DIGITS else letters.index(c)
                n, size = n * len(letters) + digit, size * len(letters)
        n, out = self.number(n, size, kind), []
        for c, letters in zip(reversed(text), reversed(sets)):
            if letters is not None:
                n, digit = divmod(n, len(letters))
                c = chr(letters[digit]) if isinstance(letters, range) else chr(ord(c) - unicodedata.decimal(c) + digit) if letters is _DIGITS else letters[digit]
            out.append(c)
        return "".join(reversed(out))

    def _word_of(self, folded: str) -> str:
        return self.shaped(folded, "word")

    def word(self, word: str) -> str:
        """A word of a name in the script and letter case of `word`."""
        low = fold(word)
        gender = self.given.get(phonetic(low)) if len(low) > 2 else None
        new = self._word(low) + (_ENDING[gender] if gender is not None else "")
        if _CYR.match(word):
            new = "".join(_CYRILLIC.get(c, c) for c in new)
        return new.upper() if word.isupper() and (len(word) > 1 or len(new) == 1) else new.capitalize() if word[:1].isupper() else new

    def _phone(self, value: str) -> str:
        """The country code kept, the other digits changed as one number."""
        code = re.match(r"\s*(?:\+|00)\d{1,3}(?=[ \xa0().-])", value)
        at = code.end() if code else 0
        return value[:at] + self.shaped(value[at:], "phone")

    def _id(self, value: str) -> str:
        """Other letters and digits of the same kinds; check digits and letters hold again where they held."""
        from .personal import iban, luhn

        small = value.lower()
        digits = re.sub(r"\D", "", value)
        recase = lambda new: "".join(n.upper() if c.isupper() else n for c, n in zip(value, new))
        if re.fullmatch(r"[A-Z]{2}\d{2}[ \xa0A-Z0-9]+", value) and len(value) >= 15 and iban(value):
            body = recase(small[:4] + self.shaped(small[4:], "id"))
            plain = re.sub(r"\s", "", body)
            check = 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97
            return body[:2] + f"{check:02d}" + body[4:]
        if digits.isascii() and len(digits) == 16 and not re.search(r"[^\W\d]", value) and luhn(digits):
            body = self.shaped(value[:-1], "id")
            return next(body + c for c in _DIGITS if luhn(re.sub(r"\D", "", body) + c))
        if re.fullmatch(r"\d{8}[A-Z]", value) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(value[:8]) % 23] == value[8]:
            body = self.shaped(value[:8], "id")
            return body + "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23]
        return recase(self.shaped(small, "id")) if len(small) == len(value) else self.shaped(value, "id")

    def replace(self, value: str, kind: str) -> str:
        """The surrogate of a value of a kind."""
        if kind == "phone":
            return self._phone(value)
        if kind == "id_number":
            return self._id(value)
        if kind == "email":
            end = re.search(r"[A-Za-z]{2,12}$", value)  # the last part of the domain stays
            head, tail = (value[: end.start()], value[end.start() :]) if end else (value, "")
            keep = {"at", "dot", "punkt", "punto", "point", "arroba", "a"}
            return _WORD.sub(lambda m: m[0] if m[0].lower() in keep else self.shaped(m[0], "digits") if m[0].isdecimal() else self.word(m[0]), head) + tail
        if kind == "address":
            return _WORD.sub(lambda m: self.shaped(m[0], "house") if m[0].isdecimal() else m[0] if m[0].lower() in _KEEP or len(m[0]) < 3 else self.word(m[0]), value)
        return _WORD.sub(lambda m: self.word(m[0]), value)

    def rewrite(self, text: str, spans: list[tuple[int, int, str]]) -> str:
        """The text with a surrogate in each place."""
        out, at = [], 0
        for a, e, kind in spans:
            out += [text[at:a], self.replace(text[a:e], kind)]
            at = e
        return "".join([*out, text[at:]])
