"""Problem 9: find text that was decoded with a wrong encoding and restore it, span by span.

Garbled sequences are computed beforehand for all encoding pairs and stand in one Aho-Corasick automaton: of text in UTF-8
read with any one-byte encoding, and of the letters of 27 languages in a one-byte encoding read with any other one. The
first decide by themselves. The second may also be right letters of another language, so the hits of a sentence decide
together, by fixed letter statistics: nothing depends on what else stands in the corpus. Only matched spans are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Python's names of the one-byte encodings that texts are read with.
ONE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman", "mac-cyrillic")
# Letters outside ASCII per thousand letters of a language's text, rounded.
LATIN = {
    "fr": "é19 à5 è2.7 ê2.2 ç.9 î.5 ô.3 û.6 ù.6 â.5 ï.1 ë.1 œ.2", "de": "ü10 ä5.8 ö4.4 ß3.1", "es": "¿.5 ¡.1 ó8.3 í7.3 á5 é4.3 ñ3.1 ú1.7 ü.1", "pt": "ã7.3 ç5.3 é3.4 í2 ó3 ê4.5 á5 õ2 ú2 â2 à.7 ô1.5 ü.1", "it": "è2.6 à6.4 ò1.5 ù1.7 ì.5 é.5", "ca": "à6 é4 è4 ó6 í5 ç1.5 ï1 ò3 ú1.5 ü.5",
    "sv": "ä18 å13.4 ö13 é.3", "da": "å12 ø9.4 æ8.7 é.5", "is": "ð44 á18 í15.7 þ14.6 ó10 æ8.7 ö7.8 é6.5 ú6.1 ý2.3", "fi": "ä36 ö4.4 å.1", "nl": "ë1 é.8 ï.5 ö.2 ü.1 è.2 ó.1", "et": "ä13 õ12 ü8 ö3 š.2 ž.1", "sq": "ë70 ç6",
    "tr": "ı51 ü18.5 ş17.8 ğ11.3 ç11.6 ö7.8 İ3 â.2 î.1", "pl": "ł17.5 ę11 ą10 ó8.5 ż8 ś7 ć4 ń2 ź.8", "cs": "í16.4 á8.7 é6.3 ě12.2 š6.9 č4.6 ř3.8 ž7.2 ý10 ů2 ú1 ó.2 ť.1 ď.2 ň.1", "sk": "á17 í9 é7 ý9 č10 š8 ž9 ú9 ľ4 ť5 ň2 ô2 ä1 ď2 ó.9 ŕ.1 ĺ.1",
    "hu": "é34 á34 ö8.2 ő8.8 ó6.1 ü6.5 í4.8 ú2.3 ű1.9", "ro": "ă40 î14 ş15 ţ10 ș15 ț10 â9", "hr": "č11 š10 ž6 ć8 đ3", "lt": "ė16 š11 ų13 ž9 ū4 į6 ą7 č4 ę2", "lv": "ā40 ī20 ē16 ū6 š9 ž2 ņ6 ļ4 ķ2 ģ1.5 č.8",
}
DENSE = {
    "ru": "о110 е85 а80 и74 н67 т63 с55 р47 в45 л43 к35 м32 д30 п28 у26 я20 ы19 ь17 г17 з16 б16 ч14 й12 х10 ж9 ш7 ю6 ц5 щ3.6 э3.2 ф2.6 ъ.4 ё.4", "uk": "о94 а81 н68 и61 і57 в54 т55 е46 р47 с41 к36 л36 у34 д33 м31 п29 я23 з23 ь18 б17 г16 ч14 й13 х12 ж9 ш8 ц9 ю8 ї7 є6 щ5 ф4 ґ.1",
    "bg": "а115 и95 о92 е86 т74 н69 р52 с48 в45 л36 к34 д33 п28 м25 з22 ъ16 я15 г15 б14 у14 ч12 й7 ж7 щ6 ц5 ш4 х5 ю2 ф3 ь.2", "sr": "а115 о97 е88 и96 н57 р50 с48 т44 в37 ј45 к36 л33 м33 у42 д37 п28 г16 з17 б15 ч9 љ5 ш10 ж6 ц9 х6 њ8 ћ7 ђ2 џ.4 ф2",
    "el": "α99 ά18 ε60 έ21 η43 ή14 ι70 ί23 ο75 ό22 υ36 ύ7 ω18 ώ8 τ80 σ46 ς39 ν63 ρ42 κ41 π41 μ33 λ27 θ10 δ17 γ17 χ12 φ8 β7 ξ5 ζ4 ψ1.5 ϊ.5 ϋ.2 ΐ.2 ΰ.1",
}
#: Log probability under which a character isn't of the language; the one language whose letters are those of garbled Turkish.
RARE, ICELANDIC = float(np.log(3e-5)), list(LATIN).index("is")
#: Sentences and lines, each judged by itself, and words that hold a character outside ASCII.
SENTENCE = re.compile(r"[^\n]*?(?:[.!?][\"')»”]*\s+|\n|$)")
ODD_WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f\s][^\x00-\x40\x5b-\x60\x7b-\x7f\s]*")
#: Characters whose garbled UTF-8 is looked for: Latin (Vietnamese too), combining marks, Greek, Cyrillic, Hebrew, Arabic, spaces and
#: punctuation, currency, arrows, mathematics, kana, ligatures, emoji; beside them all that a one-byte encoding holds.
RANGES = ((0x80, 0x17F), (0x218, 0x21B), (0x300, 0x328), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x5BE, 0x5EA), (0x60C, 0x652), (0x1EA0, 0x1EF9), (0x2002, 0x2044), (0x2060, 0x2063), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265), (0x3001, 0x30FF), (0xFB00, 0xFB02), (0xFEFF, 0xFEFF), (0x1F300, 0x1F64F))
QUOTE_LIKE = frozenset("‘’“”–—…•«»№\xa0")
FLIP = regex.compile(r"\p{Ll}(?=\p{Lu})")
#: Log of how much rarer a capital is right after a small letter, or a symbol between letters; symbols that right text has there.
INSIDE, WITHIN_WORDS = float(np.log(1e-3)), QUOTE_LIKE | frozenset("©®™°·§¶†")


def _byte_table(encoding: str) -> list[str]:
    """What each byte becomes; a byte without a character passes through as the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@cache
def utf8_patterns() -> dict[str, tuple[str, bool, bool]]:
    """Garbled sequence -> (original, weak, Cyrillic). A weak sequence may also be correct text and needs company."""
    out: dict[str, tuple[str, bool, bool]] = {}
    tables = [_byte_table(e) for e in ONE_BYTE]
    wanted = {chr(code) for lo, hi in RANGES for code in range(lo, hi + 1)} | {c for table in tables for c in table if c > "\x7f"}
    for table in tables:
        for original in sorted(wanted):
            garbled = "".join(table[b] for b in original.encode())
            rest, cyrillic = garbled[1:], "Ѐ" <= garbled[0] <= "ӿ"
            weak = garbled[0] == "×" or garbled == "√π" or all(c in QUOTE_LIKE or (cyrillic and "Ѐ" <= c <= "ӿ") for c in rest)
            out.setdefault(garbled, (original, weak and (len(rest) == 1 or cyrillic), cyrillic))
    for b, c in enumerate(tables[0]):
        if 0x80 <= b < 0xA0 and c != chr(b):
            out.setdefault(chr(b), (c, False, False))
    return out


@cache
def encoding_pairs() -> list[dict[str, str]]:
    """For every pair of different one-byte encodings (true, wrong), what each garbled character was."""
    tables = [_byte_table(e) for e in ONE_BYTE]
    return [{w: t for w, t in zip(wrong[128:], true[128:]) if w != t and t.isprintable()} for true, wrong in permutations(tables, 2)]


@cache
def letter_patterns() -> dict[str, np.ndarray]:
    """Garbled letter or quotation mark -> for which of the encoding pairs it is one."""
    letters = {x[0] for v in (*LATIN.values(), *DENSE.values()) for x in v.split()} | QUOTE_LIKE
    pairs = encoding_pairs()
    out: dict[str, np.ndarray] = {}
    for k, pair in enumerate(pairs):
        for garbled, true in pair.items():
            if true in letters or true.lower() in letters:
                out.setdefault(garbled, np.zeros(len(pairs), bool))[k] = True
    return out


class Judge:
    """Finds sentences of a one-byte encoding read with another one, by the likelihood of their letters in the fitting language.

    A letter is told from its place too: right after a small letter there is hardly a capital.
    """

    def __init__(self) -> None:
        listed = [{x[0]: float(x[1:]) / 1000 for x in v.split()} for v in (*LATIN.values(), *DENSE.values())]
        self.dense = np.arange(len(listed)) >= len(LATIN)
        self.listed = listed
        self.ascii = np.log([5e-4 if d else (1 - sum(f.values())) / 15 for f, d in zip(listed, self.dense)]).astype(np.float32)
        self.maps, self.patterns = encoding_pairs(), letter_patterns()
        # among pairs that suit as well, the encodings that most text is in come first
        self.common = np.array([2.0 * (true in ("cp1252", "cp1250", "cp1251")) for true, _ in permutations(ONE_BYTE, 2)])
        self.never = np.zeros(len(self.maps), bool)
        self.plain: dict[tuple[str, int], np.ndarray] = {}
        self.read: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def logs(self, at: tuple[str, int]) -> np.ndarray:
        """Log probability of a character, at its place, in each language."""
        if at not in self.plain:
            c, place = at
            low = c if c == "İ" else c.lower()
            other = 1e-3 if c in QUOTE_LIKE else 2e-5 if c.isalpha() else 5e-6
            self.plain[at] = np.log([f.get(low, other) for f in self.listed]).astype(np.float32) + (INSIDE if (place and c.isupper()) or (place == 2 and not c.isalpha() and c not in "’–") else 0)
        return self.plain[at]

    def readings(self, at: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of encodings: log probabilities of what the character becomes, whether it is foreign then."""
        if at not in self.read:
            logs = np.stack([self.logs((m.get(at[0], at[0]), at[1])) for m in self.maps])
            self.read[at] = logs, logs < RARE
        return self.read[at]

    def counts(self, sentence: str) -> tuple[dict[tuple[str, int], int], int]:
        """The characters outside ASCII that stand in words, with their place (1 after a small ASCII letter, 2 before another letter too), and the number of ASCII letters of those words."""
        odd: dict[tuple[str, int], int] = {}
        plain = 0
        for word in ODD_WORD.findall(sentence):
            if len(word) > 2:  # not units and symbols
                before = " "
                for x, after in zip(word, word[1:] + " "):
                    if x > "\x7f":
                        at = x, ("a" <= before <= "z") + ("a" <= before <= "z" and after.isalpha())
                        odd[at] = odd.get(at, 0) + 1
                    else:
                        plain += 1
                    before = x
        return odd, plain

    def score(self, sentence: str) -> float:
        odd, plain = self.counts(sentence)
        return float((sum((self.logs(c) * n for c, n in odd.items()), np.zeros(1, np.float32)) + self.ascii * plain).max())

    def gains(self, odd: dict[tuple[str, int], int], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """By how much each pair of encodings makes the sentence likelier (0 where it doesn't fit), and for which pairs that alone decides."""
        size = sum(odd.values())
        base = self.ascii * plain
        before = base + sum(self.logs(c) * n for c, n in odd.items())
        lang = int(before.argmax())
        foreign = sum(n for c, n in odd.items() if self.logs(c)[lang] < RARE)
        after, hits, strange = np.tile(base, (len(self.maps), 1)), np.zeros(len(self.maps), int), np.zeros((len(self.maps), len(base)), int)
        for c, n in odd.items():
            logs, odd_then = self.readings(c)
            hit = self.patterns.get(c[0], self.never)
            after += logs * n
            hits += hit * n
            strange += (odd_then & hit[:, None]) * n
        best, at = after.argmax(1), np.arange(len(self.maps))
        gain = np.where((hits > 0) & (strange[at, best] <= 0.05 * hits), after[at, best] - before[lang], 0)
        mean = gain / np.maximum(hits, 1)
        many = self.dense[best] & (hits >= 20) & (mean >= 0.3) & (gain >= 20)
        return gain, (hits >= 3) & (size >= 3) & (many | ((mean >= 2) & (gain >= (12 if foreign else 25))))

    def right(self, sentence: str, odd: dict[tuple[str, int], int], plain: int) -> bool:
        """Whether all letters are of one language and about as frequent as they should be; that is most text and saves the rest."""
        if not odd or _flips(sentence):
            return not odd
        logs = [(self.logs(c), n) for c, n in odd.items()]
        lang = (self.ascii * plain + sum(x * n for x, n in logs)).argmax()
        least = -3.6 if self.dense[lang] else -5.5
        return lang != ICELANDIC and all(x[lang] >= RARE for x, _ in logs) and sum(x[lang] * n for x, n in logs) > least * sum(odd.values())

    def repair(self, text: str, hits: list[int], spans: list[tuple[int, int, str]], utf8: Callable[[str], tuple[str, int]]) -> tuple[str, int]:
        """(text with garbled sentences read anew, number of characters changed).

        ``hits`` and ``spans``: the places of garbled letters and of garbled UTF-8 that the automaton gave; only sentences with letters are judged. A sentence that
        decides by itself gives the document's pairs of encodings; under those the others only have to be likelier. Of pairs
        that suit a sentence nearly as well, the one that suits the whole document best is taken. A sentence that ``utf8``
        makes as likely as any pair, or of which it explains half, is left to that.
        """
        sentences, found, later, at, k, span = [], [], [], 0, 0, 0
        for x in SENTENCE.findall(text):
            if x:
                at += len(x)
                some, explained = k, 0
                while span < len(spans) and spans[span][0] < at:
                    explained += spans[span][1] - spans[span][0]
                    span += 1
                while k < len(hits) and hits[k] < at:
                    k += 1
                sentences.append(x)
                # with fewer than three hits a sentence doesn't decide by itself; it is judged if another one does
                found.append(self._judged(x, explained) if k - some >= 3 else None)
                later.append(explained if 0 < k - some < 3 else None)
        if not any(f and f[1].any() for f in found):
            return text, 0
        found = [f if late is None else self._judged(x, late) for x, f, late in zip(sentences, found, later)]
        total = sum(f[0] for f in found if f) + self.common
        own: list[int | None] = []
        for x, f in zip(sentences, found):
            near = f[1] & (f[0] >= 0.7 * f[0][f[1]].max()) if f and f[1].any() else None
            k = None if near is None else int(np.where(near, total, -np.inf).argmax())
            own.append(k if k is not None and self._better(x, k, utf8) else None)
        known = sorted({k for k in own if k is not None}, key=lambda k: -total[k])
        n, out = 0, []
        for x, f, k in zip(sentences, found, own):
            if k is None and f:
                k = next((j for j in known if f[0][j] >= 4 and self._better(x, j, utf8)), None)
            new = x if k is None else self.reread(x, k)
            n += sum(a != b for a, b in zip(x, new))
            out.append(new)
        return "".join(out), n

    def _judged(self, sentence: str, explained: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The gains; None for a right sentence, and for one of which garbled UTF-8 explains half of the odd characters."""
        odd, plain = self.counts(sentence)
        if self.right(sentence, odd, plain) or (explained and 2 * explained >= sum(c > "\x7f" for c in sentence)):
            return None
        return self.gains(odd, plain)

    def _better(self, sentence: str, k: int, utf8: Callable[[str], tuple[str, int]]) -> bool:
        new, (other, n) = self.reread(sentence, k), utf8(sentence)
        return _flips(new) <= _flips(sentence) and not (n and self.score(other) >= self.score(new))

    def reread(self, text: str, k: int) -> str:
        return "".join(self.maps[k].get(c, c) for c in text)


def _flips(text: str) -> int:
    """Capitals after small letters, which right text hardly has."""
    return len(FLIP.findall(text))


@cache
def _judge() -> Judge:
    return Judge()


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, original in spans:
        parts += [text[at:a], original]
        at = b
    return "".join([*parts, text[at:]])


class Repairer:
    """Matches and replaces the garbled spans of one text at a time."""

    def __init__(self) -> None:
        import ahocorasick

        self.known, self.letters = utf8_patterns(), letter_patterns()
        self.automaton = ahocorasick.Automaton()
        for garbled in {**self.known, **self.letters}:
            self.automaton.add_word(garbled, (len(garbled), garbled in self.known, garbled in self.letters))
        self.automaton.make_automaton()

    def match(self, text: str) -> tuple[list[tuple[int, int, str]], list[int]]:
        """Spans of garbled UTF-8 to replace (the longest match at each place, weak ones only in company), and the places of garbled letters."""
        spans: list[tuple[int, int]] = []
        letters = []
        for end, (size, utf8, letter) in self.automaton.iter(text):
            if letter:
                letters.append(end)
            if utf8:
                start = end + 1 - size
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if not spans or spans[-1][1] <= start:
                    spans.append((start, end + 1))
        info = [self.known[text[a:b]] for a, b in spans]
        if not info or any(not weak for _, weak, _ in info):
            return [(a, b, original) for (a, b), (original, _, _) in zip(spans, info)], letters
        out = []
        for k, ((a, b), (original, _, cyrillic)) in enumerate(zip(spans, info)):
            before, after = k and spans[k - 1][1] == a, k + 1 < len(spans) and spans[k + 1][0] == b
            inside = a and b < len(text) and text[a - 1].isalpha() and text[b].isalpha()
            run = (k > 1 and before and spans[k - 2][1] == spans[k - 1][0]) or (before and after) or (after and k + 2 < len(spans) and spans[k + 1][1] == spans[k + 2][0])
            if run if cyrillic else (before or after or inside):
                out.append((a, b, original))
        return out, letters

    def _utf8(self, text: str) -> tuple[str, int]:
        """(text with garbled UTF-8 replaced, number of characters that were garbled)."""
        spans = self.match(text)[0]
        return _replaced(text, spans), sum(b - a for a, b, _ in spans)

    def _misplaced(self, text: str, letters: list[int]) -> list[tuple[int, str]]:
        """Garbled letters that show by their place: symbols, or capitals, among the small letters of a word of four or more."""
        out = []
        for i in letters:
            c = text[i]
            if 0 < i < len(text) - 1 and "a" <= text[i + 1] <= "z" and c not in WITHIN_WORDS and ((small := "a" <= text[i - 1] <= "z") or "A" <= text[i - 1] <= "Z"):
                symbol = unicodedata.category(c)[0] in "PS" and unicodedata.category(c) != "Sm"
                if symbol or c.isupper():
                    a = b = i
                    while a and text[a - 1].isascii() and text[a - 1].isalpha():
                        a -= 1
                    while b + 1 < len(text) and text[b + 1].isascii() and text[b + 1].isalpha():
                        b += 1
                    pairs = encoding_pairs()
                    true = next((t for k in np.flatnonzero(self.letters[c]) if (t := pairs[k][c]).islower() and t < "\u0250"), None)
                    if true and (b - i >= 3 if not (small or symbol) else b - a >= 3 - symbol):
                        out.append((i, true))
        return out

    def repair(self, text: str | None) -> tuple[str | None, int, bool]:
        """(restored text, number of garbled spans, whether all could be restored)."""
        if not text or text.isascii():
            return text, 0, True
        spans, letters = self.match(text)
        # letters first, as some of them would pass for garbled UTF-8
        text, n = _judge().repair(text, letters, spans, self._utf8)
        again = bool(spans)
        if n:
            spans, letters = self.match(text)
        while spans:  # text garbled several times is restored layer by layer; each makes it shorter or has fewer controls
            n += len(spans)
            text = _replaced(text, spans)
            spans, letters = self.match(text)
        if again:
            text, more = _judge().repair(text, letters, spans, self._utf8)
            n += more
            letters = self.match(text)[1] if more else letters
        if hits := self._misplaced(text, letters):
            chars = list(text)
            for i, c in hits:
                chars[i] = c
            text, n = "".join(chars), n + len(hits)
        lost = text.count("�")
        return text, n + lost, not lost and not re.search(r"[\x80-\x84\x86-\x9f]", text)


def repair_encoding(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The garbled documents: ``key``, garbled_spans, restorable, restored (the text with the matched spans replaced).

    Each document is judged by itself, in one pass without a shuffle. Characters that were lost (U+FFFD) count as garbled
    and stay as they are, with restorable false. Null, empty and plain ASCII texts give no row; equal rows give equal rows.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer()
        for part in rows:
            done = [(k, *repairer.repair(t)) for k, t in zip(part["k"], part["t"])]
            yield pd.DataFrame([(k, n, ok, t) for k, t, n, ok in done if n], columns=["k", "n", "ok", "t"])

    dirty = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.octet_length("t") > F.length("t"))
    return dirty.mapInPandas(run, f"k {kind}, n int, ok boolean, t string").select(F.col("k").alias(key), F.col("n").alias("garbled_spans"), F.col("ok").alias("restorable"), F.col("t").alias("restored"))
