"""Personal data: plain patterns, and the same behind disguises, mapped back to the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind changes no match: a run of digits that fails from its start fails from inside.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and LOCAL.match(text, a - 1):
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _part(digits: str) -> bool:
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns; a match that fails its check is passed over."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _look_alikes() -> dict[int, str | None]:
    """Characters that stand for one ASCII character: compatibility forms and decimal digits
    by rule, letters of other scripts by shape, and invisible ones, which go."""
    table: dict[int, str | None] = {}
    for first, last in ((0x2070, 0x208E), (0x2460, 0x2468), (0xFE50, 0xFE6B), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x0660, 0x0669), (0x06F0, 0x06F9), (0x0966, 0x096F)):
        for c in range(first, last + 1):
            n = unicodedata.normalize("NFKC", chr(c))
            n = str(unicodedata.decimal(n)) if len(n) == 1 and unicodedata.decimal(n, None) is not None else n
            if len(n) == 1 and n.isascii() and n.isprintable():
                table[c] = n
    # Cyrillic and Greek letters and signs by the ASCII character they look like.
    table |= {ord(a): b for a, b in zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαοορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaoopvABEZHIKMNOPTYX")}
    table |= {ord(c): "-" for c in "‐‑‒–−"} | {ord("․"): ".", ord("。"): ".", ord(" "): " ", ord(" "): " ", ord(" "): " "}
    return table | {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


ALIKE = _look_alikes()
ALIKE_SET = frozenset(map(chr, ALIKE))
ALIKE_ANY = re.compile("[" + "".join(map(re.escape, map(chr, sorted(ALIKE)))) + "]")

# Spelled digits by language.
SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0", "plus": "+"}
DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Four digits or numbers in a row, some spelled; prose has fewer.
ONE = rf"(?:{DIGIT}|[0-9]{{1,4}})"
SPELLED_RUN = re.compile(rf"(?<!\w){ONE}(?:(?:\s{{1,3}}|\s?[-.,/]\s?|\s{{1,3}}(?:dot|point|punkt|punto)\s{{1,3}}){ONE})" "{3,}" r"(?!\w)", re.I)
SPELLED_ONE = re.compile(rf"(?<!\w)({DIGIT})(?!\w)(?:\s{{1,3}}(?=(?:{DIGIT})(?!\w)))?", re.I)
DOTS = "dot|punkt|punto|point"
OPEN, CLOSE = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
A_DOT = rf"(?:{OPEN}(?:{DOTS}|\.){CLOSE}|[ \t]{{1,3}}(?:{DOTS})[ \t]{{1,3}})"
# Letters that stand for a digit beside digits.
LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1"}
LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl](?=[0-9 .()-])|(?<=[0-9 .()+-])[OoIl](?=[0-9])|(?<=[0-9])[OoIl](?![A-Za-z0-9])|(?<=[0-9]\.)[OoIl](?![A-Za-z0-9])")
# Last labels of host names of more than two letters; those of two that are
# words, which end an address only before a sign or the text's end; words that no host is named by.
TOP = "com|org|net|edu|gov|mil|int|info|dev|app|biz|name|pro|shop|site|online|tech|cloud|blog|example|test"
WORDY = "am|an|as|at|be|by|do|go|he|if|in|is|it|me|my|no|of|on|or|so|to|up|us|we|la|le|se|er|im|um|ja|el|un|al|ya"
ARTICLES = "the|a|an|this|that|each|every|one|its|your|my|der|die|das|le|la|les|el|los|las"
LAST = rf"(?:(?:{TOP}|(?!(?:{WORDY})(?![A-Za-z0-9-]))[A-Za-z]{{2}})(?![A-Za-z0-9-])|(?:{WORDY})(?=[ \t]*(?:[\n\r.,;:!?)\]}}>\"']|\Z)))"
#: As a bare word, "at" is a sign only before host labels with spelled dots and a last label of these.
AT = re.compile(
    rf"(?:{OPEN}(?:at|arroba|@){CLOSE}|[ \t]{{1,3}}(?:at|arroba|@)[ \t]{{1,3}}(?!(?:{ARTICLES})[ \t])(?=(?:[A-Za-z0-9-]{{1,63}}{A_DOT}){{1,8}}{LAST})"
    rf"|(?:[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})(?=(?:[A-Za-z0-9-]{{1,63}}[ \t]?\.[ \t]?){{1,8}}{LAST}))",
    re.I,
)
DOT = re.compile(rf"{A_DOT}|[ \t]\.[ \t]?(?=(?:{TOP}|[A-Za-z]{{2}})(?![A-Za-z0-9-]))", re.I)


class Tape:
    """A text under change, with the source span of each of its characters (eight octets a character)."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + 1

    def rewrite(self, pattern: re.Pattern, out: Callable[[re.Match], str | None]) -> Tape:
        """Each match becomes ``out`` of it: one character, which spans the match, or none (None: as it is)."""
        text, done = [], 0
        kept = np.ones(len(self.text), dtype=bool)
        spans = []
        for m in pattern.finditer(self.text):
            new = out(m)
            if new is None:
                continue
            a, b = m.span()
            text += self.text[done:a], new
            kept[a + len(new) : b] = False
            if new:
                spans.append((a, b - 1))
            done = b
        if text:
            text.append(self.text[done:])
            if spans:
                first, last = np.array(spans).T
                self.end[first] = self.end[last]
            self.text, self.start, self.end = "".join(text), self.start[kept], self.end[kept]
        return self


def _spell(tape: Tape) -> Tape:
    runs = [m.span() for m in SPELLED_RUN.finditer(tape.text)]
    if not runs:
        return tape
    inside = iter(runs)
    a, b = next(inside)

    def digit(m: re.Match) -> str | None:
        nonlocal a, b
        while m.start() >= b:
            if (n := next(inside, None)) is None:
                return None
            a, b = n
        return SPELLED[m[1].lower()] if a <= m.start() else None

    return tape.rewrite(SPELLED_ONE, digit)


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans, in the source, of what the base patterns find only after normalisation.

    Transducers in turn: look-alike characters, letters for digits, runs of
    spelled digits, at and dot in brackets, as words or set apart. Each keeps the source span of every character
    it writes, so a finding in the last text is one in the source.
    """
    tape = Tape(text)
    if not (text.isascii() or ALIKE_SET.isdisjoint(text)):
        tape.rewrite(ALIKE_ANY, lambda m: ALIKE[ord(m[0])] or "")
    tape.rewrite(LETTER_DIGIT, lambda m: LETTER_DIGITS[m[0]])
    tape = _spell(tape)
    tape.rewrite(AT, lambda m: "@")
    tape.rewrite(DOT, lambda m: ".")
    if tape.text == text:
        return []
    out = []
    for a, kind, b in plain_spans(tape.text):
        s, e = int(tape.start[a]), int(tape.end[b - 1])
        if text[s:e] != tape.text[a:b]:
            out.append((s, kind, e))
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the disguised ones that no base span of the kind holds."""
    base = plain_spans(text)
    of = [[(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))]

    def held(a: int, kind: int, b: int) -> bool:
        """Base spans of a kind lie apart, so only the last that begins by ``a`` may hold it."""
        i = bisect_right(of[kind], a, key=lambda x: x[0])
        return i > 0 and of[kind][i - 1][1] >= b

    return base, sorted({*base, *(x for x in disguised_spans(text) if not held(*x))})


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


@F.pandas_udf(FOUND)
def found_udf(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        base, spans = find(t)
        counts = [0, 0, 0, 0]
        for _, k, _ in base:
            counts[k] += 1
        rows.append((*counts, named(base), named(spans)))
    return pd.DataFrame(rows, columns=FOUND.names)


def personal_data(docs: DataFrame, text_col: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with a struct ``out``: counts of base spans by kind, ``base`` and all ``spans`` as text.

    Whole texts are read, in time linear in their length (up to the sorting of
    spans); null and empty ones have none; repeated rows stay. Of spans that
    begin together the kinds' order decides. A column of the name ``out`` is
    replaced, others stay as they are. No rows: none. No shuffle.
    """
    return docs.withColumn(out, found_udf(F.coalesce(text_col, F.lit(""))))


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping ones the first."""
    parts, done = [], 0
    for a, k, b in find(text)[1]:
        if a >= done:
            parts += text[done:a], f"<{KINDS[k]}>"
            done = b
    return "".join([*parts, text[done:]])


def masked_column(text_col: str = "text") -> Column:
    """``masked`` for a column; a null text stays null."""

    @F.pandas_udf(T.StringType())
    def mask(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t) for t in text], dtype=object)

    return mask(text_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: one row per document; counts are of base spans."""
    got = personal_data(docs.select("doc_id", "text"))
    return got.select("doc_id", *(f"found.n_{k}" for k in KINDS), F.sha2("found.base", 256).alias("base_sha256"), "found.spans")
