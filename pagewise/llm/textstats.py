"""Counts over one whole text, as UTF-8 octets."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = b"#*$%&|<>"

#: Character classes, in histogram order.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "symbol", "other_ascii", "latin_sign", "latin_letter", "other_script", "three_octets", "four_octets")
BEYOND_ASCII, BEYOND_LATIN = 8, 10


def _class_of(c: int) -> int:
    """Class of a character by its first octet; len(CLASSES) for octets that start none."""
    if 97 <= c <= 122:
        return 0
    if 65 <= c <= 90:
        return 1
    if 48 <= c <= 57:
        return 2
    if c == 10:
        return 4
    if c in b" \t\r\x0b\x0c":
        return 3
    if c in b".,;:!?'\"()-":
        return 5
    if c in SYMBOLS:
        return 6
    if c < 0x80:
        return 7
    # U+0080-00BF are signs; Latin letters with marks go up to U+024F; then Greek, Cyrillic and others.
    return 8 + (c >= 0xC3) + (c >= 0xCA) + (c >= 0xE0) + (c >= 0xF0) if c >= 0xC0 else len(CLASSES)


CLASS_OF = np.array([_class_of(c) for c in range(256)])
BLANKS = list(b" \t\n\x0b\x0c\r")

# Function words of the languages known here. Their order has no meaning.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were all their has would what will there if can",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la avec son être mais comme ou si leur y dont elle deux",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta",
}
WORDS_OF = {lang: tuple(dict.fromkeys(w.encode() for w in words.split())) for lang, words in COMMON_WORDS.items()}
#: Of a text in no known language the words of all are counted.
WORDS_OF_ANY = tuple(dict.fromkeys(w for words in WORDS_OF.values() for w in words))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.zeros(len(words) + 1, dtype=np.int32)
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit[i] += 1
            hit[min(i + width, len(words))] -= 1
    return int((np.cumsum(hit) > 0).sum())


def base_counts(text: bytes) -> tuple[list[bytes], np.ndarray, tuple[int, int, int, int, int]]:
    """Words; character classes; and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    octets = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    classes = np.bincount(CLASS_OF, weights=octets, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)
    word_chars = int(octets[:0x80].sum() + octets[0xC0:].sum() - octets[BLANKS].sum())
    symbols = int(octets[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return words, classes, (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words))


def common_counts(words: list[bytes], lang: str | None) -> np.ndarray:
    """How often each of the language's common words occurs, and last all other words."""
    names = WORDS_OF.get(lang, WORDS_OF_ANY)
    often = Counter(words)
    got = [often[w] for w in names]
    return np.array([*got, len(words) - sum(got)], dtype=np.int64)
