"""Text as columns: normalised titles and artists, trigrams, Dice similarity, genre classes."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that a title loses, one pattern after another, each up to the end.
SUFFIXES = (
    r"\s*[-–—|]\s*(feat|ft|featuring|with)\b.*",
    r"\s+(feat|ft|featuring|with)\b.*",
    r"\s+(remix|remixed|rework|edit)\b.*",
    r"\s+(live|live version|live at\b).*",
    r"\s+(remaster(ed)?|remaster\d{0,4})\b.*",
    r"\s+(radio edit|radio version)\b.*",
    r"\s+(deluxe|deluxe edition|deluxe version)\b.*",
    r"\s+(extended|extended mix|extended version)\b.*",
    r"\s+(acoustic|acoustic version)\b.*",
    r"\s+(album version|single version|original version|original mix)\b.*",
    r"\s+(explicit|clean version|clean)\b.*",
    r"\s+(bonus track|bonus)\b.*",
    r"\s+(mono|stereo)\b.*",
)

#: Where this is not found no suffix is: the sign of the first, or what stands after the space before the others.
_ANY_SUFFIX = r"[-–—|]|\s(?:" + "|".join(p.removeprefix(r"\s+") for p in SUFFIXES[1:]) + ")"

#: Genre classes in the order in which they are tried.
CLASSES = (
    ("latin", "latin|reggaeton|bachata|salsa|urbano|latino|cumbia|corrido|mariachi|bossa"),
    ("r&b", "r&b|rnb|soul|neo-soul|funk|motown|quiet storm"),
    ("rap", "rap|hip hop|hip-hop|trap|drill|grime|phonk|boom bap"),
    ("rock", "rock|metal|punk|alt|grunge|emo|indie rock|hard rock|guitar"),
    ("edm", "edm|electro|house|techno|trance|dubstep|dnb|dance|synth|club|disco|electron"),
    ("pop", "pop|boy band|idol|singer-songwriter|indie pop"),
)


def _composed() -> str:
    """A pattern for ASCII letters that Unicode composes with a mark behind them into one character (NFC), by Unicode's own table."""
    letters: dict[str, str] = {}
    for code in range(0xA0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in string.ascii_letters and unicodedata.normalize("NFC", parts[0] + parts[1]) != parts[0] + parts[1]:
            letters[parts[1]] = "".join(sorted({*letters.get(parts[1], ""), parts[0]}))
    return "|".join(rf"[{found}]\p{{Mn}}*?\x{{{ord(mark):x}}}" for mark, found in sorted(letters.items()))


COMPOSED = _composed()


def normalized(c: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and underscores a space, single spaces, trimmed; null is empty. A letter
    and its accent are one character, however they are written, and so a space."""
    given = F.coalesce(c, F.lit(""))
    one = F.when(F.octet_length(given) == F.length(given), given).otherwise(F.regexp_replace(given, COMPOSED, " "))  # ASCII has no marks
    return F.trim(F.regexp_replace(F.lower(one), r"[^a-z0-9_]+", " "))


def without_suffixes(c: Column) -> Column:
    """A normalised title without closing brackets and without the suffixes of versions."""
    first = F.trim(F.regexp_replace(normalized(c), r"[\(\[][^\)\]]*[\)\]]\s*$", ""))
    cut = reduce(lambda s, pattern: F.trim(F.regexp_replace(s, pattern, "")), SUFFIXES, first)
    return F.when(first.rlike(_ANY_SUFFIX), cut).otherwise(first)  # most titles have none


def artist(c: Column) -> Column:
    """A normalised name without a leading article."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalized(c), r"^the\s+", ""), r"^a\s+", ""))


def trigrams(c: Column) -> Column:
    """The different windows of three characters, with a space on either side."""
    s = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))


#: Characters of normalised texts, in the order of their codes.
ALPHABET = " _" + string.digits + string.ascii_lowercase
GRAMS = len(ALPHABET) ** 3


def gram_coder() -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function of normalised texts (neither null nor empty) that gives their trigrams, with a space on either side, as numbers
    below GRAMS, repeats included, and the text that each belongs to. It is a closure, so tasks need nothing of the package."""
    place, base = np.zeros(256, np.int64), len(ALPHABET)
    place[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(base)

    def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.concat_arrays([texts]).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        length = np.diff(offsets)
        whose = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(data)) + 2 * whose
        padded = np.zeros(len(data) + 2 * len(length) + 2, np.int64)  # 0: a space
        padded[at + 1] = place[data]
        return ((padded[at] * base) + padded[at + 1]) * base + padded[at + 2], whose

    return codes


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of trigrams: 1 for equal texts, 0 if one is empty."""
    x, y = trigrams(a), trigrams(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def genre_class(c: Column) -> Column:
    """The first class with a match in the text, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CLASSES):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out
