"""Text normalisers as Column expressions, and the registry that chains of names refer to."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chain that free text is compared under, and prefixes of names that are titles.
DEFAULT_CHAIN = ("collapse_ws", "lower", "strip_accents", "strip_punct", "collapse_ws")
TITLES = "dr|dra|drs|prof|profa"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used: a plan repeats whatever it names twice."""
    return F.element_at(F.transform(F.array(value), lambda bound: use(bound)), 1)


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to one character and marks, and those characters; by rule, over the basic plane."""
    source, target = [], []
    for point in range(0xA0, 0x10000):
        letter = chr(point)
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7B0:  # surrogates; Hangul decomposes to letters, not marks
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != letter:
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Drops combining marks, also those inside precomposed letters."""
    source, target = _accents()
    bare = lambda x: F.regexp_replace(F.translate(x, source, target), r"\p{Mn}+", "")
    return let(c, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(bare(x)))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_punct(c: Column) -> Column:
    """Everything but letters, numbers, _ and white space becomes a space."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", " ")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}+", "")


def strip_titles(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)^\s*({TITLES})\.?\s+", "")


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "strip_accents": strip_accents,
    "collapse_ws": collapse_ws,
    "strip_punct": strip_punct,
    "digits_only": digits_only,
    "strip_titles": strip_titles,
}


def apply_chain(c: Column, chain: Iterable[str] = DEFAULT_CHAIN) -> Column:
    for name in chain:
        if name not in NORMALIZERS:
            raise KeyError(f"unknown normalizer {name!r}; available: {sorted(NORMALIZERS)}")
        c = NORMALIZERS[name](c)
    return c


def casefold(c: Column) -> Column:
    """Lower of upper: folds what lower alone leaves apart, such as sharp s. The optimizer makes one step of two that stand directly in each other, hence the empty text."""
    return F.lower(F.concat(F.upper(c), F.lit("")))


#: A letter outside blocks in which lower is enough: Latin without micro sign, dotted and dotless i and long s; punctuation.
_BEYOND_LOWER = r"[^\x00-\u00b4\u00b6-\u012f\u0132-\u017e\u2000-\u206f]"


@cache
def _letters() -> tuple[str, str]:
    """Letters that lower of upper changes, and what they become, where one letter stays one letter; by rule, over all planes."""
    source, target = [], []
    for point in (*range(0xD800), *range(0xE000, 0x110000)):
        letter = chr(point)
        upper = letter.upper()
        folded = (upper if len(upper) == 1 else letter).lower()[0]  # of i with a dot above, the i
        if folded != letter:
            source.append(letter)
            target.append(folded)
    return "".join(source), "".join(target)


def fold_letters(c: Column) -> Column:
    """Lower of upper, letter by letter, whatever stands beside a letter: sharp s and ligatures stay as they are, and a sigma folds alike at a word's end. As an SQL engine without full case mappings has it."""
    source, target = _letters()
    return let(c, lambda x: F.when((F.octet_length(x) == F.length(x)) | ~F.rlike(x, F.lit(_BEYOND_LOWER)), F.lower(x)).otherwise(F.translate(x, source, target)))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty strings."""

    def of(x: Column) -> Column:
        longer = F.greatest(F.length(x["a"]), F.length(x["b"]))
        return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x["a"], x["b"]) / longer)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def safe_name(c: Column) -> Column:
    """A file name: other characters than letters, digits, . _ - become one dash; 'run' if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("run"))
