"""Parsers of numbers, booleans, dates and model output, as Column expressions; null means that the text can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.text import let, strip, strip_accents

# Words for true and false, stand-ins for an empty value, and month names, without accents.
TRUE_WORDS = ("true", "1", "yes", "y", "sim", "s", "verdadeiro", "urgente")
FALSE_WORDS = ("false", "0", "no", "n", "nao", "falso", "rotina")
EMPTY_WORDS = ("", "null", "none", "nil", "n/a", "na", "-", "--", "nao informado", "nao consta", "ilegivel", "not available", "unknown")
PT_MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
EN_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def folded(c: Column) -> Column:
    return strip_accents(F.lower(strip(c)))


def is_empty_text(c: Column) -> Column:
    return c.isNull() | folded(c).isin(*EMPTY_WORDS)


def parse_bool(c: Column) -> Column:
    return let(folded(c), lambda x: F.when(x.isin(*TRUE_WORDS), F.lit(True)).when(x.isin(*FALSE_WORDS), F.lit(False)))


def parse_number(c: Column) -> Column:
    """Of two kinds of separators the last is the decimal one; a lone comma is decimal."""

    def of(kept: Column) -> Column:
        comma, point = (F.instr(F.reverse(kept), x) for x in ",.")
        plain = (
            F.when((comma > 0) & (point > 0) & (comma < point), F.translate(F.translate(kept, ".", ""), ",", "."))
            .when((comma > 0) & (point > 0), F.translate(kept, ",", ""))
            .otherwise(F.translate(kept, ",", "."))
        )
        return plain.try_cast("double")

    return let(F.regexp_replace(c, r"[^\d,.\-]", ""), of)


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int"))
    return F.when(year.isNull() | month.isNull() | day.isNull(), F.lit(None)).otherwise(F.try_to_date(text, "yyyy-MM-dd"))


def _year(c: Column) -> Column:
    """Two digits: within the fifty years before and after 2026; a fixed rule, so that results don't age."""
    n = c.try_cast("int")
    return F.when(F.length(c) == 2, F.when(n < 76, n + 2000).otherwise(n + 1900)).otherwise(n)


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def parse_date(c: Column, dayfirst: bool = True) -> Column:
    """A full date (day, month and year), else null.

    yyyy-mm-dd at the start is ISO whatever dayfirst says, and null if there is no such day. Otherwise numbers with . / - or
    blanks between them, in the order that dayfirst says unless one of them can only be the day; year first reads the other
    two likewise; month names in English and Portuguese, long or cut to three letters, in any order. Week days,
    ordinal endings and a trailing time are passed over.
    """
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    as_iso = lambda x: _date(*(_group(x, iso, k) for k in (1, 2, 3)))
    return let(strip(c), lambda x: F.when(x.rlike(iso), as_iso(x)).otherwise(_loose_date(x, dayfirst)))


def _loose_date(c: Column, dayfirst: bool) -> Column:
    low = F.regexp_replace(folded(c), r"\bde\b", " ")
    for k, (pt, en) in enumerate(zip(PT_MONTHS, EN_MONTHS, strict=True), 1):
        names = sorted({pt, en, pt[:3], en[:3]} | ({"sept"} if en == "september" else set()), key=lambda n: (-len(n), n))
        low = F.regexp_replace(low, rf"\b({'|'.join(names)})\b\.?", f" m{k:02d} ")
    low = F.regexp_replace(low, r"^[a-z]+(-feira)?,?\s+(?=\d|m\d\d)", "")
    low = F.regexp_replace(low, r"(\d)(st|nd|rd|th|o)\b", "$1")
    low = F.regexp_replace(low, r"[t\s]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(am|pm|z|utc)?$", "")
    return let(F.trim(F.regexp_replace(low, r"[\s,./-]+", " ")), lambda x: _plain_date(x, dayfirst))


def _plain_date(low: Column, dayfirst: bool) -> Column:
    """Of numbers and months written m01 to m12, with blanks between them."""
    named = [(r"^(\d{1,2}) m(\d\d) (\d{4}|\d\d)$", 3, 2, 1), (r"^m(\d\d) (\d{1,2}) (\d{4}|\d\d)$", 3, 1, 2), (r"^(\d{4}) m(\d\d) (\d{1,2})$", 1, 2, 3)]
    found = [_date(_year(_group(low, p, y)), _group(low, p, m), _group(low, p, d)) for p, y, m, d in named]
    for pattern, year, one, two in ((r"^(\d{1,2}) (\d{1,2}) (\d{4}|\d\d)$", 3, 1, 2), (r"^(\d{4}) (\d{1,2}) (\d{1,2})$", 1, 2, 3)):
        y, a, b = _year(_group(low, pattern, year)), _group(low, pattern, one), _group(low, pattern, two)
        first = F.coalesce(_date(y, b, a), _date(y, a, b))
        second = F.coalesce(_date(y, a, b), _date(y, b, a))
        found.append(first if dayfirst else second)
    return F.coalesce(*found)


def parse_json(c: Column) -> Column:
    """The object in a model's output as a variant: from a fenced block, the whole text or the outermost braces; of a list the first element."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    braces = F.when((first > 0) & F.contains(c, F.lit("}")) & (last > first), F.substring(c, first, last - first + 1))

    def object_of(candidate: Column) -> Column:
        kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
        head = lambda v: F.try_variant_get(v, "$[0]", "variant")
        return let(F.try_parse_json(strip(candidate)), lambda v: F.when(kind(v).startswith("OBJECT"), v).when(kind(head(v)).startswith("OBJECT"), head(v)))

    return F.coalesce(object_of(fenced), object_of(c), object_of(braces))
