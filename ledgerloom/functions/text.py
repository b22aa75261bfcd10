"""Text rules of the curation jobs as column expressions; only identifiers need an Arrow helper."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as blank in a cell: ASCII and Unicode spaces, line separators, byte-order mark.
BLANK = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Month names.
MONTHS = ["януари", "февруари", "март", "април", "май", "юни", "юли", "август", "септември", "октомври", "ноември", "декември"]
#: The official transliteration. One-letter images, then the longer ones.
ONE_TO_ONE = ("абвгдезийклмнопрстуфхъь", "abvgdeziyklmnoprstufhay")
MULTI = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ю": "yu", "я": "ya"}
TRUE_WORDS = ["true", "да", "yes", "1", "y"]
FALSE_WORDS = ["false", "не", "no", "0", "n"]


#: The characters of BLANK.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


_ISO = r"^\d{4}-\d{2}-\d{2}(?:T.+)?$"
_DMY = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
_NAMED = r"^(\d{1,2})\s+(\p{L}+)\s+(\d{4})$"


def _month(low: Column) -> Column:
    """Number of the month that a lower-case date names; 0 for another word."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, _NAMED, 2))


def parse_date(c: Column, trimmed: bool = False) -> Column:
    """YYYY-MM-DD or null: ISO date or timestamp, day-month-year, or day, month name, year. Ranges aren't checked."""
    t = c if trimmed else trim(c)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    low = F.lower(t)
    return (
        F.when(F.rlike(t, F.lit(_ISO)), F.substring(t, 1, 10))
        .when(
            F.rlike(t, F.lit(_DMY)),
            F.concat_ws("-", F.regexp_extract(t, _DMY, 3), two(F.regexp_extract(t, _DMY, 2)), two(F.regexp_extract(t, _DMY, 1))),
        )
        .when(
            F.rlike(low, F.lit(_NAMED)) & (_month(low) > 0),
            F.concat_ws("-", F.regexp_extract(low, _NAMED, 3), two(_month(low)), two(F.regexp_extract(low, _NAMED, 1))),
        )
    )


def is_date(c: Column, trimmed: bool = False) -> Column:
    """Whether ``parse_date`` gives a date, without making it."""
    t = c if trimmed else trim(c)
    low = F.lower(t)
    return F.rlike(t, F.lit(_ISO)) | F.rlike(t, F.lit(_DMY)) | (F.rlike(low, F.lit(_NAMED)) & (_month(low) > 0))


GROUPED = f"^-?\\d{{1,3}}(?:(?:{BLANK}|\\.)\\d{{3}})*(?:,\\d+)?$"
PLAIN = r"^-?\d+(?:\.\d+)?$"


def number_rule(c: Column, trimmed: bool = False) -> Column:
    """decimal-comma-to-point, decimal-point, integer, or null when not a number."""
    t = c if trimmed else trim(c)
    return (
        F.when(F.rlike(t, F.lit(GROUPED)), F.when(F.contains(t, F.lit(",")), "decimal-comma-to-point").otherwise("integer"))
        .when(F.rlike(t, F.lit(PLAIN)), F.when(F.contains(t, F.lit(".")), "decimal-point").otherwise("integer"))
    )


def parse_number(c: Column, trimmed: bool = False) -> Column:
    t = c if trimmed else trim(c)
    grouped = F.replace(F.regexp_replace(t, f"{BLANK}|\\.", ""), F.lit(","), F.lit("."))
    return F.when(F.rlike(t, F.lit(GROUPED)), grouped).when(F.rlike(t, F.lit(PLAIN)), t).try_cast("double")


def parse_boolean(c: Column, trimmed: bool = False) -> Column:
    t = F.lower(c if trimmed else trim(c))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def transliterate(c: Column) -> Column:
    """Cyrillic to Latin; the case of a letter is kept on the first letter of its image."""
    small, large = ONE_TO_ONE
    out = F.translate(c, small + small.upper(), large + large.upper())
    for cyr, lat in MULTI.items():
        out = F.replace(F.replace(out, F.lit(cyr), F.lit(lat)), F.lit(cyr.upper()), F.lit(lat.capitalize()))
    return out


def slug(c: Column, longest: int = 80) -> Column:
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.when(F.coalesce(cut, F.lit("")) == "", "item").otherwise(cut)


def has_cyrillic(c: Column) -> Column:
    return F.rlike(c, F.lit("[А-Яа-яЁёЍѝ]"))


def is_cyrillic(c: Column) -> Column:
    """Only Cyrillic letters, blanks, digits and marks, and at least one letter."""
    return has_cyrillic(c) & ~F.rlike(c, F.lit("[A-Za-z]"))


def query_terms(c: Column) -> Column:
    """All terms of a query, each required."""
    return F.filter(F.split(F.lower(trim(c)), f"{BLANK}+"), lambda t: t != "")


def tokens(c: Column) -> Column:
    """Index tokens: runs of letters and digits, case folded, diacritics kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def is_number_text(c: Column) -> Column:
    """Decimal notation only; casts also take words like NaN or 1d."""
    return F.rlike(trim(c), F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"))


def sort_keys(c: Column, descending: bool = False) -> list[Column]:
    """Order of grid cells: numbers by value, then text by Bulgarian collation, blanks last (first when descending)."""
    text = F.coalesce(c, F.lit(""))
    kind = F.when(is_number_text(text), 0).when(text != "", 1).otherwise(2)
    keys = [kind, F.when(is_number_text(text), trim(text)).try_cast("double"), F.collate(text, "bg")]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


_SMALL, _LARGE = ONE_TO_ONE
_LATIN = {**dict(zip(_SMALL, _LARGE, strict=True)), **MULTI}
_LATIN |= {k.upper(): v.capitalize() for k, v in _LATIN.items()}
_LATIN_TABLE = str.maketrans(_LATIN)
_IDENTIFIER = re.compile(r"[a-z][a-z0-9_]*")


def identifier(name: str) -> str:
    """A column name fit for SQL from any header: transliterated, decomposed, lower case, '_' elsewhere."""
    plain = unicodedata.normalize("NFKD", name.translate(_LATIN_TABLE)).lower()
    plain = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else "_" for c in plain)
    plain = "_".join(x for x in plain.split("_") if x)
    found = plain if "a" <= plain[:1] <= "z" else "c_" + plain
    if not _IDENTIFIER.fullmatch(found):
        found = "c_" + "".join(c for c in found if c == "_" or (c.isascii() and c.isalnum()))
    return found


def identifiers(headers: list[str]) -> list[str]:
    """Distinct identifiers of one table's headers; a repeat gets the first free number."""
    taken: set[str] = set()
    out = []
    for h in headers:
        base = name = identifier(h or "")
        n = 1
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def column_names(headers: pd.Series) -> pd.Series:
    """array of headers to array of identifiers (NFKD has no built-in)."""
    return headers.map(lambda hs: identifiers(list(hs)) if hs is not None else None)
