"""Column functions over lines of text: normalisation, line predicates, sizes, tags, dates."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as C


def rx(pattern: str) -> str:
    """Unicode classes, and only a line feed ends a line."""
    return f"(?Ud){pattern}"


def any_match(text: Column, patterns: list[str]) -> Column:
    return text.rlike(rx("|".join(f"(?:{p})" for p in patterns)))


def any_word(text: Column, listed: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in listed])


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(text: Column) -> Column:
    """Compatibility composition; text of one-byte characters only needs none and is spared the Python round trip's work."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(_nfkc(F.when(F.octet_length(text) != F.char_length(text), text)))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Dashes, broken words, ampersands, apostrophes, currency signs and white space, in that order."""
    text = nfkc(text) if compose else text
    text = F.regexp_replace(text, C.DASHES, "-")
    for pattern, joined in C.JOINS:
        text = F.regexp_replace(text, rx(pattern), joined)
    for sign in C.CURRENCIES:
        text = F.regexp_replace(text, rx(rf"(\d+)\s*\{sign}"), rf"$1\{sign}")
    return F.trim(F.regexp_replace(text, rx(r"\s+"), " "))


def has_price(text: Column) -> Column:
    return text.rlike(rx(C.PRICE))


def term_count(text: Column) -> Column:
    """Listed words and regions in the lower-case text; one in both lists counts twice."""
    low = F.lower(text)
    return F.size(F.filter(F.array(*map(F.lit, C.TERMS + C.REGIONS)), lambda w: F.contains(low, w)))


def exclusion_group(text: Column) -> Column:
    """The first group of exclusions that the text hits, or null."""
    low = F.lower(text)
    return reduce(lambda out, g: out.when(any_match(low, C.EXCLUSIONS[g]), F.lit(g)), C.EXCLUSIONS, F.when(F.lit(False), F.lit("")))


def is_item(text: Column) -> Column:
    low = F.lower(text)
    vintage = low.rlike(rx(r"\b(19|20)\d{2}\b")) & any_word(low, C.TERMS + C.REGIONS)
    sign = has_price(low) | vintage | any_match(low, [p for _, p, _ in C.BOTTLES]) | (term_count(text) >= 2)
    return F.coalesce((F.char_length(text) >= 3) & exclusion_group(text).isNull() & sign, F.lit(False))


def line_traits(text: Column) -> dict[str, Column]:
    """What decides whether a line continues another, or is continued: its lead, a price, a house's term, few words."""
    low = F.lower(text)
    tokens = F.size(F.filter(F.split(low, rx(r"\s+")), lambda t: t != ""))
    return {"lead": low.rlike(r"^[a-z&;|\-–(]"), "price": has_price(low), "house": any_word(low, C.HOUSE_TERMS), "few": tokens <= 3}


def is_continuation(text: Column, previous: Column) -> Column:
    own, before = line_traits(text), line_traits(previous)
    return own["lead"] | (before["price"] & ~own["price"]) | (before["house"] & own["few"])


def bottle(text: Column) -> Column:
    """``struct(name, ml)`` of the first size that matches; standard where none does."""
    low = F.lower(text)
    made = lambda n, ml: F.struct(F.lit(n).alias("name"), F.lit(ml).alias("ml"))
    out = None
    for name, pattern, ml in C.BOTTLES:
        out = F.when(low.rlike(rx(pattern)), made(name, ml)) if out is None else out.when(low.rlike(rx(pattern)), made(name, ml))
    return out.otherwise(made("standard", 750))


def variants(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(rx(p)), F.lit(n)) for n, p in C.VARIANTS]), lambda x: x.isNotNull())


def header_level(text: Column) -> Column:
    """1, 2 or 3, or null for a line that is no heading."""
    low = F.lower(text)
    hit = lambda n: any_match(text, C.HEADER_PATTERNS[n]) | any_word(low, C.HEADER_WORDS[n])
    return F.when(hit(1), 1).when(hit(2), 2).when(hit(3), 3)


def date_in_filename(name: Column) -> Column:
    dashed = F.regexp_extract(name, r"(20[0-9]{2}[-_][0-9]{2}[-_][0-9]{2})", 1)
    plain = F.regexp_extract(name, r"(20[0-9]{2}[0-9]{2}[0-9]{2})", 1)
    return F.coalesce(F.try_to_date(F.translate(dashed, "_", "-"), "yyyy-MM-dd"), F.try_to_date(plain, "yyyyMMdd"))


def date_in_metadata(created: Column, modified: Column) -> Column:
    return F.try_to_date(F.regexp_extract(F.coalesce(F.nullif(created, F.lit("")), modified), r"^D:([0-9]{8})", 1), "yyyyMMdd")


def list_date(user: Column, name: Column, created: Column, modified: Column, run_date: str) -> Column:
    """The user's date, else the file name's, else the metadata's, else the run's."""
    return F.coalesce(F.try_to_date(user, "yyyy-M-d"), date_in_filename(name), date_in_metadata(created, modified), F.lit(run_date).cast("date"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_.-]", "_")


def json_number(x: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
