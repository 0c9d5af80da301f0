"""Confidence of field values and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import any_word, rx


def is_valid(field: str | Column, value: Column) -> Column:
    """Whether a value fits its field; missing values do not, fields without a check do."""
    size, low = F.char_length(value), F.lower(value)
    shady = any_word(low, C.RANK_WORDS)
    checks = {
        "vintage": value.rlike(rx(C.VINTAGE_VALUE)),
        "price": value.rlike(rx(C.PRICE_VALUE)),
        "bottle_size": value.rlike(rx(C.SIZE_VALUE)),
        "country": size.between(2, 50),
        "region": size.between(2, 100),
        "producer": size.between(2, 100) & ~shady,
        "cuvee": size.between(1, 100),
    }
    out = F.when(value.isNull() | (value == ""), False)
    if isinstance(field, str):  # a known name needs no cases
        return out.otherwise(checks.get(field, F.lit(True)))
    for name, ok in checks.items():
        out = out.when(field == name, ok)
    return out.otherwise(True)


def checked(field: Column, value: Column) -> Column:
    """``struct(valid, confidence)``: .0 for missing values, .7 for fields without a check, else .9 or .3."""
    missing = value.isNull() | (value == "")
    known = field.isin("vintage", "price", "bottle_size", "country", "region", "producer", "cuvee")
    valid = is_valid(field, value)
    return F.struct(valid.alias("valid"), F.when(missing, 0.0).when(~known, 0.7).when(valid, 0.9).otherwise(0.3).alias("confidence"))


def lookup(key: Column | str, table: dict[str, float], other: float) -> Column:
    if isinstance(key, str):
        return F.lit(table.get(key, other))
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def field_confidence(field: str | Column, value: Column, origin: Column | str, base: Column) -> Column:
    up, fits = F.upper(value), F.when(is_valid(field, value), 1.0).otherwise(0.5)
    if isinstance(field, str):
        special = {"vintage": F.when(up.isin("NV", "N.V."), 0.9).otherwise(1.0), "price": F.when(up == "POA", 0.8).otherwise(1.0)}.get(field, F.lit(1.0))
        return F.least(base * lookup(origin, C.ORIGIN_FACTORS, C.OTHER_ORIGIN) * fits * special * C.FIELD_WEIGHTS.get(field, 0.5), F.lit(1.0))
    score = base * lookup(origin, C.ORIGIN_FACTORS, C.OTHER_ORIGIN) * fits
    score = score * F.when((field == "vintage") & up.isin("NV", "N.V."), 0.9).otherwise(1.0) * F.when((field == "price") & (up == "POA"), 0.8).otherwise(1.0)
    return F.least(score * lookup(field, C.FIELD_WEIGHTS, 0.5), F.lit(1.0))


def row_confidence(confidence: Column) -> Column:
    """Weighted mean over the known fields of a map of field confidences; 0 for none."""
    weights = F.create_map(*[x for k, v in C.FIELD_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    known = F.filter(F.array(*map(F.lit, C.FIELD_WEIGHTS)), lambda k: F.map_contains_key(confidence, k))
    whole = F.aggregate(known, F.lit(0.0), lambda acc, k: acc + F.try_element_at(weights, k))
    return F.when(whole == 0, 0.0).otherwise(F.aggregate(known, F.lit(0.0), lambda acc, k: acc + F.try_element_at(confidence, k) * F.try_element_at(weights, k)) / whole)
