"""Scalar expressions with the exact null and type behaviour the metrics need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MILLIS = 86_400_000
DAY_SECONDS = 86_400


def trunc_date(ts: str | Column, grain: str) -> Column:
    """Bucket start as a DATE (day, week or month)."""
    if grain == "day":
        return F.to_date(ts)
    return F.trunc(ts, grain)


def monday(day: str | Column) -> Column:
    """Monday of the week that holds ``day``."""
    day = F.col(day) if isinstance(day, str) else day
    return F.date_add(day, -F.weekday(day))


def epoch_millis_to_date(millis: Column) -> Column:
    return F.date_from_unix_date(F.floor(millis / DAY_MILLIS).cast("int"))


def epoch_seconds_to_date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / DAY_SECONDS).cast("int"))


def date_range_label(first: Column, last: Column) -> Column:
    return F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit(" to "), F.date_format(last, "yyyy-MM-dd"))


def diff_label(value: Column, previous: Column) -> Column:
    """``"12 (3)"``: the value and its change; the change of a first value is 0."""
    change = F.coalesce(value - previous, F.lit(0))
    return F.concat(value.cast("string"), F.lit(" ("), change.cast("string"), F.lit(")"))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL, not an error, for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def floor_at_zero(value: Column) -> Column:
    """At least 0, and NULL for NULL (plain ``greatest`` would skip the NULL)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0).cast("double")))


#: Any decimal of so many digits is told exactly by the double next to it.
DOUBLE_DIGITS = 15
#: Digits before and after the point and the exponent of a JSON number (or of a string of one).
NUMBER = r"^\s*[-+]?(\d*)\.?(\d*)(?:[eE]([-+]?\d{1,4}))?\s*$"


def json_text(df: DataFrame, column: str, path: str) -> Column:
    """The text of a scalar inside JSON text or a variant, with all its digits.

    JSON text is scanned for the one path.  That scan reads numbers as doubles, so a document with
    a long run of digits is read as a variant, which keeps 38 digits.  Where even that has only a
    double (long numbers with an exponent), the text is ``inexact:`` and the double.  A number
    nearer to 0 than any double reads as 0.
    """
    if isinstance(df.schema[column].dataType, T.VariantType):
        return _variant_text(F.col(column), path)
    text = F.get_json_object(column, path)
    exact = _variant_text(F.try_parse_json(column), path)
    broken = F.concat(F.lit("inexact: "), text)
    short = ~F.col(column).rlike(rf"[0-9.]{{{DOUBLE_DIGITS + 1},}}")
    return F.when(short, text).when(text.isNotNull(), F.coalesce(exact, broken))


def _variant_text(variant: Column, path: str) -> Column:
    text = F.try_variant_get(variant, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    long = F.length(F.regexp_replace(text, "[eE].*|[^0-9]", "")) > DOUBLE_DIGITS
    return F.when((kind == "DOUBLE") & long, F.concat(F.lit("inexact: "), text)).otherwise(text)


def unreadable(text: Column, kind: T.DecimalType) -> Column:
    """Whether a text is no number, does not fit ``kind`` or has more decimals than it.

    Decided by value: ``1e-8``, ``2.50E-2`` and ``0.10000000000000000`` are a few decimals each.
    """
    whole = kind.precision - kind.scale
    plain = text.rlike(rf"^-?\d{{1,{whole}}}(\.\d{{1,{kind.scale}}})?$")
    digits = F.concat(F.regexp_extract(text, NUMBER, 1), F.regexp_extract(text, NUMBER, 2))
    used = F.rtrim(digits, F.lit("0"))
    exponent = F.coalesce(F.regexp_extract(text, NUMBER, 3).try_cast("int"), F.lit(0))
    decimals = (
        F.length(F.regexp_extract(text, NUMBER, 2)) - (F.length(digits) - F.length(used)) - exponent
    )
    rounded = (F.length(used) > 0) & (decimals > kind.scale)
    odd = ~text.rlike(NUMBER) | rounded | text.try_cast(kind).isNull()
    return F.when(text.isNull() | plain, F.lit(False)).otherwise(odd)


def exact_decimal(text: Column, kind: T.DecimalType, strict: bool = True) -> Column:
    """A number as text to ``kind``; what is `unreadable` raises, or is NULL if not ``strict``.

    Both whatever the session's settings.
    """
    bad = unreadable(text, kind)
    if strict:
        return _or_raise(text.try_cast(kind), bad, F.concat(F.lit(f"not a {kind.simpleString()}: "), text))
    return F.when(~bad, text.try_cast(kind))


def json_decimal(
    df: DataFrame, column: str, path: str, kind: T.DecimalType, strict: bool = True
) -> Column:
    """A number inside JSON text or a variant, exactly: see `json_text` and `exact_decimal`."""
    return exact_decimal(json_text(df, column, path), kind, strict)


def _or_raise(value: Column, bad: Column, message: Column) -> Column:
    return F.when(bad, F.raise_error(message)).otherwise(value)


def strict_cast(value: Column, kind: T.DecimalType) -> Column:
    """``value`` as ``kind``; raises if it does not fit, whatever the session's settings."""
    number = value.try_cast(kind)
    bad = value.isNotNull() & number.isNull()
    return _or_raise(number, bad, F.lit(f"a sum does not fit {kind.simpleString()}"))


def strict_sum(value: str | Column) -> Column:
    """Sum of decimals; raises where an overflow would give NULL."""
    total = F.try_sum(value)
    return _or_raise(total, (F.count(value) > 0) & total.isNull(), F.lit("a sum overflows"))


def first_element(array: str | Column) -> Column:
    """First element, NULL for an empty array."""
    return F.get(array, 0)
