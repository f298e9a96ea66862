"""Column helpers for lenient typing, null-safe arithmetic and rounding.

Rules of this library: divisions go through `ratio`, text becomes numbers through `to_double` or `to_timestamp`, and decimals
are cut with `rounded`; no NaN or infinity passes ingestion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens that stand for a missing value in exports.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd/MM/yyyy HH:mm[:ss]", "dd/MM/yyyy")


def known(text: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    """The text, or null where it is a token for a missing value."""
    return F.when(~text.isin(list(tokens)), text)


def to_double(text: Column) -> Column:
    """A plain decimal number; null for anything else, so no NaN, infinity, unit or separator gets through."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_timestamp(text: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """The first format that fits, as a time without zone; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def strict_timestamp(text: Column) -> Column:
    """A time without zone; text that is none raises an error."""
    return text.cast("timestamp_ntz")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rounded(x: Column, places: int = 2) -> Column:
    """Half to even on the scaled binary value, and never a negative zero."""
    scale = F.lit(float(10**places))
    return F.rint(x * scale) / scale + F.lit(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    """x between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def same_text(text: Column, value: str) -> Column:
    """Equal but for case and outer white space."""
    return F.lower(stripped(text)) == value.lower()


def mentions(text: Column, part: str) -> Column:
    """Whether the text holds a part, whatever the case; null holds nothing."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def in_years(ts: Column, years: list[int]) -> Column:
    """Whether a time falls into one of the years, as half-open ranges that reach the scan."""
    out = F.lit(False)
    for y in sorted(set(years)):
        out = out | ((ts >= F.to_timestamp_ntz(F.lit(f"{y}-01-01 00:00:00"))) & (ts < F.to_timestamp_ntz(F.lit(f"{y + 1}-01-01 00:00:00"))))
    return out


def log_mean(mean: Column) -> Column:
    return F.when(mean > 0, F.ln(mean))
