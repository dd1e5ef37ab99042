"""Text, date and number expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode white space, plus the four ASCII separators that also count as blank. ``trim`` alone
# would leave tabs and no-break spaces in place.
_BLANK = r"(?U)[\s\x1c-\x1f]+"
LENIENT_DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy")


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + _BLANK, ""), _BLANK + "$", "")


def normalize_name(c: Column) -> Column:
    return strip_blank(F.lower(c))


def joined_name(first: Column, last: Column) -> Column:
    """First and last name with a space between; a missing part counts as empty text."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def strict_date(c: Column, fmt: str = "d/M/yyyy") -> Column:
    """ISO text of a day-first date; null stays null, any other text fails the query."""
    parsed = F.try_to_date(c, fmt)
    bad = F.raise_error(F.concat(F.lit(f"not a date in format {fmt}: "), c)).cast("date")
    return F.date_format(F.when(c.isNotNull() & parsed.isNull(), bad).otherwise(parsed), "yyyy-MM-dd")


def lenient_date(c: Column, formats: Sequence[str] = LENIENT_DATE_FORMATS) -> Column:
    """ISO text of the first format that fits, else null."""
    return F.date_format(F.coalesce(*[F.try_to_date(c, f) for f in formats]), "yyyy-MM-dd")


def padded_id(prefix: str, number: Column, width: int = 5) -> Column:
    """``prefix`` and the number padded to at least ``width`` digits (longer numbers stay whole)."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", number.cast("long")))


def decimal_to_comma(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit("."), F.lit(","))


def comma_to_decimal(c: Column, precision: int = 18, scale: int = 2) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast(f"decimal({precision},{scale})")


def seeded_digest(seed: int | str, *parts: Column) -> Column:
    """Hex md5 of the seed and the parts: a shuffle key that any engine can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def digest_number(digest: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits of a digest as a number."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` in double, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
