"""Scalar expressions over single values: money, dates, digits, tokens, JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date styles tried in this order with the shape of their text, and spellings of "no value".
DATE_STYLES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
}
MISSING_SPELLINGS = ["", "n/a", "null", "none"]
CHARACTERS_PER_TOKEN = 4


def money(amount: Column) -> Column:
    """Two-place decimal, so that sums do not depend on the order of the rows."""
    return amount.cast("decimal(18,2)")


def money_sum(amount: Column) -> Column:
    return F.sum(money(amount)).cast("double")


def blank_to_null(text: Column) -> Column:
    """Null for the usual spellings of a missing value."""
    return F.when(~F.lower(F.trim(text)).isin(MISSING_SPELLINGS), text)


def parse_date(text: Column, styles: Iterable[str] = tuple(DATE_STYLES)) -> Column:
    """Date of the first style that fits; null when none does.

    The shape is tested before the parser runs, as a failing parse is far dearer than a failing match.
    """
    return F.coalesce(*[F.when(text.rlike(DATE_STYLES[style]), F.try_to_date(text, style)) for style in styles])


def iso_date(text: Column, styles: Iterable[str] = tuple(DATE_STYLES)) -> Column:
    return F.date_format(parse_date(text, styles), "yyyy-MM-dd")


def parse_amount(text: Column) -> Column:
    """Number in text such as ``$1,234.56``; null when it is none."""
    return F.regexp_replace(F.trim(text), "[$,]", "").try_cast("double")


def digit_overlap(old: Column, new: Column) -> Column:
    """Shared digits over all digits of two texts; null when either has none.

    Counted digit by digit, as there are only ten: no arrays are built.
    """
    shared, either = F.lit(0), F.lit(0)
    for digit in "0123456789":
        in_old, in_new = F.contains(old, F.lit(digit)), F.contains(new, F.lit(digit))
        shared = shared + (in_old & in_new).cast("int")
        either = either + (in_old | in_new).cast("int")
    return F.when(old.rlike("[0-9]") & new.rlike("[0-9]"), shared / either)


def normalize_value(text: Column) -> Column:
    """Trimmed, lower case, with single-digit months and days of a date padded."""
    trimmed = F.trim(text)
    pattern = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    dated = F.concat_ws(
        "-",
        F.regexp_extract(trimmed, pattern, 1),
        F.lpad(F.regexp_extract(trimmed, pattern, 2), 2, "0"),
        F.lpad(F.regexp_extract(trimmed, pattern, 3), 2, "0"),
    )
    return F.lower(F.when(trimmed.rlike(pattern), dated).otherwise(trimmed))


def normalize_phone(text: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(text, "[^0-9]", "")


def normalize_name(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """Characters over four, rounded down."""
    return F.floor(F.length(text) / CHARACTERS_PER_TOKEN)


def sanitize(text: Column) -> Column:
    """Quotes doubled, NUL and SQL comments removed, white space squeezed."""
    quoted = F.replace(text, F.lit("'"), F.lit("''"))
    without_nul = F.regexp_replace(quoted, r"\x00", "")
    without_line = F.regexp_replace(without_nul, r"--[^\n]*(?=\n?\z)", "")
    without_block = F.regexp_replace(without_line, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(without_block, r"[ \t\n\r\f\x0B]+", " "))


def checksum(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def cosine_distance(left: Column, right: Column) -> Column:
    """One minus the cosine of two equally long number arrays, in double precision."""
    zero = F.lit(0.0)

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, zero, lambda total, x: total + x)

    return 1.0 - dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def share(part: Column, whole: Column) -> Column:
    """Part over whole as a double; null for an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))
