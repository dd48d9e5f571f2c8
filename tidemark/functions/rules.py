"""Small builders for rule chains written as data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_match(rules: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """Value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, as_column(value)) if chain is None else chain.when(condition, as_column(value))
    return chain if otherwise is None else chain.otherwise(as_column(otherwise))


def banded(number: Column, bands: Iterable[tuple[float, object]], otherwise) -> Column:
    """Value of the first band whose upper limit lies above ``number``."""
    return first_match([(number < limit, value) for limit, value in bands], otherwise)


def keyed(key: Column, values: Mapping[str, object], otherwise=None) -> Column:
    """Value listed for the key."""
    return first_match([(key == name, value) for name, value in values.items()], otherwise)


def pick(values: list[str], index: Column) -> Column:
    """Entry of a fixed list at ``index`` modulo its length."""
    listed = F.array(*[F.lit(v) for v in values])
    return F.element_at(listed, (index % len(values) + 1).cast("int"))


def padded(prefix: str, number: Column, width: int) -> Column:
    """Prefix and zero-padded number, as in ``CUST0000000042``."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
