"""Ordered rules: first failing rule as a reason, or all violated rules as an array."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(condition: Column) -> Column:
    """Three-valued logic closed: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def first_reason(rules: Iterable[tuple[str | Column, Column]]) -> Column:
    """Name of the first rule that holds, null when none does.

    A name may itself be a column, for reasons that carry a detail.
    """
    chain = None
    for name, condition in rules:
        label = name if isinstance(name, Column) else F.lit(name)
        chain = F.when(truthy(condition), label) if chain is None else chain.when(truthy(condition), label)
    return chain


def violations(rules: Iterable[tuple[str, Column]]) -> Column:
    """All rules that hold, in order, as an array of names."""
    return F.array_compact(F.array(*[F.when(truthy(condition), F.lit(name)) for name, condition in rules]))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null when there is nothing to divide by."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def require(condition: Column, message: str) -> Column:
    """A column that is true, or fails the job with the message."""
    return F.assert_true(truthy(condition), F.lit(message)).isNull()
