"""Text, money and rate rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadbook.contract import MONEY, NUMBER_LIMIT, STATUSES, TRUE_WORDS


def status_text(status: Column) -> Column:
    return F.lower(F.trim(status))


def known_status(status: Column) -> Column:
    return status.isin(*STATUSES)


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text != F.lit(""), F.lit(False))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*TRUE_WORDS)


def money(amount: Column) -> Column:
    """Two-decimal amount, null when the input is no number.

    The type is far wider than any amount that cleaning lets pass, so no fare is lost.
    """
    return amount.try_cast(MONEY)


def measurable(number: Column) -> Column:
    """Missing, or a finite number of a size that can be a measurement."""
    return number.isNull() | (F.abs(number) < F.lit(NUMBER_LIMIT))


def profit(earnings: Column, fuel: Column, maintenance: Column) -> Column:
    """Earnings less both costs, exact to the cent."""
    return (earnings.cast(MONEY) - fuel.cast(MONEY) - maintenance.cast(MONEY)).cast(MONEY)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_hour(count: Column, seconds: Column | float) -> Column:
    """``count`` per ``seconds`` scaled to an hour."""
    span = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return count * (F.lit(3600.0) / span)
