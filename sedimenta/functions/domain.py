"""Scalar expressions over the columns of transaction tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def present(column: Column) -> Column:
    """A double without NaN: NaN and NULL are both NULL."""
    return F.nanvl(column, F.lit(None).cast("double"))


def day_of(seconds: Column) -> Column:
    """Day number; second 86400 begins day 0. Floors, also before the origin."""
    return F.floor((seconds - DAY_SECONDS) / DAY_SECONDS).cast("long")


def week_of(day: Column) -> Column:
    return F.floor(day / 7).cast("long")


def hour_of(seconds: Column) -> Column:
    """Hour of the day, not shifted by the origin."""
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("long")


def weekday_of(day: Column) -> Column:
    return F.pmod(day, F.lit(7)).cast("long")


def cents(amount: Column) -> Column:
    """Whole cents, halves away from zero; a missing or infinite amount is 0."""
    finite = F.when(F.abs(present(amount)) < 9e16, amount)
    return F.coalesce(F.round(finite * 100).cast("long"), F.lit(0).cast("long"))


def whole(number: Column) -> Column:
    """A double that holds a whole number, as long; NaN, infinite and NULL are NULL."""
    return F.when(F.abs(present(number)) < 9e18, number).cast("long")


def unified_domain(domain: Column) -> Column:
    """Lower case, without surrounding blanks and then without one final dot."""
    bare = F.regexp_replace(F.lower(domain), r"\A\s+|\s+\z", "")
    return F.when(bare.endswith("."), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def smooth_rate(positive: Column, labelled: Column, prior: float | Column, alpha: float = 20.0) -> Column:
    """(positive + alpha * prior) / (labelled + alpha); exactly the prior if nothing is labelled."""
    prior = F.lit(prior) if not isinstance(prior, Column) else prior
    return F.when(labelled == 0, prior).otherwise((positive + alpha * prior) / (labelled + alpha))
