"""Formulas of the domain as columns: shares of sums with guarded denominators, never means of shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_of_sums(top: Column, bottom: Column) -> Column:
    return F.sum(top) / F.nullif(F.sum(bottom), F.lit(0))


def shooting_share(made: Column, attempted: Column) -> Column:
    return ratio_of_sums(made, attempted)


def effective_share(made: Column, threes: Column, attempted: Column) -> Column:
    return (F.sum(made) + 0.5 * F.sum(threes)) / F.nullif(F.sum(attempted), F.lit(0))


def true_share(points: Column, attempted: Column, free_throws: Column) -> Column:
    return F.sum(points) / F.nullif(2 * (F.sum(attempted) + 0.44 * F.sum(free_throws)), F.lit(0))


def per_minutes(measure: Column, minutes: Column, unit: int = 36) -> Column:
    return F.sum(measure) * unit / F.nullif(F.sum(minutes), F.lit(0))


def per_event(measure: Column, event: Column) -> Column:
    return F.sum(measure) / F.nullif(F.count_distinct(event), F.lit(0))


def win_share(won: Column) -> Column:
    return F.avg(F.when(won, 1.0).otherwise(0.0))


def net_rating(offence: Column, defence: Column) -> Column:
    return F.avg(offence) - F.avg(defence)


def multi_double(thresholds: list[Column], at_least: int) -> Column:
    """Per row: at least so many of the conditions hold (double-double: 2, triple: 3, quadruple: 4)."""
    return sum((F.when(t, 1).otherwise(0) for t in thresholds), F.lit(0)) >= at_least


def consistency(measure: Column) -> Column:
    """Mean over deviation, weighted by the logarithm of the sample; null if the deviation is 0."""
    return F.avg(measure) / F.nullif(F.stddev_samp(measure), F.lit(0)) * F.ln(F.count(measure))


def usage_rate(own: Column, team: Column) -> Column:
    return 100 * ratio_of_sums(own, team)


def rebounds(offensive: Column, defensive: Column) -> Column:
    return offensive + defensive
