"""Column expressions: dates, guarded arithmetic, curves."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

NUDGE = 1e-9


def settled(value: Column, digits: int = 6) -> Column:
    """A double rounded so that the last bits of a sum's order don't show: nudged off decimal ties first."""
    return F.round(value.cast("double") + F.lit(NUDGE), digits)


def ratio(top: Column, bottom: Column) -> Column:
    """A double quotient that is null where the divisor is 0 or either side is null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: the share of rows on which a condition holds, null counting as no."""
    return F.avg(F.when(condition, F.lit(1.0).cast("double")).otherwise(F.lit(0.0).cast("double")))


def clipped(value: Column, low: float, high: float) -> Column:
    """A value held in [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


# ---- dates --------------------------------------------------------------------------------------------------------


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.to_date(F.date_trunc("week", day))


def week_end(day: Column) -> Column:
    """The Sunday that labels a week in weekly groupers."""
    return F.date_add(week_start(day), 6)


def month_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("month", day))


def iso_label(day: Column) -> Column:
    """The ISO week as ``YYYY-Www``, with the year that the week belongs to."""
    year = F.year(F.date_add(week_start(day), 3))
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_of_52(day: Column) -> Column:
    """The ISO week held in 1..52."""
    return F.greatest(F.lit(1), F.least(F.lit(52), F.weekofyear(day)))


def month_of_week(week: Column) -> Column:
    """The month that a week of the year is counted to: 4.345 weeks each."""
    return F.greatest(F.lit(1), F.least(F.lit(12), (F.floor((week - 1) / F.lit(4.345)) + 1).cast("int")))


def week_after(start: Column, steps: Column) -> Column:
    """The week of a 52-week year that lies some steps after a start week."""
    return F.pmod(start - 1 + steps, F.lit(52)) + 1


# ---- curves -------------------------------------------------------------------------------------------------------


def logistic(z: Column) -> Column:
    """The logistic function with its argument held in [-30, 30]."""
    return 1 / (1 + F.exp(-clipped(z, -30, 30)))


def shifted_logit(p: Column, shift: Column, edge: float = 1e-4) -> Column:
    """A probability moved by ``shift`` on the logit scale."""
    held = clipped(p, edge, 1 - edge)
    return logistic(F.log(held / (1 - held)) + shift)


def gaussian(distance: Column, gamma: float = 1.0) -> Column:
    return F.exp(-F.lit(float(gamma)) * distance * distance)


def over_price_penalty(gap: Column, free: float, decay: float) -> Column:
    """1 up to a free zone of the price gap, then falling exponentially."""
    return F.exp(-F.lit(float(decay)) * F.greatest(F.lit(0.0), gap - F.lit(float(free))))


def rarity(count: Column, present: Column) -> Column:
    """The weight of a token: minus the logarithm of its share of the rows that have the feature."""
    return -F.log(count.cast("double") / present.cast("double"))


def min_max(value: Column, over: WindowSpec | None = None, constant: float = 0.0) -> Column:
    """A value scaled to [0, 1] over a window; ``constant`` where all are equal."""
    over = over or Window.partitionBy()
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(float(constant)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda a, v: a + v)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of vectors normalised with 1e-12 added to their lengths."""
    return dot(left, right) / ((norm(left) + 1e-12) * (norm(right) + 1e-12))
