"""Small column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

MS_HOUR, MS_DAY = 3_600_000, 86_400_000


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(n, d) -> Column:
    """n / d, 0 where d is not positive or missing."""
    return F.when(col(d) > 0, col(n) / col(d)).otherwise(F.lit(0.0))


def log1p0(x) -> Column:
    """log(1 + x) with negative and missing values as 0."""
    return F.log1p(F.greatest(F.coalesce(col(x).cast("double"), F.lit(0.0)), F.lit(0.0)))


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def average_rank(value, group: list[str], descending: bool = False) -> Column:
    """Rank within the group, ties sharing the mean of their places; nulls come first, or last if descending.

    Counted on the group's values, gathered in each of its rows, so that ranks by many columns share one sort by group;
    a group is a request's candidates. Give a computed value as a column of its own, so that it is computed once.
    """
    g = Window.partitionBy(*group)
    values, n = F.collect_list(col(value)).over(g), F.count("*").over(g)
    before = F.size(F.filter(values, lambda x: x > col(value) if descending else x < col(value)))
    upto = F.size(F.filter(values, lambda x: x >= col(value) if descending else x <= col(value)))
    nulls = n - F.size(values)
    first, last = (F.size(values) + 1, n) if descending else (F.lit(1), nulls)
    skipped = F.lit(0) if descending else nulls
    return (F.when(col(value).isNull(), first + last).otherwise(2 * skipped + before + 1 + upto)) / 2


def rank_pct(value, group: list[str], descending: bool = True) -> Column:
    return average_rank(value, group, descending) / F.count("*").over(Window.partitionBy(*group))


def minus_group_mean(value, group: list[str]) -> Column:
    return col(value) - F.avg(col(value)).over(Window.partitionBy(*group))


def round_scaled(x, digits: int) -> Column:
    """Rounded by the scaled number, half away from zero, as DuckDB does; round() goes by the decimals that stand for a number, so halves differ."""
    return F.round(col(x) * 10**digits, 0) / 10**digits


def last_n(array, n: int) -> Column:
    """The last n entries, or all of a shorter array."""
    return F.slice(col(array), F.greatest(F.size(col(array)) - (n - 1), F.lit(1)), n)


def any_of(columns: list[str]) -> Column:
    """Whether any of the columns is not null."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def hour_cycle(ms, period: int, part: Column) -> tuple[Column, Column]:
    angle = F.lit(2) * F.pi() * part / period
    return F.sin(angle), F.cos(angle)


def text_of(array) -> Column:
    """An array as words, null as the empty text."""
    return F.coalesce(F.array_join(col(array), " "), F.lit(""))


def tokens(text) -> Column:
    """Lower-case words of two or more letters or digits."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def unit_dot(a, b) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
