"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

PERSON, START, END, DAYS, JOBS, EPISODE, CONTRACT = "cf", "inizio", "fine", "durata", "arco", "over_id", "COD_TIPOLOGIA_CONTRATTUALE"


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    quotient = F.try_divide(a.cast("double"), b.cast("double"))
    return quotient if default is None else F.coalesce(quotient, F.lit(float(default)))


def share(x: Column, *partition: str) -> Column:
    """Percentage of the partition's total."""
    return F.round(100 * ratio(x, F.sum(x).over(Window.partitionBy(*partition))), 1)


def by_person(*more: str) -> WindowSpec:
    """A person's segments in order."""
    return Window.partitionBy(PERSON, *more).orderBy(F.asc_nulls_last(START), F.asc_nulls_last(END))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, x: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(x) if isinstance(x, str) else x)), F.lit(0))


def sigmoid(x: Column, slope: float, middle: float) -> Column:
    return 1 / (1 + F.exp(-slope * (x - middle)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; a null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def chain_value(x: Column, which: str = "last") -> Column:
    """The first or last link of "a->b->c"; none leaves the chain as it is."""
    if which not in ("first", "last", "none"):
        raise ValueError(which)
    if which == "none":
        return x
    links = F.split(x, "->")
    return F.when(x.contains("->"), F.trim(F.element_at(links, -1 if which == "last" else 1))).otherwise(x)
