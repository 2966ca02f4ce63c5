"""Column functions for probabilities and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(p: Column, eps: float = 0.001) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _with_each(values: Column, other: Column, fn) -> Column:
    """``fn(value, other)`` per element.

    The second value is repeated next to the array instead of being captured by the lambda, which
    would work it out anew for every element.
    """
    return F.zip_with(values, F.array_repeat(other, F.size(values)), fn)


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(array_sum(_with_each(values, top, lambda v, m: F.exp(v - m))))


def softmax(values: Column) -> Column:
    return _with_each(values, log_sum_exp(values), lambda v, s: F.exp(v - s))


def odds_to_probability(odds: Column) -> Column:
    return odds / (odds + 1)


def relative_change(base: Column, value: Column) -> Column:
    """(base - value) in percent of base."""
    return (base - value) * 100 / base


def megabytes(size: Column) -> Column:
    return size / 1024 / 1024


def ranked(values: Column, top: int) -> Column:
    """Positions and values of the ``top`` largest entries, ties by position."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("label")))
    return F.transform(
        F.slice(F.array_sort(pairs), 1, top),
        lambda s: F.struct(s["label"].alias("label"), (-s["neg"]).alias("p")),
    )


def at_label(values: Column, label: Column) -> Column:
    return F.get(values, label)


def mismatches(a: Column, b: Column) -> Column:
    """Number of positions in which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, v: acc + v)
