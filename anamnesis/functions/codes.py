"""Column functions for demographic codes, ages and symptom bit sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Race numbering of the record files.
RACE_CODES = {"white": 0, "black": 1, "asian": 2, "native": 3, "other": 4}

# Mean Gregorian year in days, and the widest mask a bigint can carry.
DAYS_PER_YEAR = 365.2425
MASK_BITS = 62


def lookup(value: Column, mapping: Mapping[str, object]) -> Column:
    """``mapping[value]`` for a small literal mapping; a miss is NULL."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def gender_code(value: Column, missing: int = 1) -> Column:
    """F is 0, anything else 1; NULL is ``missing`` (2 in the encoded-observation files)."""
    return F.when(value == "F", 0).when(value.isNull(), missing).otherwise(1)


def marital_code(value: Column) -> Column:
    """M is 1, S is 0, anything else (also NULL) is 2."""
    return F.when(value == "M", 1).when(value == "S", 0).otherwise(2)


def race_code(value: Column, codes: Mapping[str, int] = RACE_CODES) -> Column:
    return lookup(value, codes)


def age(birth: Column, onset: Column, mode: str = "calendar") -> Column:
    """Age at onset.

    ``calendar``  |year(birth) - year(onset)|
    ``years``     whole mean years, absolute value
    ``months``    whole mean months / 12, signed
    ``months_int`` the same cut to an integer, signed
    """
    days = F.datediff(onset, birth)
    if mode == "calendar":
        return F.abs(F.year(birth) - F.year(onset))
    if mode == "years":
        return F.abs((days / F.lit(DAYS_PER_YEAR)).cast("int"))
    months = (days / F.lit(DAYS_PER_YEAR / 12)).cast("int")
    if mode == "months":
        return months / F.lit(12.0)
    if mode == "months_int":
        return (months / F.lit(12.0)).cast("int")
    raise ValueError(f"unknown age mode {mode!r}")


def age_on(birth: Column, day: str) -> Column:
    """Whole mean years between birth and a fixed date."""
    return (F.datediff(F.lit(day).cast("date"), birth) / F.lit(DAYS_PER_YEAR)).cast("int")


def bit_mask(indices: Column) -> Column:
    """Bits set at the given positions; repeats do not carry. A position from ``MASK_BITS`` on is an error: it has no bit of its own."""
    fits = F.transform(indices, lambda i: F.when(i < MASK_BITS, i).otherwise(F.raise_error(F.lit(f"a mask has {MASK_BITS} bits"))))
    return F.aggregate(
        F.array_distinct(fits),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))),
    )


def has_bit(mask: Column, index: int) -> Column:
    return F.getbit(mask, F.lit(index)).cast("int")


def bits_to_number(bits: Column) -> Column:
    """A 0/1 array read as a binary number, most significant bit first. More than ``MASK_BITS`` bits are an error."""
    fits = F.when(F.size(bits) <= MASK_BITS, bits).otherwise(F.raise_error(F.lit(f"a number has {MASK_BITS} bits")))
    text = F.array_join(F.transform(fits, lambda b: b.cast("string")), "")
    return F.conv(text, 2, 10).cast("bigint")


def multi_hot(indices: Column, width: int | Column) -> Column:
    """0/1 array of the given width, a number or the size of a dictionary; meant for narrow report edges."""
    size = F.lit(width) if isinstance(width, int) else width.cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), size), F.lit(1), size), lambda i: F.array_contains(indices, i).cast("int"))


def hot_positions(bits: Column, names: Column) -> Column:
    """Names (an array in column order) of the nonzero positions of a 0/1 array."""
    pairs = F.zip_with(bits, names, lambda b, n: F.when(b != 0, n))
    return F.array_compact(pairs)


def one_hot_race(code: Column, width: int = 5) -> Column:
    """0/1 array with code 0 in the last position."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: (i == F.lit(width - 1) - code).cast("int"),
    )
