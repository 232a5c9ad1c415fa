"""Array and sequence column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for a missing number, next to the empty string and null (fixed value).
MISSING_WORD = "missing"


def clean_number(cell: Column) -> Column:
    """Cell text to double: blanks, the missing word, NaN and anything else unreadable become null."""
    number = F.when(cell != MISSING_WORD, cell).try_cast("double")
    return F.when(~F.isnan(number), number)


def known(value: Column) -> Column:
    """NaN to null, so that one kind of missing value is left."""
    return F.when(~F.isnan(value), value)


def countdown(days_from: Column, days_to_end: Column, length_days: Column) -> Column:
    """``[days_from, days_from - 1, ..., days_to_end]``; empty when the season has negative length."""
    empty = F.array().cast("array<int>")
    return F.when(length_days >= 0, F.sequence(days_from, days_to_end, F.lit(-1))).otherwise(empty)


def array_length(array: Column) -> Column:
    """Length, with null counted as 0."""
    return F.coalesce(F.when(array.isNotNull(), F.size(array)), F.lit(0))


def pad_zeros(array: Column, length: Column) -> Column:
    """Append zeros up to ``length``; a longer array stays as it is."""
    missing = F.greatest(length - F.size(array), F.lit(0))
    return F.concat(array, F.array_repeat(F.lit(0.0), missing))


def cutoff_length(length: Column, fraction) -> Column:
    """``length * fraction`` cut to an int. The fraction stays a double: a decimal would truncate differently."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return (length * share).cast("int")


def prefix(array: Column, count: Column) -> Column:
    """The first ``count`` items."""
    return F.slice(array, F.lit(1), F.greatest(count, F.lit(0)))


def all_but_last(array: Column) -> Column:
    return prefix(array, F.size(array) - 1)


def item_at(array: Column, index: Column, strict: bool = True) -> Column:
    """Item at a 0-based index. Out of range fails the query, or gives null with ``strict=False``."""
    pick = F.element_at if strict else F.try_element_at
    return pick(array, (index + 1).cast("int"))


def last_item(array: Column) -> Column:
    """Last item, null for an empty array."""
    return F.try_element_at(array, F.lit(-1))


def mean_abs_error(predicted: Column, actual: Column) -> Column:
    """Mean of |predicted - actual| over two arrays of one length; null for empty arrays."""
    errors = F.zip_with(predicted, actual, lambda p, t: F.abs(p - t))
    total = F.aggregate(errors, F.lit(0.0), lambda acc, e: acc + e)
    return F.when(F.size(errors) > 0, total / F.size(errors))


def prefix_sums(array: Column, counts: Sequence[Column]) -> Column:
    """Sums of the first items of an array, for each of the rising ``counts``; every item is added once, in its order."""
    ends = [F.lit(0), *[F.greatest(c, F.lit(0)) for c in counts]]
    parts = F.array(*[F.struct(a.alias("start"), (b - a).alias("n")) for a, b in zip(ends, ends[1:])])

    def longer(sums: Column, part: Column) -> Column:
        added = F.aggregate(F.slice(array, part["start"] + 1, part["n"]), last_item(sums), lambda total, v: total + v)
        return F.concat(sums, F.array(added))

    return F.slice(F.aggregate(parts, F.array(F.lit(0.0)).cast("array<double>"), longer), 2, len(counts))


def fourier_terms(position: Column, period, amplitudes) -> Column:
    """Sum of ``a_k * sin(2 pi k x / T)`` over k = 1, 2, ..."""
    turn = F.lit(2.0) * F.pi() * position / F.lit(float(period))
    terms = [F.lit(float(a)) * F.sin(F.lit(float(k)) * turn) for k, a in enumerate(amplitudes, start=1)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total
