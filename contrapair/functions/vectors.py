"""Array-column arithmetic: one item per row, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    An expression written inside a lambda is evaluated again for every element; bound to a
    lambda variable it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return total(times(a, b))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def safe_div(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def correlation_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Centred correlation; 0 when either side has no spread."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    ok = (vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy)
    return F.when(ok, (n * sxy - sx * sy) / F.sqrt(F.when(ok, vx * vy).otherwise(1.0))).otherwise(0.0)


def centred(a: Column) -> Column:
    return let(a, lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m)))


def unit(a: Column) -> Column:
    return let(a, lambda v: let(
        F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda norm: F.transform(v, lambda x: x / norm)))


def median(a: Column) -> Column:
    """Median of one short array."""
    def mid(s: Column) -> Column:
        m = F.size(s)
        return (F.element_at(s, ((m + 1) / 2).cast("int")) + F.element_at(s, (m / 2).cast("int") + 1)) / 2

    return let(F.array_sort(a), mid)


def windows(a: Column, half: int, body: Callable[[Column], Column]) -> Column:
    """body of each centred window of 2*half+1 elements, shorter at the ends."""
    n = F.size(a)

    def at(i: Column) -> Column:
        lo = F.greatest(i - half, F.lit(0))
        return body(F.slice(a, lo + 1, F.least(i + half, n - 1) - lo + 1))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def moving_average(a: Column, half: int) -> Column:
    return windows(a, half, mean)


def roll(a: Column, d: Column) -> Column:
    """out[p] = a[(p + d) mod n]."""
    k = F.pmod(d, F.size(a))
    return F.concat(F.slice(a, k + 1, F.size(a) - k), F.slice(a, F.lit(1), k))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(safe_div(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def sign_code(a: Column, bits: int = 63) -> Column:
    """Integer whose bit i is set when element i is positive."""
    head = F.slice(a, 1, bits)
    return F.aggregate(
        F.transform(head, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
