"""Levels and array arithmetic of signals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: keeps logarithms and divisions finite.
EPS = 1e-10


def as_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_column(ts))


def rms(x) -> Column:
    """Aggregate: root mean square, 0 of no rows, 1e-5 of silence."""
    x = as_column(x)
    return F.coalesce(F.sqrt(F.avg(x * x) + EPS), F.lit(0.0))


def decibels(x) -> Column:
    return 20.0 * F.log10(F.greatest(as_column(x), F.lit(EPS)))


def clip(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(as_column(x), F.lit(low)), F.lit(high))


def total(array) -> Column:
    return F.aggregate(as_column(array), F.lit(0.0), lambda a, x: a + x.cast("double"))


def array_rms(array) -> Column:
    """Root mean square of an array; 0 of an empty one."""
    array = as_column(array)
    squares = total(F.transform(array, lambda x: x.cast("double") * x))
    return F.when(F.size(array) > 0, F.sqrt(squares / F.size(array) + EPS)).otherwise(F.lit(0.0))


def to_mono(left, right) -> Column:
    return F.zip_with(as_column(left), as_column(right), lambda a, b: (a + b) / 2)


def subtract(a, b) -> Column:
    return F.zip_with(as_column(a), as_column(b), lambda x, y: x - y)


def fit_length(array, n) -> Column:
    """Cut to n values, or fill up with zeros."""
    array, n = as_column(array), as_column(n)
    cut = F.slice(array, F.lit(1), n)
    return F.concat(cut, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n - F.size(cut), F.lit(0)).cast("int")))


def apply_fades(array, fade_in: int, fade_out: int) -> Column:
    """Linear ramps from and to zero, each over half the array at most; a ramp has both its ends."""
    array = as_column(array)
    n = F.size(array)
    rise, fall = (F.least(F.lit(k), F.floor(n / 2).cast("int")) for k in (fade_in, fade_out))

    def ramp(i, k):
        return F.when(k > 1, i / (k - 1)).otherwise(F.lit(0.0))

    def faded(x, i):
        up = F.when(i < rise, ramp(i, rise)).otherwise(F.lit(1.0))
        down = F.when(i >= n - fall, ramp(n - 1 - i, fall)).otherwise(F.lit(1.0))
        return (x * up * down).cast("float")

    return F.transform(array, faded)


def norm(a) -> Column:
    return F.sqrt(total(F.transform(as_column(a), lambda x: x.cast("double") * x)))


def dot(a, b) -> Column:
    return total(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y))


def similarity(a, b) -> Column:
    """1 for equal vectors, falling to 0 with their relative distance."""
    far = norm(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") - y))
    return F.greatest(F.lit(0.0), 1.0 - far / (0.5 * (norm(a) + norm(b)) + EPS))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def slope(y, x) -> Column:
    """Aggregate: least-squares slope of y over x."""
    return F.regr_slope(as_column(y).cast("double"), as_column(x).cast("double"))


def pearson(a, b) -> Column:
    """Aggregate: correlation, 0 where a side has no variance."""
    a, b = as_column(a).cast("double"), as_column(b).cast("double")
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
