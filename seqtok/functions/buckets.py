"""Bucket expressions.

``bucket_unit`` equals ``Bucketizer(splits=[-inf, 0, 1, ..., n-1, inf])``: values below
0 go to bucket 0, ``[k-1, k)`` to bucket k, everything from ``n-1`` up to bucket n.
It is a closed-form expression, so any n works without materialising split arrays.
``bucket_stddev`` uses bins one standard deviation wide starting at the minimum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_count(maximum, minimum, stddev) -> Column:
    """``(max-min) // stddev``, or 1 when stddev is 0 or NULL (a single row) or beyond the range of
    doubles."""
    mx, mn, sd = (F.col(c) if isinstance(c, str) else c for c in (maximum, minimum, stddev))
    wide = F.isnan(sd) | (F.abs(sd) == float("inf")) | (F.abs(mx - mn) == float("inf"))
    return (
        F.when(sd.isNull() | (sd == 0) | mx.isNull() | wide, F.lit(1).cast("long"))
        .otherwise(F.floor((mx - mn) / sd))
        .cast("long")
    )


def _nan_guard(x: Column, value: Column, on_nan: str, keep_bucket: int) -> Column:
    if on_nan == "error":
        invalid = F.raise_error(F.lit("NaN in bucketized column; use on_nan='keep'"))
        return F.when(F.isnan(x), invalid.cast("int")).otherwise(value)
    if on_nan == "keep":
        return F.when(F.isnan(x), F.lit(keep_bucket)).otherwise(value)
    if on_nan == "skip":       # such rows are dropped by the operator
        return F.when(F.isnan(x), F.lit(None).cast("int")).otherwise(value)
    raise ValueError(f"on_nan must be 'error', 'keep' or 'skip', got {on_nan!r}")


def bucket_unit(x: Column, n: int, on_nan: str = "error") -> Column:
    """Bucket with unit-wide splits ``0, 1, ..., n-1``; result in ``[0, n]``.

    ``x`` is clamped to ``[-1, n]`` before ``floor`` so that +-inf and huge values
    cannot overflow; NULL stays NULL.
    """
    n = int(n)
    clamped = F.least(F.greatest(x, F.lit(-1.0)), F.lit(float(n)))
    b = F.least(F.greatest(F.floor(clamped) + 1, F.lit(0)), F.lit(n)).cast("int")
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(
        _nan_guard(x, b, on_nan, n + 1)
    )


def bucket_stddev(x: Column, minimum: float | None, stddev: float | None, n: int,
                  on_nan: str = "error") -> Column:
    """Bucket ``floor((x-min)/stddev)`` clamped to ``[0, n-1]``; 0 when stddev is 0, NULL or not finite.
    Infinite values go to the end buckets."""
    n = int(n)
    if stddev is None or stddev == 0 or not math.isfinite(stddev) or minimum is None:
        b = F.lit(0)
    else:
        scaled = (x - F.lit(float(minimum))) / F.lit(float(stddev))
        clamped = F.least(F.greatest(scaled, F.lit(-1.0)), F.lit(float(n)))
        b = F.least(F.greatest(F.floor(clamped), F.lit(0)), F.lit(max(n - 1, 0)))
    b = b.cast("int")
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(
        _nan_guard(x, b, on_nan, n)
    )
