"""Array-column helpers for windows and steps (all higher-order built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_pad(arr: Column, n: int, pad: Column) -> Column:
    """Left-pad ``arr`` with ``pad`` elements up to length ``n``."""
    missing = F.greatest(F.lit(n) - F.size(arr), F.lit(0))
    return F.concat(F.array_repeat(pad, missing), arr)


def one_hot(y: Column, k: int) -> Column:
    """``to_categorical``: int array of length k with a 1 at position y. A y outside
    ``0..k-1`` fails the job; NULL stays NULL."""
    wrong = F.raise_error(F.concat(F.lit(f"class outside 0..{k - 1}: "), y.cast("string")))
    hot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: (c == y).cast("int"))
    return F.when(y.isNull(), F.lit(None).cast("array<int>")).when(
        (y < 0) | (y >= k), wrong.cast("array<int>")).otherwise(hot)


def reshape_steps(flat: Column, steps: int, width: int) -> Column:
    """Regroup a flat array of ``steps*width`` values into ``steps`` arrays of ``width``. A shorter array gives
    shorter steps."""
    short = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda t: F.slice(flat, t * width + 1, width),
    )
    if steps < 1 or width < 1:
        return short
    # element by element: a slice in a lambda copies the whole array for every step
    starts, places = ([F.lit(i) for i in r] for r in (range(0, steps * width, width), range(width)))
    whole = F.transform(F.array(*starts), lambda t: F.transform(F.array(*places), lambda i: F.get(flat, t + i)))
    return F.when(F.size(flat) >= steps * width, whole).otherwise(short)


def past_future_split(steps: Column, center: int, total: int) -> tuple[Column, Column]:
    """Past = steps ``0..center`` consumed backwards; future = ``center..total-1``.

    The center step is in both halves.
    """
    past = F.reverse(F.slice(steps, 1, center + 1))
    future = F.slice(steps, center + 1, total - center)
    return past, future
