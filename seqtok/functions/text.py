"""Token text.

The reference builds tokens with Python's ``str(value) + field``. Spark prints doubles
the Java way (``1.0E7``); ``py_float_text`` gives Python's text with native
expressions: plain decimal for ``1e-4 <= |x| < 1e16`` (shortest digits, at least one
decimal), otherwise ``d.ddde+XX``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_float_text(x: Column) -> Column:
    """Python ``repr``-style text of a double column; NULL stays NULL."""
    java = x.cast("string")
    # plain branch: decimal(38,22) keeps 16 integer and 22 fraction digits
    dec = x.cast("decimal(38,22)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(dec, "0+$", ""), "\\.$", ".0")
    # scientific branch: the shortest '%.{k}e' text that reads back as x; Java's
    # '%e' already prints 'd.ddde+XX' like Python (Java's own toString is not always
    # shortest before JDK 19, so its digits are not used here)
    # (one reference to x keeps the expression small; only evaluated for such values)
    formats = F.array(*[F.lit(f"%.{k}e") for k in range(17)])
    sci = F.element_at(
        F.filter(F.transform(formats, lambda f: F.printf(f, x)),
                 lambda c: c.cast("double") == x), 1)
    ax = F.abs(x)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, java)  # '0.0' / '-0.0' as in Python
        # Java prints plain shortest digits here, exactly like Python: no regex needed
        .when((ax >= 1e-3) & (ax < 1e7), java)
        .when((ax >= 1e-4) & (ax < 1e16), plain)
        .otherwise(sci)
    )


def value_text(x: Column, dtype: T.DataType) -> Column:
    """Text of a value as Python's ``str`` would print it; NULL becomes ``None``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        txt = py_float_text(x.cast("double"))
    elif isinstance(dtype, T.BooleanType):
        txt = F.when(x, F.lit("True")).when(~x, F.lit("False"))
    else:
        txt = x.cast("string")
    return F.coalesce(txt, F.lit("None"))


def encode_token(df: DataFrame, column: str, suffix: str) -> Column:
    """``str(value) + suffix`` for one column of ``df``."""
    dtype = df.schema[column].dataType
    return F.concat(value_text(F.col(column), dtype), F.lit(suffix))
