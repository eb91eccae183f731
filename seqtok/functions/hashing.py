"""Seeded per-row draws that do not depend on partitioning.

``F.rand(seed)`` changes with the partition layout, so draws are taken from the md5 of
``'<seed>/<key>'``: the first 8 hex digits give a uniform in [0, 1), the next 8 an
index. The same text is reproducible in any SQL engine that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string")))


def uniform01(seed: int, key: Column) -> Column:
    """Uniform draw in [0, 1) from hex digits 1-8 of ``md5('<seed>/<key>')``."""
    hexpart = F.substring(_digest(seed, key), 1, 8)
    return F.conv(hexpart, 16, 10).cast("double") / F.lit(4294967296.0)


def hash_index(seed: int, key: Column, k: int) -> Column:
    """Index in [0, k) from hex digits 9-16 of ``md5('<seed>/<key>')``."""
    hexpart = F.substring(_digest(seed, key), 9, 8)
    return (F.conv(hexpart, 16, 10).cast("long") % F.lit(int(k))).cast("int")
