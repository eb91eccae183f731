"""Keyed history windows over arriving records.

The state of a key is its last ``n - 1`` values and the order value of its newest record, so it does not grow
with the stream; it lives in the query's checkpoint and survives restarts. Each micro-batch is grouped by key,
sorted by the order column inside the key, and gives every record the window that the batch operator
(``ranges.range_windows`` with keys) gives it, provided the records of a key arrive in order: a later micro-batch
holds later records. A record that is not after the newest one of an earlier micro-batch is late: its window would
change windows that are already written, so it comes out with ``late`` true and a NULL window, and
stays out of the history. Records of one micro-batch may come in any order.

Memory: the records of one key in one micro-batch meet in one task; ``max_files_per_trigger`` of the source
bounds them. Rows with a NULL order value are late; a NULL key is a key of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyed_window_stream(records: DataFrame, key: str, order: str, value: str, n: int, pad, out: str = "window") -> DataFrame:
    """``(key, order, window array, late boolean)`` of a stream of records.

    ``order`` is an integer or timestamp column, ``value`` an integer, double, boolean or string. Windows are the
    last ``n`` values up to and including the record, left-padded with ``pad``.
    """
    if n < 1:
        raise ValueError("window length must be >= 1")
    value_type = records.schema[value].dataType
    # the order travels as a long (timestamps as microseconds): exact and sortable in every batch
    order_type = records.schema[order].dataType
    as_long = F.unix_micros(order) if isinstance(order_type, T.TimestampType) else F.col(order).cast("long")
    rows = records.select(F.col(key).alias("k"), as_long.alias("o"), F.struct(F.col(value).alias("v")).alias("v"))
    item = T.StructType([T.StructField("v", value_type)])
    state_type = T.StructType([T.StructField("last", T.LongType()), T.StructField("history", T.StringType())])
    out_type = T.StructType([T.StructField("k", records.schema[key].dataType), T.StructField("o", T.LongType()),
                             T.StructField("w", T.ArrayType(item)), T.StructField("late", T.BooleanType())])

    def work(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, history = state.get if state.exists else (None, "[]")
        past = json.loads(history)
        batch = [(o, v["v"] if isinstance(v, dict) else v[0]) for p in parts for o, v in zip(p["o"], p["v"])]
        late = [o for o, _ in batch if pd.isna(o) or (last is not None and o <= last)]
        fresh = sorted(((int(o), v) for o, v in batch if not pd.isna(o) and (last is None or o > last)), key=lambda r: r[0])
        orders, windows = [], []
        for o, v in fresh:
            v = None if v is None or (not isinstance(v, str) and pd.isna(v)) else v.item() if hasattr(v, "item") else v
            past.append(v)
            whole = [pad] * (n - len(past)) + past
            windows.append([{"v": x} for x in whole])
            orders.append(o)
            del past[:max(len(past) - (n - 1), 0)]
            last = o
        if fresh:
            state.update((last, json.dumps(past)))
        yield pd.DataFrame({"k": [group[0]] * len(batch), "o": pd.array(orders + [None if pd.isna(o) else int(o) for o in late], "Int64"),
                            "w": windows + [None] * len(late), "late": [False] * len(fresh) + [True] * len(late)})

    got = rows.groupBy("k").applyInPandasWithState(work, out_type, state_type, "append", GroupStateTimeout.NoTimeout)
    back = F.timestamp_micros("o") if isinstance(order_type, T.TimestampType) else F.col("o").cast(order_type)
    return got.select(F.col("k").alias(key), back.alias(order), F.transform("w", lambda x: x["v"]).alias(out), "late")
