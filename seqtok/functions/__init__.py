"""Column-expression helpers: all built from ``pyspark.sql.functions``, no UDFs."""

from seqtok.functions.arrays import (
    left_pad,
    one_hot,
    past_future_split,
    reshape_steps,
)
from seqtok.functions.buckets import bucket_count, bucket_stddev, bucket_unit
from seqtok.functions.hashing import hash_index, uniform01
from seqtok.functions.text import encode_token, py_float_text, value_text

__all__ = [
    "bucket_count", "bucket_stddev", "bucket_unit", "encode_token", "hash_index",
    "left_pad", "one_hot", "past_future_split", "py_float_text", "reshape_steps",
    "uniform01", "value_text",
]
