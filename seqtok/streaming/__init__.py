"""Streaming variants of the stateless record operators."""

from seqtok.streaming.tokenize import (
    index_stream, read_record_stream, start_parquet_sink, token_frequency_stream,
)

__all__ = ["index_stream", "read_record_stream", "start_parquet_sink", "token_frequency_stream"]
