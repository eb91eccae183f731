"""Structured Streaming: tokenize and index record files as they arrive.

Tokenizing and indexing a record is stateless once the bounds and the vocabulary are
fixed (they come from a batch run), so new record files are processed incrementally:
``readStream.text`` -> the same ``parse_records`` / ``tokenize_records`` projection ->
stream-static joins with the vocabulary -> Parquet sink with a checkpoint in the shared
folder (exactly-once file sink, survives restarts). Positions and history windows need
the global record order and stay batch operators over the sink's output. A streaming
text source gives no line index (``monotonically_increasing_id`` is not allowed on
streams), so streamed rows carry ``_file, _block`` only; order streamed records by a
record key (time, id) when positioning them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqtok.config import KDD_COLUMNS, Bounds, Params, RecordSpec
from seqtok.operators.lookup import fits_broadcast, join_each_position
from seqtok.operators.tokens import tokenize_records
from seqtok.session import scratch_path
from seqtok.sources.records import parse_records

# a streaming text source has no line index: file and split only
STREAM_ORDER_COLUMNS = ("_file", "_block")


def read_record_stream(spark: SparkSession, source_dir: str, columns: Sequence[str] = KDD_COLUMNS,
                       on_bad: str = "quarantine", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming records with the order columns; bad lines are flagged, not fatal."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(source_dir)
    lines = raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return parse_records(lines, columns, "value", on_bad, STREAM_ORDER_COLUMNS)


def index_stream(records: DataFrame, spec: RecordSpec, bounds: Mapping[str, Bounds],
                 vocab: DataFrame, params: Params = Params()) -> DataFrame:
    """Tokens and ids for a record stream; ``vocab`` is a static ``(token, token_id)``.

    One stream-static left join per token position; the vocabulary is broadcast when
    its measured size fits ``params.broadcast_max_bytes``, otherwise joined by shuffle.
    """
    keep = [c for c in (*STREAM_ORDER_COLUMNS, "_corrupt") if c in records.columns]
    tok = tokenize_records(records, spec, bounds, params, keep=keep)
    small = vocab.select(F.col("token").alias("__key"), F.col("token_id").alias("__val"))
    if fits_broadcast(small, params):
        small = F.broadcast(small)
    unk = F.lit(params.unk_id).cast("long")
    return join_each_position(tok, "tokens", spec.n_tokens, small, unk, "token_ids")


def start_parquet_sink(stream: DataFrame, path: str, checkpoint: str | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """Append the stream to Parquet; the checkpoint defaults to the shared folder."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-checkpoint")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)


def token_frequency_stream(records: DataFrame, spec: RecordSpec, bounds: Mapping[str, Bounds],
                           params: Params = Params()) -> DataFrame:
    """Running ``(token, freq)`` over a record stream: a streaming ``groupBy().count()``
    whose state holds one row per distinct token (partial aggregation per micro-batch,
    state kept in the query's checkpoint). Use output mode ``complete`` or ``update``."""
    has_flag = "_corrupt" in records.columns
    tok = tokenize_records(records, spec, bounds, params, keep=["_corrupt"] if has_flag else [])
    arr = F.col("tokens") if params.include_label_tokens else F.slice("tokens", 1, spec.n_features)
    if has_flag:
        # corrupt records explode to nothing; no Filter under the wide token projection
        # (Catalyst's constraint derivation over it can stall the planner)
        arr = F.when(~F.col("_corrupt"), arr)
    return tok.select(F.explode(arr).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"))
