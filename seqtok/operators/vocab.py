"""Vocabulary stage: frequencies, ids, indexing, unknown and masked tokens, top-k.

Frequencies are a plain ``groupBy().count()`` (partial + final hash aggregate: a hot
token is combined map-side, so it costs one row per map task in the shuffle). Ids are
dense and deterministic: position in ``(freq desc, token asc)`` from
``global_position``, so they do not depend on partition order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtok.config import Params
from seqtok.functions.hashing import hash_index, uniform01
from seqtok.operators.lookup import fits_broadcast, lookup_column, lookup_positions
from seqtok.operators.sequence import global_position
from seqtok.operators.tokens import packed, unpacked
from seqtok.session import materialize

_DEFAULT = Params()
MANY_TOKENS = 16               # more tokens a record: looked up a batch of records at a time
_LOADED: dict[str, dict[bytes, int]] = {}       # vocabulary of a Python worker


def token_frequencies(tokens: DataFrame, token_col: str = "token", count_col: str | None = None) -> DataFrame:
    """``(token, freq)`` over a one-token-per-row DataFrame; ``count_col``: how often each row's token counts."""
    freq = F.sum(count_col) if count_col else F.count(F.lit(1))
    return tokens.groupBy(F.col(token_col).alias("token")).agg(freq.alias("freq"))


def distinct_tokens(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    return tokens.select(F.col(token_col).alias("token")).distinct()


def build_vocabulary(freq: DataFrame, params: Params = _DEFAULT,
                     n_rows: int | None = None) -> DataFrame:
    """``(token, token_id, freq)`` with ids ``first_id..`` in (freq desc, token asc).

    Reserved ids (pad, unknown) are not rows of the table; lookups default to
    ``unk_id``. Materialize ``freq`` first when it is expensive to recompute;
    ``n_rows`` is its row count when already known.
    """
    ranked = global_position(freq, [-F.col("freq"), F.col("token")], "__r", params, n_rows)
    return ranked.select(
        "token", (F.col("__r") + F.lit(params.first_id)).alias("token_id"), "freq"
    )


def extend_vocabulary(vocab: DataFrame, freq: DataFrame, params: Params = _DEFAULT) -> DataFrame:
    """``(token, token_id, freq, version)``: ``vocab`` grown by the token frequencies of a later input.

    Ids never change: tokens that ``vocab`` has keep theirs, new ones get the next ids in (freq desc,
    token asc) and the next version number. ``freq`` is the sum over all inputs. ``vocab`` without a
    ``version`` column is version 1. Both tables are read by joins on the token (one row per token on
    either side, so no key is hot); models and chunks made with an older version stay valid.
    """
    old = vocab.select("token", "token_id", F.col("freq").alias("__old"),
                       (F.col("version") if "version" in vocab.columns else F.lit(1)).cast("int").alias("version"))
    new = freq.select(F.col("token").alias("__t"), F.col("freq").alias("__new"))
    last = old.agg(F.max("token_id").alias("i"), F.max("version").alias("v")).first()
    first_id = params.first_id if last["i"] is None else last["i"] + 1
    kept = old.join(new, F.col("token") == F.col("__t"), "left").select(
        "token", "token_id", (F.col("__old") + F.coalesce("__new", F.lit(0))).alias("freq"), "version")
    fresh = materialize(new.join(old, F.col("__t") == F.col("token"), "left_anti").where(F.col("__t").isNotNull()), "new-tokens")
    ranked = global_position(fresh, [F.desc("__new"), F.asc("__t")], "__r", params)
    added = ranked.select(F.col("__t").alias("token"), (F.col("__r") + F.lit(first_id)).alias("token_id"),
                          F.col("__new").alias("freq"), F.lit((last["v"] or 0) + 1).cast("int").alias("version"))
    return kept.unionByName(added)


def top_tokens(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens; ties by token (TakeOrderedAndProject, no full sort)."""
    return freq.orderBy(F.desc("freq"), F.asc("token")).limit(k)


def first_n(df: DataFrame, order, n: int) -> DataFrame:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*cols).limit(n)


def index_tokens(records: DataFrame, vocab: DataFrame, n_tokens: int,
                 params: Params = _DEFAULT, tokens_col: str = "tokens",
                 out: str = "token_ids", broadcast: bool | None = None,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Map every token to its id; tokens missing from ``vocab`` become ``unk_id``.

    ``broadcast=None`` measures ``vocab`` (one small action) and broadcasts it when it
    fits ``params.broadcast_max_bytes``; otherwise a salted shuffle join is used. With more than
    ``MANY_TOKENS`` tokens a record the broadcast goes to the Python workers, where each different token of
    a batch of records is looked up once. ``keep``: the columns of ``records`` to return, else all.
    """
    if broadcast is None:
        broadcast = fits_broadcast(vocab.select("token", "token_id"), params)
    if broadcast and n_tokens > MANY_TOKENS and not records.isStreaming:
        return _index_batches(records, vocab, n_tokens, params, tokens_col, out, keep)
    records = records if keep is None else records.select(*dict.fromkeys([*keep, tokens_col]))
    indexed = _index_joined(records, vocab, n_tokens, params, tokens_col, out, broadcast)
    return indexed if keep is None else indexed.select(*keep, out)


def _index_joined(records: DataFrame, vocab: DataFrame, n_tokens: int, params: Params, tokens_col: str, out: str,
                  broadcast: bool) -> DataFrame:
    return lookup_positions(
        records, tokens_col, n_tokens, vocab, "token", "token_id",
        F.lit(params.unk_id).cast("long"), out, broadcast, params,
    )


def _index_batches(records: DataFrame, vocab: DataFrame, n_tokens: int, params: Params, tokens_col: str, out: str,
                   keep: Sequence[str] | None) -> DataFrame:
    kept = [c for c in (records.columns if keep is None else keep) if c != out]
    words = vocab.select(F.col("token").cast("binary"), F.col("token_id").cast("long")).where(F.col("token").isNotNull())
    table = records.sparkSession.sparkContext.broadcast(words.toArrow())
    fields = [records.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.LongType()))]
    return records.select(*kept, packed(F.col(tokens_col))).mapInArrow(
        _look_up(table, uuid.uuid4().hex, n_tokens, params.unk_id, kept, out), T.StructType(fields))


def _look_up(table, name: str, n: int, default: int, kept: list[str], out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _loaded(name, table)
        for batch in batches:
            tokens, starts, sizes = unpacked(batch)
            known = np.fromiter((ids.get(t, default) for t in tokens.dictionary.to_pylist()), np.int64, len(tokens.dictionary))
            # the last one stands for tokens that are missing
            found = np.append(known[tokens.indices.to_numpy()], default)
            place = np.arange(n)
            at = np.where(place < sizes[:, None], starts[:, None] + place, len(tokens))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(found[at].ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=[*kept, out])

    return run


def _loaded(name: str, table) -> dict[bytes, int]:
    """The broadcast vocabulary, made a dictionary once in each worker."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = dict(zip(table.value.column(0).to_pylist(), table.value.column(1).to_pylist()))
    return _LOADED[name]


def replace_oov(records: DataFrame, vocab: DataFrame, n_tokens: int,
                params: Params = _DEFAULT, tokens_col: str = "tokens",
                out: str = "tokens_seen", ids_out: str | None = None,
                broadcast: bool | None = None) -> DataFrame:
    """Inference branch: tokens missing from ``vocab`` become ``unknown_token``. With
    ``ids_out`` the same lookup also gives the ids (``unk_id`` for unknown tokens)."""
    table = vocab.select("token", F.struct("token", "token_id").alias("__seen"))
    if broadcast is None:
        broadcast = fits_broadcast(table, params)
    none = F.struct(F.lit(params.unknown_token).alias("token"),
                    F.lit(params.unk_id).cast("long").alias("token_id"))
    staged = lookup_positions(records, tokens_col, n_tokens, table, "token", "__seen", none,
                              "__pairs", broadcast, params)
    staged = staged.withColumn(out, F.col("__pairs.token"))
    if ids_out:
        staged = staged.withColumn(ids_out, F.col("__pairs.token_id"))
    return staged.drop("__pairs")


def mask_tokens(indexed: DataFrame, freq: DataFrame, n_features: int,
                params: Params = _DEFAULT, tokens_col: str = "tokens",
                ids_col: str = "token_ids", pos_col: str = "pos",
                broadcast: bool | None = None) -> DataFrame:
    """Training branch: per record one position r in ``[0, maskable)`` is drawn; its id
    becomes ``unk_id`` when ``u > 1/freq(token_r)``, i.e. with probability ``1-1/freq``.

    Both draws come from ``md5('<seed>/<pos>')``, so they are the same on any
    partitioning. Adds ``mask_pos`` and ``masked``.
    """
    k = params.maskable or n_features
    if broadcast is None:
        broadcast = fits_broadcast(freq.select("token", "freq"), params)
    pos = F.col(pos_col)
    r = hash_index(params.mask_seed, pos, k)
    staged = indexed.withColumn("mask_pos", r).withColumn("__u", uniform01(params.mask_seed, pos))
    staged = lookup_column(
        staged, F.element_at(F.col(tokens_col), F.col("mask_pos") + 1), freq, "token", "freq",
        "__f", broadcast, (pos_col,), params,
    )
    masked = F.coalesce(F.col("__u") > F.lit(1.0) / F.col("__f"), F.lit(False))
    unk = F.lit(params.unk_id).cast("long")
    return (staged.withColumn("masked", masked)
                  .withColumn(ids_col, F.transform(
                      F.col(ids_col),
                      lambda x, i: F.when((i == F.col("mask_pos")) & F.col("masked"), unk).otherwise(x)))
                  .drop("__u", "__f"))

