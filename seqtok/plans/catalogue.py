"""The query catalogue: every operator run over the given tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables; its
DuckDB twin is in ``seqtok.plans.oracle``. ``events`` stands in for the record stream:
``event_id`` orders the records, ``value`` is the continuous field, ``props`` and
``user_id`` are text fields, ``event_type`` is the answer (``error`` = attack).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.config import EVENTS_ATTACK, KDD_COLUMNS, Params, WIDE_FIELDS, events_spec, kdd_spec
from seqtok.functions.arrays import one_hot, past_future_split, reshape_steps
from seqtok.functions.buckets import bucket_unit
from seqtok.functions.text import py_float_text
from seqtok.operators import evaluate as ev_ops
from seqtok.operators import factors, learn, sequence_bayes
from seqtok.operators.ranges import RANGE_COLUMNS, Ranged, file_positions, range_windows, ranged_rows
from seqtok.operators.sequence import (
    assign_batch, assign_chunk, assign_chunk_by_key, binary_label, global_position, rank_within,
    sequence_window, split_name,
)
from seqtok.operators.tokens import (
    bounds_table, bucket_expr, collect_bounds, explode_tokens, to_sentence, tokenize_records,
)
from seqtok.operators.lookup import table_stats
from seqtok.operators.vectors import attention_pool, embed_tokens, past_future_pool
from seqtok.operators.vocab import (
    build_vocabulary, distinct_tokens, extend_vocabulary, first_n, index_tokens, mask_tokens, replace_oov,
    token_frequencies, top_tokens,
)
from seqtok.session import materialize, scratch_path, scratch_table
from seqtok.sources import sinks
from seqtok.sources.records import parse_records, read_records, rows_per_file

# events parameters: 1,000-row chunks (8 train, 2 validation, rest test), 128-row batches;
# history windows are computed per 1,000-row chunk with a halo from the previous chunk
EV = Params(attack_values=EVENTS_ATTACK, rows_per_chunk=1000, batch_size=128,
            train_chunks=8, validation_chunks=2, window=40, maskable=None,
            halo_chunk_rows=1000)
N_FEATURES = events_spec().n_features          # 4
N_TOKENS = events_spec().n_tokens              # 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------- shared stages
def events_records(spark: SparkSession, sf_dir: str, params: Params = EV, positioned: bool = True,
                   order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """``([pos,] event_id, user_id, tokens, answer)``: tokenized events. With ``positioned`` the
    records are numbered in ``order`` and written once by ``global_position`` before
    anything else is computed; tokens are a projection over them. Queries that need no
    record order leave it out."""
    events = read(spark, sf_dir, "events")
    spec = events_spec()
    bounds = collect_bounds(events, spec.bucket_columns)
    rows = events.select("event_id", *spec_columns(spec))
    if positioned:
        n_rows = next(iter(bounds.values())).n_rows
        rows = global_position(rows, list(order), "pos", params, n_rows=n_rows)
    keep = (["pos"] if positioned else []) + ["event_id", "user_id"]
    return tokenize_records(rows, spec, bounds, params, keep=keep)


def events_ranged(spark: SparkSession, sf_dir: str, params: Params = EV, broadcast: bool | None = None,
                  order: tuple[str, ...] = ("event_id",), columns: tuple[str, ...] = ("event_id", "feat")) -> Ranged:
    """``columns`` of ``events_indexed``, with ``pos``, as ordered ranges: the records are shuffled once, into
    their ranges; tokens and broadcast lookups leave them where they are."""
    events = read(spark, sf_dir, "events")
    spec = events_spec()
    bounds = collect_bounds(events, spec.bucket_columns)
    rows = events.select("event_id", *spec_columns(spec))
    ranged = ranged_rows(rows, list(order), "pos", params, next(iter(bounds.values())).n_rows)
    rec = tokenize_records(ranged.rows, spec, bounds, params, keep=[*RANGE_COLUMNS, "pos", "event_id", "user_id"])
    return ranged.over(_indexed(rec, params, broadcast).select(*RANGE_COLUMNS, "pos", *columns))


def spec_columns(spec) -> list[str]:
    cols = [f.column for f in spec.features] + ([spec.answer] if spec.answer else [])
    return list(dict.fromkeys(cols))


def events_vocab(rec: DataFrame, params: Params = EV) -> tuple[DataFrame, DataFrame, bool]:
    """``(freq, vocab, small)``. One aggregate over the written frequency table gives
    its row count and size bound; the vocabulary's ``(token, token_id)`` rows have the
    same layout as ``(token, freq)``, so the same bound decides whether lookups in
    either table may be broadcast."""
    tokens = explode_tokens(rec, "event_id", include_answer=params.include_label_tokens)
    freq = materialize(token_frequencies(tokens), "frequencies")
    n, nbytes = table_stats(freq.select("token", "freq"))
    # the vocabulary is persisted (as the reference saves it) and then shared by all lookups
    vocab = materialize(build_vocabulary(freq, params, n_rows=n), "vocabulary")
    return freq, vocab, nbytes <= params.broadcast_max_bytes


def events_indexed(spark: SparkSession, sf_dir: str, params: Params = EV,
                   broadcast: bool | None = None, positioned: bool = True,
                   order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """``([pos,] event_id, user_id, tokens, answer, token_ids, feat, label)``."""
    return _indexed(events_records(spark, sf_dir, params, positioned, order), params, broadcast)


def _indexed(rec: DataFrame, params: Params, broadcast: bool | None) -> DataFrame:
    _, vocab, small = events_vocab(rec, params)
    idx = index_tokens(rec, vocab, N_TOKENS, params, broadcast=small if broadcast is None else broadcast)
    return idx.select("*", F.slice("token_ids", 1, N_FEATURES).alias("feat"),
                      binary_label(F.col("answer"), params).alias("label"))


def pad_step(params: Params = EV) -> F.Column:
    return F.array_repeat(F.lit(params.pad_id).cast("long"), N_FEATURES)


def events_windows(spark: SparkSession, sf_dir: str, n: int = 40, params: Params = EV) -> DataFrame:
    """Indexed, windowed, labelled, chunked and batched events."""
    ranged = events_ranged(spark, sf_dir, params, columns=("event_id", "user_id", "tokens", "answer", "token_ids", "feat", "label"))
    win = range_windows(ranged, {"features": ("feat", pad_step(), True), "labels": ("label", 0, False)},
                        n, params=params)
    win = assign_batch(assign_chunk(win, params.rows_per_chunk), params.batch_size)
    return win.withColumn("split", split_name(F.col("chunk_id"), params))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic score columns standing in for three saved models, as rows
    ``(model_id, event_id, score, label)`` from one scan."""
    events = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    parts = [
        ("m_value", F.least(F.col("value") / 100.0, F.lit(1.0))),
        ("m_inverse", F.lit(1.0) - F.least(F.col("value") / 500.0, F.lit(1.0))),
        ("m_props", k / 100.0),
    ]
    models = F.array(*[F.struct(F.lit(mid).alias("model_id"), score.alias("score")) for mid, score in parts])
    label = binary_label(F.col("event_type"), EV).alias("label")
    return events.select("event_id", label, F.inline(models))


def _r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _join_ids(c) -> F.Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, ",")


# ---------------------------------------------------------------- queries
def q_column_bounds(spark, sf):
    specs = [("events", ["value"]), ("lineitem", ["l_quantity", "l_discount", "l_tax"]),
             ("orders", ["o_totalprice"]), ("customer", ["c_acctbal"]), ("part", ["p_size"])]
    out = None
    for table, cols in specs:
        t = bounds_table(read(spark, sf, table), cols, table)
        out = t if out is None else out.unionByName(t)
    return out.select("column_name", "min_value", "max_value", _r6("stddev").alias("stddev"),
                      "n_buckets")


def q_bucketize_unit(spark, sf):
    events = read(spark, sf, "events")
    b = collect_bounds(events, ["value"])["value"]
    return events.select("event_id", "value", bucket_unit(F.col("value"), b.n_buckets).alias("bucket"))


def q_bucketize_stddev(spark, sf):
    li = read(spark, sf, "lineitem")
    cols = {"l_quantity": "quantity_bucket", "l_discount": "discount_bucket", "l_tax": "tax_bucket"}
    b = collect_bounds(li, list(cols))
    p = EV.with_(bucket_width="stddev")
    return li.select("l_orderkey", "l_linenumber", "l_quantity",
                     *[bucket_expr(F.col(c), b[c], p).alias(o) for c, o in cols.items()])


def q_encode_tokens(spark, sf):
    rec = events_records(spark, sf, positioned=False)
    names = ["tok_value_bucket", "tok_value", "tok_props", "tok_user_id", "tok_answer"]
    return rec.select("event_id", *[F.col("tokens")[i].alias(n) for i, n in enumerate(names)])


def q_record_sentence(spark, sf):
    rec = events_records(spark, sf, positioned=False)
    return rec.select("event_id", to_sentence(F.col("tokens")).alias("sentence"),
                      F.size("tokens").alias("n_tokens"))


def q_text_record_split(spark, sf):
    events = read(spark, sf, "events")
    lines = events.select(F.concat_ws(
        ",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type",
        py_float_text(F.col("value")), "props").alias("value"))
    cols = ["f_event_id", "f_user_id", "f_event_type", "f_value", "f_props"]
    return parse_records(lines, cols, on_bad="fail")


def q_text_record_order(spark, sf):
    """Records from text files: events are written as comma-separated lines into
    several files (file and line order = event order), read back with the fixed-schema
    text reader, and positioned by (file, split, line) without a sort."""
    events = read(spark, sf, "events")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"),
                       "event_type", py_float_text(F.col("value")), "props").alias("value")
    path = scratch_path(spark, "records-text")
    write_event_files(events.select("event_id", line), path)
    rec = read_records(spark, path, ["f_event_id", "f_user_id", "f_event_type", "f_value", "f_props"])
    return file_positions(rec, "pos", EV).select("f_event_id", "f_value", "pos")


EVENTS_PER_FILE = 2500


def write_event_files(lines: DataFrame, path: str) -> None:
    """Stand-in record files: one text file per ``EVENTS_PER_FILE`` event numbers, in
    directories that sort like the events; their number grows with the events."""
    part = F.lpad(F.floor(F.col("event_id") / EVENTS_PER_FILE).cast("string"), 12, "0")
    (lines.withColumn("part", part).repartition("part").sortWithinPartitions("part", "event_id")
          .select("part", "value").write.partitionBy("part").text(path))


def q_chunk_by_file(spark, sf):
    """Chunks of 1,000 records that also end where their input file ends, over record
    files read back by the text reader."""
    events = read(spark, sf, "events")
    path = scratch_path(spark, "records-files")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    write_event_files(events.select("event_id", line.alias("value")), path)
    rec = read_records(spark, path, ["f_event_id", "f_user_id"])
    out = assign_chunk_by_key(rec, 1000, ["_file"], ["_block", "_row"], params=EV)
    return out.select("f_event_id", "chunk_id", "row_in_chunk")


def q_token_frequencies(spark, sf):
    return token_frequencies(explode_tokens(events_records(spark, sf, positioned=False), "event_id"))


def doc_tokens(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    return docs.select(F.explode(F.split("text", " ", -1)).alias("token"))


def q_doc_token_frequencies(spark, sf):
    return token_frequencies(doc_tokens(spark, sf))


def q_distinct_tokens(spark, sf):
    return distinct_tokens(explode_tokens(events_records(spark, sf, positioned=False), "event_id"))


def q_top_tokens(spark, sf):
    return top_tokens(token_frequencies(doc_tokens(spark, sf)), 100)


def q_first_n(spark, sf):
    return first_n(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                   ["o_orderkey", "o_custkey"], 100)


def q_vocabulary(spark, sf):
    _, vocab, _ = events_vocab(events_records(spark, sf, positioned=False))
    return vocab


def q_index_tokens(spark, sf):
    return events_indexed(spark, sf, positioned=False).select(
        "event_id", _join_ids("token_ids").alias("token_ids"))


def q_index_tokens_salted(spark, sf):
    """The shuffle lookup: hot tokens salted by their frequency (here from 500 rows up)."""
    idx = events_indexed(spark, sf, EV.with_(salt_rows=500), broadcast=False, positioned=False)
    return idx.select("event_id", _join_ids("token_ids").alias("token_ids"))


def q_oov_replace(spark, sf):
    """Inference branch: the vocabulary comes from the first 80% of the record sequence
    (the training part), and ALL records are then indexed against it, so tokens only
    seen later become ``unknown``."""
    rec = events_records(spark, sf)
    n = rec.count()
    train = rec.where(F.col("pos") < (n * 8) // 10)
    _, vocab, small = events_vocab(train)
    idx = replace_oov(rec, vocab, N_TOKENS, EV, ids_out="token_ids", broadcast=small)
    return idx.select("event_id", _join_ids("tokens_seen").alias("tokens_seen"),
                      _join_ids("token_ids").alias("token_ids"))


def q_mask_tokens(spark, sf):
    rec = events_records(spark, sf)
    freq, vocab, small = events_vocab(rec)
    idx = index_tokens(rec, vocab, N_TOKENS, EV, broadcast=small)
    masked = mask_tokens(idx, freq, N_FEATURES, EV.with_(mask_seed=42), broadcast=small)
    return masked.select("event_id", "mask_pos", "masked", _join_ids("token_ids").alias("token_ids"))


def q_binary_label(spark, sf):
    events = read(spark, sf, "events")
    return events.select("event_id", F.col("event_type").alias("answer"),
                         binary_label(F.col("event_type"), EV).alias("label"))


def q_global_position(spark, sf):
    return global_position(read(spark, sf, "events"), ["value", "event_id"], "pos", EV).select(
        "event_id", "pos")


def q_global_position_ranges(spark, sf):
    """Global position with 1,000-row ranges: many ranges at any test scale."""
    p = EV.with_(rows_per_range=1000)
    return global_position(read(spark, sf, "events"), ["value", "event_id"], "pos", p).select(
        "event_id", "pos")


def q_sequence_window_global(spark, sf):
    win = range_windows(events_ranged(spark, sf), {"window": ("feat", pad_step(), True)}, 40, params=EV)
    return win.select("event_id", _join_ids("window").alias("window"))


def q_sequence_window_keyed(spark, sf):
    """Windows per user: records are positioned by (user, event) once, before the lookups."""
    ranged = events_ranged(spark, sf, order=("user_id", "event_id"), columns=("event_id", "user_id", "feat"))
    win = range_windows(ranged, {"window": ("feat", pad_step(), True)}, 40, keys=["user_id"], params=EV)
    return win.select("event_id", "user_id", _join_ids("window").alias("window"))


def q_label_window(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type")
    ranged = ranged_rows(events, ["event_id"], "pos", EV)
    values = {"labels": (binary_label(F.col("event_type"), EV), 0, False)}
    return range_windows(ranged, values, 40, params=EV).select("event_id", _join_ids("labels").alias("labels"))


def q_past_future_split(spark, sf):
    # ids become text once a record, not once in each of its 51 windows
    texts = (F.col("feat").cast("array<string>"), pad_step().cast("array<string>"), True)
    win = range_windows(events_ranged(spark, sf), {"window": texts}, 51, params=EV)
    win = win.select("event_id", reshape_steps(F.col("window"), 51, N_FEATURES).alias("steps"))
    past, future = past_future_split(F.col("steps"), 25, 51)
    return win.select("event_id", _join_ids(F.flatten(past)).alias("past"),
                      _join_ids(F.flatten(future)).alias("future"))


def _positioned_events(spark, sf):
    return global_position(read(spark, sf, "events"), ["event_id"], "pos", EV)


def q_chunk_assign(spark, sf):
    return assign_chunk(_positioned_events(spark, sf), EV.rows_per_chunk).select(
        "event_id", "pos", "chunk_id", "row_in_chunk")


def q_chunk_by_key(spark, sf):
    """Chunks of 20 rows that also end where a user's events end (the per-file cut of
    the reference, keyed here by user)."""
    events = read(spark, sf, "events").select("event_id", "user_id")
    return assign_chunk_by_key(events, 20, ["user_id"], ["event_id"], params=EV).select(
        "event_id", "user_id", "chunk_id", "row_in_chunk")


def q_batch_assign(spark, sf):
    chunked = assign_chunk(_positioned_events(spark, sf), EV.rows_per_chunk)
    return assign_batch(chunked, EV.batch_size).select("event_id", "chunk_id", "batch_id")


def q_train_validation_split(spark, sf):
    chunked = assign_chunk(_positioned_events(spark, sf), EV.rows_per_chunk)
    return chunked.select("event_id", "chunk_id", split_name(F.col("chunk_id"), EV).alias("split"))


def q_rows_per_file(spark, sf):
    counts = rows_per_file(read(spark, sf, "lineitem"))
    return counts.select(F.regexp_extract("file_path", "([^/]+)$", 1).alias("file_name"), "n_rows")


def q_one_hot(spark, sf):
    emb = read(spark, sf, "embeddings")
    return emb.select("vec_id", "label", _join_ids(one_hot(F.col("label"), 10)).alias("one_hot"))


def _embedding_dim(emb: DataFrame) -> int:
    return int(emb.agg(F.max(F.size("embedding"))).first()[0])


def q_embed_tokens(spark, sf):
    idx = events_indexed(spark, sf, positioned=False).select("event_id", "feat")
    emb = read(spark, sf, "embeddings")
    dim = _embedding_dim(emb)
    vectors = emb.select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"))
    out = embed_tokens(idx, vectors, N_FEATURES, dim, ids_col="feat")
    x = F.col("embedded")
    # a step is a hit when its vector has a non-zero element (slices: no lambda)
    hits = None
    for i in range(N_FEATURES):
        step = F.slice(x, i * dim + 1, dim)
        h = ((F.array_max(step) != 0) | (F.array_min(step) != 0)).cast("int")
        hits = h if hits is None else hits + h
    vsum = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    vchk = F.aggregate(F.zip_with(x, F.sequence(F.lit(1), F.size(x)), lambda v, i: v * i),
                       F.lit(0.0), lambda a, v: a + v)
    return out.select("event_id", hits.alias("n_hits"), _r6(vsum).alias("vec_sum"),
                      _r6(vchk).alias("vec_check"))


def _w_past(dim):
    return [((d % 7) - 3) * 0.05 for d in range(dim)]


def _w_future(dim):
    return [((d % 5) - 2) * 0.04 for d in range(dim)]


def _b_past(t):
    return (t % 5) * 0.01


def _b_future(t):
    return (t % 3) * 0.02


def _embedding_steps(spark, sf):
    emb = read(spark, sf, "embeddings")
    dim = _embedding_dim(emb)
    steps = rank_within(emb, ["label"], ["vec_id"], "step", EV)
    return steps, dim


def q_attention_pool(spark, sf):
    steps, dim = _embedding_steps(spark, sf)
    pooled = attention_pool(steps, ["label"], "step", "embedding", _w_past(dim), _b_past)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "pooled")).select(
        "label", "dim", _r6("pooled").alias("pooled"))


def q_attention_weights(spark, sf):
    steps, dim = _embedding_steps(spark, sf)
    _, weights = attention_pool(steps, ["label"], "step", "embedding", _w_past(dim), _b_past,
                                return_attention=True, keep=["vec_id"])
    return weights.select("label", "vec_id", "step", _r6("attention").alias("attention"))


def q_attention_pool_masked(spark, sf):
    """Attention pooling with a mask: vectors with a negative first component take no part."""
    steps, dim = _embedding_steps(spark, sf)
    masked = steps.withColumn("mask", (F.col("embedding")[0] >= 0).cast("int"))
    pooled = attention_pool(masked, ["label"], "step", "embedding", _w_past(dim), _b_past, mask_col="mask")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "pooled")).select(
        "label", "dim", _r6("pooled").alias("pooled"))


def q_past_future_pool(spark, sf):
    steps, dim = _embedding_steps(spark, sf)
    pooled = past_future_pool(steps, ["label"], "step", "embedding", 25,
                              _w_past(dim), _b_past, _w_future(dim), _b_future)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "pooled")).select(
        "label", "dim", _r6("pooled").alias("pooled"))


def q_class_weights(spark, sf):
    lab = read(spark, sf, "labels")
    w = lab.select("quality", learn.class_weight(F.col("quality"), EV).alias("weight"))
    return w.groupBy("quality").agg(F.count(F.lit(1)).alias("n"),
                                    _r6(F.sum("weight")).alias("weight_sum"))


def _round_metrics(df: DataFrame, keys=()) -> DataFrame:
    return df.select(*keys, "threshold", "tp", "fp", "fn", _r6("precision").alias("precision"),
                     _r6("recall").alias("recall"), _r6("f1").alias("f1"))


def q_precision_recall_curve(spark, sf):
    scores = model_scores(spark, sf).where(F.col("model_id") == "m_value")
    return _round_metrics(ev_ops.precision_recall_curve(scores, params=EV))


def q_compare_models(spark, sf):
    return _round_metrics(ev_ops.compare_models(model_scores(spark, sf), params=EV),
                          ["model_id"])


def q_model_losses(spark, sf):
    ls = ev_ops.model_losses(model_scores(spark, sf), params=EV)
    return ls.select("model_id", _r6("log_loss").alias("log_loss"),
                     _r6("weighted_loss").alias("weighted_loss"),
                     _r6("binary_accuracy").alias("binary_accuracy"), "n")


def q_best_model(spark, sf):
    ls = ev_ops.model_losses(model_scores(spark, sf), params=EV)
    return ev_ops.best_model(ls).select("model_id", _r6("log_loss").alias("log_loss"))


def q_align_scores(spark, sf):
    """Two tables of different rows paired by key: a score exists for every document (its
    share of 5,000 characters), truth only for the documents in ``labels``."""
    docs = read(spark, sf, "documents")
    predictions = docs.select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"))
    truth = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return ev_ops.align_scores(predictions, truth, ["doc_id"]).select("doc_id", "score", "label")


def q_chunk_round_trip(spark, sf):
    idx = events_indexed(spark, sf)
    chunked = assign_chunk(idx, EV.rows_per_chunk)
    out = chunked.select("event_id", "pos", "chunk_id", "label", "token_ids",
                         split_name(F.col("chunk_id"), EV).alias("split"))
    path = scratch_path(spark, "chunks")
    sinks.write_chunks(out, path, chunks_per_directory=4)
    t, v = EV.train_chunks, EV.validation_chunks
    back = None
    for split, first, last in (("train", 0, t - 1), ("validation", t, t + v - 1), ("test", t + v, None)):
        part = sinks.read_chunks(spark, path, first, last, split, chunks_per_directory=4)
        back = part if back is None else back.unionByName(part)
    return back.select("event_id", "chunk_id", "split", "label", _join_ids("token_ids").alias("token_ids"))


def q_sentence_round_trip(spark, sf):
    """Sentences through CSV and back, with a blank-edged, a quoted and an empty token put in
    (by position) so that every record's text is exact."""
    rec = events_records(spark, sf)
    odd = F.element_at(F.array(F.lit(" lead"), F.lit("trail "), F.lit('say "x"'), F.lit("")),
                       (F.col("pos") % 4 + 1).cast("int"))
    only = F.when(F.col("pos") % 10 == 0, F.array(odd)).otherwise(
        F.concat(F.array(odd), F.col("tokens"), F.array(odd)))
    path = scratch_path(spark, "sentences")
    sinks.write_sentences(rec.select("pos", only.alias("tokens")), path, fmt="csv")
    back = sinks.read_sentences(spark, path, fmt="csv")
    return back.select("pos", to_sentence(F.col("tokens")).alias("sentence"),
                       F.size("tokens").alias("n_tokens"))


def q_vocabulary_round_trip(spark, sf):
    _, vocab, _ = events_vocab(events_records(spark, sf, positioned=False))
    path = scratch_path(spark, "vocabulary")
    sinks.save_vocabulary(vocab, path)
    return sinks.load_vocabulary(spark, path).select("token", "token_id", "freq")


def q_metrics_table(spark, sf):
    metrics = q_precision_recall_curve(spark, sf)
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(metrics, path)
    return sinks.read_metrics(spark, path)


def q_fit_and_score(spark, sf):
    """Fit two class-weighted window classifiers on the train chunks, save and reload
    them, and score every window with both (rows only: no SQL twin)."""
    idx = events_indexed(spark, sf)
    win = sequence_window(idx, "feat", 5, pad_step(), flatten=True, params=EV)
    win = assign_chunk(win, EV.rows_per_chunk).select(
        "pos", "label", learn.window_terms(F.col("window"), N_FEATURES, 5).alias("terms"),
        learn.class_weight(F.col("label"), EV).alias("weight"),
        split_name(F.col("chunk_id"), EV).alias("split"),
    )
    win = materialize(win, "windows")
    train = win.where(F.col("split") == "train")
    models = learn.fit_candidates(train, [("lr_it5", 5, 0.0), ("lr_it20", 20, 0.01)],
                                  num_features=1 << 16)
    root = scratch_path(spark, "models")
    learn.save_models(spark, models, root)
    loaded = learn.load_models(spark, root)
    out = None
    for mid, model in sorted(loaded.items()):
        s = learn.score_windows(model, win, mid)
        out = s if out is None else out.unionByName(s)
    return out


def _bayes_records(spark, sf) -> Ranged:
    """Ordered records with their feature tokens, label, weight, and whether their window is for training."""
    events = read(spark, sf, "events")
    spec = events_spec()
    bounds = collect_bounds(events, spec.bucket_columns)
    ranged = ranged_rows(events.select("event_id", *spec_columns(spec)), ["event_id"], "pos", EV,
                         next(iter(bounds.values())).n_rows)
    rec = tokenize_records(ranged.rows, spec, bounds, EV, keep=["__range", "__at", "pos", "event_id"])
    label = binary_label(F.col("answer"), EV)
    chunk = F.floor(F.col("pos") / EV.rows_per_chunk)
    return ranged.over(rec.select(
        "__range", "__at", "pos", "event_id", F.slice("tokens", 1, N_FEATURES).alias("tokens"), label.alias("label"),
        learn.class_weight(label, EV).alias("weight"), (split_name(chunk, EV) == "train").alias("train")))


BAYES_GRID = {"alpha_0.1": 0.1, "alpha_1": 1.0, "alpha_10": 10.0}


def _bayes_scores(spark, sf) -> DataFrame:
    records = _bayes_records(spark, sf)
    model = sequence_bayes.fit_sequence_bayes(records, BAYES_GRID, 5, N_FEATURES, params=EV)
    root = scratch_path(spark, "bayes")
    sequence_bayes.save_sequence_bayes(model, root)
    model = sequence_bayes.load_sequence_bayes(spark, root)
    return sequence_bayes.score_sequence_bayes(model, records, ["event_id", "label"], N_FEATURES, params=EV)


def q_bayes_scores(spark, sf):
    """A grid of class-weighted naive Bayes models fitted on the train chunks, saved,
    loaded again, and applied to the window of 5 records of every event, along the sequence."""
    return _bayes_scores(spark, sf).select("model_id", "event_id", "label", _r6("score").alias("score"))


def q_bayes_best(spark, sf):
    """The candidate of the naive Bayes grid with the least log loss over all windows."""
    best = ev_ops.best_model(ev_ops.model_losses(_bayes_scores(spark, sf), params=EV))
    return best.select("model_id", _r6("log_loss").alias("log_loss"))


def q_token_vectors(spark, sf):
    """Context vectors (40 seeded sign dimensions) of all record tokens."""
    rec = events_records(spark, sf, positioned=False)
    vectors = learn.context_vectors(rec.select("tokens"), dim=40, window_size=2)
    return vectors.select("token", _join_ids("vector").alias("vector"))


def q_score_curve(spark, sf):
    """The exact precision/recall curve of every model: each distinct score is a threshold."""
    curve = ev_ops.score_curve(model_scores(spark, sf), group_cols=["model_id"], params=EV)
    return curve.select("model_id", _r6("threshold").alias("threshold"), "tp", "fp", "fn", _r6("precision").alias("precision"),
                        _r6("recall").alias("recall"), _r6("f1").alias("f1"))


def q_average_precision(spark, sf):
    """Average precision, best F1 and its threshold per model, over all scores."""
    curve = ev_ops.score_curve(model_scores(spark, sf), group_cols=["model_id"], params=EV.with_(rows_per_range=1000))
    best = ev_ops.average_precision(curve, ["model_id"])
    return best.select("model_id", "n_steps", *[_r6(c).alias(c) for c in ("average_precision", "best_f1", "best_threshold")])


def q_vocabulary_growth(spark, sf):
    """The vocabulary of the first half of the events, saved as version 1, grown by the tokens of the second
    half, saved as version 2 and loaded again: old ids stay, new tokens get the next ones."""
    rec = events_records(spark, sf, positioned=False)
    half = (rec.agg(F.max("event_id").alias("m")).first()["m"] or 0) // 2
    words = [explode_tokens(part, "event_id") for part in (rec.where(F.col("event_id") <= half), rec.where(F.col("event_id") > half))]
    first = build_vocabulary(materialize(token_frequencies(words[0]), "frequencies"), EV).withColumn("version", F.lit(1))
    root = scratch_path(spark, "vocabularies")
    loaded = sinks.load_vocabulary_version(spark, root, sinks.save_vocabulary_version(first, root))
    grown = materialize(extend_vocabulary(loaded, token_frequencies(words[1]), EV), "grown")
    return sinks.load_vocabulary_version(spark, root, sinks.save_vocabulary_version(grown, root)).select(
        "token", "token_id", "freq", "version")


def q_token_pmi(spark, sf):
    """Positive pointwise mutual information of all token pairs of a record at most two places apart."""
    rec = events_records(spark, sf, positioned=False)
    return factors.positive_pmi(rec, window_size=2, params=EV).select("token", "context", "n", _r6("ppmi").alias("ppmi"))


def q_token_embeddings(spark, sf):
    """Vectors of all record tokens learned from their co-occurrence: 8 leading factors of the positive PMI
    (rows only: no SQL twin; NumPy checks them in the tests)."""
    rec = events_records(spark, sf, positioned=False)
    vectors, _ = factors.learn_vectors(factors.positive_pmi(rec, window_size=2, params=EV), dim=8, iterations=6, params=EV)
    return vectors.select("token", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


def _stored_chunks(spark, df: DataFrame, name: str) -> DataFrame:
    """``df`` (with ``pos``) as a chunk table, bucketed by chunk, read back."""
    table, path = scratch_table(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.write_chunk_table(assign_chunk(df, EV.rows_per_chunk), table, path, buckets)
    return sinks.read_chunk_table(spark, table)


def q_batches_stored(spark, sf):
    """Batches over stored chunks: rows, first event and attacks of each, without an exchange."""
    events = ranged_rows(read(spark, sf, "events").select("event_id", "event_type"), ["event_id"], "pos", EV).rows
    rows = events.select("event_id", "pos", binary_label(F.col("event_type"), EV).alias("label"))
    batched = assign_batch(_stored_chunks(spark, rows, "chunk-table"), EV.batch_size)
    return batched.groupBy("chunk_id", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.sum("label").alias("attacks"))


def q_align_stored(spark, sf):
    """Scores of every second event and labels of the events up to value 90, both stored by chunk, paired by
    chunk and row."""
    events = ranged_rows(read(spark, sf, "events").select("event_id", "event_type", "value"), ["event_id"], "pos", EV).rows
    scores = events.select("pos", "event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"))
    truth = events.where(F.col("value") <= 90).select("pos", binary_label(F.col("event_type"), EV).alias("label"))
    scores = _stored_chunks(spark, scores.where(F.col("event_id") % 2 == 0), "score-table")
    paired = ev_ops.align_chunks(scores, _stored_chunks(spark, truth, "truth-table").drop("pos"))
    return paired.select("event_id", "chunk_id", "row_in_chunk", "score", "label")


def wide_record_lines(spark, sf) -> DataFrame:
    """Stand-in 42-field records: ``(l_orderkey, l_linenumber, line_md5, value)``, a comma line
    per row of lineitem with its order and customer (see ``config.WIDE_FIELDS``)."""
    li, orders, cust = (read(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rows = (li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
              .join(cust, orders["o_custkey"] == cust["c_custkey"]))
    fields = [F.expr(e) for e in WIDE_FIELDS]
    lines = rows.select("l_orderkey", "l_linenumber", F.concat_ws(",", *fields).alias("value"))
    return lines.withColumn("line_md5", F.md5("value"))


def q_wide_records(spark, sf):
    """The connection-record flow on 42-field lines: split, bounds over text columns, 42
    tokens, vocabulary, ids, windows of 5 records by (order, line number, line text). A window
    holds the ids of each of its records as one text, and their numbers."""
    key = ["l_orderkey", "l_linenumber", "line_md5"]
    p = EV.with_(normal_values=("R",), attack_values=None)
    spec = kdd_spec()
    rec = materialize(parse_records(wide_record_lines(spark, sf), KDD_COLUMNS, keep=key), "wide-records")
    bounds = collect_bounds(rec, spec.bucket_columns)
    tok = tokenize_records(rec, spec, bounds, p, keep=key)
    freq = materialize(token_frequencies(explode_tokens(tok, counted=True), count_col="n"), "wide-frequencies")
    vocab = materialize(build_vocabulary(freq, p), "wide-vocabulary")
    idx = index_tokens(tok, vocab, spec.n_tokens, p, keep=[*key, "answer"])
    # only ids are sorted, as one text a record: they become text once, not once in each window
    feat = _join_ids(F.slice("token_ids", 1, spec.n_features)).alias("feat")
    n = F.least(F.size("token_ids"), F.lit(spec.n_features)).alias("n")
    rows = materialize(idx.select(*key, feat, n, binary_label(F.col("answer"), p).alias("label")), "wide-ids")
    ranged = ranged_rows(rows, key, "pos", p, next(iter(bounds.values())).n_rows)
    pad = F.lit(",".join([str(p.pad_id)] * spec.n_features))
    values = {"features": ("feat", pad, False), "sizes": ("n", spec.n_features, False), "labels": ("label", 0, False)}
    win = range_windows(ranged, values, 5, params=p, keep=key)
    n_ids = F.aggregate("sizes", F.lit(0), lambda total, n: total + n)
    return win.select(*key, F.md5(_join_ids("features")).alias("window_md5"), n_ids.alias("n_ids"),
                      _join_ids("labels").alias("labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "column_bounds": q_column_bounds,
    "bucketize_unit": q_bucketize_unit,
    "bucketize_stddev": q_bucketize_stddev,
    "encode_tokens": q_encode_tokens,
    "record_sentence": q_record_sentence,
    "text_record_split": q_text_record_split,
    "text_record_order": q_text_record_order,
    "token_frequencies": q_token_frequencies,
    "doc_token_frequencies": q_doc_token_frequencies,
    "distinct_tokens": q_distinct_tokens,
    "top_tokens": q_top_tokens,
    "first_n": q_first_n,
    "vocabulary": q_vocabulary,
    "index_tokens": q_index_tokens,
    "index_tokens_salted": q_index_tokens_salted,
    "oov_replace": q_oov_replace,
    "mask_tokens": q_mask_tokens,
    "binary_label": q_binary_label,
    "global_position": q_global_position,
    "global_position_ranges": q_global_position_ranges,
    "sequence_window_global": q_sequence_window_global,
    "sequence_window_keyed": q_sequence_window_keyed,
    "label_window": q_label_window,
    "past_future_split": q_past_future_split,
    "chunk_assign": q_chunk_assign,
    "chunk_by_key": q_chunk_by_key,
    "chunk_by_file": q_chunk_by_file,
    "batch_assign": q_batch_assign,
    "train_validation_split": q_train_validation_split,
    "rows_per_file": q_rows_per_file,
    "one_hot": q_one_hot,
    "embed_tokens": q_embed_tokens,
    "attention_pool": q_attention_pool,
    "attention_weights": q_attention_weights,
    "attention_pool_masked": q_attention_pool_masked,
    "past_future_pool": q_past_future_pool,
    "class_weights": q_class_weights,
    "precision_recall_curve": q_precision_recall_curve,
    "compare_models": q_compare_models,
    "model_losses": q_model_losses,
    "best_model": q_best_model,
    "align_scores": q_align_scores,
    "chunk_round_trip": q_chunk_round_trip,
    "sentence_round_trip": q_sentence_round_trip,
    "vocabulary_round_trip": q_vocabulary_round_trip,
    "metrics_table": q_metrics_table,
    "fit_and_score": q_fit_and_score,
    "bayes_scores": q_bayes_scores,
    "bayes_best": q_bayes_best,
    "token_vectors": q_token_vectors,
    "wide_records": q_wide_records,
    "score_curve": q_score_curve,
    "average_precision": q_average_precision,
    "vocabulary_growth": q_vocabulary_growth,
    "token_pmi": q_token_pmi,
    "token_embeddings": q_token_embeddings,
    "batches_stored": q_batches_stored,
    "align_stored": q_align_stored,
}
