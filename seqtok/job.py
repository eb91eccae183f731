"""The whole flow as functions and a command line.

    python -m seqtok.job preprocess INPUT OUTPUT        records -> sentences, bounds, vocabulary
    python -m seqtok.job index OUTPUT [--inference] [--time-data] [--window 40] [--by-file] [--past-future]
    python -m seqtok.job train OUTPUT                   classifiers on the train chunks
    python -m seqtok.job evaluate OUTPUT                scores, precision/recall, best model

New files are judged by what an earlier run learned, as a test set of its own:

    python -m seqtok.job preprocess NEW TEST --learned-from OUTPUT
    python -m seqtok.job index TEST --inference --learned-from OUTPUT
    python -m seqtok.job evaluate TEST --learned-from OUTPUT --split all

``OUTPUT`` is a folder on storage that all executors share. Each step reads what the steps
before have written there: ``sentences``, ``bounds``, ``vocabulary``, ``chunks``, ``models``,
``scores``, ``metrics``, ``losses``, ``best``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtok.config import KDD_COLUMNS, Params, RecordSpec, kdd_spec
from seqtok.functions.arrays import past_future_split, reshape_steps
from seqtok.operators import evaluate, sequence_bayes
from seqtok.operators.learn import class_weight
from seqtok.operators.ranges import Ranged, file_positions, ranged_rows
from seqtok.operators.sequence import (
    assign_batch, assign_chunk, assign_chunk_by_key, binary_label, sequence_windows, split_name,
)
from seqtok.operators.tokens import collect_bounds, explode_tokens, tokenize_records
from seqtok.operators.vocab import build_vocabulary, index_tokens, mask_tokens, replace_oov, token_frequencies
from seqtok.session import materialize
from seqtok.sources import sinks
from seqtok.sources.records import read_records

PAST_FUTURE_STEPS = 51
ALPHAS = {"alpha_0.1": 0.1, "alpha_1": 1.0, "alpha_10": 10.0}


def _at(out: str, name: str) -> str:
    return os.path.join(out, name)


def preprocess(spark: SparkSession, source: str, out: str, params: Params = Params(),
               spec: RecordSpec | None = None, columns: Sequence[str] = KDD_COLUMNS,
               on_bad: str = "fail", learned_from: str | None = None) -> None:
    """Record files to positioned sentences, the bounds, and the vocabulary with frequencies.

    The text is read once; positions come from the file splits, without a sort. With
    ``learned_from`` the bounds of that earlier output are used and no vocabulary is built.
    """
    spec = spec or kdd_spec()
    rec = read_records(spark, source, columns, on_bad)
    if on_bad == "quarantine":
        rec = rec.where(~F.col("_corrupt")).drop("_corrupt")
    pos = file_positions(rec, "pos", params)
    if learned_from:
        bounds = sinks.load_bounds(spark, _at(learned_from, "bounds"))
    else:
        bounds = collect_bounds(pos, spec.bucket_columns)
        sinks.save_bounds(spark, bounds, _at(out, "bounds"))
    tokens = tokenize_records(pos, spec, bounds, params, keep=["pos", "_file"])
    tokens.write.mode("overwrite").parquet(_at(out, "sentences"))
    if learned_from:
        return
    sentences = spark.read.parquet(_at(out, "sentences"))
    words = explode_tokens(sentences, include_answer=params.include_label_tokens)
    freq = materialize(token_frequencies(words), "frequencies")
    sinks.save_vocabulary(build_vocabulary(freq, params), _at(out, "vocabulary"))


def index_windows(spark: SparkSession, out: str, training: bool = True, time_data: bool = False,
                  window: int | None = None, params: Params = Params(), by_file: bool = False,
                  n_tokens: int | None = None, learned_from: str | None = None,
                  past_future: bool = False) -> DataFrame:
    """Sentences to indexed, windowed, labelled chunks; ``record`` holds the record's own ids.

    ``training`` masks one token per record by its frequency; else unknown tokens are
    replaced. ``time_data`` labels a window with the labels of its records instead of the
    last one's. ``by_file`` also ends chunks where an input file ends. ``learned_from``: the vocabulary
    of that output. ``past_future``: instead of ``features``, the input of the two-sided model: ``past``
    (first to middle step, read backwards) and ``future`` (middle to last step).
    """
    n = window or (PAST_FUTURE_STEPS if past_future else params.window)
    sentences = spark.read.parquet(_at(out, "sentences"))
    vocab = sinks.load_vocabulary(spark, _at(learned_from or out, "vocabulary"))
    n_tokens = n_tokens or kdd_spec().n_tokens
    if training:
        idx = mask_tokens(index_tokens(sentences, vocab, n_tokens, params), vocab.select("token", "freq"),
                          n_tokens - 1, params)
    else:
        idx = replace_oov(sentences, vocab, n_tokens, params, ids_out="token_ids")
    feat = idx.select("pos", "_file", F.slice("token_ids", 1, n_tokens - 1).alias("record"),
                      binary_label(F.col("answer"), params).alias("label"))
    pad = F.array_repeat(F.lit(params.pad_id).cast("long"), n_tokens - 1)
    values = {"features": ("record", pad, True)}
    if time_data:
        values["labels"] = ("label", 0, False)
    win = sequence_windows(feat, values, n, params=params)
    if by_file:
        cut = assign_chunk_by_key(feat.select("pos", "_file"), params.rows_per_chunk, ["_file"], ["pos"],
                                  params=params)
        win = win.join(cut.drop("_file"), "pos")
    else:
        win = assign_chunk(win, params.rows_per_chunk)
    if past_future:
        past, future = past_future_split(reshape_steps(F.col("features"), n, n_tokens - 1), n // 2, n)
        win = win.withColumns({"past": F.flatten(past), "future": F.flatten(future)}).drop("features")
    win = assign_batch(win, params.batch_size).withColumn("split", split_name(F.col("chunk_id"), params))
    sinks.write_chunks(win, _at(out, "chunks"))
    spark.createDataFrame([(n, n_tokens - 1)], "steps int, fields int").write.mode("overwrite").parquet(_at(out, "layout"))
    return sinks.read_chunks(spark, _at(out, "chunks"))


def _records(spark: SparkSession, out: str, split: str | None, params: Params) -> tuple[Ranged, int, int]:
    """Ordered ``(pos, record, label, split)`` of a split (None: all) and of the records its windows reach
    back to; steps and fields of the windows. The windows themselves are not read."""
    layout = spark.read.parquet(_at(out, "layout")).first()
    rows = sinks.read_chunks(spark, _at(out, "chunks")).select("pos", "record", "label", "split")
    if split is not None:
        span = rows.where(F.col("split") == split).agg(F.min("pos").alias("a"), F.max("pos").alias("b")).first()
        if span["a"] is None:
            rows = rows.where("false")
        else:       # a split is a run of positions
            rows = rows.where(F.col("pos").between(span["a"] - layout["steps"] + 1, span["b"]))
    return ranged_rows(rows, ["pos"], None, params), layout["steps"], layout["fields"]


def train(spark: SparkSession, out: str, params: Params = Params(), alphas: dict[str, float] | None = None) -> None:
    """Class-weighted classifiers on the train chunks, saved below ``models``."""
    records, steps, fields = _records(spark, out, "train", params)
    rows = records.rows.withColumn("weight", class_weight(F.col("label"), params)).withColumn(
        "train", F.col("split") == "train")
    model = sequence_bayes.fit_sequence_bayes(records.over(rows), alphas or ALPHAS, steps, fields, "record", params=params)
    sequence_bayes.save_sequence_bayes(model, _at(out, "models"))


def evaluate_models(spark: SparkSession, out: str, params: Params = Params(), split: str = "test",
                    learned_from: str | None = None) -> DataFrame:
    """Scores of every saved model on a split (``all``: every record), the threshold sweep, losses, and the
    best. ``learned_from``: the models of that output."""
    records, steps, fields = _records(spark, out, None if split == "all" else split, params)
    model = sequence_bayes.load_sequence_bayes(spark, _at(learned_from or out, "models"))
    learned = model.totals.first()["steps"]
    if learned != steps:
        raise ValueError(f"the models were learned on windows of {learned} records, these chunks have {steps}")
    scores = sequence_bayes.score_sequence_bayes(model, records, ["pos", "label", "split"], fields, "record", params=params)
    if split != "all":
        scores = scores.where(F.col("split") == split)
    scores.drop("split").write.mode("overwrite").parquet(_at(out, "scores"))
    scores = spark.read.parquet(_at(out, "scores"))
    sinks.write_metrics(evaluate.compare_models(scores, params=params), _at(out, "metrics"))
    losses = evaluate.model_losses(scores, params=params)
    losses.write.mode("overwrite").parquet(_at(out, "losses"))
    evaluate.best_model(losses).write.mode("overwrite").parquet(_at(out, "best"))
    return spark.read.parquet(_at(out, "best"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqtok.job", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="step", required=True)
    pre = sub.add_parser("preprocess")
    pre.add_argument("input")
    pre.add_argument("output")
    pre.add_argument("--on-bad", choices=("fail", "quarantine"), default="fail")
    index = sub.add_parser("index")
    index.add_argument("output")
    index.add_argument("--inference", action="store_true")
    index.add_argument("--time-data", action="store_true")
    index.add_argument("--window", type=int)
    index.add_argument("--by-file", action="store_true")
    index.add_argument("--past-future", action="store_true", help="windows of 51 records in two halves")
    sub.add_parser("train").add_argument("output")
    judge = sub.add_parser("evaluate")
    judge.add_argument("output")
    judge.add_argument("--split", default="test", help="train, validation, test or all")
    for p in (pre, index, judge):
        p.add_argument("--learned-from", metavar="OUTPUT", help="bounds, vocabulary or models of an earlier output")
    for p in sub.choices.values():
        p.add_argument("--parity", action="store_true", help="ids and buckets of the original job")
        p.add_argument("--rows-per-chunk", type=int)
        p.add_argument("--train-chunks", type=int)
        p.add_argument("--validation-chunks", type=int)
    a = parser.parse_args(argv)
    given = {k: v for k in ("rows_per_chunk", "train_chunks", "validation_chunks")
             if (v := getattr(a, k)) is not None}
    params = Params.parity(**given) if a.parity else Params(**given)
    spark = spark or SparkSession.builder.appName("seqtok").getOrCreate()
    if a.step == "preprocess":
        preprocess(spark, a.input, a.output, params, on_bad=a.on_bad, learned_from=a.learned_from)
    elif a.step == "index":
        index_windows(spark, a.output, not a.inference, a.time_data, a.window, params, a.by_file,
                      learned_from=a.learned_from, past_future=a.past_future)
    elif a.step == "train":
        train(spark, a.output, params)
    else:
        evaluate_models(spark, a.output, params, a.split, a.learned_from).show()


if __name__ == "__main__":
    main()
