"""Our operators against the numbers FIXTURES.md lists for the sf0.01 tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from seqtok.config import Params
from seqtok.functions.buckets import bucket_unit
from seqtok.operators.evaluate import precision_recall_curve
from seqtok.operators.tokens import collect_bounds


def _read(spark, name):
    return spark.read.parquet(f"{SF01}/{name}.parquet")


@pytest.mark.parametrize("table,col,mn,mx,sd,n", [
    ("events", "value", 0.01, 490.02, 49.10235, 9),
    ("lineitem", "l_quantity", 1, 50, 14.43212, 3),
    ("lineitem", "l_discount", 0, 0.1, 0.02905, 3),
    ("lineitem", "l_tax", 0, 0.08, 0.02348, 3),
    ("orders", "o_totalprice", 1013.7, 499978.59, 143990.00419, 3),
    ("customer", "c_acctbal", -994.28, 9997.41, 3207.64492, 3),
    ("part", "p_size", 1, 50, 14.48249, 3),
])
def test_bounds_at_sf001(spark, table, col, mn, mx, sd, n):
    b = collect_bounds(_read(spark, table), [col])[col]
    assert b.minimum == pytest.approx(mn) and b.maximum == pytest.approx(mx)
    assert b.stddev == pytest.approx(sd, abs=1e-5) and b.n_buckets == n


def test_unit_bucket_histogram_at_sf001(spark):
    ev = _read(spark, "events")
    n = collect_bounds(ev, ["value"])["value"].n_buckets
    hist = dict(ev.groupBy(bucket_unit(F.col("value"), n).alias("b")).count().collect())
    assert hist == {1: 178, 2: 210, 3: 184, 4: 201, 5: 195, 6: 180, 7: 164, 8: 181, 9: 8507}


def test_sweep_counts_at_sf001(spark):
    ev = _read(spark, "events").select(
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label"))
    rows = {round(r.threshold, 10): r for r in precision_recall_curve(ev, params=Params()).collect()}
    # (tp, predicted positives) per threshold
    for t, tp, pp in [(0.0, 2014, 10000), (0.5, 732, 3665), (0.9, 338, 1612), (1.0, 0, 0)]:
        r = rows[t]
        assert (r.tp, r.tp + r.fp) == (tp, pp)
