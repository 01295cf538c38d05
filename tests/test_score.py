"""Scoring against a kept table of last rows, and the density by vectors."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.operators.buckets import density
from seqlens.operators.score import HistoryTail, history_features
from seqlens.operators.temporal import add_temporal_features
from seqlens.sources.testdata import laps
from seqlens.spec import LAPS

SF001 = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def batch_of(lap_rows, b):
    return lap_rows.where(F.ceil(F.col("race_progress") * 5) == b + 1)


def test_batches_scored_one_by_one_equal_the_whole_history(spark):
    all_rows = laps(spark, SF001)
    kept = HistoryTail(spark, tempfile.mkdtemp(prefix="seqlens-tail-"))
    assert kept.before() is None and kept.batches() == []
    got = []
    for b in range(5):
        new = batch_of(all_rows, b)
        got += rows(kept.features(new, b))
        kept.advance(new, b)
    assert sorted(got) == rows(add_temporal_features(all_rows))
    last = batch_of(all_rows, 4)
    earlier = all_rows.where(F.ceil(F.col("race_progress") * 5) <= 4)
    assert rows(history_features(last, earlier)) == rows(kept.features(last, 4))
    assert kept.before().groupBy(*LAPS.keys).count().agg(F.max("count")).first()[0] <= 3


def test_a_repeated_batch_changes_nothing(spark):
    all_rows = laps(spark, SF001)
    kept = HistoryTail(spark, tempfile.mkdtemp(prefix="seqlens-tail-"))
    for b in (0, 1, 1, 1):
        kept.advance(batch_of(all_rows, b), b)
    once = HistoryTail(spark, tempfile.mkdtemp(prefix="seqlens-tail-"))
    for b in (0, 1):
        once.advance(batch_of(all_rows, b), b)
    assert kept.batches() == [0, 1] and rows(kept.before()) == rows(once.before())
    kept.advance(all_rows.limit(0), 2)
    assert rows(kept.before()) == rows(once.before())
    kept.forget(1)
    assert kept.batches() == [2]
    with pytest.raises(ValueError):
        kept.forget(0)


def test_scoring_reads_the_tail_alone(spark):
    all_rows = laps(spark, SF001)
    folder = tempfile.mkdtemp(prefix="seqlens-tail-")
    kept = HistoryTail(spark, folder)
    kept.advance(batch_of(all_rows, 0), 0)
    new = spark.createDataFrame(batch_of(all_rows, 1).limit(5).collect(), all_rows.schema)
    assert {f.split("/batch=")[0].removeprefix("file://") for f in kept.features(new).inputFiles()} == {folder}


def test_density_against_numpy(spark):
    x = np.array([1.0, 1, 2, 5, 5, 5, 9])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = {r.point: (r.x, r.density) for r in density(df, "x", 7).collect()}
    h = x.std(ddof=1) * len(x) ** -.2
    for i, g in enumerate(np.linspace(1, 9, 7)):
        want = np.exp(-.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert got[i] == (pytest.approx(g), pytest.approx(want, abs=1e-12))
    assert "Generate" not in density(df, "x", 7)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values", [[], [None], [3.0], [3.0, 3.0]])
def test_density_without_spread_is_null(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert {r.density for r in density(df, "x", 4).collect()} == {None}
