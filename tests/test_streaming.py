"""Stream replay equals batch: file source + availableNow trigger."""

import os
import tempfile

from pyspark.sql import functions as F

from seqlens.operators.temporal import add_temporal_features, temporal_feature_names
from seqlens.sources.testdata import laps, read_table
from seqlens.streaming.features import events_window_rate, temporal_features_stream
from tests.conftest import SF001


def _drain(sdf, sink):
    q = (sdf.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", sink + "_ckpt").outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(60)


def test_stream_features_equal_batch(spark):
    base = laps(spark, SF001).where(F.col("race") == "Brand#11")
    root = tempfile.mkdtemp(prefix="seqlens-stream-")
    src = os.path.join(root, "src")
    # two files: early laps then late laps of every sequence
    base.where(F.col("race_progress") <= 0.5).write.parquet(os.path.join(src, "a"))
    base.where(F.col("race_progress") > 0.5).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(base.schema).parquet(os.path.join(src, "*"))
    out = os.path.join(root, "out")
    _drain(temporal_features_stream(stream), out)
    got = spark.read.parquet(out)
    assert got.where("late").count() == 0
    names = temporal_feature_names()
    want = add_temporal_features(base).select("driver", "race", "yr", "lap", *names)
    g = got.select("driver", "race", "yr", "lap", *[F.round(c, 6).alias(c) for c in names])
    w = want.select("driver", "race", "yr", "lap", *[F.round(c, 6).alias(c) for c in names])
    assert g.count() == w.count()
    assert g.exceptAll(w).count() == 0 and w.exceptAll(g).count() == 0


def test_late_rows_are_flagged(spark):
    base = laps(spark, SF001).where(F.col("race") == "Brand#11")
    root = tempfile.mkdtemp(prefix="seqlens-late-")
    src = os.path.join(root, "src")
    base.where(F.col("lap") != 2).write.parquet(os.path.join(src, "a"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    out = os.path.join(root, "out")
    q = (temporal_features_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start())
    assert q.awaitTermination(60)
    base.where(F.col("lap") == 2).write.parquet(os.path.join(src, "b"))
    stream2 = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q2 = (temporal_features_stream(stream2).writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start())
    assert q2.awaitTermination(60)
    got = spark.read.parquet(out)
    late = got.where("late")
    # lap 2 is late only where a later lap of the same sequence was seen first
    seq = base.groupBy("driver", "race", "yr").agg(F.max("lap").alias("m"))
    n_late = seq.where(F.col("m") >= 3).count()
    assert late.count() == n_late
    assert late.where(F.col("lap") != 2).count() == 0
    # a late row has no features; the rows on time keep theirs
    names = temporal_feature_names()
    assert late.where(" OR ".join(f"{n} IS NOT NULL" for n in names)).count() == 0
    assert got.where("NOT late").where(" OR ".join(f"{n} IS NULL" for n in names)).count() == 0


def test_state_is_typed_and_ends_with_the_watermark(spark):
    base = laps(spark, SF001).where(F.col("race") == "Brand#11")
    root = tempfile.mkdtemp(prefix="seqlens-ttl-")
    src, out = os.path.join(root, "src"), os.path.join(root, "out")
    at = lambda day: F.lit(f"2031-01-{day:02d} 00:00:00").cast("timestamp")

    def feed(part, day, name):
        part.withColumn("ts", at(day)).write.parquet(os.path.join(src, name))
        stream = spark.readStream.schema(base.withColumn("ts", at(day)).schema).parquet(os.path.join(src, "*"))
        _drain(temporal_features_stream(stream, ttl="2 days", event_time="ts"), out)
    feed(base.where("lap <= 2"), 1, "a")
    feed(base.where("lap = 3").where("driver <> 'CHINA'"), 9, "b")   # moves the watermark past the state of day 1
    feed(base.where("lap = 4"), 10, "c")
    got = spark.read.parquet(out)
    first = got.where("lap = 4").join(base.where("lap = 3").select("driver", "race", "yr"), ["driver", "race", "yr"])
    # a sequence that was silent starts anew; the others still know their last step
    silent = first.where("driver = 'CHINA'").agg(F.max("lap_history_count")).first()[0]
    assert silent in (0, None)
    assert first.where("driver <> 'CHINA'").agg(F.min("lap_history_count")).first()[0] >= 1


def test_event_window_rate_batch(spark):
    ev = read_table(spark, SF001, "events")
    r = events_window_rate(ev)
    assert r.agg(F.sum("events")).first()[0] == ev.count()


def test_event_window_rate_on_a_stream_equals_batch(spark):
    ev = read_table(spark, SF001, "events")
    root = tempfile.mkdtemp(prefix="seqlens-events-")
    ev.repartition(4).write.parquet(root + "/src")
    stream = events_window_rate(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(root + "/src"),
                                watermark="40 days")
    q = (stream.writeStream.format("memory").queryName("rates").outputMode("complete")
         .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start())
    assert q.awaitTermination(60)
    got = spark.table("rates").withColumn("mean_value", F.round("mean_value", 6))
    want = events_window_rate(ev).withColumn("mean_value", F.round("mean_value", 6))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


class _ConstModel:
    """Stand-in scorer: probability from the lap-time lag (deterministic)."""

    def predict_proba(self, df, col):
        return df.withColumn(col, F.least(F.col("lap_time_lag1") / 200.0, F.lit(1.0)))


def test_alert_stream_writes_labels(spark):
    from seqlens.streaming.features import score_stream
    base = laps(spark, SF001).where(F.col("race") == "Brand#11")
    root = tempfile.mkdtemp(prefix="seqlens-alert-")
    src = os.path.join(root, "src")
    base.write.parquet(src)
    feats = temporal_features_stream(spark.readStream.schema(base.schema).parquet(src))
    sink = os.path.join(root, "alerts")
    q = score_stream(feats, _ConstModel(), 0.5, sink, os.path.join(root, "ckpt")) \
        .trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    out = spark.read.parquet(sink)
    assert out.count() == base.count()
    assert set(out.columns) >= {"p", "prediction", "label", "confidence", "reason"}
    assert out.where((F.col("p") >= 0.5) != (F.col("prediction") == 1)).count() == 0


def test_alert_sink_is_idempotent_and_keeps_late_rows(spark):
    from seqlens.streaming.features import score_stream
    base = laps(spark, SF001).where(F.col("race") == "Brand#11")
    root = tempfile.mkdtemp(prefix="seqlens-replay-")
    src, sink = os.path.join(root, "src"), os.path.join(root, "alerts")
    feats = lambda: temporal_features_stream(spark.readStream.schema(base.schema).parquet(os.path.join(src, "*")))
    run = lambda ckpt: score_stream(feats(), _ConstModel(), 0.5, sink, os.path.join(root, ckpt)).trigger(
        availableNow=True).start().awaitTermination(60)
    base.where("lap <> 2").write.parquet(os.path.join(src, "a"))
    run("c1")
    once = spark.read.parquet(sink).count()
    run("c2")  # the same batch again, as after a lost checkpoint
    assert spark.read.parquet(sink).count() == once == base.where("lap <> 2").count()
    base.where("lap = 2").write.parquet(os.path.join(src, "b"))
    run("c1")
    out = spark.read.parquet(sink)
    assert out.count() == base.count()
    assert out.where("late").count() > 0 and out.where("late AND p IS NOT NULL").count() == 0
