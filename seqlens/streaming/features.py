"""Streaming sequence features and event-time window rates.

``temporal_features_stream`` keeps, per sequence key, the last three rows in
typed keyed state (``applyInPandasWithState``) and emits the features of the
batch operator for every new row.  A row whose step isn't after the last step
seen for its key comes too late: the state holds only later rows, so it is
emitted with ``late = true`` and NULL features, and leaves the state alone.
State that no row has touched for ``ttl`` is dropped; with an event-time column
the watermark decides.  State is spread over the cluster by the key hash and
checkpointed with the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqlens.operators.temporal import temporal_feature_names
from seqlens.spec import LAPS, SequenceSpec

KEEP = 3
_NUMBERS = ["value", "delta", "degradation", "position", "position_change"]
_STATE = ("step array<int>, " + ", ".join(f"{c} array<double>" for c in _NUMBERS) + ", category array<string>, seen long")


def _features(rows: pd.DataFrame, seen: np.ndarray) -> list:
    """Feature columns of ``rows`` (one sequence, in step order), in the batch operator's order."""
    def lags(c):
        x = rows[c].astype("float64")
        return np.stack([x.shift(k).to_numpy() for k in (1, 2, 3)])

    def mean(x):
        n = (~np.isnan(x)).sum(0)
        return np.where(n > 0, np.nansum(x, 0) / np.maximum(n, 1), np.nan)

    def std(x):
        n = (~np.isnan(x)).sum(0)
        d = np.nansum((x - mean(x)) ** 2, 0)
        return np.where(n > 1, np.sqrt(d / np.maximum(n - 1, 1)), np.nan)

    v, d, g, p, pc = (lags(c) for c in _NUMBERS)
    before = rows["category"].shift(1)
    changed = before.notna() & (rows["category"].fillna("nan") != before)
    out = [*v, *d, mean(v), std(v), mean(d), std(d), mean(g), p[0], mean(p), pc[0],
           rows["value"].astype("float64").to_numpy() - mean(v)]
    return [np.nan_to_num(x, nan=0.0) for x in out] + [changed.astype(int).to_numpy(), np.minimum(seen, KEEP)]


def temporal_features_stream(sdf: DataFrame, spec: SequenceSpec = LAPS, ttl: str | None = None,
                             event_time: str | None = None) -> DataFrame:
    """Streaming twin of :func:`seqlens.operators.temporal.add_temporal_features`.

    With ``event_time``, a timestamp column, rows older than the watermark of
    ``ttl`` are dropped by Spark and a key's state ends ``ttl`` after its
    newest row.  With ``ttl`` alone it ends that long after it was last
    processed (for triggers that go on: under ``availableNow`` Spark would wait
    for these timeouts).  Without either, state stays.
    """
    names = temporal_feature_names(spec)
    out_schema = T.StructType([sdf.schema[k] for k in spec.keys] + [T.StructField(spec.step, T.IntegerType()),
                                                                    T.StructField("late", T.BooleanType())]
                              + [T.StructField(n, T.IntegerType() if n.endswith("_changed_last_lap")
                                               or n == "lap_history_count" else T.DoubleType()) for n in names])
    if event_time and not ttl:
        raise ValueError("event_time needs a ttl")
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0
    cols = [*spec.keys, F.col(spec.step).cast("int").alias("step"),
            *[F.col(getattr(spec, c)).cast("double").alias(c) for c in _NUMBERS],
            F.col(spec.category).cast("string").alias("category")]
    if event_time:
        sdf = sdf.withWatermark(event_time, ttl)
        cols.append(F.col(event_time).alias("_ts"))
    src = sdf.select(*cols)
    fields = ["step", *_NUMBERS, "category"]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else tuple([] for _ in fields) + (0,)
        hist, seen = pd.DataFrame(dict(zip(fields, map(list, held[:-1])))), int(held[-1])
        parts = [p for p in pdfs if len(p)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values("step", kind="mergesort").reset_index(drop=True)
        last = hist["step"].iloc[-1] if len(hist) else None
        late = batch["step"].duplicated()
        if last is not None:
            late |= batch["step"] <= last
        fresh = batch[~late]
        rows = pd.concat([hist, fresh[fields]], ignore_index=True) if len(hist) else fresh[fields].reset_index(drop=True)
        feats = [x[len(hist):] for x in _features(rows, seen - len(hist) + np.arange(len(rows)))]
        done = pd.DataFrame(dict(zip(names, feats)))
        done.insert(0, spec.step, fresh["step"].to_numpy())
        done.insert(1, "late", False)
        old = pd.DataFrame({spec.step: batch["step"][late], "late": True})
        out = pd.concat([done, old], ignore_index=True) if len(old) else done
        for n in names[-2:]:
            out[n] = out[n].astype("Int32")
        for i, k in enumerate(spec.keys):
            out.insert(i, k, key[i])
        if len(fresh):
            tail = rows.tail(KEEP)
            none = lambda c: [None if pd.isna(x) else x for x in tail[c]]
            state.update(([int(x) for x in tail["step"]], *[none(c) for c in _NUMBERS], none("category"), seen + len(fresh)))
        if event_time:
            newest = int(batch["_ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_ms)
        elif ttl:
            state.setTimeoutDuration(ttl_ms)
        yield out

    timeout = (GroupStateTimeout.EventTimeTimeout if event_time else
               GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)
    return src.groupBy(*spec.keys).applyInPandasWithState(fn, out_schema, _STATE, "append", timeout)


def events_window_rate(events: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Per (tumbling window, event type): events, mean value, purchases.

    Works on a stream (the watermark bounds the state) and on a batch frame alike.
    """
    kind = events.schema["ts"].dataType
    src = events
    if events.isStreaming:  # a watermark needs a timestamp with time zone
        src = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = src.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).cast("long").alias("events"), F.avg("value").alias("mean_value"),
        F.sum((F.col("event_type") == "purchase").cast("long")).alias("purchases"))
    return g.select(F.col("w.start").cast(kind).alias("window_start"), "event_type", "events", "mean_value", "purchases")


def score_stream(features: DataFrame, model, threshold: float, sink_path: str, checkpoint: str,
                 prob_col: str = "p"):
    """Alerts: streamed features -> model probability -> decision labels, per micro-batch to parquet.

    Each micro-batch is written to a partition of its own, ``batch_id=N``, in
    overwrite mode: a batch that runs again after a failure replaces its rows.
    Late rows have no features; they are kept with their flag, unscored.
    """
    from seqlens.operators.score import label_scores

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = label_scores(model.predict_proba(batch.where(~F.col("late")), prob_col), threshold, prob_col)
        late = batch.where("late").select(*[F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c)
                                            for c, t in scored.dtypes])
        scored.unionByName(late).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
