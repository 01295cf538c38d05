"""Scoring-with-history and event-window queries."""

import uuid

from pyspark.sql import functions as F

from seqlens.functions.expr import fill_unknown
from seqlens.functions.util import r6
from seqlens.operators.score import HistoryTail, history_features
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.q_label import TEMPORAL_SQL, temporal_select
from seqlens.plans.registry import register
from seqlens.session import ensure_checkpoint_dir
from seqlens.sources.testdata import laps, read_table
from seqlens.streaming.features import events_window_rate


@register("q_history_join_features", with_laps(", tf AS (" + TEMPORAL_SQL + """)
SELECT tf.* FROM tf JOIN laps USING (driver, race, yr, lap) WHERE laps.race_progress > 0.9"""))
def q_history_join_features(spark, sf):
    """Features of the latest laps from the last three history laps only (equals full-table features)."""
    l = laps(spark, sf)
    new, hist = l.where(F.col("race_progress") > 0.9), l.where(F.col("race_progress") <= 0.9)
    return temporal_select(history_features(new, hist))


BATCH_ENDS = (0.3, 0.6, 0.9)  # progress up to which the three batches of history reach


@register("q_history_tail_features", with_laps(", tf AS (" + TEMPORAL_SQL + """)
SELECT tf.* FROM tf JOIN laps USING (driver, race, yr, lap) WHERE laps.race_progress > 0.9"""))
def q_history_tail_features(spark, sf):
    """Features of the latest laps from a kept table of last laps, into which the history went in three batches."""
    l = laps(spark, sf)
    kept = HistoryTail(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tail-{uuid.uuid4().hex}")
    done = F.lit(-1.0)
    for batch, end in enumerate(BATCH_ENDS):
        p = F.col("race_progress")
        kept.advance(l.where((p > done) & (p <= end)), batch)
        done = F.lit(end)
    kept.forget(1)
    return temporal_select(kept.features(l.where(F.col("race_progress") > BATCH_ENDS[-1])))


@register("q_events_tumbling_rate", """
SELECT date_trunc('day', ts) AS window_start, event_type, cast(count(*) AS BIGINT) AS events,
       round(avg(value), 6) AS mean_value, cast(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases
FROM events GROUP BY ALL""")
def q_events_tumbling_rate(spark, sf):
    """Batch twin of the streaming tumbling-window rate on ``events``."""
    r = events_window_rate(read_table(spark, sf, "events"))
    return r.select("window_start", "event_type", "events", r6("mean_value").alias("mean_value"), "purchases")
