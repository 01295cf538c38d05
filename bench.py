"""Headline timings at one scale factor; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all
cores), BENCH_QUERIES (comma list, default the headline set).  Each query is
run to completion through the no-op sink (full computation, nothing
collected to the driver); the time is the best of ``BENCH_REPEAT`` runs
after one warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqlens.plans.registry import queries  # noqa: E402
from seqlens.session import get_spark  # noqa: E402

HEADLINE = ["q_temporal_features", "q_label_rebuild", "q_rate_by_category", "q_average_precision",
            "q_roc_auc", "q_spearman_matrix", "q_target_encode", "q_target_encode_oof"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def learning(spark, sf_dir: str) -> dict:
    """Seconds of one fit (preprocessor and model, one grid point) of two specs, and rows scored in a second."""
    from seqlens.operators import models as MD
    from seqlens.operators.dataset import model_frame
    from seqlens.sources.testdata import laps
    frame = model_frame(laps(spark, sf_dir))
    train, out = frame.where("split = 'train'"), {}
    for name in ("logistic_regression", "decision_tree"):
        spec = MD.spec_named(name)
        t0 = time.perf_counter()
        fit = MD.fit_pipeline(train, spec, spec.grid[1])
        out[f"fit_{name}_sec"] = round(time.perf_counter() - t0, 3)
        scored = fit.score(frame)
        t0 = time.perf_counter()
        run(scored)
        out[f"score_{name}_rows_per_sec"] = round(frame.count() / (time.perf_counter() - t0))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = get_spark(f"local[{cpus}]", cpus, app="seqlens-bench", extra={"spark.driver.memory": "16g"})
    qs = queries()
    run(qs["q_rate_by_category"](spark, sf_dir))  # warm-up: JVM, codegen caches
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(qs[name](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    learn = learning(spark, sf_dir) if os.environ.get("BENCH_LEARNING", "1") == "1" else {}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "learning": learn, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
