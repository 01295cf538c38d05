"""Session construction and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, cpus: int | None = None,
              app: str = "seqlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster ``master`` is left to spark-submit, and so are memory and the
    number of shuffle partitions.  Only for a ``local[N]`` master the
    partitions follow the cores of this machine.
    """
    b = SparkSession.builder.appName(app)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "false",
        "spark.scheduler.mode": "FAIR",
    }
    if master:
        b = b.master(master)
        if master.startswith("local"):
            conf["spark.sql.shuffle.partitions"] = str(max(8, 2 * (cpus or os.cpu_count() or 8)))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it.  Only a local master, where driver and executors are
    one process, gets a scratch folder when the setting is unset; elsewhere
    that would be a folder other machines can't see, so it is an error.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None) or now
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="seqlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if now is None or not now.rstrip("/").startswith(_as_uri(d)):
        sc.setCheckpointDir(d)
    return d


def _as_uri(d: str) -> str:
    d = d.rstrip("/")
    return d if ":" in d.split("/")[0] else f"file:{d}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans and fits that are over.

    Its cleaner does so when the driver's JVM finds them unreachable, which a
    driver with memory to spare may not look for in half an hour
    (``spark.cleaner.periodicGC.interval``).
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def storage_memory(spark: SparkSession) -> int:
    """Bytes that all executors now registered (and the driver) have for stored blocks."""
    shares = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    total = 0
    while shares.hasNext():
        total += shares.next()._1()
    return total
