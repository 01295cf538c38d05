import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("seqlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="seqlens-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir"))
    yield s
    s.stop()


# (entity, step, category, value, delta, position, position change, degradation); a null value, a null
# category and a tie in the value
STEPS = [
    ("kestrel", 1, "A", 70.5, 0.0, 9, 0.0, 0.0), ("kestrel", 2, "A", 71.25, 0.75, 9, 0.0, 0.75),
    ("kestrel", 3, "B", None, None, 8, -1.0, 0.75), ("kestrel", 4, "B", 74.0, 2.75, 10, 2.0, 3.5),
    ("kestrel", 5, None, 73.0, -1.0, 7, -3.0, 2.5),
    ("plover", 1, "C", 64.0, 0.0, 3, 0.0, 0.0), ("plover", 2, "A", 66.0, 2.0, 3, 0.0, 2.0),
    ("plover", 3, "A", 66.0, 0.0, 4, 1.0, 2.0),
]


@pytest.fixture(scope="session")
def synthetic(spark):
    """Two entities with five and three steps in one group."""
    rows = [(e, "loop-7", 2031, n, c, 1 + (n > 2), float(n), p, v, d, g, n / 8, n / 16, pc, int(n == 3))
            for e, n, c, v, d, p, pc, g in STEPS]
    schema = ("driver string, race string, yr int, lap int, compound string, stint int, tyre_life double, "
              "position int, lap_time double, lap_time_delta double, cumulative_degradation double, "
              "race_progress double, normalized_tyre_life double, position_change double, will_pit int")
    return spark.createDataFrame(rows, schema)
