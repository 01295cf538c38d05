import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seqlens.sources import files as S
from seqlens.sources import sinks as K

HEADER = ",".join(f.name for f in S.LAP_CSV_SCHEMA.fields)


def test_read_laps_declared_schema_and_nan(spark):
    d = tempfile.mkdtemp(prefix="seqlens-io-")
    p = os.path.join(d, "laps.csv")
    with open(p, "w") as fh:
        fh.write(HEADER + "\n")
        fh.write("kestrel,loop-7,2031,1,SOFT,1,1.0,5,NaN,0.0,0.0,0.1,0.05,0.0,0,0,1,0\n")
        fh.write("kestrel,loop-7,2031,2,,1,2.0,5,91.0,1.0,1.0,0.2,0.1,0.0,0,0,,0\n")
    df = S.read_laps(spark, p)
    assert "lap_time" in df.columns and dict(df.dtypes)["yr"] == "int"
    rows = df.orderBy("lap").collect()
    assert rows[0]["lap_time"] is None            # NaN -> NULL at ingest
    assert rows[1]["compound"] is None and rows[1]["next_stint"] is None


def test_read_laps_requires_target(spark):
    d = tempfile.mkdtemp(prefix="seqlens-io-")
    p = os.path.join(d, "bad.csv")
    with open(p, "w") as fh:
        fh.write("Driver,Race\nkestrel,loop-7\n")
    with pytest.raises(ValueError):
        S.read_laps(spark, p)


def test_columns_are_bound_by_name_and_bad_values_raise(spark, tmp_path):
    cols = HEADER.split(",")
    row = dict(zip(cols, "kestrel,loop-7,2031,1,SOFT,1,1.0,5,90.5,0.0,0.0,0.1,0.05,0.0,0,0,1,0".split(",")))
    back = [*reversed(cols), "Extra"]
    p = tmp_path / "shuffled.csv"
    p.write_text(",".join(back) + "\n" + ",".join([*(row[c] for c in reversed(cols)), "x"]) + "\n")
    r = S.read_laps(spark, str(p)).first()
    assert (r["driver"], r["race"], r["yr"], r["lap"], r["lap_time"], r["will_pit"]) == ("kestrel", "loop-7", 2031, 1, 90.5, 0)
    bad = tmp_path / "bad.csv"
    bad.write_text(HEADER + "\n" + ",".join({**row, "LapNumber": "x"}.values()) + "\n")
    with pytest.raises(Exception, match="(?i)malformed|CAST|cannot|parse"):
        S.read_laps(spark, str(bad)).collect()


def test_raw_file_has_no_target_and_first_existing_is_read(spark, tmp_path):
    raw = [c for c in HEADER.split(",") if c not in ("WillPitNextLap", "NextStint")]
    p = tmp_path / "raw.csv"
    p.write_text(",".join(raw) + "\nkestrel,loop-7,2031,1,SOFT,1,1.0,5,90.5,0.0,0.0,0.1,0.05,0.0,0,0\n")
    df = S.read_first_existing(spark, [str(tmp_path / "none.csv"), f"file://{p}"], required=())
    assert "will_pit" not in df.columns and df.first()["position"] == 5
    with pytest.raises(FileNotFoundError):
        S.read_first_existing(spark, [str(tmp_path / "none.csv")])


def test_report_csv_has_a_declared_schema_and_defaults_row(spark, tmp_path):
    p = tmp_path / "report.csv"
    p.write_text("model,ap\na,0.5\nb,\n")
    got = S.load_csv(spark, str(p), "model string, ap double").orderBy("model").collect()
    assert [(r.model, r.ap) for r in got] == [("a", 0.5), ("b", None)]
    defaults = spark.createDataFrame([("stint", 1.0, None), ("compound", None, "A")],
                                     "column string, numeric_default double, text_default string")
    sample = spark.createDataFrame([("B", "ignored")], "compound string, other string")
    got = {r["column"]: (r["numeric_default"], r["text_default"])
           for r in S.sample_or_defaults(defaults, sample, ["stint", "compound"]).collect()}
    assert got["stint"] == (1.0, None) and got["compound"][1] == "B"


def test_dataset_and_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.0, 2), ("k", 2.0, 1)], "model string, ap double, rank int")
    K.write_dataset(df, f"{tmp_path}/d", ["rank", "model"])
    assert spark.read.parquet(f"{tmp_path}/d").columns == ["rank", "model"]
    K.write_dataset(df, f"{tmp_path}/c", fmt="csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    K.write_report_csv(df, f"{tmp_path}/r", ["rank"])
    assert [r.model for r in spark.read.option("header", True).csv(f"{tmp_path}/r").collect()] == ["k", "m"]


def test_tolerant_json_and_csv(spark):
    d = tempfile.mkdtemp(prefix="seqlens-io-")
    assert S.load_json(spark, os.path.join(d, "missing.json")) is None
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as fh:
        fh.write("{not json")
    assert S.load_json(spark, bad) is None
    good = os.path.join(d, "good.json")
    with open(good, "w") as fh:
        json.dump({"Driver": "kestrel", "TyreLife": 30.0}, fh)
    assert S.load_json(spark, good).first()["Driver"] == "kestrel"
    assert S.load_csv(spark, os.path.join(d, "none.csv")) is None


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="seqlens-sink-")
    df = spark.createDataFrame([("a", "train", 1), ("b", "test", 0)], "g string, split string, y int")
    K.write_split(df, os.path.join(d, "split"))
    back = spark.read.parquet(os.path.join(d, "split")).where(F.col("split") == "test")
    assert back.count() == 1
    cmp_ = spark.createDataFrame([("m", float("nan"))], "model string, ap double")
    grp = spark.createDataFrame([("r", 1.0)], "race string, recall double")
    s = K.summary_frame(cmp_, grp, "m")
    K.write_rows_json(s, os.path.join(d, "summary"))
    text = "".join(r[0] for r in spark.read.text(os.path.join(d, "summary")).collect())
    assert '"best_model":"m"' in text and "NaN" not in text   # NaN written as NULL (omitted)


def test_files_with_other_headers_fail(spark, tmp_path):
    cols = HEADER.split(",")
    row = dict(zip(cols, "kestrel,loop-7,2031,1,SOFT,1,1.0,5,90.5,0.0,0.0,0.1,0.05,0.0,0,0,1,0".split(",")))
    swapped = [cols[1], cols[0], *cols[2:]]
    for k, order in enumerate((cols, swapped)):
        (tmp_path / f"{k}.csv").write_text(",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_laps(spark, str(tmp_path)).collect()
    (tmp_path / "1.csv").write_text(",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n")
    assert {(r.driver, r.race) for r in S.read_laps(spark, str(tmp_path)).collect()} == {("kestrel", "loop-7")}


def test_duplicate_rows_compares_whole_rows(spark):
    from seqlens.operators.profile import duplicate_rows
    rows = [("a", None, 1), (None, "a", 1), ("a", None, 1), ("a", None, 1), ("b", "c", None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z int")
    assert duplicate_rows(df).first()[0] == 3 and duplicate_rows(df.limit(0)).first()[0] == 0
