"""XES files: what is written comes back, in order, and a job that fails leaves nothing."""

import datetime as dt
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lanewise.functions.labels import enrich
from lanewise.operators import flow
from lanewise.sources import board_log, xes


def as_rows(df):
    return sorted(map(str, df.select([x.split(" ")[0] for x in xes.EVENTS.split(", ")]).collect()))


def test_round_trip(spark, tmp_path, sf_dir):
    events = flow.event_log(enrich(board_log.from_events(spark, sf_dir)))
    path = str(tmp_path / "log")
    xes.write_xes(events, path)
    kinds = [F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in xes.EVENTS.split(", "))]
    assert as_rows(xes.read_xes(spark, path)) == as_rows(events.select(kinds))
    seen = set()
    for name in os.listdir(path):
        assert name.endswith(".xes")
        for trace in ElementTree.parse(f"{path}/{name}").getroot():
            key = tuple(x.get("value") for x in trace if x.tag == "string")
            assert key not in seen
            seen.add(key)
            times = [v.get("value") for e in trace if e.tag == "event" for v in e if v.get("key") == "time:timestamp"]
            assert times == sorted(times) and times
    assert len(seen) == events.select("board_id", "case_id").distinct().count()


def test_odd_values(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 2, 3, 4, 5)
    rows = [("b&<", 'c"\n', "a\t'é'", at, None, "t", None, "", "x\r\n"), (None, None, None, None, None, None, True, None, None), ("b&<", 'c"\n', "later", at + dt.timedelta(1), "m", "t", False, "<", "")]
    xes.write_xes(spark.createDataFrame(rows, xes.EVENTS), str(tmp_path / "log"))
    assert sorted(map(str, map(tuple, xes.read_xes(spark, str(tmp_path / "log")).collect()))) == sorted(map(str, rows))
    xes.write_xes(spark.createDataFrame(rows[:1], xes.EVENTS), str(tmp_path / "log"))
    assert xes.read_xes(spark, str(tmp_path / "log")).count() == 4
    xes.write_xes(spark.createDataFrame([], xes.EVENTS), str(tmp_path / "none"))
    assert xes.read_xes(spark, str(tmp_path / "none")).count() == 0


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def fails(x):
        if x == "7":
            raise ValueError("no")
        return x

    rows = spark.range(40).select(F.lit("b").alias("board_id"), F.col("id").cast("string").alias("case_id"), F.lit("a").alias("activity"), F.lit(None).cast("timestamp_ntz").alias("ts"), *[F.lit(None).cast("string").alias(c) for c in ("resource", "type", "src", "dst")], F.lit(True).alias("closed"))
    (tmp_path / "log").mkdir()
    with pytest.raises(Exception, match="no"):
        xes.write_xes(rows.repartition(4).withColumn("activity", fails("case_id")), str(tmp_path / "log"))
    assert os.listdir(tmp_path / "log") == []
    xes.write_xes(rows, str(tmp_path / "log"))
    assert xes.read_xes(spark, str(tmp_path / "log")).count() == 40
