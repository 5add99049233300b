"""Redesigns on a stream against the batch operator, with rows that come late and a restart in between."""

import datetime as dt
import random

import pytest
from test_micro_log import COLUMNS, lst, make

from lanewise.functions.labels import enrich
from lanewise.operators import redesign
from lanewise.sources.board_log import LOG
from lanewise.streaming import redesigns


@pytest.mark.parametrize("classes", [None, ["list_create"]])
def test_closed_runs_equal_the_batch(spark, tmp_path, classes):
    rng = random.Random(6)
    zero = dt.datetime(2024, 1, 1)
    events = []
    for board in ("x", "y"):
        minutes = sorted(rng.randint(0, 60 * 24 * 20) for _ in range(240))
        events += [(zero + dt.timedelta(minutes=m), rng.choice(["createList", "updateList"] if rng.random() < 0.15 else ["commentCard"]), board) for m in minutes]
    # one last event far on moves the watermark over everything else; it is flagged nowhere
    events += [(zero + dt.timedelta(days=40), "commentCard", b) for b in ("x", "y")] + [(zero + dt.timedelta(days=60), "commentCard", "z")]
    log = make(spark, [(d, k, {"board_id": b} | (lst("A") if "List" in k else {})) for d, k, b in events])
    # arrival: up to a day late
    rows = sorted(log.collect(), key=lambda r: r["date"] + dt.timedelta(hours=rng.uniform(0, 23)))
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def go():
        found = redesigns.detect_redesign(enrich(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)), 3600, classes)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(found.schema).parquet(out)

    parts = [rows[k : k + 130] for k in range(0, len(rows), 130)]
    assert any(max(r["date"] for r in a) > min(r["date"] for r in b) for a, b in zip(parts, parts[1:]))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        if k == 1:
            go()  # stopped here, and started again below
    got = sorted(tuple(r) for r in go().collect())
    batch = redesign.detect_redesign(enrich(log.select(COLUMNS)), 3600, classes).filter("run > 0 AND board_id <> 'z'").collect()
    total = {b: max(r["run"] for r in batch if r["board_id"] == b) for b in ("x", "y")}
    want = sorted((r["board_id"], total[r["board_id"]] - r["run"] + 1, r["min_ts"], r["max_ts"], r["n_events"], r["n_list_events"]) for r in batch)
    assert got == want and len(got) > 10


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], LOG).write.parquet(str(tmp_path / "in"))
    found = redesigns.detect_redesign(enrich(spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))))
    q = found.writeStream.format("memory").queryName("no_runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("no_runs").count() == 0
