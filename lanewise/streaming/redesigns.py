"""Redesigns on a stream: each board keeps the rows that the watermark has not passed, and its open run.

Rows may come late by the watermark's delay; they are put in order before they count. A run ends
where a row that is not flagged follows it, so it is given out then, once and for good.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanewise.operators.redesign import HOUR

RUNS = "nth long, min long, max long, n_events long, n_list_events long"
#: Rows to come (micros, pos, 1 for a list event plus 2 for one that starts a segment), start of the segment, the open run, list events since the last run, runs so far.
STATE = "at array<long>, pos array<long>, kinds array<int>, segment long, open boolean, min long, max long, n_events long, n_list long, since long, nth long"


def advance(rows: list[tuple[int, int, int]], state: dict, within: int) -> list[tuple]:
    """Take rows in order; the runs that end, as (nth, min, max, n_events, n_list_events)."""
    ended = []
    for at, _, kind in rows:
        listed, starts = kind & 1, kind >> 1
        if starts or state["segment"] is None:
            state["segment"] = at
        if starts or at - state["segment"] < within:
            if not state["open"]:
                state |= {"open": True, "min": at, "n_events": 0, "n_list": state["since"], "since": 0, "nth": state["nth"] + 1}
            state["max"] = at
            state["n_events"] += 1
            state["n_list"] += listed
        else:
            if state["open"]:
                ended.append((state["nth"], state["min"], state["max"], state["n_events"], state["n_list"]))
                state["open"] = False
            state["since"] += listed
    return ended


def detect_redesign(enriched: DataFrame, within_s: float = 3 * HOUR, list_class: str | list[str] | None = None, delay: str = "1 day") -> DataFrame:
    """Runs of the batch operator's duration mode on a stream of labelled actions: board_id, nth (1 is the oldest),
    min_ts, max_ts, n_events, n_list_events.

    Rows that come later than ``delay`` after the newest one seen are left out. A run is given out when the
    watermark passes the first row that ends it; a board's newest run stays open until then.
    """
    within = int(within_s * 1e6)
    classes = [list_class] if isinstance(list_class, str) else list_class
    starts = F.col("l").isNotNull() if classes is None else F.coalesce(F.col("l").isin(list(classes)), F.lit(False))
    kind = F.col("l").isNotNull().cast("int") + F.when(starts, 2).otherwise(0)
    key = dict(enriched.dtypes)["board_id"]
    names = [x.split(" ")[0] for x in STATE.split(", ")]

    def run(board: tuple, frames: Iterator, group: GroupState) -> Iterator:
        import pandas as pd

        state = dict(zip(names, group.get, strict=True)) if group.exists else dict.fromkeys(names) | {"at": [], "pos": [], "kinds": [], "open": False, "since": 0, "nth": 0}
        held = list(zip(state["at"], state["pos"], state["kinds"], strict=True))
        for frame in frames:
            held += zip(frame["at"].tolist(), frame["pos"].tolist(), frame["kind"].tolist(), strict=True)
        held.sort()
        passed = group.getCurrentWatermarkMs() * 1000
        n = next((k for k, r in enumerate(held) if r[0] > passed), len(held))
        ended = advance(held[:n], state, within)
        held = held[n:]
        for k, c in enumerate(("at", "pos", "kinds")):
            state[c] = [r[k] for r in held]
        group.update(tuple(state[c] for c in names))
        if held:
            group.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, group.getCurrentWatermarkMs() + 1))
        if ended:
            out = pd.DataFrame(ended, columns=[x.split(" ")[0] for x in RUNS.split(", ")])
            out.insert(0, "board_id", board[0])
            yield out

    at = F.unix_micros("date").alias("at")
    rows = enriched.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", delay).select("board_id", "date", at, F.col("pos").cast("long").alias("pos"), kind.alias("kind"))
    found = rows.groupBy("board_id").applyInPandasWithState(run, f"board_id {key}, {RUNS}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("board_id", "nth", F.timestamp_micros("min").alias("min_ts"), F.timestamp_micros("max").alias("max_ts"), "n_events", "n_list_events")
