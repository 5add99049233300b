"""Distincts from daily bitmaps against sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_micro_log import make

from lanewise.operators import distincts
from lanewise.operators.summary import distinct_ids


@pytest.mark.parametrize("meant,held", [(8192, 32768), (3, 32768), (4, 2)])
def test_periods_by_sets(spark, monkeypatch, meant, held):
    monkeypatch.setattr(distincts, "MEANT", meant)
    monkeypatch.setattr(distincts, "HELD", held)
    rng = random.Random(meant)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 900)), "commentCard", {"board_id": rng.choice("xy"), "card_id": rng.choice([None, *map(str, range(40))]), "list_id": rng.choice([None, "A"]), "member_id": rng.choice("mn")}) for _ in range(300)]
    log = make(spark, rows)
    numbers = [tuple(r) for r in distincts.numbered(log).collect()]
    assert len({n[:2] + n[3:] for n in numbers}) == len(numbers) == len({n[:3] for n in numbers})
    bitmaps = distincts.daily(log).cache()
    week = lambda d: (d - dt.timedelta(days=d.weekday())).date()
    want = {}
    for d, _, r in rows:
        sets = want.setdefault((r["board_id"], week(d)), [set(), set(), set()])
        for s, c in zip(sets, ("card_id", "list_id", "member_id"), strict=True):
            s |= {r[c]} - {None}
    got = distincts.merged(bitmaps, F.to_date(F.date_trunc("week", "day"))).collect()
    assert {(r["board_id"], r["period"]): (r["cards"], r["lists"], r["members"]) for r in got} == {k: tuple(map(len, v)) for k, v in want.items()}
    flat = lambda df: sorted(map(tuple, df.select("board_id", "cards", "lists", "members").collect()))
    assert flat(distincts.merged(bitmaps)) == flat(distinct_ids(log, **distincts.COLUMNS))
    assert distincts.merged(distincts.daily(log.limit(0))).count() == 0
