"""Actions with keys as they occur."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from lanewise.sources import board_log, variant_log


def odd_actions(rng, board, n):
    """Actions whose keys come and go: nested, quoted, in arrays, null, empty."""
    out = []
    for k in range(n):
        a = {"id": f"{board}{k}", "type": "createList", "date": f"2024-01-{k % 28 + 1:02d}T00:00:00Z", "data": {"board": {"id": board}, "list": {"id": f"L{k}"}}}
        for key, v in {"limits": {"a b": {"x": 1.5}}, "tags": [{"q": 1}, 2], "none": None, "empty": {}, "memberCreator": {"id": "m", "name": "n"}, "we`ird": {"a.b": True}, "big": 10**20, "due": "x,y: <z>"}.items():
            if rng.random() < 0.3:
                a[key] = v
            if rng.random() < 0.1:
                a["data"][key] = {"deep": {key: v}}
        out.append(a)
    return out


def test_attributes_equal_flat_tables(spark, tmp_path):
    rng = random.Random(2)
    boards = {b: odd_actions(rng, b, 40) for b in ("b1", "b2")} | {"b3": [{"id": "only"}]}
    for b, actions in boards.items():
        (tmp_path / f"{b}.json").write_text(json.dumps({"actions": actions + actions[-3:]}, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "other.json").write_text('{"actions": 3}')
    (tmp_path / "none.json").write_text("")
    got = variant_log.read_documents(spark, str(tmp_path)).cache()
    counts = {(r["board_id"], r["path"]): r["n"] for r in variant_log.attribute_counts(got).collect()}
    want = {}
    for b, actions in boards.items():
        for a in actions:
            for column in pd.json_normalize([a]).columns:
                if "memberCreator" not in column:
                    want[b, column] = want.get((b, column), 0) + 1
    assert counts == want
    assert {r["board_id"]: r["attributes"] for r in variant_log.attributes(got).collect()} == {b: sum(k[0] == b for k in want) for b in boards}
    # the flat log is the one that a schema gives
    (tmp_path / "bad.json").unlink()
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(variant_log.flat(got)) == flat(board_log.read_json(spark, str(tmp_path)).filter("id IS NOT NULL"))


def test_unknown_keys_come_back(spark, tmp_path):
    actions = odd_actions(random.Random(3), "b1", 30)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b1.json").write_text(json.dumps({"actions": actions}))
    got = variant_log.read_documents(spark, str(tmp_path / "in"))
    as_json = lambda df: sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in df.select(F.to_json("action")).collect())
    want = sorted(json.dumps(a, sort_keys=True) for a in actions)
    assert as_json(got) == want
    got.write.parquet(str(tmp_path / "pq"))
    assert as_json(spark.read.parquet(str(tmp_path / "pq"))) == want
    variant_log.write_actions(got, str(tmp_path / "lines"))
    again = variant_log.read_lines(spark, str(tmp_path / "lines"))
    assert as_json(again) == want and again.filter("board_id = 'b1'").count() == 30
    assert got.filter(F.try_variant_get("action", "$.limits['a b'].x", "double") == 1.5).count() == sum("limits" in a for a in actions) > 0


def test_leaves():
    assert variant_log.leaves("OBJECT<`a.b`: OBJECT<c: BIGINT>, d: ARRAY<OBJECT<q: BIGINT>>, e: OBJECT<>, f: DECIMAL(3,1), `g``: h`: VOID>") == ["a.b.c", "d", "f", "g`: h"]
    assert variant_log.leaves("OBJECT<>") == []
