"""Operators on a board small enough to work out by hand."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lanewise.functions.labels import enrich
from lanewise.operators import discovery, evolution, flow, graph, metrics, redesign, summary
from lanewise.sources import board_log

DAY = 86400.0
COLUMNS = [c.split(" ")[0] for c in board_log.LOG.split(", ")]


def t(text):
    return dt.datetime.fromisoformat(f"2024-{text}")


def make(spark, rows):
    """Rows of (date, type, other columns), oldest first."""
    full = []
    for k, (date, kind, more) in enumerate(rows):
        row = dict.fromkeys(COLUMNS) | {"pos": k, "board_id": "x", "id": f"e{k}", "type": kind, "date": t(date) if isinstance(date, str) else date} | more
        full.append(tuple(row[c] for c in COLUMNS))
    return spark.createDataFrame(full, board_log.LOG)


def lst(i, name=None):
    return {"list_id": i, "list_name": name or i}


def move(a, b, name=None):
    return {"list_before_id": a, "list_before_name": name or a, "list_after_id": b, "list_after_name": b}


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("01-01 00:00", "createBoard", {}),
        ("01-01 01:00", "createList", lst("A")),
        ("01-01 02:00", "createList", lst("B")),
        ("01-01 03:00", "createCard", {"card_id": "c1", **lst("A")}),
        ("01-05 00:00", "createCard", {"card_id": "c2", **lst("A")}),
        ("01-06 00:00", "updateCard", {"card_id": "c1", **move("A", "B")}),
        ("01-10 00:00", "updateList", {"old_name": "A", **lst("A", "A2")}),
        ("01-10 12:00", "updateCard", {"card_id": "c2", **move("A", "B", "A2")}),
        ("01-12 00:00", "updateCard", {"card_id": "c1", "card_closed": True, **lst("B")}),
    ]
    return enrich(make(spark, rows)).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_labels(log):
    assert [r["l"] for r in log.orderBy("pos").collect()] == [None, "list_create", "list_create", None, None, None, "list_rename", None, None]
    assert [r["c"] for r in log.orderBy("pos").collect()][3:] == ["card_create", "card_create", "card_move", None, "card_move", "card_close"]


def test_redesigns(log):
    found = redesign.detect_redesign(log, DAY)
    assert rows(found, "run", "min_ts", "max_ts", "n_events", "n_list_events") == [(1, t("01-10 00:00"), t("01-10 12:00"), 2, 1), (2, t("01-01 00:00"), t("01-01 03:00"), 4, 2)]
    intervals = redesign.stable_intervals(log, found)
    assert rows(intervals, "run", "first_ts", "last_ts") == [(1, t("01-10 12:00"), t("01-12 00:00")), (2, t("01-01 03:00"), t("01-10 00:00"))]
    assert rows(redesign.redesign_distance(log, found), "run", "seconds") == [(1, 8 * DAY + 21 * 3600), (2, 0.0)]
    assert metrics.redesign_metrics(log, found).first()["distance_mean_days"] == 4.4375
    second = metrics.static_metrics_by_interval(log, intervals).filter("run = 2").first()
    assert (second["events"], second["cards"], second["lists"], second["list_num_components"]) == (4, 2, 1, 1)


def test_redesign_modes(log):
    assert rows(redesign.detect_redesign(log, fewer_than=2), "run", "min_ts", "n_events", "n_list_events") == [(1, t("01-10 00:00"), 1, 1), (2, t("01-01 00:00"), 3, 2)]
    assert rows(redesign.detect_redesign(log, fewer_than=4), "run", "n_events") == [(1, 3), (2, 3)]
    assert rows(redesign.detect_redesign(log, DAY, more_than=1), "run") == [(2,)]
    assert rows(redesign.detect_redesign(log, DAY, "list_rename"), "run", "n_events", "n_list_events") == [(1, 2, 1), (2, 4, 2)]
    # classes other than the given one count in the span of a run, and before the newest run they make a row of their own
    found = redesign.detect_redesign(log, 3600, ["list_create"])
    assert sorted((r["run"], str(r["min_ts"]), r["n_events"], r["n_list_events"]) for r in found.collect()) == [(0, "None", 0, 1), (1, "2024-01-01 00:00:00", 3, 2)]
    assert rows(redesign.stable_intervals(log, found), "run", "last_ts") == [(1, t("01-12 00:00"))]
    assert rows(redesign.detect_redesign(log, 3600, "list_create", more_than=0), "run") == [(0,), (1,)]


def test_lists(log):
    found = evolution.list_evolution(log)
    assert rows(found, "list_id", "begin_date", "last_date", "last_name", "names") == [("A", t("01-01 01:00"), t("01-12 00:00"), "A2", ["A2", "A"]), ("B", t("01-01 02:00"), t("01-12 00:00"), "B", ["B"])]
    assert rows(flow.transitions(log), "src", "dst", "n") == [("A", "B", 1), ("A2", "B", 1)]
    assert rows(flow.transitions(log, "id"), "src", "dst", "n") == [("A2", "B", 2)]
    assert rows(graph.connected_lists(log), "members", "size", "n_moves_in") == [(["A", "B"], 2, 2)]
    assert rows(flow.card_action_list(log), "list_name", "share") == [("A2", 1.0)]


def test_metrics(log):
    assert rows(metrics.move_metrics(log), "move_per_list_with_move", "list_with_move_perc", "cards_moving_perc", "moves_per_moving_card") == [(2.0, 1.0, 1.0, 1.0)]
    assert rows(metrics.act_metrics(log), "act_per_list", "cards_act_perc", "act_per_act_card") == [(None, 0.0, None)]
    assert rows(metrics.close_metrics(log), "cards_closed_perc") == [(0.5,)]


def test_report(log):
    text = discovery.report(discovery.board_discovery(log), "x")
    assert "- A2 -> B" in text and "- None" in text and "- and more" not in text
    assert "- and more" in discovery.report(discovery.board_discovery(log), "x", 1)


def test_other_keys_and_filters(log):
    assert rows(discovery.board_discovery(log, "comb").lists, "list") == [("A2[]",), ("A[]",), ("B[]",)]
    assert rows(evolution.daily_card_activity(log, before="2024-01-05"), "day", "n") == [(dt.date(2024, 1, 1), 1)]
    assert rows(evolution.daily_card_activity(log, after="2024-01-01", before="2024-01-06"), "day", "c", "n") == [(dt.date(2024, 1, 5), "card_create", 1)]
    assert rows(evolution.list_timeline(evolution.list_evolution(log)), "list_id", "place") == [("A", 0), ("B", 1)]
    assert summary.board_summary(log).first()["attributes"] == 12
    assert rows(summary.board_selection(log, 5, 7), "events") == [(9,)] and summary.board_selection(log, 5, 7, "createCard").count() == 0
    found = redesign.detect_redesign(log, DAY)
    intervals = redesign.stable_intervals(log, found)
    assert rows(metrics.static_metrics_by_interval(log, intervals, longer_s=3 * DAY), "run", "first_ts", "events") == [(2, t("01-01 03:00"), 4)]
    assert rows(metrics.static_metrics_by_interval(log, intervals, min_events=3), "run") == [(2,)]


@pytest.mark.parametrize("held", [2, 5, 1 << 20])
def test_components_of_any_size(spark, held):
    """Groups of more nodes than a task holds are joined in rounds."""
    import random

    rng = random.Random(held)
    edges = [(g, f"n{a}", f"n{b}") for g in ("x", "y") for a, b in [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]] + [("x", f"p{k}", f"p{k + 1}") for k in range(30)] + [("z", "a", "a")]
    label = {(g, n): n for g, a, b in edges for n in (a, b)}
    for _ in label:
        for g, a, b in edges:
            label[g, a] = label[g, b] = min(label[g, a], label[g, b])
    got = graph.labels(spark.createDataFrame(edges, "g string, a string, b string"), ["g"], held)
    assert rows(got, "g", "node", "label") == sorted((g, n, l) for (g, n), l in label.items())


def test_odd_rows(spark):
    """Reopened list, a close that is a move, lists of one name, colliding suffixes, no cards, ties in time."""
    long = "0" * 18
    df = enrich(make(spark, [
        ("01-01 00:00", "updateList", {"list_closed": False, **lst("1" + long[:17] + "abcdef", "N")}),
        ("01-01 00:00", "moveListToBoard", lst("2" + long[:17] + "abcdef", "N")),
        ("01-01 00:00", "updateCard", {"card_closed": True, **move("p", "q")}),
        ("01-01 00:00", "copyCard", {}),
    ]))
    got = df.orderBy("pos").collect()
    assert [r["l"] for r in got] == ["list_change", "list_import", None, None]
    assert [r["c"] for r in got] == [None, None, "card_close", "card_create"]
    assert summary.comb_collision(df).first()["collision"]
    assert summary.board_summary(df).first()["first_type"] == "copyCard"
    assert metrics.move_metrics(df).first()["moves_per_moving_card"] is None
    assert {r["bin"] for r in evolution.board_evolution(df, 5).filter("events > 0").collect()} == {1}


def test_empty(spark):
    df = enrich(make(spark, []))
    found = redesign.detect_redesign(df)
    for out in (summary.board_summary(df), found, evolution.list_evolution(df), graph.connected_lists(df), metrics.static_metrics(df), evolution.board_evolution(df), redesign.lifetime_deciles(df, found)):
        assert out.count() == 0


def runs_of(events, classes, within=None, fewer=None):
    """Row by row: events are (minute, class or None), oldest first; the runs, newest first, and what lies before the newest."""
    segments, at = [], []
    for time, kind in events:
        if (kind is not None and (classes is None or kind in classes)) or not segments:
            segments.append([])
        segments[-1].append(time)
        at.append(len(segments) - 1)
    flags = []
    for (time, kind), k in zip(events, at, strict=True):
        opens = kind is not None and (classes is None or kind in classes)
        flags.append(opens or (time - segments[k][0] < within if within is not None else len(segments[k]) < fewer))
    out, run, before = {0: [[], 0]}, 0, False
    for (time, kind), flag in reversed(list(zip(events, flags, strict=True))):
        if flag and not before:
            run += 1
            out[run] = [[], 0]
        if flag:
            out[run][0].append(time)
        out[run][1] += kind is not None
        before = flag
    return [(k, min(x, default=None), max(x, default=None), len(x), n) for k, (x, n) in out.items() if x or n]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4000), st.sampled_from([None, None, "createList", "moveListToBoard"])), min_size=1, max_size=30), st.sampled_from([(None, 60, None), (["list_create"], 300, None), (None, None, 3), (["list_import"], None, 4)]))
def test_redesigns_row_by_row(spark, events, mode):
    classes, within, fewer = mode
    names = {"createList": "list_create", "moveListToBoard": "list_import"}
    events = sorted(events, key=lambda x: x[0])
    zero = t("01-01 00:00")
    df = enrich(make(spark, [(zero + dt.timedelta(minutes=m), y or "createCard", lst("A") if y else {}) for m, y in events]))
    got = redesign.detect_redesign(df, None if within is None else within * 60, classes, fewer).orderBy("run").collect()
    minutes = lambda x: x and (x - zero).total_seconds() / 60
    assert [(r["run"], minutes(r["min_ts"]), minutes(r["max_ts"]), r["n_events"], r["n_list_events"]) for r in got] == runs_of([(m, names.get(y)) for m, y in events], classes, within, fewer)


def test_sources(spark, tmp_path, log):
    action = {"id": "a1", "type": "createList", "date": "2024-01-02T00:00:00Z", "idMemberCreator": "m", "data": {"board": {"id": "b1", "name": "B"}, "list": {"id": "L", "name": "x"}}}
    older = action | {"id": "a0", "date": "2024-01-01T00:00:00Z"}
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "b1.json").write_text(json.dumps({"actions": [action, older, older]}))
    (tmp_path / "json" / "bad.json").write_text("{")
    got = board_log.read_json(spark, str(tmp_path / "json"))
    assert rows(got, "board_id", "id", "list_id") == [("b1", "a0", "L"), ("b1", "a1", "L")]
    board_log.write_parquet(log.select(COLUMNS), str(tmp_path / "pq"))
    assert board_log.read_parquet(spark, str(tmp_path / "pq")).count() == 9
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "my board.csv").write_text(",id,type,date,data.card.closed\n0,a1,createCard,2024-01-02 00:00:00,True\n1,a0,createCard,2024-01-01 00:00:00,\n")
    got = board_log.read_csv(spark, str(tmp_path / "csv"))
    assert rows(got, "board_id", "pos", "id", "card_closed")[0][:3] == ("my board", -1, "a0") and got.filter("card_closed").count() == 1
    (tmp_path / "ids.txt").write_text("b1\n\nb2\nb1\n")
    assert rows(board_log.read_board_ids(spark, str(tmp_path / "ids.txt")), "board_id") == [("b1",), ("b2",)]
    board_log.write_csv(flow.transitions(log), str(tmp_path / "out"))
    board_log.write_json(log.select(COLUMNS), str(tmp_path / "js"))
    again = board_log.read_json_lines(spark, str(tmp_path / "js"))
    assert sorted(map(str, again.select(COLUMNS).collect())) == sorted(map(str, log.select(COLUMNS).collect()))


def test_csv_files_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',id,type,date,data.list.id,data.list.name\n0,a1,createList,2024-01-02 00:00:00,L1,"Say ""hi"", now\nor later"\n1,a0,createBoard,2024-01-01 00:00:00,,\n')
    (tmp_path / "b+c d.csv").write_text(",date,id,type,data.card.id,data.list.id,extra\n0,2024-01-03 00:00:00,b1,createCard,C9,L2,x\n")
    (tmp_path / "e[1].csv").write_text("\ufeff,id,type,date,data.card.closed,data.list.id\n0,e1,updateCard,2024-01-04 00:00:00,True,L3\n")
    (tmp_path / "none.csv").write_text("")
    got = {r["id"]: r for r in board_log.read_csv(spark, str(tmp_path)).collect()}
    assert set(got) == {"a0", "a1", "b1", "e1"} and {r["board_id"] for r in got.values()} == {"a", "b+c d", "e[1]"}
    assert got["a1"]["list_name"] == 'Say "hi", now\nor later' and got["a1"]["list_id"] == "L1" and got["a0"]["list_id"] is None and got["a0"]["pos"] == -1
    assert (got["b1"]["card_id"], got["b1"]["list_id"], got["b1"]["list_name"]) == ("C9", "L2", None) and got["e1"]["card_closed"] is True and got["e1"]["list_id"] == "L3"


def test_stream(spark, tmp_path, log):
    from lanewise.streaming import labels

    log.select(COLUMNS).unionByName(log.select(COLUMNS)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = labels.read_stream(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("labelled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("labelled").count() == 9 and spark.table("labelled").filter("c = 'card_move'").count() == 2
