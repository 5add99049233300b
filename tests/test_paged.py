"""The paged source, in batch and as a stream that is stopped and started again."""

import datetime as dt
import json

import compare
import pytest
from pyspark.sql import functions as F

from lanewise.plans.registry import QUERIES, SQL
from lanewise.sources import board_log, paged
from lanewise.staging import fresh_path


def service(n, inclusive=True, per_date=1):
    """A board's actions newest first, ``per_date`` of them on a date, and the page function of all boards."""
    day = lambda k: (dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // per_date)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    board = [{"id": f"a{k}", "type": "createList", "date": day(k), "data": {"list": {"id": f"L{k % 3}"}}, "more": {"unknown": k}} for k in range(n)][::-1]

    def fetch(board_id, before, batch):
        return [a | {"id": f"{board_id}-{a['id']}"} for a in board if before is None or a["date"] < before or inclusive and a["date"] == before][:batch]

    return board, fetch


@pytest.mark.parametrize("inclusive,per_date,batch", [(True, 1, 10), (False, 1, 10), (True, 3, 10), (True, 3, 4), (True, 1, 2), (True, 1, 1000), (False, 1, 1)])
def test_pages_give_each_action_once(inclusive, per_date, batch):
    board, fetch = service(40, inclusive, per_date)
    failed = []

    def shaky(*a):
        if len(failed) < 3:
            failed.append(1)
            raise OSError("once more")
        return fetch(*a)

    got = [a for page in paged.pages(shaky, "b", batch) for a in page]
    assert [a["id"] for a in got] == [f"b-{a['id']}" for a in board] and len(failed) == 3
    cut = [a for page in paged.pages(fetch, "b", batch, before=board[5]["date"], since=board[20]["date"]) for a in page]
    assert [a["id"] for a in cut] == [f"b-{a['id']}" for a in board if board[20]["date"] <= a["date"] < board[5]["date"]]


def test_pages_that_cannot_go_on():
    _, fetch = service(25, per_date=25)
    with pytest.raises(ValueError, match="larger pages"):
        list(paged.pages(fetch, "b", 10))
    assert sum(map(len, paged.pages(fetch, "b", 30))) == 25
    with pytest.raises(OSError):
        list(paged.pages(lambda *a: open("/nowhere"), "b", 10))


def test_batches_hold_one_page():
    _, fetch = service(95)
    sizes = [b.num_rows for b in paged.page_batches(fetch, [("x", None, None), ("y", None, None)], 10)]
    assert max(sizes) == 10 and sum(sizes) == 190


def test_source_and_boards_that_fail(spark):
    board, fetch = service(35)

    def broken(board_id, before, batch):
        if board_id == "bad" and before is not None:
            raise OSError("gone")
        if board_id == "worse":
            return [{"no": "id"}]
        return fetch(board_id, before, batch)

    boards = spark.createDataFrame([(b, None, None) for b in ("b1", "b2", "bad", "worse")] + [("cut", None, board[10]["date"]), ("cut", board[10]["date"], None)], "board_id string, since string, before string")
    got = paged.load_pages(spark, boards, broken, 10, 3)
    counts = {r["board_id"]: r["count"] for r in paged.actions(got).groupBy("board_id").count().collect()}
    assert counts == {"b1": 35, "b2": 35, "bad": 10, "cut": 35}
    assert {r["board_id"]: r["error"].split(":")[0] for r in paged.failed_boards(got).collect()} == {"bad": "OSError", "worse": "KeyError"}
    log = paged.actions(got.filter("board_id = 'b1'"))
    ordered = [r["id"] for r in log.orderBy("date", "pos").collect()]
    assert ordered == [f"b1-{a['id']}" for a in board][::-1] and {r["list_id"] for r in log.collect()} == {"L0", "L1", "L2"}
    assert json.loads(got.filter("board_id = 'b1'").first()["action"])["more"]["unknown"] is not None
    assert paged.load_pages(spark, boards.limit(0), fetch, 10, 2).count() == 0


def test_filters_on_boards_reach_the_source(spark):
    _, fetch = service(5)
    boards = spark.createDataFrame([("b1",), ("b2",)], "board_id string")

    def only_b1(board_id, before, batch):
        assert board_id == "b1"
        return fetch(board_id, before, batch)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = paged.load_pages(spark, boards, only_b1, 10, 2)
        for some in (got.filter("board_id = 'b1'"), got.filter("board_id IN ('b1', 'zz')")):
            assert some.count() == 5 and some.filter("error IS NOT NULL").count() == 0
        assert got.filter("error IS NOT NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_refresh_goes_on_where_it_stopped(spark, tmp_path):
    board, fetch = service(60, per_date=2)
    ids, out, at = fresh_path(spark, "ids"), str(tmp_path / "log"), str(tmp_path / "checkpoint")
    paged.write_board_ids(spark.createDataFrame([("b1",), ("b2",)], "board_id string"), ids, 2)
    upto = lambda k: (lambda date=board[k]["date"]: date)
    want = lambda k: sorted(f"{b}-{a['id']}" for b in ("b1", "b2") for a in board if a["date"] < board[k]["date"])
    ids_of = lambda df: sorted(r["id"] for r in df.collect())
    assert ids_of(paged.refresh(spark, ids, fetch, out, at, upto(40), 7)) == want(40)

    def dies(board_id, before, batch):
        if board_id == "b2" and before < board[20]["date"]:
            raise OSError("stopped between pages")
        return fetch(board_id, before, batch)

    with pytest.raises(Exception, match="stopped between pages"):
        paged.refresh(spark, ids, dies, out, at, upto(10), 7)
    assert ids_of(spark.read.parquet(out)) == want(40)
    # the batch that was cut short has its time in the checkpoint; it is read as it was, and then what came since
    paged.refresh(spark, ids, fetch, out, at, upto(0), 7)
    assert ids_of(paged.refresh(spark, ids, fetch, out, at, upto(0), 7)) == want(0)
    assert ids_of(paged.refresh(spark, ids, fetch, out, at, upto(0), 7)) == want(0)


def test_archive_serves_pages(spark, tmp_path, sf_dir):
    log = board_log.from_events(spark, sf_dir).withColumn("board_name", F.lit("n"))
    paged.write_pages(log, str(tmp_path / "a"))
    boards = log.select(F.col("board_id").cast("string").alias("board_id")).distinct()
    got = paged.actions(paged.load_pages(spark, boards, paged.archived(str(tmp_path / "a")), 97, 2))
    flat = lambda df: sorted(map(str, df.select("id", "type", F.col("date").cast("string"), "card_id", "list_id", "list_after_name", "old_name").collect()))
    assert flat(got) == flat(log.withColumn("id", F.col("id").cast("string")))


def test_archive_pages_open_few_files(spark, tmp_path, monkeypatch):
    """A page of a busy day costs the files that it lies in, not the day; parts of a board make up the board."""
    when = F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 500000)
    log = spark.range(40000).select(F.lit("b").alias("board_id"), F.lit("n").alias("board_name"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("createList").alias("type"), when.alias("date"), F.lit("m").alias("member_id"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in board_log.LOG.split(", ")[7:])])
    monkeypatch.setattr(paged, "FILE_ROWS", 2000)
    paged.write_pages(log, str(tmp_path / "a"))
    fetch, opened = paged.archived(str(tmp_path / "a")), []
    plain = paged.json.loads
    monkeypatch.setattr(paged.json, "loads", lambda *a: opened.append(1) or plain(*a))
    got = [a["pos"] for page in paged.pages(fetch, "b", 1000) for a in page]
    assert got == list(range(40000))[::-1]
    assert len(opened) < 41000  # each line about once; all lines of the day for each page before
    parts = paged.time_parts(log, 10000)
    cut = paged.actions(paged.load_pages(spark, parts, fetch, 1000, 2))
    assert parts.count() > 2 and cut.count() == cut.select("id").distinct().count() == 40000


def test_refresh_of_parts(spark, tmp_path):
    """Boards cut into parts: a refresh reads what lies in its time, each action once."""
    board, fetch = service(60)
    ids, out, at = fresh_path(spark, "ids"), str(tmp_path / "log"), str(tmp_path / "checkpoint")
    log = spark.createDataFrame([("b1", a["date"]) for a in board], "board_id string, date string").withColumn("date", F.to_timestamp("date"))
    parts = paged.time_parts(log, 20)
    assert parts.count() == 3
    paged.write_board_ids(parts, ids, 2)
    for k in (30, 0):
        got = sorted(r["id"] for r in paged.refresh(spark, ids, fetch, out, at, lambda k=k: board[k]["date"], 7).collect())
        assert got == sorted(f"b1-{a['id']}" for a in board if a["date"] < board[k]["date"])


def test_lines_of_an_archive_go_through_unparsed(spark, tmp_path, sf_dir, monkeypatch):
    """Reading pages of an archive parses no line and writes none again; who asks for more of an action gets all of it."""
    log = board_log.from_events(spark, sf_dir).withColumn("board_name", F.lit("n"))
    paged.write_pages(log, str(tmp_path / "a"))
    fetch = paged.archived(str(tmp_path / "a"))
    page = fetch("1", None, 20)
    assert [dict(a) for a in page] == [json.loads(a.line) for a in page] and len(page[0]) == len(json.loads(page[0].line))
    assert all(a[k] == json.loads(a.line)[k] for a in page for k in ("id", "date", "pos", "data"))
    with pytest.raises(KeyError):
        page[0]["nothing"]

    def never(*a):
        raise AssertionError("a line was parsed or written")

    monkeypatch.setattr(paged.json, "loads", never)
    monkeypatch.setattr(paged.json, "dumps", never)
    got = [r for b in paged.page_batches(fetch, [("1", None, None)], 97) for r in b.to_pylist()]
    monkeypatch.undo()
    assert [r["error"] for r in got] == [None] * len(got)
    assert sorted(json.loads(r["action"])["id"] for r in got) == sorted(r["id"] for r in log.filter("board_id = 1").select("id").collect())


def test_archived_ids_with_nulls_stay_whole_numbers():
    assert paged._list(paged.pa.chunked_array([[2**60 + 1, None]])) == [2**60 + 1, None]
    assert paged._list(paged.pa.chunked_array([[2**60 + 1], [3]])) == [2**60 + 1, 3]


def test_boards_are_dealt_over_more_tasks_than_cores(spark):
    ids = fresh_path(spark, "ids")
    paged.write_board_ids(spark.range(200).select(F.col("id").cast("string").alias("board_id")), ids)
    assert len(paged._files(ids)) == 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("rows", [0, 1, 50])
def test_refreshed_log_of_one_time(spark, tmp_path, sf_dir, rows):
    """All actions of one time, or none: the last refresh takes them in."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(rows)
    events.withColumn("ts", F.lit("2024-01-01 10:00:00.5").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r["id"] for r in QUERIES["refreshed_log"](spark, str(tmp_path)).collect()) == sorted(str(r["event_id"]) for r in events.collect())


def test_boards_that_break_off_fail_where_that_is_asked_for(spark):
    _, fetch = service(35)

    def breaks(board_id, before, batch):
        if board_id == "b2" and before is not None:
            raise OSError("gone")
        return fetch(board_id, before, batch)

    boards = spark.createDataFrame([("b1",), ("b2",)], "board_id string")
    assert paged.actions(paged.load_pages(spark, boards, breaks, 10, 2)).count() == 45
    with pytest.raises(Exception, match="OSError: gone"):
        paged.actions(paged.load_pages(spark, boards, breaks, 10, 2, keep_going=False)).count()


def test_boards_that_fail_fail_paged_log(spark, sf_dir, monkeypatch):
    """A part of the log is no result."""
    archived = paged.archived

    def all_but(path):
        of_all = archived(path)

        def some(board_id, before, batch):
            if board_id == "1":
                raise KeyError("no such board")
            return of_all(board_id, before, batch)

        return some

    monkeypatch.setattr(paged, "archived", all_but)
    with pytest.raises(Exception, match="no such board"):
        QUERIES["paged_log"](spark, sf_dir).collect()


ODD = {
    "many of one time": {"ts": "CASE WHEN event_id % 10 < 7 THEN TIMESTAMP_NTZ '2024-01-10 10:00:00.25' ELSE ts END"},
    "no times": {"ts": "CASE WHEN event_id % 7 > 1 THEN ts END"},
    "no boards": {"user_id": "CASE WHEN event_id % 7 > 1 THEN user_id END"},
    "one id three times": {"event_id": "event_id DIV 3", "user_id": "3L", "ts": "TIMESTAMP_NTZ '2024-01-10 10:00:00' + make_dt_interval(0, 0, 0, event_id DIV 3)"},
}


@pytest.mark.parametrize("name", ["paged_log", "refreshed_log"])
@pytest.mark.parametrize("odd", sorted(ODD))
def test_odd_logs_are_read_whole(spark, tmp_path, sf_dir, monkeypatch, odd, name):
    """More actions of one time than a page holds, actions without a time or a board, ids that stand on both sides of a page's end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    many = events.crossJoin(spark.range(8).select(F.col("id").alias("k"))).withColumn("event_id", F.col("event_id") + F.col("k") * events.count()).drop("k")
    many.withColumns({c: F.expr(e) for c, e in ODD[odd].items()}).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(compare, "TABLES", ["events"])
    assert compare.spark_rows(QUERIES[name](spark, str(tmp_path))) == compare.duck_rows(SQL[name], str(tmp_path))


def test_undated_actions_are_the_oldest(spark, tmp_path, sf_dir):
    """Without ids too: pages of any size give each action once, those without a date last; parts make up the board."""
    log = board_log.from_events(spark, sf_dir).withColumn("board_name", F.lit(None).cast("string")).withColumns({"date": F.when(F.col("id") % 3 > 0, F.col("date")), "id": F.when(F.col("id") % 5 > 0, F.col("id"))})
    paged.write_pages(log, str(tmp_path / "a"))
    fetch = paged.archived(str(tmp_path / "a"))
    want = sorted(((r["date"] is not None, r["date"], r["pos"]) for r in log.filter("board_id = 1").select("pos", F.date_format("date", paged.SPELLED).alias("date")).collect()), key=lambda x: (x[1] or "", x[2]), reverse=True)
    for batch in (1, 7, 1000):
        got = [json.loads(a.line) for page in paged.pages(fetch, "1", batch) for a in page]
        assert [(a.get("date"), a["pos"]) for a in got] == [x[1:] for x in want]
    parts = paged.time_parts(log, 50)
    assert parts.filter("board_id = '1'").count() > 2
    cut = paged.actions(paged.load_pages(spark, parts, fetch, 7, 2, keep_going=False))
    assert cut.count() == log.count() and cut.filter("date IS NULL").count() == log.filter("date IS NULL").count()


def test_years_that_do_not_order_as_strings_fail(spark, tmp_path, sf_dir):
    log = board_log.from_events(spark, sf_dir).withColumn("board_name", F.lit(None).cast("string")).withColumn("date", F.col("date") + F.expr("make_interval(9000)"))
    paged.write_pages(log, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="0 to 9999"):
        list(paged.pages(paged.archived(str(tmp_path / "a")), "1"))
