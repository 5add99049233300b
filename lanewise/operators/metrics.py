"""Usage metrics of boards, or of any groups of their events: ``keys`` name the group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.labels import describe, micros, rounded
from lanewise.operators.graph import connected_lists
from lanewise.operators.redesign import by_interval, redesign_distance, spans
from lanewise.staging import stage

BOARD = ["board_id"]


def _join(keys: list[str], *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def connected_metrics(rows: DataFrame, keys: list[str] = BOARD, use: str = "id", threshold: float = 0) -> DataFrame:
    found = connected_lists(rows, use, threshold, keys)
    return found.groupBy(*keys).agg(F.count("*").alias("list_num_components"), rounded(F.avg("size"), "list_connected_size_mean"), rounded(F.avg("size") / F.sum("size"), "list_connected_size_mean_perc"), F.count_if(F.col("n_moves_in") > 0).alias("list_num_components_move"))


def _by_card(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What metrics need of cards, from one row a card."""
    is_class = lambda c: F.col("c") == c
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    cards = rows.groupBy(*keys, "card_id").agg(
        F.count("*").alias("n"), has(F.col("list_before_id").isNotNull()).alias("moved"), has(is_class("card_act")).alias("acted"), has(F.col("card_closed")).alias("closed"),
        F.count(F.when(is_class("card_move"), F.col("id"))).alias("moves"), F.count(F.when(is_class("card_act"), F.col("id"))).alias("acts"),
    )
    known = F.col("card_id").isNotNull()
    share = lambda c: rounded(F.try_divide(F.count_if(known & F.col(c)), F.count("card_id")), f"cards_{ {'moved': 'moving', 'acted': 'act', 'closed': 'closed'}[c]}_perc")
    mean = lambda c, name: rounded(F.avg(F.when(known & (F.col(c) > 0), F.col(c))), name)
    return cards.groupBy(*keys).agg(F.sum("n").alias("events"), F.count("card_id").alias("cards"), share("moved"), share("acted"), share("closed"), mean("moves", "moves_per_moving_card"), mean("acts", "act_per_act_card"))


def _by_list(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What metrics need of lists, from one row a list."""
    move, act = F.coalesce(F.col("c") == "card_move", F.lit(False)).cast("int"), F.coalesce((F.col("c") == "card_act") & F.col("id").isNotNull(), F.lit(False)).cast("int")
    role = lambda c, own: F.struct(F.col(c).alias("list"), F.lit(own).alias("own"), (F.lit(0) if own else move).alias("moves"), (act if own else F.lit(0)).alias("acts"))
    seen = rows.select(*keys, F.explode(F.array(role("list_id", 1), role("list_before_id", 0), role("list_after_id", 0))).alias("x")).select(*keys, "x.*").filter("list IS NOT NULL")
    lists = seen.groupBy(*keys, "list").agg(F.max("own").alias("own"), F.sum("moves").alias("moves"), F.sum("acts").alias("acts"))
    mean = lambda c, name: rounded(F.avg(F.when(F.col(c) > 0, F.col(c))), name)
    return lists.groupBy(*keys).agg(F.sum("own").alias("lists"), mean("moves", "move_per_list_with_move"), rounded(F.count_if(F.col("moves") > 0) / F.count("*"), "list_with_move_perc"), mean("acts", "act_per_list"))


MOVES = ["move_per_list_with_move", "list_with_move_perc", "cards_moving_perc", "moves_per_moving_card"]
ACTS = ["cards_act_perc", "act_per_list", "act_per_act_card"]


def move_metrics(rows: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    return _join(keys, _by_card(rows, keys), _by_list(rows, keys)).select(*keys, *MOVES)


def act_metrics(rows: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    return _join(keys, _by_card(rows, keys), _by_list(rows, keys)).select(*keys, *ACTS)


def close_metrics(rows: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    return _by_card(rows, keys).select(*keys, "cards_closed_perc")


def static_metrics(rows: DataFrame, keys: list[str] = BOARD, use: str = "id", threshold: float = 0) -> DataFrame:
    """Events, cards, lists and all metrics of each group."""
    rows = stage(rows.select(*keys, "id", "c", "card_id", "card_closed", *[f"{p}_{f}" for p in ("list", "list_before", "list_after") for f in ("id", "comb")]), "metric-rows")
    found = _join(keys, _by_card(rows, keys), _by_list(rows, keys), connected_metrics(rows, keys, use, threshold))
    connected = ["list_num_components", "list_connected_size_mean", "list_connected_size_mean_perc", "list_num_components_move"]
    return found.select(*keys, "events", "cards", F.coalesce("lists", F.lit(0)).alias("lists"), *connected, *MOVES, *ACTS, "cards_closed_perc")


def static_metrics_by_interval(rows: DataFrame, intervals: DataFrame, longer_s: float | None = None, min_events: int | None = None, use: str = "id", threshold: float = 0) -> DataFrame:
    """The same for each stable interval (board_id, run), with its bounds first_ts and last_ts."""
    intervals = stage(intervals, "intervals")
    found = static_metrics(by_interval(rows, intervals, longer_s, min_events), ["board_id", "run"], use, threshold)
    return found.join(intervals, ["board_id", "run"])


def redesign_metrics(log: DataFrame, redesigns: DataFrame) -> DataFrame:
    """Statistics of the sizes of redesigns and of the seconds between them, and the mean distance in days."""
    return redesign_distance(log, redesigns).groupBy("board_id").agg(*describe("n_events", "size_"), *describe("seconds", "distance_"), rounded(F.avg("seconds") / 86400, "distance_mean_days"))


def list_evolution_metrics(log: DataFrame, evolution: DataFrame) -> DataFrame:
    """Mean life of lists in seconds, statistics of its share of the board's, mean number of names."""
    life = spans(log).select("board_id", micros("board_start", "board_end").alias("life"))
    rows = evolution.join(life, "board_id").select("board_id", micros("begin_date", "last_date").alias("own"), F.size("names").alias("names"), "life").withColumn("share", F.try_divide("own", "life"))
    return rows.groupBy("board_id").agg(rounded(F.avg(F.col("own") / 1e6), "list_duration_s"), *describe("share", "share_"), rounded(F.avg("names"), "list_renames_mean"))
