"""How lists and boards develop over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.labels import order_key, card_acted, card_closed, card_created, card_moved, list_created, micros


def list_evolution(enriched: DataFrame, longer_than_s: float | None = None) -> DataFrame:
    """Begin, end, last name and names (newest first) of each list, from its list events.

    A list whose newest event is neither an end nor a move to another board lives to the
    board's last event. ``longer_than_s`` keeps lists that live longer than so many seconds.
    """
    last = enriched.groupBy("board_id").agg(F.max("date").alias("board_end"))
    events = enriched.filter("l IS NOT NULL AND list_id IS NOT NULL")
    named = F.when(F.col("list_name").isNotNull(), order_key())
    by_name = events.groupBy("board_id", "list_id", "list_name").agg(F.min("date").alias("b"), F.max("date").alias("e"), F.max(F.struct(order_key().alias("o"), "l")).alias("newest"), F.max(named).alias("at"))
    ordered = F.sort_array(F.collect_list(F.struct("newest", "list_name")), asc=False)
    lists = by_name.groupBy("board_id", "list_id").agg(F.min("b").alias("begin_date"), F.max("e").alias("e"), F.max("newest").alias("newest"), F.max_by("list_name", "at").alias("last_name"), F.transform(ordered, lambda x: x["list_name"]).alias("names"))
    done = F.col("newest.l").isin("list_ends", "list_move")
    out = lists.join(last, "board_id").select("board_id", "list_id", "begin_date", F.when(done, F.col("e")).otherwise(F.col("board_end")).alias("last_date"), "last_name", "names")
    return out if longer_than_s is None else out.filter(micros("begin_date", "last_date") > int(longer_than_s * 1e6))


CATEGORIES = {"events": lambda: F.col("id").isNotNull(), "list_creation": list_created, "card_creation": card_created, "card_movement": card_moved, "card_closed": card_closed, "card_action": card_acted}


def _binned(log: DataFrame, bins: int) -> DataFrame:
    """``bin`` 1..bins: equal parts, closed on the right, of each board's span."""
    span = log.groupBy("board_id").agg(F.min("date").alias("t0"), F.max("date").alias("t1"))
    at = F.ceil(F.try_divide(micros("t0", "date") * bins, micros("t0", "t1")))
    return log.join(span, "board_id").withColumn("bin", F.least(F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)), F.lit(bins)).cast("int"))


def board_evolution(log: DataFrame, bins: int = 30, list_name: str | None = None) -> DataFrame:
    """Events of six overlapping categories per board and time bin, empty bins too.

    ``list_name`` counts the events of one list, in the bins of the whole board.
    """
    binned = _binned(log, bins)
    if list_name is not None:
        binned = binned.filter(F.col("list_name") == list_name)
    counts = binned.groupBy("board_id", "bin").agg(*[F.count_if(c()).alias(k) for k, c in CATEGORIES.items()])
    return _all_bins(log, bins).join(counts, ["board_id", "bin"], "left").na.fill(0, list(CATEGORIES))


def _all_bins(log: DataFrame, bins: int) -> DataFrame:
    return log.select("board_id").distinct().select("board_id", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))


def board_evolution_by_list(log: DataFrame, category: str = "events", bins: int = 30) -> DataFrame:
    """Events of one category per board, time bin and list name; zero for every bin of every such list."""
    kept = _binned(log, bins).filter(CATEGORIES[category]() & F.col("list_name").isNotNull())
    counts = kept.groupBy("board_id", "list_name", "bin").agg(F.count("*").alias("n"))
    lists = counts.select("board_id", "list_name").distinct().select("board_id", "list_name", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return lists.join(counts, ["board_id", "list_name", "bin"], "left").na.fill(0, ["n"])


def daily_card_activity(enriched: DataFrame, before: str | None = None, after: str | None = None, key: str = "list_comb", classes: list[str] | None = None) -> DataFrame:
    """Card events per board, day, class (by default work on cards and their creation) and list; optionally
    only of days before or after a date, both excluded."""
    day: Column = F.to_date("date")
    rows = enriched.filter(F.col("c").isin(classes or ["card_act", "card_create"]))
    if before is not None:
        rows = rows.filter(day < F.lit(before).cast("date"))
    if after is not None:
        rows = rows.filter(day > F.lit(after).cast("date"))
    return rows.groupBy("board_id", day.alias("day"), "c", F.coalesce(key, F.lit("##UNKNOWN")).alias(key)).agg(F.count("*").alias("n"))


def card_activity(enriched: DataFrame, classes: list[str] | None = None, key: str = "list_comb") -> DataFrame:
    """Card events one by one, as a scatter plot shows them; by default all classes but deletions."""
    rows = enriched.filter(F.col("c").isin(classes or ["card_act", "card_create", "card_move", "card_close"]))
    return rows.select("board_id", "date", "c", F.coalesce(key, F.lit("##UNKNOWN")).alias(key))


def card_time_histogram(enriched: DataFrame, bins: int = 30) -> DataFrame:
    """Card events per board, class and time bin; bins without events have no row."""
    return _binned(enriched.filter("c IS NOT NULL"), bins).groupBy("board_id", "c", "bin").agg(F.count("*").alias("n"))


def list_timeline(evolution: DataFrame) -> DataFrame:
    """Bars of a timeline: each list's place (0 for the one that ended first), begin, end and last name."""
    by_end = Window.partitionBy("board_id").orderBy("last_date", "list_id")
    return evolution.select("board_id", "list_id", (F.row_number().over(by_end) - 1).cast("long").alias("place"), "begin_date", "last_date", "last_name")
