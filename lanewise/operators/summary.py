"""Summaries of boards: counts, shares, histograms, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.labels import LABELS, order_key, card_closed, describe, micros, rounded
from lanewise.operators import quantiles


def distinct_ids(log: DataFrame, **columns: str) -> DataFrame:
    """board_id and, by the names given, the number of different values of columns. Rows are made distinct as
    narrow (board, column, value) before they are counted, so that no group is held whole and nothing else goes along."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("of"), F.col(c).cast("string").alias("id")) for name, c in columns.items()])).alias("x")
    seen = log.select("board_id", values).select("board_id", "x.*").filter("id IS NOT NULL").distinct()
    return seen.groupBy("board_id").agg(*[F.count_if(F.col("of") == name).alias(name) for name in columns])


def board_summary(log: DataFrame) -> DataFrame:
    """One row per board. ``attributes``: columns that hold data for the board."""
    held = [F.max(F.col(c).isNotNull()).cast("int") for c in log.columns if c not in ("pos", "board_id", *LABELS)]
    kind = F.col("type")
    made = F.when(kind == "createList", F.col("date"))
    counted = log.groupBy("board_id").agg(
        F.count("*").alias("events"),
        sum(held[1:], held[0]).cast("long").alias("attributes"),
        F.min(made).alias("first_list"),
        F.max(made).alias("last_list"),
        F.count_if((kind == "updateList") & F.col("old_name").isNotNull()).alias("list_renames"),
        F.count_if(F.coalesce("list_closed", F.lit(False))).alias("closed_lists"),
        F.count_if(card_closed()).alias("closed_cards"),
        F.count_if((kind == "updateCard") & F.col("list_before_id").isNotNull()).alias("movements"),
        F.count("card_due").alias("due_dates"),
        *[F.count_if(kind == k).alias(n) for k, n in (("addMemberToCard", "assignments"), ("addChecklistToCard", "checklists"), ("deleteCard", "deleted_cards"))],
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        (micros(F.min("date"), F.max("date")) / 1e6).alias("duration_s"),
        F.min_by("type", F.struct("date", -F.col("pos"))).alias("first_type"),
    )
    ids = distinct_ids(log, cards="card_id", lists="list_id", members="member_id")
    full = counted.join(ids, "board_id", "left").na.fill(0, ["cards", "lists", "members"])
    first = ["board_id", "events", "attributes", "cards", "lists", "members"]
    return full.select(*first, *[c for c in counted.columns if c not in first])


def events_per_member(log: DataFrame) -> DataFrame:
    """Statistics of how many events members have."""
    return log.filter("member_id IS NOT NULL").groupBy("board_id", "member_id").agg(F.count("*").alias("n")).groupBy("board_id").agg(*describe("n"))


def type_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("board_id", "type").agg(F.count("*").alias("n"))


def card_percentages(log: DataFrame) -> DataFrame:
    """Shares of a board's cards that move, have a checklist, are assigned, are closed; null without cards."""
    cases = {"moving": F.col("list_before_id").isNotNull(), "checklist": F.col("type") == "addChecklistToCard", "assigned": F.col("type") == "addMemberToCard", "closed": card_closed()}
    distinct = [F.countDistinct(F.when(c, F.col("card_id"))).alias(k) for k, c in cases.items()]
    counts = log.groupBy("board_id").agg(F.countDistinct("card_id").alias("cards"), *distinct)
    return counts.select("board_id", *[rounded(F.try_divide(F.col(k), F.col("cards")), k) for k in cases])


def list_names(log: DataFrame) -> DataFrame:
    """Distinct names of each list, newest first; a null name counts as a value.

    Names are made distinct before they are gathered, so a list's array is as long as its names are many.
    """
    names = log.filter("list_id IS NOT NULL").groupBy("board_id", "list_id", "list_name").agg(F.max(order_key()).alias("last"))
    ordered = F.sort_array(F.collect_list(F.struct("last", "list_name")), asc=False)
    return names.groupBy("board_id", "list_id").agg(F.transform(ordered, lambda x: x["list_name"]).alias("names"))


def list_name_map(log: DataFrame) -> DataFrame:
    """Newest name of each list id; names seen on moves away win over those on moves in, and these over plain ones."""
    seen = None
    for k, prefix in enumerate(("list", "list_after", "list_before")):
        part = log.select("board_id", F.col(f"{prefix}_id").alias("list_id"), F.col(f"{prefix}_name").alias("name"), F.lit(k).alias("rank"), "date", "pos").filter("list_id IS NOT NULL")
        seen = part if seen is None else seen.unionByName(part)
    newest = F.max_by("name", F.when(F.col("name").isNotNull(), order_key()))
    by_rank = seen.groupBy("board_id", "list_id", "rank").agg(newest.alias("name"))
    return by_rank.groupBy("board_id", "list_id").agg(F.max_by("name", "rank").alias("name"))


def comb_collision(log: DataFrame) -> DataFrame:
    """Whether two lists of a board share the id suffix that keys show."""
    suffix = F.countDistinct(F.substring("list_id", 19, 6))
    return log.groupBy("board_id").agg((suffix != F.countDistinct("list_id")).alias("collision"))


def first_type_counts(log: DataFrame) -> DataFrame:
    """How many boards begin with which type of event."""
    return board_summary(log).groupBy("first_type").agg(F.count("*").alias("n"))


#: Columns of boards that a study of many boards describes.
CORPUS = ["events", "cards", "lists", "cards_moving_perc", "cards_closed_perc"]


def corpus_describe(log: DataFrame, first_type: str | None = "createBoard") -> DataFrame:
    """Statistics over the boards that begin with ``first_type`` (None: all) of each of CORPUS, one row each."""
    shares = card_percentages(log).select("board_id", F.col("moving").alias("cards_moving_perc"), F.col("closed").alias("cards_closed_perc"))
    boards = board_summary(log).join(shares, "board_id")
    boards = boards if first_type is None else boards.filter(F.col("first_type") == first_type)
    values = F.explode(F.map_from_arrays(F.array(*map(F.lit, CORPUS)), F.array(*[F.col(c).cast("double") for c in CORPUS]))).alias("metric", "value")
    return quantiles.describe(boards.select(values), ["metric"], "value")  # the groups are all boards


def board_selection(log: DataFrame, min_events: int = 2000, min_days: float = 84, first_type: str | None = "createBoard") -> DataFrame:
    """Boards with more events and a longer life than given and, unless None, this first event."""
    found = board_summary(log).filter((F.col("events") > min_events) & (F.col("duration_s") > min_days * 86400))
    return (found if first_type is None else found.filter(F.col("first_type") == first_type)).select("board_id", "events", "duration_s")
