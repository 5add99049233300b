"""Flow of cards between lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.labels import key_columns
from lanewise.operators.summary import list_name_map


def transitions(enriched: DataFrame, use: str = "name") -> DataFrame:
    """board_id, src, dst, n. With ids, lists of one name stay apart, and src and dst are their newest names."""
    _, before, after = key_columns(use)
    n = enriched.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy("board_id", F.col(before).alias("src"), F.col(after).alias("dst")).agg(F.count("id").alias("n"))
    if use != "id":
        return n
    names = list_name_map(enriched)
    for side in ("src", "dst"):
        n = n.join(names.select("board_id", F.col("list_id").alias(side), F.col("name").alias(f"{side}_name")), ["board_id", side], "left")
    return n.select("board_id", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "n")


def transitions_pivot(enriched: DataFrame, columns: list[str], use: str = "name") -> DataFrame:
    """The transition matrix with one column per target list; null where nothing moved."""
    return transitions(enriched, use).groupBy("board_id", "src").pivot("dst", columns).agg(F.sum("n"))


def semantic_precedence(enriched: DataFrame, use: str = "id", threshold: float = 0.0) -> DataFrame:
    """Pairs of lists with a transition, and its share of the board's moves (closing moves are none); over the threshold, if there is one."""
    moves = enriched.filter("c = 'card_move'").groupBy("board_id").agg(F.count("*").alias("moves"))
    out = transitions(enriched, use).join(moves, "board_id", "left").select("board_id", "src", "dst", "n", F.round(F.try_divide("n", "moves"), 6).alias("share"), F.try_divide("n", "moves").alias("exact"))
    return (out if threshold <= 0 else out.filter(F.col("exact") > threshold)).drop("exact")


def card_action_list(enriched: DataFrame, label: str = "card_create", use: str = "id", threshold: int = 0) -> DataFrame:
    """Share of each list in card events of one class; lists must have more than ``threshold``, and shares are of what is left."""
    key, _, _ = key_columns(use)
    n = enriched.filter((F.col("c") == label) & F.col(key).isNotNull()).groupBy("board_id", F.col(key).alias("list")).agg(F.count("id").alias("n")).filter(F.col("n") > threshold)
    shares = n.select("board_id", "list", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("board_id")), 6).alias("share"))
    if use != "id":
        return shares.select("board_id", F.col("list").alias("list_name"), "share")
    return shares.withColumnRenamed("list", "list_id").join(list_name_map(enriched), ["board_id", "list_id"], "left").select("board_id", "list_id", F.col("name").alias("list_name"), "share")


def event_log(enriched: DataFrame) -> DataFrame:
    """Cases, activities and times for process mining: card creations, moves and closings, as columns case_id,
    activity, ts, resource, type, closed, src, dst. The activity is the list moved to, else that of the card."""
    rows = enriched.filter(F.col("c").isin("card_create", "card_close", "card_move"))
    closed = F.coalesce("card_closed", F.lit(False))
    activity = F.coalesce(F.col("list_after_name"), F.when(closed, "**Closed").otherwise(F.col("list_name")))
    return rows.select(F.col("card_id").alias("case_id"), activity.alias("activity"), F.col("date").alias("ts"), F.col("member_id").alias("resource"), "type", closed.alias("closed"), F.coalesce("list_before_name", F.lit("")).alias("src"), F.coalesce("list_after_name", F.lit("")).alias("dst"), "board_id")


def moves_per_list(enriched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Moves out of and into each list."""
    keys = keys or ["board_id"]
    moves = enriched.filter("c = 'card_move'")
    ends = moves.select(*keys, F.explode(F.array("list_before_id", "list_after_id")).alias("list_id")).filter("list_id IS NOT NULL")
    return ends.groupBy(*keys, "list_id").agg(F.count("*").alias("n"))
