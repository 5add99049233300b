"""The design of boards: lists, flow, precedence and what lists are used for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.flow import card_action_list, semantic_precedence
from lanewise.operators.graph import connected_lists
from lanewise.operators.summary import list_name_map


@dataclass
class BoardDesign:
    """Six tables, each keyed by board_id."""

    lists: DataFrame
    card_flow: DataFrame
    semantic_precedence: DataFrame
    card_create_list: DataFrame
    card_close_list: DataFrame
    card_use_list: DataFrame


def board_discovery(enriched: DataFrame, use: str = "id", cf_threshold: float = 0, cc_threshold: int = 0, cx_threshold: int = 0, cu_threshold: int = 0, sp_threshold: float = 0) -> BoardDesign:
    """Thresholds, in order: card flow, creating, closing and using lists, precedence."""
    flow = connected_lists(enriched, use, cf_threshold)
    lists = flow.select("board_id", "comp_id", F.explode("members").alias("list"))
    if use == "id":
        names = list_name_map(enriched).withColumnRenamed("list_id", "list")
        lists = lists.join(names, ["board_id", "list"], "left").select("board_id", "comp_id", F.coalesce("name", "list").alias("list"))
        flow = lists.groupBy("board_id", "comp_id").agg(F.array_sort(F.collect_set("list")).alias("members"))
    share = lambda label, t: card_action_list(enriched, label, use, t)
    return BoardDesign(lists.select("board_id", "list"), flow.select("board_id", "comp_id", "members"), semantic_precedence(enriched, use, sp_threshold), share("card_create", cc_threshold), share("card_close", cx_threshold), share("card_act", cu_threshold))


def report(design: BoardDesign, board_id, limit: int = 1000) -> str:
    """A text about one board; a design has as many rows as a board has lists, and of more than ``limit`` the text says so."""
    own = lambda df: df.filter(F.col("board_id") == board_id).limit(limit + 1).collect()
    part = lambda title, rows: "\n".join([title, *([f"- {r}" for r in sorted(rows)[:limit]] or ["- None"]), *["- and more"] * (len(rows) > limit)])
    shares = lambda df: [f"{r['list_name']}: {r['share']:.2f}" for r in own(df)]
    return "\n".join([
        part("Lists", [str(r["list"]) for r in own(design.lists)]),
        part("Card flow", [", ".join(map(str, r["members"])) for r in own(design.card_flow)]),
        part("Precedence", [f"{r['src']} -> {r['dst']}" for r in own(design.semantic_precedence)]),
        part("Cards are created in", shares(design.card_create_list)),
        part("Cards are closed in", shares(design.card_close_list)),
        part("Cards are worked on in", shares(design.card_use_list)),
    ])
