"""Column expressions: event classes, list keys, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Action types by what they do.
CARD_CREATE = ["createCard", "copyCard"]
CARD_ACTIONS = ["updateCard", "addMemberToCard", "commentCard", "addChecklistToCard", "updateCheckItemStateOnCard", "removeMemberFromCard", "updateChecklist", "removeChecklistFromCard", "addAttachmentToCard", "deleteAttachmentFromCard"]
LIST_CREATION = ["createList", "updateList", "moveListFromBoard", "moveListToBoard"]
#: Columns that :func:`enrich` adds.
LABELS = ["l", "c", "list_comb", "list_before_comb", "list_after_comb"]


def order_key() -> Column:
    """Chronological order of a board's rows; two structs compare field by field."""
    return F.struct("date", "pos")


def card_created() -> Column:
    return F.col("type").isin(CARD_CREATE)


def card_moved() -> Column:
    return F.col("list_before_id").isNotNull()


def card_closed() -> Column:
    return F.coalesce("card_closed", F.lit(False))


def card_acted() -> Column:
    return F.col("type").isin(CARD_ACTIONS)


def list_created() -> Column:
    return F.col("type").isin(LIST_CREATION)


def list_label() -> Column:
    """Class of list event; a closing wins whatever the type."""
    kind = F.col("type")
    return (
        F.when(F.coalesce("list_closed", F.lit(False)), "list_ends")
        .when(kind == "moveListFromBoard", "list_move")
        .when((kind == "updateList") & F.col("old_name").isNotNull(), "list_rename")
        .when(kind == "updateList", "list_change")
        .when(kind == "moveListToBoard", "list_import")
        .when(kind == "createList", "list_create")
    )


def card_label() -> Column:
    """Class of card event; a closing wins whatever the type."""
    return F.when(card_closed(), "card_close").when(F.col("type") == "deleteCard", "card_delete").when(card_moved(), "card_move").when(card_created(), "card_create").when(card_acted(), "card_act")


def comb(prefix: str) -> Column:
    """Readable key of a list: its name and the end of its id."""
    return F.concat(F.col(f"{prefix}_name"), F.lit("["), F.substring(f"{prefix}_id", 19, 6), F.lit("]"))


def enrich(log: DataFrame) -> DataFrame:
    """The log with l, c and the three list keys; a move counts for the list it leaves."""
    before = comb("list_before")
    return log.withColumns({"l": list_label(), "c": card_label(), "list_comb": F.when(card_moved(), before).otherwise(comb("list")), "list_before_comb": before, "list_after_comb": comb("list_after")})


def micros(start: Column | str, end: Column | str) -> Column:
    """Microseconds between two timestamps."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))


def key_columns(use: str) -> tuple[str, str, str]:
    """List, before and after columns for keys 'id', 'comb' or 'name'."""
    if use not in ("id", "comb", "name"):
        raise ValueError(f"keys are id, comb or name, not {use}")
    return f"list_{use}", f"list_before_{use}", f"list_after_{use}"


def rounded(c: Column, name: str) -> Column:
    return F.round(c.cast("double"), 6).alias(name)


def describe(value: str, of: str = "") -> list[Column]:
    """n, mean, sample std, min, interpolated quartiles and max of a column; ``of`` is put before the names."""
    x = F.col(value).cast("double")
    stats = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "p25": F.percentile(x, 0.25), "p50": F.percentile(x, 0.5), "p75": F.percentile(x, 0.75), "max": F.max(x)}
    return [F.count(x).alias(f"{of}n"), *[rounded(v, f"{of}{k}") for k, v in stats.items()]]
