"""Distinct cards, lists and members that merge: bitmaps by day.

Ids are numbered once, in buckets of a bounded size; a day of a board is a bitmap for each bucket.
Any time is then the OR of its days, and a number of distincts a count of bits: nothing is shuffled
but bitmaps, however many events the days have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = {"cards": "card_id", "lists": "list_id", "members": "member_id"}
#: Ids meant for a bucket of numbers, and those that a bitmap of Spark's holds.
MEANT, HELD = 8192, 32768


def _seen(log: DataFrame, columns: dict[str, str], *more: Column) -> DataFrame:
    """Different board_id, of (the name of a column) and id, with other columns."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("of"), F.col(c).cast("string").alias("id")) for name, c in columns.items()])).alias("x")
    return log.select("board_id", *more, values).select("board_id", *[F.col(c) for c in log.select(*more).columns], "x.*").filter("id IS NOT NULL").distinct()


def numbered(log: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """board_id, of, id and number (from 1) of every id; no window holds more than a bucket of them."""
    ids = _seen(log, columns)
    sizes = ids.groupBy("board_id", "of").agg(F.ceil(F.count("*") / MEANT).alias("buckets"))
    dealt = ids.join(sizes, ["board_id", "of"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
    rank = F.row_number().over(Window.partitionBy("board_id", "of", "bucket").orderBy("id")) - 1
    at = (F.floor(rank / HELD) * F.col("buckets") + F.col("bucket")) * HELD + rank % HELD
    return dealt.select("board_id", "of", "id", (at + 1).cast("long").alias("number"))


def daily(log: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """board_id, of, day, bucket and bitmap: which ids the events of a day name. To be stored, and merged as needed."""
    seen = _seen(log, columns, F.to_date("date").alias("day"))
    known = seen.join(numbered(log, columns), ["board_id", "of", "id"])
    return known.groupBy("board_id", "of", "day", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def merged(bitmaps: DataFrame, period: Column | None = None, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """Distinct ids of each board, and of each ``period`` (an expression of ``day``), a column for each name."""
    keys = ["board_id"] if period is None else ["board_id", "period"]
    rows = bitmaps if period is None else bitmaps.withColumn("period", period)
    counts = rows.groupBy(*keys, "of", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    return counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("of") == name, F.col("n"))), F.lit(0)).alias(name) for name in columns])
