"""Redesigns: runs of events close to list events; the stable intervals between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.labels import describe, micros
from lanewise.operators.summary import board_selection

HOUR = 3600.0


def detect_redesign(enriched: DataFrame, within_s: float | None = 3 * HOUR, list_class: str | list[str] | None = None, fewer_than: int | None = None, more_than: int | None = None) -> DataFrame:
    """Runs of flagged events per board: run (1 is the newest), min_ts, max_ts, n_events, n_list_events.

    A segment begins at each list event (of the classes ``list_class``, if given); what comes
    before the first is a segment too. These list events are flagged and, by duration, events
    less than ``within_s`` after the start of their segment, or with ``fewer_than`` all events of
    segments of fewer events. n_list_events counts list events of every class from the newest
    event of the run back to the next older run; where some are newer than every run, they make a
    row of run 0 without times. ``more_than`` keeps rows with more list events.

    Windows run inside a day of a board, and over days in a table of a few rows a day, so that a
    board of any size spreads over many tasks.
    """
    at = F.struct("date", "pos")
    classes = [list_class] if isinstance(list_class, str) else list_class
    starts = F.col("l").isNotNull() if classes is None else F.coalesce(F.col("l").isin(list(classes)), F.lit(False))
    rows = enriched.select("board_id", F.to_date("date").alias("day"), "date", "pos", "l", starts.alias("starts"))
    upto = Window.partitionBy("board_id", "day").orderBy("date", "pos").rowsBetween(Window.unboundedPreceding, 0)
    if fewer_than is None:
        start = F.when(F.col("starts"), F.col("date"))
        earlier = Window.partitionBy("board_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        days = rows.groupBy("board_id", "day").agg(F.max(start).alias("last"), F.min("date").alias("first"))
        days = days.select("board_id", "day", F.coalesce(F.last("last", True).over(earlier), F.first("first").over(earlier), "first").alias("carried"))
        since = F.coalesce(F.last(start, True).over(upto), "carried")
        flag = F.col("starts") | (micros(since, F.col("date")) < int(within_s * 1e6))
        rows = rows.join(days, ["board_id", "day"]).withColumn("flag", flag)
    else:
        rows = rows.withColumn("part", F.sum(F.col("starts").cast("long")).over(upto))
        parts = rows.groupBy("board_id", "day", "part").agg(F.count("*").alias("n"))
        parts = parts.withColumn("segment", F.count_if(F.col("part") > 0).over(Window.partitionBy("board_id").orderBy("day", "part")))
        parts = parts.select("board_id", "day", "part", F.sum("n").over(Window.partitionBy("board_id", "segment")).alias("size"))
        rows = rows.join(parts, ["board_id", "day", "part"]).withColumn("flag", F.col("starts") | (F.col("size") < fewer_than))
    # going back in time, a run begins where the next event is not flagged; what that is for a day's newest event is seen below
    newest = Window.partitionBy("board_id", "day").orderBy(F.desc("date"), F.desc("pos"))
    rows = rows.withColumn("begins", (F.col("flag") & ~F.lag("flag", 1, False).over(newest)).cast("long"))
    rows = rows.withColumn("part", F.sum("begins").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    date = F.when(F.col("flag"), F.col("date"))
    parts = rows.groupBy("board_id", "day", "part").agg(F.min(date).alias("min_ts"), F.max(date).alias("max_ts"), F.count_if("flag").alias("n_events"), F.count("l").alias("n_list_events"), F.min_by("flag", at).alias("oldest"))
    back = Window.partitionBy("board_id").orderBy(F.desc("day"), "part")
    goes_on = (F.col("part") == 1) & (F.lag("day").over(back) != F.col("day")) & F.lag("oldest").over(back)
    parts = parts.withColumn("new", ((F.col("part") > 0) & ~F.coalesce(goes_on, F.lit(False))).cast("long")).withColumn("run", F.sum("new").over(back))
    runs = parts.groupBy("board_id", "run").agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("n_events").alias("n_events"), F.sum("n_list_events").alias("n_list_events"))
    return runs.filter((F.col("n_events") > 0) | (F.col("n_list_events") > 0)) if more_than is None else runs.filter(F.col("n_list_events") > more_than)


def spans(log: DataFrame) -> DataFrame:
    return log.groupBy("board_id").agg(F.min("date").alias("board_start"), F.max("date").alias("board_end"))


def stable_intervals(log: DataFrame, redesigns: DataFrame) -> DataFrame:
    """board_id, run, first_ts, last_ts: from the end of each redesign to the start of the next newer one, or the board's end."""
    by_run = Window.partitionBy("board_id").orderBy("run")
    return redesigns.filter("run > 0").join(spans(log), "board_id").select("board_id", "run", F.col("max_ts").alias("first_ts"), F.coalesce(F.lag("min_ts").over(by_run), F.col("board_end")).alias("last_ts"))


def redesign_distance(log: DataFrame, redesigns: DataFrame) -> DataFrame:
    """Seconds from the end of the next older redesign, or the board's start, to the start of each."""
    by_run = Window.partitionBy("board_id").orderBy("run")
    older = F.coalesce(F.lead("max_ts").over(by_run), F.col("board_start"))
    return redesigns.filter("run > 0").join(spans(log), "board_id").select("board_id", "run", "n_events", (micros(older, F.col("min_ts")) / 1e6).alias("seconds"))


def relative_gaps(log: DataFrame, redesigns: DataFrame) -> DataFrame:
    """Each stable interval as a share of the board's life."""
    life = spans(log).select("board_id", micros("board_start", "board_end").alias("life"))
    gaps = stable_intervals(log, redesigns).join(life, "board_id")
    return gaps.select("board_id", "run", F.round(F.try_divide(micros("first_ts", "last_ts"), F.col("life")), 6).alias("gap"))


def gap_describe(gaps: DataFrame) -> DataFrame:
    """Statistics of the gaps of each board."""
    return gaps.groupBy("board_id").agg(*describe("gap"))


def corpus_study(enriched: DataFrame, min_events: int = 2000, min_days: float = 84, first_type: str | None = "createBoard", within_s: float = 24 * HOUR) -> DataFrame:
    """Statistics of the relative gaps between redesigns of each board that is selected, see board_selection."""
    chosen = board_selection(enriched, min_events, min_days, first_type).select("board_id")
    log = enriched.join(chosen, "board_id", "left_semi")
    return gap_describe(relative_gaps(log, detect_redesign(log, within_s)))


def gap_mean_of_means(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("board_id").agg(F.avg("gap").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_gap"))


def interval_slice(log: DataFrame, intervals: DataFrame, run: int) -> DataFrame:
    """The events strictly inside the stable interval of this run."""
    one = intervals.filter(F.col("run") == run).select("board_id", "first_ts", "last_ts")
    return log.join(one, "board_id").filter((F.col("date") > F.col("first_ts")) & (F.col("date") < F.col("last_ts"))).drop("first_ts", "last_ts")


def by_interval(log: DataFrame, intervals: DataFrame, longer_s: float | None = None, min_events: int | None = None) -> DataFrame:
    """Events with the run of each stable interval that holds them, bounds included, so a bound may count twice.

    Intervals shorter than ``longer_s`` or with fewer than ``min_events`` events are left out.
    The join is by board and day: an interval is one row for each of its days.
    """
    if longer_s is not None:
        intervals = intervals.filter(micros("first_ts", "last_ts") >= int(longer_s * 1e6))
    days = intervals.filter("first_ts <= last_ts").withColumn("_day", F.explode(F.sequence(F.to_date("first_ts"), F.to_date("last_ts"))))
    rows = log.withColumn("_day", F.to_date("date")).join(days, ["board_id", "_day"]).filter(F.col("date").between(F.col("first_ts"), F.col("last_ts"))).drop("first_ts", "last_ts", "_day")
    if min_events is not None:
        kept = rows.groupBy("board_id", "run").count().filter(F.col("count") >= min_events).select("board_id", "run")
        rows = rows.join(kept, ["board_id", "run"], "left_semi")
    return rows


def lifetime_deciles(log: DataFrame, redesigns: DataFrame, bins: int = 10) -> DataFrame:
    """Redesigns that begin in each tenth of the board's life, closed on the left; a start at its very end is dropped."""
    at = F.floor(F.try_divide(micros("board_start", "min_ts") * bins, micros("board_start", "board_end")))
    found = redesigns.filter("run > 0").join(spans(log), "board_id").withColumn("bin", at)
    return found.groupBy("board_id").agg(*[F.count_if(F.col("bin") == k).alias(f"d{k}") for k in range(bins)])


def redesign_lines(redesigns: DataFrame) -> DataFrame:
    """Where a timeline shows redesigns: board_id, run, edge ('min' or 'max') and its date."""
    edges = F.explode(F.map_from_arrays(F.array(F.lit("min"), F.lit("max")), F.array("min_ts", "max_ts"))).alias("edge", "date")
    return redesigns.filter("run > 0").select("board_id", "run", edges)


def redesign_histogram(redesigns: DataFrame, width: int = 25, top: int = 300) -> DataFrame:
    """Boards by number of redesigns; the last bin holds its upper edge, boards over it are dropped."""
    n = redesigns.filter("run > 0").groupBy("board_id").agg(F.count("*").alias("n")).filter(F.col("n") <= top)
    return n.groupBy(F.least(F.floor(F.col("n") / width) * width, F.lit(top - width)).cast("long").alias("bin_start")).agg(F.count("*").alias("boards"))
