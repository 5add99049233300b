"""The library's queries on the events table, and their SQL, by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.labels import enrich
from lanewise.operators import discovery, distincts, evolution, flow, graph, metrics, redesign, summary
from lanewise.plans.oracle import SQL
from lanewise.sources import csv_log, paged, variant_log, xes
from lanewise.sources.board_log import CSV_COLUMNS, LOG, from_events, write_json
from lanewise.staging import fresh_path
from lanewise.streaming import labels as stream_labels
from lanewise.streaming import redesigns as stream_redesigns

__all__ = ["QUERIES", "SQL"]

HOURS_3 = 3 * redesign.HOUR


class _Log:
    """What queries start from; each is made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.log = from_events(spark, sf_dir)
        self.rich = enrich(self.log)

    @property
    def redesigns(self) -> DataFrame:
        return redesign.detect_redesign(self.rich, HOURS_3)

    @property
    def intervals(self) -> DataFrame:
        return redesign.stable_intervals(self.log, self.redesigns)

    @property
    def evolution(self) -> DataFrame:
        return evolution.list_evolution(self.rich)

    def design(self) -> discovery.BoardDesign:
        return discovery.board_discovery(self.rich, sp_threshold=0.05)


def joined(df: DataFrame, column: str) -> DataFrame:
    """An array as a string; a null in it as <null>."""
    return df.withColumn(column, F.array_join(column, "|", "<null>"))


def _labels(*columns: str) -> Callable[[_Log], DataFrame]:
    return lambda x: x.rich.select("board_id", "id", *columns)


_ON_LOG: dict[str, Callable[[_Log], DataFrame]] = {
    "enrich": _labels("l", "c", "list_comb", "list_before_comb", "list_after_comb"),
    "label_list_events": _labels("l"),
    "label_card_events": _labels("c"),
    "list_comb": _labels("list_comb"),
    "board_summary": lambda x: summary.board_summary(x.log),
    "first_event_type": lambda x: summary.board_summary(x.log).select("board_id", "first_type"),
    "events_per_member": lambda x: summary.events_per_member(x.log),
    "type_histogram": lambda x: summary.type_histogram(x.log),
    "card_percentages": lambda x: summary.card_percentages(x.log),
    "list_names": lambda x: joined(summary.list_names(x.log), "names"),
    "list_name_map": lambda x: summary.list_name_map(x.log),
    "comb_collision": lambda x: summary.comb_collision(x.log),
    "first_type_counts": lambda x: summary.first_type_counts(x.log),
    "distincts": lambda x: distincts.merged(distincts.daily(x.log)),
    "distincts_by_week": lambda x: distincts.merged(distincts.daily(x.log), F.to_date(F.date_trunc("week", "day"))),
    "corpus_describe": lambda x: summary.corpus_describe(x.log, None),
    "board_selection_by_first_type": lambda x: summary.board_selection(x.log, 300, 7),
    "corpus_describe_of_created": lambda x: summary.corpus_describe(x.log),
    "corpus_study_of_created": lambda x: redesign.corpus_study(x.rich, 300, 7),
    "board_selection": lambda x: summary.board_selection(x.log, 300, 7, None),
    "list_evolution": lambda x: joined(x.evolution, "names"),
    "list_evolution_filtered": lambda x: joined(evolution.list_evolution(x.rich, 25 * 86400), "names"),
    "board_evolution": lambda x: evolution.board_evolution(x.log),
    "board_evolution_of_list": lambda x: evolution.board_evolution(x.log, 10, "L2"),
    "board_evolution_by_list": lambda x: evolution.board_evolution_by_list(x.log, "card_action"),
    "daily_card_activity": lambda x: evolution.daily_card_activity(x.rich),
    "daily_card_activity_between": lambda x: evolution.daily_card_activity(x.rich, before="2024-01-09", after="2024-01-05"),
    "card_activity": lambda x: evolution.card_activity(x.rich),
    "card_time_histogram": lambda x: evolution.card_time_histogram(x.rich),
    "list_timeline": lambda x: evolution.list_timeline(x.evolution),
    "redesign_lines": lambda x: redesign.redesign_lines(x.redesigns),
    "redesigns": lambda x: x.redesigns,
    "redesigns_by_count": lambda x: redesign.detect_redesign(x.rich, fewer_than=250),
    "redesigns_of_class": lambda x: redesign.detect_redesign(x.rich, HOURS_3, ["list_create", "list_rename"]),
    "redesigns_of_class_by_count": lambda x: redesign.detect_redesign(x.rich, list_class="list_change", fewer_than=600),
    "redesigns_min_events": lambda x: redesign.detect_redesign(x.rich, 72 * redesign.HOUR, more_than=1),
    "stable_intervals": lambda x: x.intervals,
    "redesign_distance": lambda x: redesign.redesign_distance(x.log, x.redesigns),
    "relative_gaps": lambda x: redesign.relative_gaps(x.log, x.redesigns),
    "gap_describe": lambda x: redesign.gap_describe(redesign.relative_gaps(x.log, x.redesigns)),
    "corpus_study": lambda x: redesign.corpus_study(x.rich, 300, 7, None),
    "gap_mean_of_means": lambda x: redesign.gap_mean_of_means(redesign.relative_gaps(x.log, x.redesigns)),
    "interval_slice": lambda x: redesign.interval_slice(x.log, x.intervals, 2).select("board_id", "id", "type", "date"),
    "lifetime_deciles": lambda x: redesign.lifetime_deciles(x.log, x.redesigns),
    "redesign_histogram": lambda x: redesign.redesign_histogram(x.redesigns),
    "transitions": lambda x: flow.transitions(x.rich),
    "transitions_by_id": lambda x: flow.transitions(x.rich, "id"),
    "transitions_by_comb": lambda x: flow.transitions(x.rich, "comb"),
    "transitions_pivot": lambda x: flow.transitions_pivot(x.rich, ["L0", "L1", "L2", "L3"]),
    "semantic_precedence": lambda x: flow.semantic_precedence(x.rich, "id", 0.05),
    "create_lists": lambda x: flow.card_action_list(x.rich, "card_create"),
    "close_lists": lambda x: flow.card_action_list(x.rich, "card_close"),
    "use_lists": lambda x: flow.card_action_list(x.rich, "card_act", threshold=20),
    "use_lists_by_comb": lambda x: flow.card_action_list(x.rich, "card_act", "comb", 20),
    "create_lists_by_name": lambda x: flow.card_action_list(x.rich, "card_create", "name"),
    "precedence_by_name": lambda x: flow.semantic_precedence(x.rich, "name", 0.05),
    "event_log": lambda x: flow.event_log(x.rich),
    "moves_per_list": lambda x: flow.moves_per_list(x.rich),
    "components": lambda x: joined(graph.connected_lists(x.rich), "members"),
    "components_by_comb": lambda x: joined(graph.connected_lists(x.rich, "comb"), "members"),
    "components_threshold": lambda x: joined(graph.connected_lists(x.rich, "id", 55), "members"),
    "design_lists": lambda x: x.design().lists,
    "design_card_flow": lambda x: joined(x.design().card_flow, "members"),
    "design_lists_by_comb": lambda x: discovery.board_discovery(x.rich, "comb").lists,
    "design_precedence": lambda x: x.design().semantic_precedence,
    "move_metrics": lambda x: metrics.move_metrics(x.rich),
    "act_metrics": lambda x: metrics.act_metrics(x.rich),
    "close_metrics": lambda x: metrics.close_metrics(x.rich),
    "connected_metrics": lambda x: metrics.connected_metrics(x.rich),
    "redesign_metrics": lambda x: metrics.redesign_metrics(x.log, x.redesigns),
    "list_evolution_metrics": lambda x: metrics.list_evolution_metrics(x.log, x.evolution),
    "static_metrics": lambda x: metrics.static_metrics(x.rich),
    "static_metrics_by_interval": lambda x: metrics.static_metrics_by_interval(x.rich, x.intervals),
    "static_metrics_of_long_intervals": lambda x: metrics.static_metrics_by_interval(x.rich, x.intervals, 86400, 40),
}


#: The log as a query that has gone through files gives it back.
READ_BACK = ["board_id", "id", "type", "date", "member_id", "card_id", "card_closed", "list_id", "list_name", "list_closed", "list_before_id", "list_before_name", "list_after_id", "list_after_name", "old_name"]


def read_back(log: DataFrame) -> DataFrame:
    """Ids as strings, times as they are written (UTC) whatever the session's zone."""
    date = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("date").cast("timestamp_ntz"))
    return log.select(*[F.col(c).cast("string").alias(c) if c in ("board_id", "id", "member_id") else F.col(c) for c in READ_BACK if c != "date"], date.alias("date"))


def _archive(log: DataFrame) -> tuple[paged.Fetch, DataFrame]:
    """Page function over an archive of the log, and its boards in parts."""
    path = fresh_path(log.sparkSession, "archive")
    paged.write_pages(log.withColumn("board_name", F.lit(None).cast("string")), path)
    return paged.archived(path), paged.time_parts(log)


def paged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through the paged source; a board that fails fails the query, since less than the log is no result."""
    log = from_events(spark, sf_dir)
    fetch, boards = _archive(log)
    return read_back(paged.actions(paged.load_pages(spark, boards, fetch, keep_going=False)))


def refreshed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through the paged source as a stream: what was there half way, then the rest from the checkpoint."""
    log = from_events(spark, sf_dir)
    fetch, boards = _archive(log)
    ids, out, checkpoint = (fresh_path(spark, x) for x in ("board-ids", "refreshed", "refreshed-checkpoint"))
    paged.write_board_ids(boards, ids)
    first, last = (t or dt.datetime(1970, 1, 1) for t in log.agg(F.min("date"), F.max("date")).first())  # a log without rows has none
    spell = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    for upto in (first + (last - first) / 2, last + dt.timedelta(seconds=1)):
        got = paged.refresh(spark, ids, fetch, out, checkpoint, lambda upto=upto: spell(upto))
    return read_back(got)


def _arrived(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the log as files that a stream reads."""
    path = fresh_path(spark, "stream-log")
    log = from_events(spark, sf_dir).withColumn("board_name", F.lit(None).cast("string"))
    log.select([F.col(c).cast(t) for c, t in (x.split(" ") for x in LOG.split(", "))]).write.parquet(path)
    return path


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream gives out of all that is there."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("board_id", F.col("board_id").cast("int"))


def redesigns_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redesigns that the log, as a stream of files, closes within a delay of a day."""
    stream = enrich(spark.readStream.schema(LOG).parquet(_arrived(spark, sf_dir)))
    return _drained(stream_redesigns.detect_redesign(stream, HOURS_3)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_ts", "max_ts")})


def activity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card events of each hour and class that the log, as a stream of files, closes within a delay of two days."""
    counts = stream_labels.activity(stream_labels.read_stream(spark, _arrived(spark, sf_dir)))
    return _drained(counts).select("board_id", "c", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


def attribute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as they occur in the actions, written as JSON lines and read as VARIANT."""
    path = fresh_path(spark, "json-lines")
    write_json(from_events(spark, sf_dir).withColumn("board_name", F.lit(None).cast("string")), path)
    return variant_log.attribute_counts(variant_log.read_lines(spark, path))


def xes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, written as XES files and read again."""
    path = fresh_path(spark, "xes")
    xes.write_xes(flow.event_log(enrich(from_events(spark, sf_dir))), path)
    return xes.read_xes(spark, path)


def csv_log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, written as flat CSV files and read again in one scan."""
    path = fresh_path(spark, "csv")
    log = from_events(spark, sf_dir).withColumn("board_name", F.lit(None).cast("string"))
    columns = [(-F.col("pos")).alias("index"), *[F.col(new).alias(old) for old, new in CSV_COLUMNS.items()]]
    written = log.select("board_id", *columns).withColumn("date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    written.write.partitionBy("board_id").option("header", True).option("escape", '"').csv(path)
    return read_back(csv_log.read_csv(spark, path, F.regexp_extract("file", "board_id=([^/]*)", 1)))


def _query(make: Callable[[_Log], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(_Log(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(make) for name, make in _ON_LOG.items()}
QUERIES |= {"paged_log": paged_log, "refreshed_log": refreshed_log, "redesigns_stream": redesigns_stream, "activity_stream": activity_stream, "attribute_counts": attribute_counts, "xes_log": xes_log, "csv_log": csv_log_read}
