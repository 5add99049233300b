"""Board logs: schema, file sources and sinks (for pages see ``paged``). One row per action, all boards in one DataFrame.

``pos`` orders actions of equal date: it grows with time (raw logs are newest first, so it
is the negated place in the file).
"""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ACTION = (
    "id STRING, type STRING, date TIMESTAMP, idMemberCreator STRING, data STRUCT<board: STRUCT<id: STRING, name: STRING>, "
    "card: STRUCT<id: STRING, closed: BOOLEAN, due: TIMESTAMP>, list: STRUCT<id: STRING, name: STRING, closed: BOOLEAN>, "
    "listBefore: STRUCT<id: STRING, name: STRING>, listAfter: STRUCT<id: STRING, name: STRING>, old: STRUCT<name: STRING>>"
)
LOG = (
    "pos BIGINT, board_id STRING, board_name STRING, id STRING, type STRING, date TIMESTAMP, member_id STRING, "
    "card_id STRING, card_closed BOOLEAN, card_due TIMESTAMP, list_id STRING, list_name STRING, list_closed BOOLEAN, "
    "list_before_id STRING, list_before_name STRING, list_after_id STRING, list_after_name STRING, old_name STRING"
)
#: Columns of flat CSV logs and what they are called here. Fixed values.
CSV_COLUMNS = {
    "id": "id",
    "type": "type",
    "date": "date",
    "idMemberCreator": "member_id",
    "data.board.name": "board_name",
    "data.card.id": "card_id",
    "data.card.closed": "card_closed",
    "data.card.due": "card_due",
    "data.list.id": "list_id",
    "data.list.name": "list_name",
    "data.list.closed": "list_closed",
    "data.listBefore.id": "list_before_id",
    "data.listBefore.name": "list_before_name",
    "data.listAfter.id": "list_after_id",
    "data.listAfter.name": "list_after_name",
    "data.old.name": "old_name",
}

#: A board log made of the events table: three boards of six lists. Both engines run this.
EVENTS_SQL = """
WITH e AS (SELECT event_id, ts, user_id, event_type, value,
                  CAST(user_id % 3 AS INT) AS b, CAST(event_id % 6 AS INT) AS l,
                  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
                  (event_type = 'error' AND event_id % 61 = 0) AS is_list,
                  (event_type = 'view' AND event_id % 6 < 4) AS is_move
           FROM {events}),
     t AS (SELECT *, CASE WHEN is_list THEN CAST((event_id / 61) AS INT) % 5 END AS lt,
                  (l + 1 + CAST(floor(value) AS INT) % 2) % 4 AS la FROM e)
SELECT event_id AS id, event_id AS pos, ts AS date, b AS board_id, user_id AS member_id,
       CASE WHEN event_id = 0 THEN 'createBoard' WHEN lt = 0 THEN 'createList' WHEN lt IN (1, 2) THEN 'updateList'
            WHEN lt = 3 THEN 'moveListFromBoard' WHEN lt = 4 THEN 'updateList'
            WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'addMemberToCard' ELSE 'addChecklistToCard' END
            WHEN event_type = 'signup' THEN 'createCard'
            WHEN event_type = 'click' THEN 'commentCard'
            WHEN event_type = 'view' THEN 'updateCard'
            WHEN event_id % 3 = 0 THEN 'updateCard'
            WHEN event_id % 7 = 0 THEN 'deleteCard'
            ELSE 'updateCheckItemStateOnCard' END AS type,
       CASE WHEN is_list THEN NULL ELSE lpad(CAST(b * 100 + k AS STRING), 24, '0') END AS card_id,
       CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN TRUE END AS card_closed,
       CASE WHEN NOT is_list AND event_id % 11 = 0 THEN ts END AS card_due,
       CASE WHEN is_move THEN NULL ELSE lpad(CAST(b * 10 + l AS STRING), 24, '0') END AS list_id,
       CASE WHEN is_move THEN NULL ELSE concat('L', CAST(l AS STRING)) END AS list_name,
       CASE WHEN lt = 4 THEN TRUE END AS list_closed,
       CASE WHEN lt = 1 THEN concat('old', CAST(l AS STRING)) END AS old_name,
       CASE WHEN is_move THEN lpad(CAST(b * 10 + l AS STRING), 24, '0') END AS list_before_id,
       CASE WHEN is_move THEN concat('L', CAST(l AS STRING)) END AS list_before_name,
       CASE WHEN is_move THEN lpad(CAST(b * 10 + la AS STRING), 24, '0') END AS list_after_id,
       CASE WHEN is_move THEN concat('L', CAST(la AS STRING)) END AS list_after_name
FROM t
"""


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def flatten(actions: DataFrame) -> DataFrame:
    """Nested actions (with pos and board_id) to the flat columns of LOG; members' details are not read."""
    lists = [F.col(f"data.{a}.{f}").alias(f"{b}_{f}") for a, b in (("listBefore", "list_before"), ("listAfter", "list_after")) for f in ("id", "name")]
    return actions.select(
        "pos", "board_id", F.col("data.board.name").alias("board_name"), "id", "type", "date", F.col("idMemberCreator").alias("member_id"),
        F.col("data.card.id").alias("card_id"), F.col("data.card.closed").alias("card_closed"), F.col("data.card.due").alias("card_due"),
        F.col("data.list.id").alias("list_id"), F.col("data.list.name").alias("list_name"), F.col("data.list.closed").alias("list_closed"),
        *lists, F.col("data.old.name").alias("old_name"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents {"actions": [...]} newest first, one board each, a file per board; malformed files give no rows.

    The board is that of the actions, or else the file. Pages may overlap, so an action counts once.
    """
    docs = spark.read.schema(f"actions ARRAY<STRUCT<{ACTION.replace('id STRING, type STRING, date TIMESTAMP, idMemberCreator STRING, data', 'id: STRING, type: STRING, date: TIMESTAMP, idMemberCreator: STRING, data:')}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = docs.select(F.col("_metadata.file_name").alias("file"), F.posexplode("actions").alias("seq", "a")).select("file", (-F.col("seq")).cast("long").alias("pos"), "a.*")
    named = rows.withColumn("board_id", F.coalesce("data.board.id", F.regexp_replace("file", r"\.json$", "")))
    return flatten(named).dropDuplicates(["board_id", "id"])


def _headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """File and first line of each text file."""

    def first(batches):
        seen = set()
        for batch in batches:
            rows = batch.to_pylist()
            new = [r for k, r in enumerate(rows) if r["start"] == 0 and r["file"] not in seen and (k == 0 or rows[k - 1]["file"] != r["file"])]
            seen.update(r["file"] for r in new)
            if new:
                yield pa.RecordBatch.from_pylist([{"file": r["file"], "line": r["line"]} for r in new])

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    return [(r["file"], r["line"]) for r in lines.mapInArrow(first, "file string, line string").collect()]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat logs with dotted column names and an index column, a file per board; its name is the board.

    Files may have different columns in any order, fields with quotes, commas and line ends.
    Files with the same header are read together. Empty files give no rows.
    """
    kinds = dict(c.split(" ") for c in LOG.split(", "))
    by_header: dict[str, list[str]] = {}
    for file, line in _headers(spark, path):
        by_header.setdefault(line, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file)))
    parts = []
    for line, files in sorted(by_header.items()):
        names = next(csv.reader([line.removeprefix("\ufeff")]))
        schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(files)
        at = {n: f"c{k}" for k, n in enumerate(names)}
        cols = [(F.col(at[old]) if old in at else F.lit(None)).cast(kinds[new]).alias(new) for old, new in CSV_COLUMNS.items()]
        file = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""), r"\+", "%2B")
        flat = raw.select((-F.col("c0").cast("long")).alias("pos"), F.url_decode(file).alias("board_id"), *cols)
        parts.append(flat.select([c.split(" ")[0] for c in LOG.split(", ")]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LOG)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_parquet` wrote; a filter on board_id reads that board's folder only."""
    return spark.read.schema(LOG).parquet(path)


def write_parquet(log: DataFrame, path: str) -> None:
    """A folder per board; a large board is several files, each of a range of its time."""
    log.repartitionByRange("board_id", "date", "pos").write.partitionBy("board_id").parquet(path)


def nested(log: DataFrame) -> DataFrame:
    """Flat rows as nested actions, with board_id and pos."""
    ref = lambda p, *more: F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_name").alias("name"), *more)
    data = F.struct(
        F.struct(F.col("board_id").alias("id"), F.col("board_name").alias("name")).alias("board"),
        F.struct(F.col("card_id").alias("id"), F.col("card_closed").alias("closed"), F.col("card_due").alias("due")).alias("card"),
        ref("list", F.col("list_closed").alias("closed")).alias("list"), ref("list_before").alias("listBefore"), ref("list_after").alias("listAfter"), F.struct(F.col("old_name").alias("name")).alias("old"),
    )
    return log.select("board_id", "pos", "id", "type", "date", F.col("member_id").alias("idMemberCreator"), data.alias("data"))


def write_json(log: DataFrame, path: str) -> None:
    """Nested actions with their place as JSON lines, a folder per board; :func:`read_json_lines` reads them."""
    nested(log).write.partitionBy("board_id").json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_json` wrote."""
    rows = spark.read.schema(f"pos BIGINT, {ACTION}").json(path)
    return flatten(rows.withColumn("board_id", F.col("data.board.id")))


def write_csv(frame: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    frame.write.option("header", True).csv(path)


def read_board_ids(spark: SparkSession, path: str) -> DataFrame:
    """One board id a line; blank lines do not count."""
    return spark.read.text(path).select(F.trim("value").alias("board_id")).filter("board_id <> ''").distinct()
