"""Logs for process mining as XES files: traces (cases) with their events in order of time.

The sink writes through Spark's Python data source API: tasks write their files to a folder of the
job, the commit moves them into place and an abort takes them away, so that readers see all of a
log or nothing. A hot case is one trace of one file, written as its rows stream by.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lanewise.sources.paged import _files, _open

#: Columns of a log, as operators.flow.event_log gives them; case_id null: events of no case.
EVENTS = "board_id string, case_id string, activity string, ts timestamp_ntz, resource string, type string, closed boolean, src string, dst string"
#: Keys of the exchange format for an event's columns, and the kind of value. Fixed values.
KEYS = {"activity": ("concept:name", "string"), "ts": ("time:timestamp", "date"), "resource": ("org:resource", "string"), "type": ("type", "string"), "closed": ("closed", "boolean"), "src": ("before", "string"), "dst": ("after", "string")}
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0">\n'
ESCAPES = {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;"}


def _value(kind: str, key: str, value) -> str:
    text = value.isoformat(timespec="microseconds") + "+00:00" if kind == "date" else str(value).lower() if kind == "boolean" else value
    return f"<{kind} key={quoteattr(key)} value={quoteattr(text, ESCAPES)}/>"


def _event(row: dict) -> str:
    return "  <event>" + "".join(_value(kind, key, row[c]) for c, (key, kind) in KEYS.items() if row[c] is not None) + "</event>\n"


def traces(rows: Iterator[dict]) -> Iterator[str]:
    """The text of traces from rows in order of board, case and time; no trace is held."""
    now = None
    for row in rows:
        case = row["board_id"], row["case_id"]
        if case != now:
            if now is not None:
                yield " </trace>\n"
            now = case
            names = [_value("string", k, v) for k, v in (("board", case[0]), ("concept:name", case[1])) if v is not None]
            yield " <trace>" + "".join(names) + "\n"
        yield _event(row)
    if now is not None:
        yield " </trace>\n"


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = _open(f"{self.path}/{self.job}")
        name = f"part-{uuid.uuid4().hex}.xes"  # of this attempt of the task
        system.create_dir(inner)
        rows = (r for batch in iterator for r in batch.to_pylist())
        with system.open_output_stream(f"{inner}/{name}") as out:
            out.write(HEAD.encode())
            for text in traces(rows):
                out.write(text.encode())
            out.write(b"</log>\n")
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _open(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{inner}/{self.job}/{m.name}", f"{inner}/{m.name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = _open(f"{self.path}/{self.job}")
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path) if f.endswith(".xes")]

    def read(self, partition: _File) -> Iterator[tuple]:
        """Events one by one; an event is forgotten once it is read."""
        system, inner = _open(partition.path)
        kinds = {key: (c, kind) for c, (key, kind) in KEYS.items()}
        with system.open_input_stream(inner) as f:
            board = case = trace = root = None
            for step, node in ElementTree.iterparse(f, ("start", "end")):
                tag = node.tag.rpartition("}")[2]
                if step == "start":
                    root = node if root is None else root
                    if tag == "trace":
                        board, case, trace = None, None, node
                elif tag == "trace":
                    root.clear()
                elif tag == "event":
                    row = dict.fromkeys(KEYS)
                    for x in node:
                        if x.get("key") in kinds:
                            c, kind = kinds[x.get("key")]
                            text = x.get("value")
                            row[c] = dt.datetime.fromisoformat(text).astimezone(dt.UTC).replace(tzinfo=None) if kind == "date" else text == "true" if kind == "boolean" else text
                    for x in trace:  # the trace's own values stand before its events
                        if x.get("key") == "board":
                            board = x.get("value")
                        elif x.get("key") == "concept:name":
                            case = x.get("value")
                    trace.clear()
                    yield (board, case, *(row[c] for c in KEYS))


class XesSource(DataSource):
    """``spark.read.format("xes").load(path)`` gives EVENTS; writing wants these columns, see :func:`write_xes`."""

    @classmethod
    def name(cls) -> str:
        return "xes"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_xes(events: DataFrame, path: str) -> None:
    """Add an event log (columns of EVENTS) to the XES files at ``path``: a case is one trace of one file, its events by time.

    Events of one time go by activity, type and lists. Times are UTC.
    """
    spark = events.sparkSession
    spark.dataSource.register(XesSource)
    columns = [F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in EVENTS.split(", "))]
    rows = events.select(columns).repartition("board_id", "case_id").sortWithinPartitions("board_id", "case_id", "ts", "activity", "type", "src", "dst")
    rows.write.format("xes").mode("append").option("path", path).save()


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Events of XES files, a task for each file."""
    spark.dataSource.register(XesSource)
    return spark.read.format("xes").load(path)
