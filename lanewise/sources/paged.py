"""Boards read page by page, as a batch and as a stream source of Spark's Python data source API.

A page function ``fetch(board_id, before, batch)`` gives up to ``batch`` actions of a board that
are older than (or as old as) ``before``, newest first; ``before`` is a date, or the cursor of a
:class:`Line` that it gave. Readers hold one page and hand each on as an Arrow batch. A board that
fails is a row with an error, or fails the query (``keep_going``). Boards come from text files, a
task for each file, so the driver sees file names only.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from lanewise.sources.board_log import ACTION, flatten, nested
from lanewise.staging import fresh_path

Cursor = tuple[str, int]
Fetch = Callable[[str | None, str | Cursor | None, int], list[Mapping]]
#: A board whose id is null, in files of boards.
NULL = "\\N"
#: Of a row either action or error is null.
PAGES = "board_id string, pos long, action string, error string"
ARROW = pa.schema([("board_id", pa.string()), ("pos", pa.int64()), ("action", pa.string()), ("error", pa.string())])


class Line(Mapping):
    """An action as its line of JSON: what is known of it is at hand, all else is parsed when it is asked for.
    What comes after it is asked for by its cursor."""

    __slots__ = ("line", "cursor", "known")

    def __init__(self, line: str, cursor: Cursor, **known):
        self.line, self.cursor, self.known = line, cursor, known

    def __getitem__(self, key: str):
        found = self.known.get(key)
        return json.loads(self.line)[key] if found is None else found

    def __iter__(self) -> Iterator[str]:
        return iter(json.loads(self.line))

    def __len__(self) -> int:
        return len(json.loads(self.line))


def pages(fetch: Fetch, board_id: str, batch: int = 1000, retries: int = 3, before: str | None = None, since: str | None = None) -> Iterator[list[Mapping]]:
    """Pages of a board's actions, newest first, until a short page.

    A page that fails is asked for again ``retries`` times. The next page starts before the date of
    the last action; where the source takes that for "or at it", what was there already is left out.
    Where a full page holds nothing but actions of the very date that it was to start before, what is
    older can not be reached: ValueError. After a page of Lines the next starts right after the last one,
    however many have its date or id. Only actions before ``before`` and not before ``since``
    count; all dates are of one format, so that they compare as they are.
    """
    cursor, known = before, set()
    while True:
        for attempt in range(retries + 1):
            try:
                page = fetch(board_id, cursor, batch)
                break
            except OSError:
                if attempt == retries:
                    raise
        lines = bool(page) and isinstance(page[-1], Line)
        yield [a for a in page if (lines or a["id"] not in known) and (before is None or a["date"] < before) and (since is None or a["date"] >= since)]
        if len(page) < batch or since is not None and page[-1]["date"] < since:
            return
        if lines:
            cursor = page[-1].cursor
            continue
        last = page[-1]["date"]
        if last == cursor:
            raise ValueError(f"board {board_id} has {batch} actions or more at {last}; ask for larger pages")
        cursor, known = last, {a["id"] for a in page if a["date"] == last}


def page_batches(fetch: Fetch, boards: Iterable[tuple[str | None, str | None, str | None]], batch: int, retries: int = 3, keep_going: bool = True) -> Iterator[pa.RecordBatch]:
    """Arrow batches of PAGES, one a page; ``boards``: (id, since, before). ``keep_going``: a board that fails gives
    a row with the error, after the pages that came, which are a part of it only; else it raises."""
    for board, since, before in boards:
        n = 0
        try:
            for page in pages(fetch, board, batch, retries, before, since):
                if page:
                    lines = [a.line if isinstance(a, Line) else json.dumps(a) for a in page]
                    yield pa.record_batch([[board] * len(page), [-n - k for k in range(len(page))], lines, [None] * len(page)], schema=ARROW)
                    n += len(page)
        except Exception as e:
            if not keep_going:
                raise
            yield pa.record_batch([[board], [None], [None], [f"{type(e).__name__}: {e}"]], schema=ARROW)


class _File(InputPartition):
    """The boards of one file, and the time that is asked for."""

    def __init__(self, path: str, since: str | None = None, before: str | None = None):
        self.path, self.since, self.before = path, since, before


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Also file:/x, as the JVM spells local paths."""
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str) -> list[str]:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _boards(part: _File, only: set[str] | None = None) -> Iterator[tuple[str | None, str | None, str | None]]:
    """Lines of a file: an id and, after tabs, since and before; those that the reader was given narrow them."""
    system, inner = _open(part.path)
    with system.open_input_stream(inner) as f:
        for line in f.read().decode().splitlines():
            board, since, before = (x.strip() or None for x in (line.split("\t") + ["", ""])[:3])
            if board and (only is None or board in only):
                since = max((x for x in (since, part.since) if x), default=None)
                before = min((x for x in (before, part.before) if x), default=None)
                if since is None or before is None or since < before:
                    yield None if board == NULL else board, since, before


def now(lag_s: float = 60) -> str:
    """The time so many seconds ago, as the service writes times; what is older is taken to be there."""
    return (dt.datetime.now(dt.UTC) - dt.timedelta(seconds=lag_s)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def page_source(fetch: Fetch, name: str = "board_pages", clock: Callable[[], str] = now) -> type[DataSource]:
    """A source to register with ``spark.dataSource.register``. Options: ``path`` (files of board ids, optionally with
    since and before after tabs), ``batch`` (1000), ``retries`` (3), ``since`` (nothing older is read), ``keep_going`` ("true"): otherwise a board
    that fails stops a batch query too, ``push``: with "true", a filter on board_id keeps
    other boards from being asked for; Spark wants spark.sql.python.filterPushdown.enabled for it.

    As a stream its offset is a time: a batch reads of all boards what is dated from the last offset to the
    next, which is ``clock()``. The checkpoint holds one time however many boards there are, and a batch that was
    cut short is read again as it was. There a board that fails stops the query, to be started again.
    """

    class Pages(DataSourceReader):
        def __init__(self, options: dict):
            self.options, self.only = options, None

        def partitions(self) -> list[InputPartition]:
            return [_File(f, self.options.get("since"), self.options.get("before")) for f in _files(self.options["path"])]

        def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
            keep_going = self.options.get("keep_going", "true") == "true"
            return page_batches(fetch, _boards(partition, self.only), int(self.options.get("batch", 1000)), int(self.options.get("retries", 3)), keep_going)

    class PagesOfSome(Pages):
        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("board_id",):
                    self.only = {f.value} if self.only is None else self.only & {f.value}
                elif isinstance(f, In) and f.attribute == ("board_id",):
                    self.only = set(f.value) if self.only is None else self.only & set(f.value)
                else:
                    yield f

    class PageStream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:
            return {"upto": self.options.get("since", "")}

        def latestOffset(self) -> dict:
            return {"upto": clock()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [_File(f, start["upto"] or None, end["upto"]) for f in _files(self.options["path"])] if start["upto"] < end["upto"] else []

        def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
            return page_batches(fetch, _boards(partition), int(self.options.get("batch", 1000)), int(self.options.get("retries", 3)), keep_going=False)

        def commit(self, end: dict) -> None:
            """Nothing is kept here: the offset is in the checkpoint."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return (PagesOfSome if self.options.get("push") == "true" else Pages)(dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PageStream(dict(self.options))

    return Source


def actions(paged: DataFrame) -> DataFrame:
    """The log of rows of PAGES, batch or stream; errors are left out, so where pages were read with ``keep_going``
    the log is whole only if :func:`failed_boards` has no rows."""
    rows = paged.filter("error IS NULL").select("board_id", "pos", F.from_json("action", ACTION).alias("a"))
    return flatten(rows.select("board_id", "pos", "a.*"))


def failed_boards(paged: DataFrame) -> DataFrame:
    """Boards whose pages broke off, and why."""
    return paged.filter("error IS NOT NULL").select("board_id", "error")


def write_board_ids(boards: DataFrame, path: str, tasks: int | None = None) -> None:
    """Files of board ids (column board_id; optionally since and before), one for each task that is to read them (four for
    each core, since boards and what of them lies in a refresh differ)."""
    columns = [F.coalesce(F.col(c), F.lit(null)) if c in boards.columns else F.lit("") for c, null in (("board_id", NULL), ("since", ""), ("before", ""))]
    boards.select(F.concat_ws("\t", *columns).alias("value")).repartition(tasks or 4 * boards.sparkSession.sparkContext.defaultParallelism).write.text(path)


def load_pages(spark: SparkSession, boards: DataFrame, fetch: Fetch, batch: int = 1000, tasks: int | None = None, name: str = "board_pages", keep_going: bool = True) -> DataFrame:
    """Rows of PAGES of the boards; a board with since and before is read in that time only, so that several rows cut
    a very large board into parts that are read side by side. ``keep_going``: a board that fails is a row with its error,
    else the query fails."""
    path = fresh_path(spark, "board-ids")
    write_board_ids(boards, path, tasks)
    spark.dataSource.register(page_source(fetch, name))
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(name).option("path", path).option("batch", batch).option("push", push).option("keep_going", keep_going).load()


#: Rows of a file of an archive; a page is read from the few files that its time lies in.
FILE_ROWS = 10_000
#: How dates are spelled in an archive.
SPELLED = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
#: What Spark calls the folder of a null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_pages(log: DataFrame, path: str) -> None:
    """An archive of actions that :func:`archived` serves page by page: JSON lines in Parquet, a folder for each board and
    day; its files are short and each holds a stretch of time, which its footer tells. Actions have numbers of their
    own (``nth``), which tell those of one date apart; no date is spelled as an empty string."""
    rows = nested(log).withColumn("day", F.to_date("date"))
    ordered = rows.repartitionByRange("board_id", "date").sortWithinPartitions("board_id", "day", "date", "pos")
    # after the shuffle: ranges are found on a sample of rows that are made whole, and lines are longer than rows
    date = F.date_format("date", SPELLED)
    lines = F.to_json(F.struct("pos", "id", "type", date.alias("date"), "idMemberCreator", "data")).alias("value")
    nth = F.monotonically_increasing_id().alias("nth")  # in order of pos, since a date lies in one range
    ordered.select("board_id", "day", F.coalesce(date, F.lit("")).alias("date"), nth, lines).write.partitionBy("board_id", "day").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


@lru_cache(maxsize=4096)
def _span(path: str) -> tuple[Cursor, Cursor]:
    """Bounds of the cursors in a file of an archive; files are never written again under their name."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        meta = pq.ParquetFile(f).metadata
    at = [meta.schema.names.index(c) for c in ("date", "nth")]
    stats = [[meta.row_group(k).column(c).statistics for c in at] for k in range(meta.num_row_groups)]
    if any(s is None or not s.has_min_max for group in stats for s in group):
        return ("", 0), ("\uffff", 0)
    return tuple(min(s.min for s in c) for c in zip(*stats, strict=True)), tuple(max(s.max for s in c) for c in zip(*stats, strict=True))


def _list(column: pa.ChunkedArray) -> list:
    """By numpy, which is faster, unless numbers with nulls would come back as floats."""
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


@lru_cache(maxsize=4)
def _rows(path: str) -> tuple[list[str], list[int], list[str]]:
    """Dates, nths and lines of a file of an archive, oldest first."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        rows = pq.ParquetFile(f).read(["date", "nth", "value"]).sort_by([("date", "ascending"), ("nth", "ascending")])
    return tuple(_list(c) for c in rows.columns)


def archived(path: str) -> Fetch:
    """A page function over an archive; it opens the days and files it needs, newest first, and hands lines on as they are.

    Cursors are (date, nth). Actions without a date are older than all others."""

    def fetch(board_id: str | None, before: str | Cursor | None, batch: int) -> list[Mapping]:
        system, inner = _open(path)
        root = path.removesuffix(inner)
        end = before if before is None or isinstance(before, tuple) else (before, 0)
        page: list[Mapping] = []
        folders = system.get_file_info(fs.FileSelector(f"{inner}/board_id={NULL_FOLDER if board_id is None else board_id}"))
        days = sorted(((f.path.rpartition("=")[2].replace(NULL_FOLDER, ""), f.path) for f in folders), reverse=True)
        if any(len(day) > 10 for day, _ in days):
            raise ValueError(f"board {board_id} has dates outside the years 0 to 9999, which do not compare as strings")
        for day, folder in days:
            if len(page) >= batch:
                break
            if end is None or day <= end[0][:10]:
                files = [root + f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.size and not f.base_name.startswith(("_", "."))]
                found: list[tuple] = []
                for (first, last), file in sorted(((_span(f), f) for f in files), key=lambda x: x[0][1], reverse=True):
                    if len(found) >= batch and found[batch - 1][:2] > last:
                        break
                    if end is None or first < end:
                        columns = dates, nths, _ = _rows(file)
                        stop = len(dates) if end is None else bisect_left(nths, end[1], bisect_left(dates, end[0]), bisect_right(dates, end[0]))
                        start = max(0, stop - batch)
                        found += zip(*(c[start:stop] for c in columns), strict=True)
                        found.sort(key=lambda a: a[:2], reverse=True)
                page += [Line(line, (at, k), date=at) for at, k, line in found[: batch - len(page)]]
        return page

    return fetch


def time_parts(log: DataFrame, rows: int = 50_000) -> DataFrame:
    """Boards (board_id, since, before) cut at hours into parts of about so many actions, to be read side by side."""
    hours = log.groupBy(F.col("board_id").cast("string").alias("board_id"), F.date_trunc("hour", "date").alias("hour")).count()
    by_hour = Window.partitionBy("board_id").orderBy("hour")
    nth = F.floor((F.sum("count").over(by_hour) - F.col("count")) / rows)
    parts = hours.select("board_id", "hour", nth.alias("part")).groupBy("board_id", "part").agg(F.date_format(F.min("hour"), SPELLED).alias("hour"))
    by_part = Window.partitionBy("board_id").orderBy("part")
    return parts.select("board_id", F.when(F.row_number().over(by_part) > 1, F.col("hour")).alias("since"), F.lead("hour").over(by_part).alias("before"))


def refresh(spark: SparkSession, ids: str, fetch: Fetch, out: str, checkpoint: str, clock: Callable[[], str] = now, batch: int = 1000, name: str = "board_pages") -> DataFrame:
    """Bring the stored log at ``out`` up to ``clock()``, from where it stopped; ``ids``: files of write_board_ids.

    What is dated since the last refresh is read once and stored once, also where a refresh was cut short
    between pages. Returns the whole stored log.
    """
    spark.dataSource.register(page_source(fetch, name, clock))
    stream = actions(spark.readStream.format(name).option("path", ids).option("batch", batch).load())
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
