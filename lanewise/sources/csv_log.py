"""Flat logs in CSV files of any headers, in one scan.

Tasks read lines. A task that has a whole file parses it, with the file's own header. A large file
is several tasks, and none of them knows whether it begins inside quotes; each says by how many
quotes it turns that over, these are summed up along the file, and then each piece is cut into
records. A record that goes over pieces is put together again; headers meet their pieces by file.
"""

from __future__ import annotations

import csv
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.sources.board_log import CSV_COLUMNS, LOG
from lanewise.staging import discard, stage

#: Characters of a piece of a large file.
PIECE = 1 << 20
ROWS = 2048
SCANNED = "file string, fields array<string>, start long, k int, text string, odd int"


def _fields(names: list[str], record: list[str]) -> list[str | None]:
    """The index, then the columns of CSV_COLUMNS; what is empty or missing is null."""
    found = dict(zip(names, record))
    return [record[0] or None, *(found.get(c) or None for c in CSV_COLUMNS)]


def _records(names: list[str] | None, lines: Iterator[str]) -> Iterator[list[str | None]]:
    reader = csv.reader(lines)
    for record in reader:
        if not record:
            continue
        if names is None:
            names = [record[0].removeprefix("﻿"), *record[1:]]
        else:
            yield _fields(names, record)


def _scan(piece: int):
    """Lines to the fields of whole files, and to pieces of others."""
    target = pa.schema([("file", pa.string()), ("fields", pa.list_(pa.string())), ("start", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("odd", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (file, start, whole), lines in itertools.groupby(rows(batches), key=lambda r: r[:3]):
            if whole:
                for fields in _records(None, (r[3] + "\n" for r in lines)):
                    yield {"file": file, "fields": fields}
                continue
            k, held, size = 0, [], 0
            for r in lines:
                if held and size + len(r[3]) > piece:
                    yield {"file": file, "start": start, "k": k, "text": "\n".join(held), "odd": sum(x.count('"') for x in held) % 2}
                    k, held, size = k + 1, [], 0
                held.append(r[3])
                size += len(r[3])
            yield {"file": file, "start": start, "k": k, "text": "\n".join(held), "odd": sum(x.count('"') for x in held) % 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in found(batches):
            held.append(row)
            size += len(row.get("text") or "")
            if len(held) >= ROWS or size > PIECE:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    return run


#: Parts of a piece: the end of a record begun before, whole records, a record begun, and the header.
END, WHOLE, BEGUN, HEADER = range(4)


def cut(text: str, inside: bool, first: bool) -> list[tuple[int, str]]:
    """Parts of a piece that begins inside quotes or not; ``first``: it begins with the file's header."""
    lines = text.split("\n")
    out: list[tuple[int, str]] = []
    begun, last, openly = 0, 0, inside  # begin of the record that is read, end of the last whole one
    if inside:
        for k, line in enumerate(lines):
            if line.count('"') % 2:
                begun = last = k + 1
                openly = False
                break
        else:
            return [(END, text)]
        out.append((END, "\n".join(lines[:begun])))
    whole = begun
    for k in range(begun, len(lines)):
        if lines[k].count('"') % 2:
            openly = not openly
        if not openly:
            last = k + 1
            if first and "".join(lines[whole:last]).strip("﻿\r "):
                out.append((HEADER, "\n".join(lines[whole:last]).removeprefix("﻿")))
                first, whole = False, last
    if first and last < len(lines):
        raise ValueError(f"the header of a file goes over {len(text)} characters")
    if last > whole:
        out.append((WHOLE, "\n".join(lines[whole:last])))
    if last < len(lines):
        out.append((BEGUN, "\n".join(lines[last:])))
    return out


def _map(df: DataFrame, schema: str, one) -> DataFrame:
    """``one`` gives the rows (as tuples) of each row (as a dict)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(one(row))
                for k in range(0, len(out), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + ROWS], strict=True), target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def _of_pieces(pieces: DataFrame) -> DataFrame:
    """file, fields of files in several pieces (file, start, k, text, odd)."""
    narrow = pieces.select("file", "start", "k", "odd")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = narrow.groupBy("file", "start").agg(F.sum("odd").alias("n"))
    blocks = blocks.select("file", "start", F.coalesce(F.sum("n").over(upto(Window.partitionBy("file").orderBy("start"))), F.lit(0)).alias("before"))
    own = narrow.withColumn("own", F.coalesce(F.sum("odd").over(upto(Window.partitionBy("file", "start").orderBy("k"))), F.lit(0)))
    states = stage(own.join(blocks, ["file", "start"]).select("file", "start", "k", ((F.col("own") + F.col("before")) % 2 == 1).alias("inside")), "csv-states")
    known = pieces.select("file", "start", "k", "text").join(states, ["file", "start", "k"])
    parts = stage(_map(known, "file string, start long, k int, part int, text string", lambda r: [(r["file"], r["start"], r["k"], p, t) for p, t in cut(r["text"], r["inside"], r["start"] == 0 and r["k"] == 0)]), "csv-parts")
    headers = stage(parts.filter(F.col("part") == HEADER).select("file", F.col("text").alias("header")), "csv-headers")
    along = Window.partitionBy("file").orderBy("start", "k", "part")
    ends = parts.filter(F.col("part").isin(BEGUN, END)).withColumn("nth", F.count_if(F.col("part") == BEGUN).over(along))
    joined = ends.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "k", "part", "text"))).alias("p")).select("file", F.array_join("p.text", "\n").alias("text"))
    texts = parts.filter(F.col("part") == WHOLE).select("file", "text").unionByName(joined).join(headers, "file")

    def parse(r: dict) -> Iterator[tuple]:
        names = next(csv.reader(_lines(r["header"])))
        return ((r["file"], f) for f in _records(names, _lines(r["text"])))

    return _map(texts, "file string, fields array<string>", parse)


def _lines(text: str) -> Iterator[str]:
    return (x + "\n" for x in text.split("\n"))


def read_csv(spark: SparkSession, path: str, board: Column | None = None, piece: int = PIECE) -> DataFrame:
    """Flat logs with dotted column names and an index column, a file per board.

    Files may have different columns in any order, unknown ones too; fields may hold quotes (doubled),
    commas and line ends. ``board``: its id, from the column ``file`` (the file's path); by default the
    file's name without .csv. Empty files give no rows. One scan, whatever the number of files and
    headers; nothing is gathered. A header must fit in a piece.
    """
    meta = F.col("_metadata")
    whole = (meta["file_block_start"] == 0) & (meta["file_block_length"] == meta["file_size"])
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), whole.alias("whole"), "value")
    scanned = stage(lines.mapInArrow(_scan(piece), SCANNED), "csv")
    pieces = scanned.filter("text IS NOT NULL")
    rows = scanned.filter("text IS NULL").select("file", "fields")
    if not pieces.isEmpty():
        rows = stage(rows.unionByName(_of_pieces(pieces)), "csv-rows")
        discard(scanned)
    kinds = dict(c.split(" ") for c in LOG.split(", "))
    if board is None:
        name = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.csv$", "")
        board = F.url_decode(F.regexp_replace(name, r"\+", "%2B"))
    value = {new: F.get("fields", F.lit(k + 1)).cast(kinds[new]).alias(new) for k, new in enumerate(CSV_COLUMNS.values())}
    value |= {"pos": (-F.get("fields", F.lit(0)).cast("double").cast("long")).alias("pos"), "board_id": board.alias("board_id")}
    return rows.select([value[c] for c in kinds])
