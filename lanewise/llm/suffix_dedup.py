"""Removal of repeated byte strings by distributed prefix doubling over chosen positions.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Ranking every position would shuffle some twenty times the text. So in each round
a string of LENGTH bytes is ranked through one position in it: the one whose prefix of the
round's width has the least hash among those that fit inside. Strings side by side mostly
share it (a *stretch*), and equal strings have equal ranks, so nothing is missed.

1. Ranks of 1, 2, 4, ... bytes double inside the tasks up to the first width. Spark sorts
   (rank, document) pairs; ranks that only one document has leave.
2. The stretches left get the rank of all their bytes, beyond LENGTH. Spark sorts
   (rank, document); stretches that a smaller document has too are settled. Of the others,
   those leave whose prefix has no other stretch.
3. What is left is cut out of the texts and sorted by (rank, document) once more. Strings under
   a rank with at most FEW of them are compared byte by byte in the task that has the rank, the
   first one of each kind held. Other ranks are narrowed first, to ranks of 35 bytes. Under those
   that still have more than FEW strings doubling goes on to LENGTH: every string gets a rank of
   its own. A task settles what it can by itself: strings that a smaller document of its own has
   too leave as whole runs. Of the rest Spark sorts (string rank, document), the strings of the
   first document leave.

Ranks are hashes: of 64 bits where they only choose candidates, of 128 bits where they decide.
A rank that very many documents share is no hot group: each batch of a task sends two rows at
most into its group (the least and the greatest document); what the batch alone decides goes
along under a salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lanewise.llm.common import bounded_batches, discard, partitions, release, stage, table, unused

LENGTH = 50
#: Width of the prefixes that are ranked before strings of LENGTH bytes are.
PREFIX = 20
#: Strings under one prefix rank that a task compares (and so holds: some 100 bytes each) by itself.
FEW = 1 << 14
#: Bytes handled at once inside a task.
STEP = 1 << 18
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(29))
    a *= M2
    return a


def prefix_hashes(data: np.ndarray, size: int, by: np.uint64 = M1) -> np.ndarray:
    """Hash of the ``size`` bytes from each position, by doubling."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    while 2 * n <= size:
        h = _mix(h[:-n] * by + h[n:])
        n *= 2
    return h if n == size else _mix(h[: len(h) - (size - n)] * by + h[size - n :])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def stretches(column: pa.Array, length: int = LENGTH, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """Of all texts of a batch: row, first and last string start (bytes of the text), prefix hash; and the bytes."""
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    parts = []
    for at in range(0, max(0, len(data) - length + 1), STEP):
        piece = data[at : at + STEP + length - 1]
        least = sliding_min(prefix_hashes(piece, prefix), length - prefix + 1)
        n = len(least)
        fits = np.ones(n, bool)
        fresh = np.ones(n, bool)
        fresh[1:] = least[1:] != least[:-1]
        a, b = np.searchsorted(off, [at, at + n + length])
        for end in off[a : b + 1].tolist():
            fits[max(0, end - length + 1 - at) : max(0, end - at)] = False
            if 0 <= end - at < n:
                fresh[end - at] = True
        first = np.flatnonzero(fresh & fits)
        # a stretch ends before the next fresh start or where strings stop fitting
        stop = np.ones(n, bool)
        stop[:-1] = fresh[1:] | ~fits[1:]
        last = np.flatnonzero(stop & fits)
        row = np.searchsorted(off, first + at, side="right") - 1
        parts.append((row, first + at - off[row], last + at - off[row], least[first]))
    if not parts:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), data, off
    return (*(np.concatenate([p[k] for p in parts]) for k in range(4)), data, off)


def _salts(keys: list[np.ndarray], doc: np.ndarray, both_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and document, and for the rows in it: 0 for those of the least (and the greatest)
    document of their key in the batch, a salt for the others."""
    order = np.lexsort((doc, *keys[::-1]))
    d = doc[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    inner = d > d[start][group]
    if both_ends:
        inner &= d < d[np.append(start[1:], len(d)) - 1][group]
    return order, np.where(inner, (d * 2654435761 & 0x7FFFFFFF) | 1, 0).astype(np.int32)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], names=list(columns))


def _pairs(length: int, width: int, tagged: bool):
    """(doc, tag, text) to the distinct (h, salt, doc) of each batch; ``tagged``: (h, salt, doc, late, tag). Of texts that
    share a rank and a doc the first is enough to tell who else has the rank; the others are ``late``: they come
    after all that tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, _, h, _, _ = stretches(batch.column(2), length, width)
            doc, tag = (batch.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1))
            if tagged:
                by_tag = np.argsort(tag, kind="stable")
                h, doc, tag = h[by_tag], doc[by_tag], tag[by_tag]
            order, salt = _salts([h], doc, True)
            h, doc, tag = h[order], doc[order], tag[order]
            late = np.zeros(len(h), bool)
            late[1:] = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
            keep = ~late
            if tagged:
                keep[1:] |= tag[1:] != tag[:-1]
            more = {"late": late[keep], "tag": tag[keep]} if tagged else {}
            yield _batch({"h": h[keep], "salt": salt[keep], "doc": doc[keep]} | more)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, doc (and tag) of rows sorted by (h, salt, (late,) doc) whose rank two documents have. Rows with a salt are of that
    kind; of the others, only those of the last rank's first document are held, and late ones never."""
    held: list[pa.Table] = []
    told = False  # whether the rows held are out already; then one stands for all
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        aside = [c for c in ("salt", "late") if c in rows.column_names]
        salted = rows.column("salt").to_numpy() != 0
        if salted.any():
            yield from rows.filter(pa.array(salted)).drop_columns(aside).to_batches()
        rows = pa.concat_tables([*held, rows.filter(pa.array(~salted))]).combine_chunks()
        if not rows.num_rows:
            continue
        h, d = rows.column("h").to_numpy(), rows.column("doc").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
        several = np.maximum.reduceat(d, start) > d[start]
        several[0] |= told
        out = several[group]
        if told:
            out[0] = False
        told = bool(several[-1])
        last = np.flatnonzero(group == len(start) - 1)
        late = len(aside) > 1 and rows.column("late")[int(last[-1])].as_py()
        # where late rows have begun nothing more comes that tells
        held = [rows.take(pa.array(last[:1] if told or late else last))]
        yield from rows.filter(pa.array(out)).drop_columns(aside).to_batches()


def _lists(column: pa.Array) -> list[np.ndarray]:
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


DECIDED = "c1 long, c2 long, salt int, h long, doc long, tag long, s long, e long"


def _decided(c1: np.ndarray, c2: np.ndarray, h: np.ndarray, doc: np.ndarray, tag: np.ndarray, s: np.ndarray, e: np.ndarray, more: list | None = None) -> pa.RecordBatch:
    """Rows of DECIDED in the order of their ranks; with ``more``, rows of CONTEXTS without bytes."""
    order, salt = _salts([c1, c2], doc, False)
    c1, c2, h, doc, tag, s, e = (x[order] for x in (c1, c2, h, doc, tag, s, e))
    out = _batch({"c1": c1, "c2": c2, "salt": salt, "h": h, "doc": doc, "tag": tag, "s": s, "e": e})
    if more is None:
        return out
    return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(len(s), pa.binary()), pa.array([more[k] for k in order], pa.binary())], names=[*out.schema.names, "bytes", "more"])


def _stretch_ranks(length: int, width: int):
    """(doc, tag, text, shared prefix ranks) to rows of stretches under these ranks; c1, c2: rank of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, s, e, h, data, off = stretches(batch.column(2), length, width)
            doc, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            bounds = np.searchsorted(row, np.arange(len(doc) + 1))
            keep = np.zeros(len(row), bool)
            for k, ranks in enumerate(_lists(batch.column(3))):
                a, b = bounds[k], bounds[k + 1]
                if b > a:
                    keep[a:b] = np.isin(h[a:b].view(np.int64), ranks)
            row, s, e, h = row[keep], s[keep], e[keep], h[keep]
            raw = data.tobytes()
            c = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((off[row] + s).tolist(), (off[row] + e + length).tolist(), strict=True)), np.int64).reshape(-1, 2)
            yield _decided(c[:, 0].copy(), c[:, 1].copy(), h, doc[row], tags[row], s, e)

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (c1, c2, salt, doc), whether a smaller document has the same rank; one rank is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        later, held = _later(batch, held)
        yield pa.RecordBatch.from_arrays([pa.array(later), *(batch.column(k) for k in ("doc", "tag", "h", "s", "e"))], names=["settled", "doc", "tag", "h", "s", "e"])


def _later(batch: pa.RecordBatch, held: tuple | None) -> tuple[np.ndarray, tuple]:
    c1, c2, salt, doc = (batch.column(k).to_numpy() for k in ("c1", "c2", "salt", "doc"))
    fresh = np.concatenate([[held is None or (c1[0], c2[0]) != held[:2]], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
    first = np.concatenate([[held[2] if held else 0], doc[fresh]])
    return (salt != 0) | (doc > first[np.cumsum(fresh)]), (c1[-1], c2[-1], first[-1])


#: bytes: of a stretch whose strings are compared; c1: there, whether h is narrowed; more: further runs of a ranked string in the same text (pairs of longs).
CONTEXTS = f"{DECIDED}, bytes binary, more binary"


def _strings(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Of rows (h, doc, tag, s, bytes) all bytes, and of each string where it starts in them, its row, and its place there."""
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    size = np.array([len(r[4]) for r in rows])
    n = size - length + 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, np.repeat(np.cumsum(size) - size, n) + step, np.repeat(np.arange(len(rows)), n), step


def _with_bytes(h: list, doc: list, tag: list, s: list, e: list, own: list, narrowed: int) -> pa.RecordBatch:
    none = pa.array([0] * len(h), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([narrowed] * len(h), pa.int64()), none, none.cast(pa.int32()), *(pa.array(x, pa.int64()) for x in (h, doc, tag, s, e)), pa.array(own, pa.binary()), pa.nulls(len(h), pa.binary())], names=["c1", "c2", "salt", "h", "doc", "tag", "s", "e", "bytes", "more"])


def _contexts(length: int):
    """(doc, tag, text, marks of four longs: h, s, e, whether h has many strings) to rows of CONTEXTS with the bytes of
    each stretch. Under a rank with many strings stretches are narrowed (c1 is 1): h is a rank of more bytes, which
    is chosen in each string as the prefix is."""

    def plain(rows: list[tuple]) -> pa.RecordBatch:
        h, doc, tag, s, own = zip(*rows, strict=True)
        return _with_bytes(h, doc, tag, s, [a + len(b) - length for a, b in zip(s, own, strict=True)], own, 0)

    def narrowed(rows: list[tuple]) -> pa.RecordBatch:
        data, at, row, step = _strings(rows, length)
        width = (PREFIX + length) // 2
        least = sliding_min(prefix_hashes(data, width), length - width + 1)[at]
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
        last, row = np.append(first[1:], len(at)) - 1, row[first]
        h, doc, tag, s = (np.array([r[c] for r in rows], np.int64)[row] for c in range(4))
        h = _mix(h.view(np.uint64) * M1 + least[first]).view(np.int64)
        raw = data.tobytes()
        own = [raw[a : b + length] for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)]
        return _with_bytes(h, doc, tag, s + step[first], s + step[last], own, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[tuple]] = [[], []]
            size = [0, 0]
            for doc, tag, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _lists(batch.column(3)), strict=True):
                data = text.as_py().encode()
                for h, s, e, many in marks.reshape(-1, 4).tolist():
                    for at in range(s, e + 1, STEP):
                        stop = min(e, at + STEP - 1)
                        held[many].append((h, doc, tag, at, data[at : stop + length]))
                        size[many] += stop - at + length
                        if size[many] >= STEP:
                            yield (plain, narrowed)[many](held[many])
                            held[many], size[many] = [], 0
            for many, make in enumerate((plain, narrowed)):
                if held[many]:
                    yield make(held[many])

    return run


def _ranks(length: int):
    """(h, doc, tag, s, bytes) to rows of CONTEXTS without bytes: of each string that is held at once the first document's,
    and of the other documents the runs of such strings, which are settled here."""

    def ranked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data, at, row, step = _strings(rows, length)
        k1, k2 = prefix_hashes(data, length)[at], prefix_hashes(data, length, M3)[at]
        first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (row[1:] != row[:-1])]))
        last, row = np.append(first[1:], len(at)) - 1, row[first]
        h, doc, tag, s = (np.array([r[c] for r in rows], np.int64)[row] for c in range(4))
        s, e, k1, k2 = s + step[first], s + step[last], k1[first], k2[first]
        order = np.lexsort((s, tag, doc, k2, k1))
        h, doc, tag, s, e, k1, k2 = (x[order] for x in (h, doc, tag, s, e, k1, k2))
        fresh = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        later = doc > doc[fresh][np.cumsum(fresh) - 1]
        yield from known(*(x[later] for x in (h, doc, tag, s, e)))
        h, doc, tag, s, e, k1, k2 = (x[~later] for x in (h, doc, tag, s, e, k1, k2))
        new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (k1, k2, doc, tag)], axis=0)]))
        runs = np.stack([s, e], axis=1)
        more = [runs[a + 1 : b].tobytes() if b > a + 1 else None for a, b in zip(new.tolist(), [*new[1:].tolist(), len(s)], strict=True)]
        yield _decided(*(x[new] for x in (k1, k2, h, doc, tag, s, e)), more)

    def known(h: np.ndarray, doc: np.ndarray, tag: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Strings that these rows alone decide: those side by side are one run, under a salt."""
        if not len(s):
            return
        order = np.lexsort((s, tag, doc))
        h, doc, tag, s, e = (x[order] for x in (h, doc, tag, s, e))
        start = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (doc, tag)], axis=0) | (s[1:] != e[:-1] + 1)]))
        none = np.zeros(len(start), np.int64)
        salt = ((doc[start] * 2654435761 & 0x7FFFFFFF) | 1).astype(np.int32)
        made = _batch({"c1": none, "c2": none, "salt": salt, "h": h[start], "doc": doc[start], "tag": tag[start], "s": s[start], "e": e[np.append(start[1:], len(s)) - 1]})
        yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(len(start), pa.binary()), pa.nulls(len(start), pa.binary())], names=[*made.schema.names, "bytes", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[4])
                if size >= 4 * STEP:
                    yield from ranked(held)
                    held, size = [], 0
        if held:
            yield from ranked(held)

    return run


def _compare(length: int):
    """Of rows sorted by (h, c1, c2, salt, doc), the runs of strings that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tag", "s", "e"]
        h0, seen, held = None, {}, None
        for batch in batches:
            ranked, rest = (batch.filter(m) for m in (batch.column("bytes").is_null(), batch.column("bytes").is_valid()))
            out: list[tuple] = []
            for h, doc, tag, s, data in zip(*(rest.column(c).to_pylist() for c in ("h", "doc", "tag", "s", "bytes")), strict=True):
                if h != h0:
                    h0, seen = h, {}
                start = None
                for p in range(len(data) - length + 1):
                    known = seen.setdefault(data[p : p + length], doc) < doc
                    if known and start is None:
                        start = p
                    elif not known and start is not None:
                        out.append((doc, tag, s + start, s + p - 1))
                        start = None
                if start is not None:
                    out.append((doc, tag, s + start, s + len(data) - length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)
            if ranked.num_rows:
                later, held = _later(ranked, held)
                told = ranked.filter(pa.array(later))
                yield told.select(names)
                told = told.filter(told.column("more").is_valid())
                for doc, tag, runs in zip(*(told.column(c).to_pylist() for c in ("doc", "tag", "more")), strict=True):
                    s, e = np.frombuffer(runs, np.int64).reshape(-1, 2).T
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(s), pa.int64()) for x in (doc, tag)] + [pa.array(s.copy()), pa.array(e.copy())], names=names)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by (doc, tag, s), those that touch as one."""
    names = ["doc", "tag", "s", "e"]
    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        doc, tag, s, e = (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True))
        if not len(doc):
            continue
        other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        base = np.cumsum(other) << 40  # keeps the texts apart under a running maximum
        reach = np.maximum.accumulate(base + e)
        start = np.flatnonzero(other | np.concatenate([[True], (base + s)[1:] > reach[:-1] + 1]))
        stop = np.append(start[1:], len(doc)) - 1
        made = [doc[start], tag[start], s[start], (reach - base)[stop]]
        held = [x[-1:] for x in made]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in made], names=names)
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)


def contexts(source: DataFrame, settled: DataFrame, length: int, few: int = FEW) -> DataFrame:
    """Rows of CONTEXTS of the stretches that are not settled and whose prefix has another one."""
    left = settled.filter("NOT settled")
    own = F.struct("doc", "tag", "s")
    several = left.groupBy("h").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.sum(F.col("e") - F.col("s") + 1).alias("n")).filter("a <> b")
    # staged, so that Spark sees both sides of the join and may split a hot rank
    several = stage(several.select("h", (F.col("n") > few).cast("long").alias("many")), "several")
    marks = left.join(several, "h").groupBy("doc", "tag").agg(F.flatten(F.collect_set(F.array("h", "s", "e", "many"))).alias("marks"))
    columns = [c.split(" ")[0] for c in CONTEXTS.split(", ")]
    rows = stage(source.join(marks, ["doc", "tag"]).select("doc", "tag", "text", "marks").mapInArrow(_contexts(length), CONTEXTS), "contexts")
    release(source.sparkSession)
    narrowed = rows.filter("c1 <> 0")
    hot = stage(narrowed.groupBy("h").agg(F.sum(F.col("e") - F.col("s") + 1).alias("n")).filter(F.col("n") > few).select("h"), "hot")
    ranked = narrowed.join(hot, "h", "left_semi").select("h", "doc", "tag", "s", "bytes").mapInArrow(_ranks(length), CONTEXTS)
    return rows.join(hot, "h", "left_anti").select(columns).unionByName(ranked)


def tag_of(docs: DataFrame) -> Column | None:
    """What tells texts that share a doc_id apart: a hash of the text. None where no doc_id stands twice, which one
    pass over the ids tells."""
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    return None if twice.isEmpty() else F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)


def repeated_strings(docs: DataFrame, tag: Column | None, length: int = LENGTH) -> DataFrame:
    """(doc, tag, marks) of documents with strings that start in a smaller one too; marks: an array
    of longs, two for each run of such strings: first and last start. ``tag``: see :func:`tag_of`; None: 0."""
    spark = docs.sparkSession
    n = partitions(spark)
    zero = F.lit(0).cast("long")
    source = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(F.col("doc_id").cast("long").alias("doc"), (zero if tag is None else tag).alias("tag"), "text")
    more, order, keys = ("", ["h", "salt", "doc"], ["doc"]) if tag is None else (", late boolean, tag long", ["h", "salt", "late", "doc"], ["doc", "tag"])
    pairs = source.mapInArrow(_pairs(length, PREFIX, tag is not None), f"h long, salt int, doc long{more}").repartition(n, "h", "salt").sortWithinPartitions(*order)
    shared = pairs.mapInArrow(_shared, "h long, doc long" + ("" if tag is None else ", tag long")).groupBy(*keys).agg(F.collect_set("h").alias("ranks"))
    shared = stage(shared.select("doc", (zero if tag is None else F.col("tag")).alias("tag"), "ranks"), "shared")
    release(spark)
    rows = source.join(shared, ["doc", "tag"]).select("doc", "tag", "text", "ranks").mapInArrow(_stretch_ranks(length, PREFIX), DECIDED)
    settled = rows.repartition(n, "c1", "salt").sortWithinPartitions("c1", "c2", "salt", "doc").mapInArrow(_first, "settled boolean, doc long, tag long, h long, s long, e long")
    settled = stage(settled, "settled")
    discard(shared)
    release(spark)
    runs = "doc long, tag long, s long, e long"
    compared = contexts(source, settled, length).repartition(n, "h", "c1", "salt").sortWithinPartitions("h", "c1", "c2", "salt", "doc").mapInArrow(_compare(length), runs)
    compared = stage(compared.repartition(n, "doc", "tag").sortWithinPartitions("doc", "tag", "s").mapInArrow(_runs, runs), "compared")
    release(spark)
    marks = settled.filter("settled").select("doc", "tag", "s", "e").unionByName(compared)
    return marks.groupBy("doc", "tag").agg(F.flatten(F.collect_set(F.array("s", "e"))).alias("marks"))


def covered(data: bytes, marks: np.ndarray | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of a text, and the maximal removed runs as [start, stop)."""
    if marks is None or not len(marks):
        return data, []
    marks = np.asarray(marks).reshape(-1, 2)
    delta = np.zeros(len(data) + 1, np.int64)
    np.add.at(delta, marks[:, 0], 1)
    np.add.at(delta, marks[:, 1] + length, -1)
    gone = np.cumsum(delta)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and others) and three more, which replace columns of their name:

    kept (the remaining bytes), kept_text (these as text, without characters that a cut
    halves) and spans (the removed runs, as offsets of the UTF-8 text).
    Strings are judged on the texts as given. Null texts are empty. Rows with a null doc_id
    have no place in the order: nothing is removed from them or because of them. Rows that
    share a doc_id remove nothing from each other. doc_id is an integer (TypeError else).
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    bounded_batches(spark)
    known_tag = tag_of(docs)
    marks = repeated_strings(docs, known_tag, length)

    @F.pandas_udf("kept binary, kept_text string, spans array<struct<start:bigint,stop:bigint>>")
    def cut(text, marks):
        import pandas as pd

        rows = [covered(t.encode(), m, length) for t, m in zip(text, marks, strict=True)]
        return pd.DataFrame({"kept": [k for k, _ in rows], "kept_text": [k.decode("utf-8", "ignore") for k, _ in rows], "spans": [[{"start": a, "stop": b} for a, b in s] for _, s in rows]})

    added = ("kept", "kept_text", "spans")
    own, done, tag = unused(docs, "marks"), unused(docs, "cut"), unused(docs, "tag")
    rest = docs.drop(*added).withColumn(tag, F.lit(0).cast("long") if known_tag is None else known_tag)
    joined = rest.join(marks.select(F.col("doc").alias("doc_id"), F.col("tag").alias(tag), F.col("marks").alias(own)), ["doc_id", tag], "left")
    return joined.withColumn(done, cut(F.coalesce("text", F.lit("")), own)).select(*[c for c in docs.columns if c not in added], f"{done}.*")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes over all whole ``documents``."""
    out = suffix_dedup(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
