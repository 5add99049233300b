"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is segmented into the pieces of a vocabulary with the largest sum of scores; of equal
segmentations the one with the longest last piece wins, then the one with the longest piece
before it, and so on. Scores are whole multiples of 1 / SCALE, so sums are exact whatever the
order of adding, and every search below gives the same ids.

Giant texts are cut into chunks of a fixed length, wherever that falls. A piece may straddle a
cut by up to M - 1 characters (M: longest piece), so the state at a cut is how many characters
of the next chunk its last piece takes. Each chunk gives an M x M matrix in the (max, +)
algebra: best score by entry and exit state. Products of the matrices are associative: blocks
of chunks are multiplied side by side, then blocks of a text, which gives the exact scores at
each cut. From these every chunk is traced back by itself, for every exit state; where the
traces enter then picks one of them for each chunk.

No piece goes over a blank that follows another character, so a text falls into units there,
blanks first. A chunk's matrix is the product of those of its units. Between its first and its
last bound of units these are single numbers, the scores of the units' best segmentations,
which the library finds; only the units that cuts go through, and chunks without a bound, need
all states. Units of over LONG characters, where the library's 32-bit sums might not be exact,
are searched here.

A vocabulary of merges has ranks in place of log probabilities; these become Zipf log
probabilities, -ln(rank + 2). Bytes stand for characters without a piece, and for U+2581,
which is the vocabulary's sign for a blank; so any text comes back whole. No model is trained.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, bounded_batches, partitions, stage, table, unused

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters in a chunk; texts over it are cut.
CHUNK = 16_384
#: Chunks whose matrices one task multiplies.
BLOCK = 64
#: Scores are rounded to multiples of 1 / SCALE. 32-bit sums of up to 2**24 / SCALE are exact.
SCALE = 1024
#: Characters of the longest unit that the library searches; less where characters cost more than 32 each. Ids do not depend on it.
LONG = 512
#: Units of up to so many characters are remembered, so many of them.
KNOWN_CHARS, KNOWN = 24, 1 << 16
NONE = -(1 << 60)
UNIT = re.compile(r" *[^ ]+| +\Z")
INNER = re.compile("[^ ] ")


class Pieces:
    """The model with log-probability scores, without a dummy prefix of its own."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        if model.trainer_spec.model_type == 2:
            for p in model.pieces:
                if p.type == 1:
                    p.score = -math.log(2 - p.score)
        for p in model.pieces:
            if p.type == 1:
                p.score = round(p.score * SCALE) / SCALE
        model.trainer_spec.model_type = 1
        model.normalizer_spec.add_dummy_prefix = False
        self.lib = sentencepiece.SentencePieceProcessor()
        self.lib.LoadFromSerializedProto(model.SerializeToString())
        self.pieces = [p.piece for p in model.pieces]
        normal = [p.piece for p in model.pieces if p.type == 1]
        self.longest = max(map(len, normal))
        self.known: dict[str, list[int]] = {}
        score = [p.score for p in model.pieces if p.type == 1]
        unknown = min(score) - 10.0
        self.score = np.full(len(self.pieces), 0.0)
        self.byte_of: dict[int, int] = {}
        for k, p in enumerate(model.pieces):
            if p.type == 1:
                self.score[k] = p.score
            elif p.type == 6:
                b = int(p.piece[1:-1], 16)
                self.byte_of[k] = b
                self.score[k] = 0.0 if 0x80 <= b < 0xC0 else unknown  # a character counts once, at its first byte
        self.id_of_byte = {b: k for k, b in self.byte_of.items()}
        self.is_byte = np.isin(np.arange(len(self.pieces)), list(self.byte_of))
        self.plain = [p.replace(BLANK, " ") for p in self.pieces]
        #: Whether a blank that follows another character always begins a unit.
        self.free_cuts = not any(BLANK in p.lstrip(BLANK) for p in normal)
        self.unknown = round(unknown * SCALE)
        self.gain = np.rint(self.score * SCALE).astype(np.int64)
        self.long = min(LONG, 2**24 // -self.unknown)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            ids = np.array([k for k, p in enumerate(model.pieces) if p.type == 1 and len(p.piece) == n], np.int64)
            if len(ids):
                h = functools.reduce(_extend, np.array([list(map(ord, self.pieces[k])) for k in ids], np.uint64).T, np.zeros(len(ids), np.uint64))
                order = np.argsort(h)
                self.by_length[n] = h[order], ids[order], self.gain[ids[order]]

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins and ends at bounds of units; it has its leading blank already."""
        out: list[int] = []
        for unit in UNIT.findall(text) if self.free_cuts else [text] if text else []:
            found = self.known.get(unit)
            out += self._unit(unit) if found is None else found
        return out

    def _unit(self, unit: str) -> list[int]:
        if len(unit) > self.long:
            w, ids = edges(self, unit, len(unit))
            entry = np.full(self.longest, NONE)
            entry[0] = 0
            return trace(self, unit, w, ids, forward(w[:, None], entry[None, None])[:, 0, 0], entry, [len(unit)])[0][1]
        out: list[int] = []
        sign = [self.id_of_byte[b] for b in BLANK.encode()]
        for k, part in enumerate(unit.split(BLANK)):
            out += (sign if k else []) + (self.lib.encode(part) if part else [])
        if len(unit) <= KNOWN_CHARS:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[unit] = out
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Blanks for their sign, runs of bytes as UTF-8, without the first blank."""
        at = np.flatnonzero(self.is_byte[ids])
        listed = ids.tolist()
        if not len(at):
            return "".join(map(self.plain.__getitem__, listed))[1:]
        out, done = [], 0
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            out += map(self.plain.__getitem__, listed[done:a])
            out.append(bytes(map(self.byte_of.__getitem__, listed[a:b])).decode("utf-8", "replace"))
            done = b
        return "".join([*out, *map(self.plain.__getitem__, listed[done:])])[1:]


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character longer."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h + c + np.uint64(1)


def edges(m: Pieces, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight and id of the piece of L + 1 characters at p, for p under ``size``; ids: -1 for a character without a piece."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = np.where(c == ord(BLANK), np.uint64(1 << 40), np.where(c == 32, np.uint64(ord(BLANK)), c))
    w = np.full((m.longest, size), NONE)
    ids = np.full((m.longest, size), -1)
    w[0] = m.unknown
    h = np.zeros(size, np.uint64)
    for n in range(1, m.longest + 1):
        fits = min(size, len(c) - n + 1)
        if fits <= 0:
            break
        h = _extend(h[:fits], c[n - 1 : n - 1 + fits])
        if n in m.by_length:
            hashes, found, weights = m.by_length[n]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            w[n - 1, hit], ids[n - 1, hit] = weights[k[hit]], found[k[hit]]
    return w, ids


def forward(w: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Best scores (place, text, entry vector) of texts with weights ``w`` (length, text, place), where ``entry``
    (text, vector, state) tells the scores with which pieces of the chunk before end at the first places."""
    n, texts, size = w.shape
    f = np.full((size + n + 1, texts, entry.shape[1]), NONE)
    f[:n] = entry.transpose(2, 0, 1)
    for p in range(size):
        reach = f[p + 1 : p + 1 + n]
        np.maximum(reach, f[p] + w[:, :, p, None], out=reach)
    return f


def trace(m: Pieces, text: str, w: np.ndarray, ids: np.ndarray, f: np.ndarray, entry: np.ndarray, exits: list[int]) -> list[tuple[int, list[int]]]:
    """Entry state and ids of the best path to each of the places ``exits``; (-1, []) where none leads."""
    n, size = w.shape
    back: dict[int, int] = {}
    out = []
    for v in exits:
        if f[v] <= NONE // 2:
            out.append((-1, []))
            continue
        path: list[int] = []
        while not (v < n and entry[v] == f[v]):  # a piece that began before the chunk is longer than any in it
            if v not in back:
                back[v] = next(p for p in range(max(0, v - n), v) if p < size and f[p] + w[v - p - 1, p] == f[v])
            p = back[v]
            k = int(ids[v - p - 1, p])
            path += [k] if k >= 0 else [m.id_of_byte[b] for b in reversed(text[p].encode())]
            v = p
        out.append((v, path[::-1]))
    return out


def transfers(m: Pieces, texts: list[str], sizes: list[int]) -> list[np.ndarray]:
    """For each text T[i, j]: best score of text[i : size + j]; it holds the chunk and what may follow it."""
    n = m.longest
    unit = np.where(np.eye(n, dtype=bool), 0, NONE)[None].repeat(len(texts), 0)
    w = np.full((n, len(texts), max(sizes)), NONE)
    for k, (text, size) in enumerate(zip(texts, sizes, strict=True)):
        w[:, k, :size] = edges(m, text, size)[0]
    f = forward(w, unit)
    return [f[size : size + n, k].T for k, size in enumerate(sizes)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NONE)


def inner_bounds(m: Pieces, piece: str, size: int) -> tuple[int, int]:
    """The first and the last place inside a chunk at which a unit begins, or (-1, -1)."""
    found = INNER.search(piece, 0, size) if m.free_cuts else None
    if found is None:
        return -1, -1
    last = piece.rfind(" ", 1, size)
    while piece[last - 1] == " ":
        last = piece.rfind(" ", 1, last)
    return found.start() + 1, last


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """All columns of ``docs`` (which has a text) and ids, an array of int.

    Null and empty texts have no ids. Rows may repeat: equal long texts are scanned once.
    An empty table gives an empty one. A column named ids is replaced, others pass through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("ids")
    key = unused(docs, "text_key")

    @F.pandas_udf("array<int>")
    def short(text):
        import pandas as pd

        m = pieces(model)
        return pd.Series([np.array(m.encode(" " + t), np.int32) if t else [] for t in text])

    size = F.length("text")
    near = docs.filter(F.coalesce(size, F.lit(0)) <= chunk).withColumn("ids", short(F.coalesce("text", F.lit(""))))
    far = docs.filter(size > chunk).withColumn(key, F.sha2("text", 256))
    texts = far.select(F.col(key).alias("text_key"), "text").dropDuplicates(["text_key"])
    scanned = scan(stage(matrices(texts, model, chunk), "chunks"), model)
    return near.unionByName(far.join(scanned.withColumnRenamed("text_key", key), key).drop(key))


def matrices(texts: DataFrame, model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk k of each text (text_key, text): its matrix t, row by row, and what its trace needs.

    head is what lies before its first bound of units, tail what lies behind the last, with the
    characters that its last piece may take from the next chunk; tail_size counts without these.
    body holds the ids in between. A chunk without a bound is all tail, and its head is null.
    """
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = " " + text
                at = range(0, len(text), chunk)
                columns = [key] * len(at), list(range(len(at))), [min(chunk, len(text) - a) for a in at], [text[a : a + chunk + m.longest] for a in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["text_key", "k", "size", "piece"])

    def made(batch: pa.RecordBatch) -> dict:
        m = pieces(model)
        n, few = m.longest, 16
        free = np.where(np.eye(n, dtype=bool), 0, NONE)
        out: dict = {"text_key": batch.column("text_key"), "k": batch.column("k"), "head": [], "body": [], "tail": [], "tail_size": [], "t": []}
        open_rows = []
        for row, (piece, size) in enumerate(zip(batch.column("piece").to_pylist(), batch.column("size").to_pylist(), strict=True)):
            first, last = inner_bounds(m, piece, size)
            head, body, tail, t = None, [], piece, None
            if first >= 0:
                head, body, tail = piece[:first], m.encode(piece[first:last]), piece[last:]
                size -= last
                into = forward(edges(m, head, first)[0][:, None], free[None])[first, 0]
                from_bound = forward(edges(m, tail, size)[0][:, None], free[None, :1])[size : size + n, 0, 0]
                t = product(into[:, None] + m.gain[body].sum(), from_bound[None]).ravel()
            else:
                open_rows.append(row)
            for c, v in zip(("head", "body", "tail", "tail_size", "t"), (head, body, tail, size, t), strict=True):
                out[c].append(v)
        for a in range(0, len(open_rows), few):
            some = open_rows[a : a + few]
            for row, t in zip(some, transfers(m, [out["tail"][r] for r in some], [out["tail_size"][r] for r in some]), strict=True):
                out["t"][row] = t.ravel()
        return out

    rows = texts.select("text_key", "text").mapInArrow(cut, "text_key string, k int, size int, piece string").repartition(partitions(spark), "text_key", "k")
    return arrow_map(rows, "text_key string, k int, head string, body array<int>, tail string, tail_size int, t array<long>", made)


def scan(chunks: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """text_key and ids of texts whose :func:`matrices` these are; the table is read several times."""
    n = pieces(model).longest
    block = ["text_key", "block"]
    mats = chunks.select("text_key", "k", F.expr(f"k div {BLOCK}").cast("int").alias("block"), "t")

    def multiply(pdf):
        whole = functools.reduce(product, (np.asarray(t).reshape(n, n) for t in pdf.sort_values("k")["t"]))
        return pdf[block].head(1).assign(t=[whole.ravel()])

    def along(entry, ts) -> list[np.ndarray]:
        """The scores with which each matrix is entered."""
        out = []
        for t in ts:
            out.append(entry)
            entry = product(entry, np.asarray(t).reshape(n, n))
        return out

    def over_blocks(pdf):
        start = np.full(n, NONE)
        start[0] = 0
        pdf = pdf.sort_values("block")
        return pdf[block].assign(entry=along(start, pdf["t"]))

    def inside(pdf, starts):
        pdf = pdf.sort_values("k")
        return pdf[["text_key", "k"]].assign(entry=along(np.asarray(starts["entry"].iloc[0]), pdf["t"]))

    products = mats.groupBy(*block).applyInPandas(multiply, "text_key string, block int, t array<long>")
    starts = products.groupBy("text_key").applyInPandas(over_blocks, "text_key string, block int, entry array<long>")
    scores = mats.groupBy(*block).cogroup(starts.groupBy(*block)).applyInPandas(inside, "text_key string, k int, entry array<long>")

    def traces(batch: pa.RecordBatch) -> dict:
        m = pieces(model)
        out: dict = {"text_key": batch.column("text_key"), "k": batch.column("k"), "enter": [], "head_ids": [], "tails": []}
        at_bound = np.full(n, NONE)
        at_bound[0] = 0

        def back(text, size, entry, exits):
            w, ids = edges(m, text, size)
            return trace(m, text, w, ids, forward(w[:, None], entry[None, None])[:, 0, 0], entry, exits)

        for head, tail, size, entry in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "tail_size", "entry")), strict=True):
            exits = list(range(size, size + n))
            if head is None:
                found = back(tail, size, np.array(entry), exits)
                out["enter"].append([e for e, _ in found])
                out["head_ids"].append([])
            else:
                ((enter, ids),) = back(head, len(head), np.array(entry), [len(head)])
                found = back(tail, size, at_bound, exits)
                out["enter"].append([enter] * n)
                out["head_ids"].append(ids)
            out["tails"].append([p for _, p in found])
        return out

    rows = chunks.select("text_key", "k", "head", "tail", "tail_size").join(scores, ["text_key", "k"])
    traced = stage(arrow_map(rows, "text_key string, k int, enter array<int>, head_ids array<int>, tails array<array<int>>", traces), "traces")

    def leave(pdf):
        pdf = pdf.sort_values("k")
        out, ahead = [], 0
        for enter in pdf["enter"][::-1]:
            out.append(ahead)
            ahead = int(enter[ahead])
        return pdf[["text_key", "k"]].assign(leave=out[::-1])

    chosen = traced.select("text_key", "k", "enter").groupBy("text_key").applyInPandas(leave, "text_key string, k int, leave int")
    ends = traced.join(chosen, ["text_key", "k"])
    part = lambda df, number, ids: df.select("text_key", "k", F.lit(number).alias("part"), ids.alias("ids"))
    parts = part(chunks, 1, F.col("body")).unionByName(part(ends, 0, F.col("head_ids"))).unionByName(part(ends, 2, F.get("tails", F.col("leave"))))
    whole = parts.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("k", "part", "ids"))).alias("p"))
    return whole.select("text_key", F.flatten(F.col("p.ids")).alias("ids"))


def decode(self, ids: np.ndarray) -> str:
        """Blanks for their sign, runs of bytes as UTF-8, without the first blank."""
        at = np.flatnonzero(self.is_byte[ids])
        listed = ids.tolist()
        if not len(at):
            return "".join(map(self.plain.__getitem__, listed))[1:]
        out, done = [], 0
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            out += map(self.plain.__getitem__, listed[done:a])
            out.append(bytes(map(self.byte_of.__getitem__, listed[a:b])).decode("utf-8", "replace"))
            done = b
        return "".join([*out, *map(self.plain.__getitem__, listed[done:])])[1:]


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character longer."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h + c + np.uint64(1)


def edges(m: Pieces, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight and id of the piece of L + 1 characters at p, for p under ``size``; ids: -1 for a character without a piece."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = np.where(c == ord(BLANK), np.uint64(1 << 40), np.where(c == 32, np.uint64(ord(BLANK)), c))
    w = np.full((m.longest, size), NONE)
    ids = np.full((m.longest, size), -1)
    w[0] = m.unknown
    h = np.zeros(size, np.uint64)
    for n in range(1, m.longest + 1):
        fits = min(size, len(c) - n + 1)
        if fits <= 0:
            break
        h = _extend(h[:fits], c[n - 1 : n - 1 + fits])
        if n in m.by_length:
            hashes, found, weights = m.by_length[n]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            w[n - 1, hit], ids[n - 1, hit] = weights[k[hit]], found[k[hit]]
    return w, ids


def forward(w: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Best scores (place, text, entry vector) of texts with weights ``w`` (length, text, place), where ``entry``
    (text, vector, state) tells the scores with which pieces of the chunk before end at the first places."""
    n, texts, size = w.shape
    f = np.full((size + n + 1, texts, entry.shape[1]), NONE)
    f[:n] = entry.transpose(2, 0, 1)
    for p in range(size):
        reach = f[p + 1 : p + 1 + n]
        np.maximum(reach, f[p] + w[:, :, p, None], out=reach)
    return f


def trace(m: Pieces, text: str, w: np.ndarray, ids: np.ndarray, f: np.ndarray, entry: np.ndarray, exits: list[int]) -> list[tuple[int, list[int]]]:
    """Entry state and ids of the best path to each of the places ``exits``; (-1, []) where none leads."""
    n, size = w.shape
    back: dict[int, int] = {}
    out = []
    for v in exits:
        if f[v] <= NONE // 2:
            out.append((-1, []))
            continue
        path: list[int] = []
        while not (v < n and entry[v] == f[v]):  # a piece that began before the chunk is longer than any in it
            if v not in back:
                back[v] = next(p for p in range(max(0, v - n), v) if p < size and f[p] + w[v - p - 1, p] == f[v])
            p = back[v]
            k = int(ids[v - p - 1, p])
            path += [k] if k >= 0 else [m.id_of_byte[b] for b in reversed(text[p].encode())]
            v = p
        out.append((v, path[::-1]))
    return out


def transfers(m: Pieces, texts: list[str], sizes: list[int]) -> list[np.ndarray]:
    """For each text T[i, j]: best score of text[i : size + j]; it holds the chunk and what may follow it."""
    n = m.longest
    unit = np.where(np.eye(n, dtype=bool), 0, NONE)[None].repeat(len(texts), 0)
    w = np.full((n, len(texts), max(sizes)), NONE)
    for k, (text, size) in enumerate(zip(texts, sizes, strict=True)):
        w[:, k, :size] = edges(m, text, size)[0]
    f = forward(w, unit)
    return [f[size : size + n, k].T for k, size in enumerate(sizes)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NONE)


def _bound(text: str, start: int, stop: int) -> int:
    """The first place in [start, stop) at which a unit begins, or -1."""
    return next((p for p in range(start, stop) if text[p] == " " and text[p - 1] != " "), -1)


def cuts(m: Pieces, text: str, chunk: int) -> list[int]:
    """Where the chunks of a text begin, and its end: at bounds of units, unless one is over LONG."""
    out = [0]
    for at in range(chunk, len(text), chunk):
        if at <= out[-1]:
            continue
        found = _bound(text, at, min(at + LONG, len(text))) if m.free_cuts else -1
        out.append(found if found >= 0 else at if at + LONG < len(text) else len(text))
    return out if out[-1] == len(text) else [*out, len(text)]


PIECES = "text_key string, k int, part int, soft_start boolean, soft_end boolean, size int, piece string, ids array<int>"


def _parts(m: Pieces, text: str, chunk: int) -> Iterator[tuple[int, int, bool, bool, int, str]]:
    """(chunk, part, whether it begins and ends at bounds of units, characters, text with what may follow)."""
    at = cuts(m, text, chunk)
    free = lambda p: p == 0 or p == len(text) or (m.free_cuts and text[p] == " " and text[p - 1] != " ")
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        soft = free(a), free(b)
        inner = [a, b]
        if soft != (True, True) and m.free_cuts:  # what lies between bounds of units is cut out
            bounds = [p for p in range(a + 1, b) if text[p] == " " and text[p - 1] != " "]
            if bounds:
                inner = [a, *([] if soft[0] else bounds[:1]), *([] if soft[1] else bounds[-1:]), b]
        inner = sorted(set(inner))
        for part, (x, y) in enumerate(zip(inner, inner[1:], strict=False)):
            yield k, part, free(x), free(y), y - x, text[x : y + (0 if free(y) else m.longest)]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """All columns of ``docs`` (which has a text) and ids, an array of int.

    Null and empty texts have no ids. Rows may repeat: equal long texts are scanned once.
    An empty table gives an empty one. A column named ids is replaced, others pass through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("ids")
    key = unused(docs, "text_key")

    @F.pandas_udf("array<int>")
    def short(text):
        import pandas as pd

        m = pieces(model)
        return pd.Series([np.array(m.encode(" " + t), np.int32) if t else [] for t in text])

    size = F.length("text")
    near = docs.filter(F.coalesce(size, F.lit(0)) <= chunk).withColumn("ids", short(F.coalesce("text", F.lit(""))))
    far = docs.filter(size > chunk).withColumn(key, F.sha2("text", 256))
    scanned = _scan(spark, far.select(F.col(key).alias("text_key"), "text").dropDuplicates(["text_key"]), model, chunk)
    return near.unionByName(far.join(scanned.withColumnRenamed("text_key", key), key).drop(key))


def _scan(spark: SparkSession, texts: DataFrame, model: str, chunk: int) -> DataFrame:
    """text_key and ids of long texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        names = ["text_key", "k", "part", "soft_start", "soft_end", "size", "piece"]
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(_parts(m, " " + text, chunk))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()), strict=True))], names=names)

    def plain(batch: pa.RecordBatch) -> dict:
        m = pieces(model)
        out = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        soft = [a and b for a, b in zip(out["soft_start"].to_pylist(), out["soft_end"].to_pylist(), strict=True)]
        texts = out["piece"].to_pylist()
        return out | {"ids": [m.encode(t) if s else None for t, s in zip(texts, soft, strict=True)], "piece": [None if s else t for t, s in zip(texts, soft, strict=True)]}

    rows = texts.mapInArrow(cut, PIECES.rpartition(",")[0]).repartition(partitions(spark), "text_key", "k")
    rows = stage(arrow_map(rows, PIECES, plain), "pieces")
    hard = rows.filter("piece IS NOT NULL").drop("ids")
    done = rows.filter("piece IS NULL").select("text_key", "k", "part", "ids")
    if not hard.isEmpty():
        done = done.unionByName(_hard(hard, model))
    whole = done.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("k", "part", "ids"))).alias("p"))
    return whole.select("text_key", F.flatten(F.col("p.ids")).alias("ids"))


def _hard(hard: DataFrame, model: str) -> DataFrame:
    """text_key, k, part and ids of parts of long units."""
    n = pieces(model).longest
    keys = ["text_key", "k", "part"]
    at = "text_key string, k int, part int"
    few = 16

    def matrices(batch: pa.RecordBatch) -> dict:
        m = pieces(model)
        texts, sizes = batch.column("piece").to_pylist(), batch.column("size").to_pylist()
        made = [t.ravel() for a in range(0, len(texts), few) for t in transfers(m, texts[a : a + few], sizes[a : a + few])]
        return {c: batch.column(c) for c in (*keys, "soft_start")} | {"t": made}

    def heads(pdf):
        pdf = pdf.sort_values(["k", "part"])
        at_start = np.full(n, NONE)
        at_start[0] = 0
        now, out = at_start, []
        for soft, t in zip(pdf["soft_start"], pdf["t"], strict=True):
            now = at_start if soft else now
            out.append(now)
            now = product(now, np.asarray(t).reshape(n, n))
        return pdf[keys].assign(entry=out)

    scores = arrow_map(hard, f"{at}, soft_start boolean, t array<long>", matrices).groupBy("text_key").applyInPandas(heads, f"{at}, entry array<long>")

    def traces(batch: pa.RecordBatch) -> dict:
        m = pieces(model)
        out = {c: batch.column(c) for c in (*keys, "soft_start", "soft_end")} | {"enter": [], "paths": []}
        for text, size, entry in zip(*(batch.column(c).to_pylist() for c in ("piece", "size", "entry")), strict=True):
            w, ids = edges(m, text, size)
            entry = np.array(entry)
            f = forward(w[:, None], entry[None, None])[:, 0, 0]
            found = trace(m, text, w, ids, f, entry, list(range(size, size + n)))
            out["enter"].append([e for e, _ in found])
            out["paths"].append([p for _, p in found])
        return out

    traced = stage(arrow_map(hard.join(scores, keys), f"{at}, soft_start boolean, soft_end boolean, enter array<int>, paths array<array<int>>", traces), "traces")

    def leave(pdf):
        pdf = pdf.sort_values(["k", "part"])
        out, ahead = [], 0
        for soft, enter in zip(pdf["soft_end"][::-1], pdf["enter"][::-1], strict=True):
            out.append(0 if soft else ahead)
            ahead = int(enter[out[-1]])
        return pdf[keys].assign(leave=out[::-1])

    chosen = traced.select(*keys, "soft_end", "enter").groupBy("text_key").applyInPandas(leave, f"{at}, leave int")
    return traced.join(chosen, keys).select(*keys, F.get("paths", F.col("leave")).alias("ids"))


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text that its ids stand for; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        m = pieces(model)
        return pd.Series([None if x is None else m.decode(np.asarray(x, np.int64)) for x in ids])

    return encoded.withColumn(out, text("ids"))


def digest(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with n_tokens, ids_sha256 (of comma-joined ids) and round_trip (decoding gives the text
    back), which replace columns of their name."""
    added = ["n_tokens", "ids_sha256", "round_trip"]

    @F.pandas_udf("n_tokens long, ids_sha256 string, round_trip boolean")
    def summary(ids, text):
        import pandas as pd

        m = pieces(model)
        rows = [(len(x), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest(), m.decode(x) == t) for x, t in zip((np.asarray(x, np.int64) for x in ids), text, strict=True)]
        return pd.DataFrame(rows, columns=added)

    found = unused(encoded, "digest")
    kept = encoded.drop(*added)
    return kept.withColumn(found, summary("ids", F.coalesce("text", F.lit("")))).select(*kept.columns, f"{found}.*")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    return digest(encode(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))).select("doc_id", "n_tokens", "ids_sha256", "round_trip")
