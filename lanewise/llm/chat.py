"""Transcript parsing: roles by a hidden Markov model over lines, then canonical turns.

A hidden state is a role with whether the line opens a turn. An observation is the speaker
marker of a line with features of the line.

The pieces of all transcripts are sorted by conversation and place, by ranges, so a hot
conversation spreads over many tasks. Each task cuts what it has of a conversation into
chunks of at most CHUNK lines. Conversations that are one chunk in the middle of a task, that
is nearly all, are decoded by Viterbi where they are, many at once. Of the others each chunk
gives a matrix of best scores between the state before it and its last one; the matrices of a
conversation are combined, first inside tasks, then over them, and each chunk is traced back
by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, bounded_batches, partitions, stage, table

ROLES = ("system", "user", "assistant")
#: Fixed speaker words of a marker, by role.
SPEAKERS = {"system": "system|sys|s", "user": "user|human|question|prompter|q", "assistant": "assistant|ai|bot|model|answer|a"}
N_STATES = 2 * len(ROLES)
#: The codes of lines with text, and one for blank lines.
N_OBSERVED = 4 * 2 * 2 * 2 + 1
AFTER_BLANK = 4
BLANK_CODE = N_OBSERVED - 1
#: Lines and characters of a conversation in a chunk.
CHUNK, CHUNK_CHARS = 4096, 1 << 20
MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|<\|)?(?:" + "|".join(f"({SPEAKERS[r]})" for r in ROLES) + r")\s*(?:\*\*\s*:|\|>|:\*\*|:|>)\s*", re.ASCII | re.IGNORECASE)
BLANK = re.compile(r"\s*\Z", re.ASCII)
QUESTION = re.compile(r"\?\s*\Z", re.ASCII)
LINE = re.compile(r"\r?\n")


def observe(line: str, after_blank: bool) -> int:
    """Code of marker (none or a role), blank line before, question, short line; or of a blank line."""
    if BLANK.match(line):
        return BLANK_CODE
    found = MARKER.match(line)
    return 8 * (found.lastindex if found else 0) + AFTER_BLANK * after_blank + 2 * bool(QUESTION.search(line, max(0, len(line) - 64))) + (len(line) < 60)


def bare(line: str) -> str:
    """An opening line without its marker."""
    found = MARKER.match(line)
    return line[found.end() :] if found else line


CHUNKS = "seg int, k int, open boolean, edge boolean, lines array<string>, seen array<int>, state array<int>, before int, last_blank boolean, last_state int"


def chunked(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of transcripts (see :func:`parse`), staged: conv_id, seg (task), k (number in it), the lines with codes
    and known states, the known state of the line before. ``edge``: not a whole conversation for certain."""
    spark = lines.sparkSession
    bounded_batches(spark)
    given = lambda c, t: (F.col(c) if c in lines.columns else F.lit(None)).cast(t).alias(c)
    rows = lines.select("conv_id", given("turn", "long"), given("line", "long"), F.coalesce("text", F.lit("")).alias("text"), given("state", "int"))
    order = ["conv_id", "turn", "line", "tie", "row"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kind = dict(lines.dtypes)["conv_id"]
    found = stage(rows.select("conv_id", "text", "state").mapInArrow(_cut(chunk), f"conv_id {kind}, {CHUNKS}"), "transcripts", "zstd")
    edge = found.filter("edge")
    # what a task could not know about its first conversation: the last line in the task before
    ends = edge.groupBy("conv_id", "seg").agg(F.max_by(F.struct("last_blank", "last_state"), "k").alias("end"))
    ahead = ends.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.lag("end").over(Window.partitionBy("conv_id").orderBy("seg")).alias("prior"))
    joined = edge.join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")
    opened = F.col("open") & F.col("prior").isNotNull()
    first = F.get("seen", F.lit(0))
    fixed = F.concat(F.array(first + F.when(F.col("prior.last_blank") & (first < BLANK_CODE), AFTER_BLANK).otherwise(0)), F.expr("slice(seen, 2, size(seen))"))
    joined = joined.withColumns({"seen": F.when(opened, fixed).otherwise(F.col("seen")), "before": F.when(opened, F.coalesce("prior.last_state", F.lit(-1))).otherwise(F.col("before"))})
    return found.filter("NOT edge").unionByName(stage(joined.drop("prior"), "edges"))


def _cut(chunk: int):
    """Sorted pieces of text to chunks. before: state of the line before in the conversation, -1 if unknown, null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId()
        out: list[dict] = []
        now: dict = {}
        conv = object()
        nth, k, chars = -1, 0, 0  # conversation of the task, its chunk, characters in that
        kinds = {"seg": pa.int32(), "k": pa.int32(), "open": pa.bool_(), "edge": pa.bool_(), "lines": pa.list_(pa.string()), "seen": pa.list_(pa.int32()), "state": pa.list_(pa.int32()), "before": pa.int32(), "last_blank": pa.bool_(), "last_state": pa.int32()}
        kind = pa.null()

        def close(edge: bool) -> None:
            if now:
                now.update(edge=now["edge"] or edge, last_blank=now["seen"][-1] == BLANK_CODE, last_state=now["state"][-1])
                out.append(dict(now))
                now.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r["conv_id"] for r in out], kind), *(pa.array([r[c] for r in out], t) for c, t in kinds.items())], names=["conv_id", *kinds])
            out.clear()
            return made

        for batch in batches:
            kind = batch.schema.field(0).type
            held = 0
            for c, text, state in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != conv:
                    close(False)
                    nth, conv, k = nth + 1, c, 0
                for i, piece in enumerate(LINE.split(text)):
                    known = state if state is None or i == 0 else state | 1
                    if now and (len(now["seen"]) >= chunk or chars > CHUNK_CHARS):
                        before, blank = now["state"][-1], now["seen"][-1] == BLANK_CODE
                        close(True)
                        k += 1
                        now.update(conv_id=c, seg=seg, k=k, open=False, edge=True, lines=[], seen=[], state=[], before=-1 if before is None else before)
                    elif not now:
                        blank = False
                        now.update(conv_id=c, seg=seg, k=k, open=nth == 0, edge=nth == 0, lines=[], seen=[], state=[], before=None)
                    else:
                        blank = now["seen"][-1] == BLANK_CODE
                    if not now["seen"]:
                        chars = 0
                    now["lines"].append(piece)
                    now["seen"].append(observe(piece, blank))
                    now["state"].append(known)
                    chars += len(piece)
                held += len(text)
                if held > CHUNK_CHARS and out:
                    held = 0
                    yield flush()
            if out:
                yield flush()
        close(True)
        if out:
            yield flush()

    return run


def fit(chunks: DataFrame, learn: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log start, transition and emission probabilities, from counts over all lines with a known
    state in conversations for which ``learn`` holds, added to a prior in which a marker tells its role."""
    start, move, emit = np.ones(N_STATES), np.full((N_STATES, N_STATES), 0.5), np.full((N_STATES, N_OBSERVED), 0.05)
    for k in range(len(ROLES)):
        start[2 * k + 1] = move[:, 2 * k + 1] = 0.01  # a line inside a turn follows its own role only
        move[[2 * k, 2 * k + 1], 2 * k + 1] = 1
        emit[2 * k, 8 * (k + 1) : 8 * (k + 2)] += 5
        emit[2 * k + 1, :8] += 5
        emit[2 * k + 1, BLANK_CODE] += 5

    def counts(batch: pa.RecordBatch) -> dict:
        n = [np.zeros(N_STATES), np.zeros((N_STATES, N_STATES)), np.zeros((N_STATES, N_OBSERVED))]
        for state, seen, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is None and state[0] is not None:
                n[0][state[0]] += 1
            for a, s, o in zip([before, *state[:-1]], state, seen, strict=True):
                if s is not None:
                    n[2][s, o] += 1
                    if a is not None and a >= 0:
                        n[1][a, s] += 1
        rows = [(w, *at) if len(at) == 2 else (w, *at, -1) for w, x in enumerate(n) for at in map(tuple, np.argwhere(x))]
        return {"what": [r[0] for r in rows], "a": [r[1] for r in rows], "b": [r[2] for r in rows], "n": [int(n[w][a] if b < 0 else n[w][a, b]) for w, a, b in rows]}

    found = arrow_map(chunks.filter(learn).select("state", "seen", "before"), "what int, a int, b int, n long", counts)
    for r in found.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect():
        if r["what"] == 0:
            start[r["a"]] += r["n"]
        else:
            (move, emit)[r["what"] - 1][r["a"], r["b"]] += r["n"]
    for k in range(N_STATES):  # an inside state never follows another role
        for j in range(len(ROLES)):
            if k // 2 != j:
                move[k, 2 * j + 1] = 1e-9
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return log(start), log(move), log(emit)


def viterbi(seen: list[list[int]], model) -> list[list[int]]:
    """Best states of whole conversations, all of them step by step together."""
    start, move, emit = model
    order = sorted(range(len(seen)), key=lambda k: -len(seen[k]))
    longest = len(seen[order[0]]) if order else 0
    alive = np.searchsorted(-np.array([len(seen[k]) for k in order]), -np.arange(longest), side="left")  # how many go beyond step t
    codes = np.zeros((len(seen), longest), np.int64)
    for row, k in enumerate(order):
        codes[row, : len(seen[k])] = seen[k]
    score = start + emit[:, codes[:, 0]].T if longest else None
    back = []
    for t in range(1, longest):
        step = score[: alive[t], :, None] + move
        back.append(step.argmax(axis=1))
        score[: alive[t]] = step.max(axis=1) + emit[:, codes[: alive[t], t]].T
    state = score.argmax(axis=1) if longest else None
    out = np.zeros((len(seen), longest), np.int64)
    for t in range(longest - 1, -1, -1):
        n = alive[t] if t else len(seen)
        out[:n, t] = state[:n]
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    found: list[list[int]] = [[]] * len(seen)
    for row, k in enumerate(order):
        found[k] = out[row, : len(seen[k])].tolist()
    return found


def transfer(seen: list[int], model) -> np.ndarray:
    """T[i, j]: best score of the lines when the line before them had state i (last row: there is none) and their last has j."""
    start, move, emit = model
    T = np.vstack([move, start]) + emit[:, seen[0]]
    for o in seen[1:]:
        T = (T[:, :, None] + move[None]).max(axis=1) + emit[:, o]
    return T


def trace(seen: list[int], enter: int, leave: int, model) -> list[int]:
    """Best states of the lines between two states; enter N_STATES: they begin a conversation."""
    start, move, emit = model
    score = np.vstack([move, start])[enter] + emit[:, seen[0]]
    back = []
    for o in seen[1:]:
        step = score[:, None] + move
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + emit[:, o]
    path = [leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def bounds(ts: list[np.ndarray], enter: int, leave: int | None) -> list[tuple[int, int]]:
    """The states before and at the end of each step of the best path; leave None: any."""
    heads = [ts[0][enter]]
    for T in ts[1:]:
        heads.append((heads[-1][:, None] + T[:N_STATES]).max(axis=0))
    out = [int(np.argmax(heads[-1])) if leave is None else leave]
    for k in range(len(ts) - 1, 0, -1):
        out.append(int(np.argmax(heads[k - 1] + ts[k][:N_STATES, out[-1]])))
    out = out[::-1]
    return list(zip([enter, *out[:-1]], out, strict=True))


def _fragments(lines: list[str], states: list[int]) -> list[tuple[int, int, list[str]]]:
    """(turn, role, lines) of the turns; turn 0 goes on with what came before."""
    out: list[tuple[int, int, list[str]]] = []
    turn = 0
    for text, s in zip(lines, states, strict=True):
        if s % 2 == 0:
            turn += 1
            out.append((turn, s // 2, [bare(text)]))
        elif out:
            out[-1][2].append(text)
        else:
            out.append((turn, s // 2, [text]))
    return out


TURNS = "turn_no long, role string, n_lines long, content string, chat string"


def _whole(chunks: DataFrame, model) -> DataFrame:
    """Turns of conversations that are one chunk."""
    kind = dict(chunks.dtypes)["conv_id"]

    def turns(batch: pa.RecordBatch) -> dict:
        convs, lines, seen = (c.to_pylist() for c in batch.columns)
        out: dict[str, list] = {c: [] for c in ("conv_id", "turn_no", "role", "n_lines", "content", "chat")}
        for conv, texts, states in zip(convs, lines, viterbi(seen, model), strict=True):
            for turn, r, part in _fragments(texts, states):
                while len(part) > 1 and BLANK.match(part[-1]):
                    part.pop()
                content = "\n".join(part)
                for c, v in zip(out, (conv, turn, ROLES[r], len(part), content, f"<|im_start|>{ROLES[r]}\n{content}<|im_end|>\n"), strict=True):
                    out[c].append(v)
        return out

    return arrow_map(chunks.select("conv_id", "lines", "seen"), f"conv_id {kind}, {TURNS}", turns)


def recover(chunks: DataFrame, model) -> DataFrame:
    """conv_id, seg, k, lines and states of chunks of conversations that have several."""
    kind = dict(chunks.dtypes)["conv_id"]
    size = (N_STATES + 1, N_STATES)

    def matrices(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("conv_id", "seg", "k")} | {"t": [transfer(o, model).ravel().tolist() for o in batch.column("seen").to_pylist()]}

    def unpack(pdf, by):
        pdf = pdf.sort_values(by)
        return pdf, [np.asarray(t).reshape(size) for t in pdf["t"]]

    def inside(pdf):
        pdf, ts = unpack(pdf, "k")
        T = ts[0]
        for more in ts[1:]:
            T = (T[:, :, None] + more[None, :N_STATES]).max(axis=1)
        return pdf[["conv_id", "seg"]].head(1).assign(t=[T.ravel().tolist()])

    def across(pdf):
        pdf, ts = unpack(pdf, "seg")
        found = bounds(ts, N_STATES, None)
        return pdf[["conv_id", "seg"]].assign(enter=[a for a, _ in found], leave=[b for _, b in found])

    def within(pdf):
        pdf, ts = unpack(pdf, "k")
        found = bounds(ts, int(pdf["enter"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pdf[["conv_id", "seg", "k"]].assign(enter=[a for a, _ in found], leave=[b for _, b in found])

    same = lambda a, b, *on: a.alias("a").join(b.alias("b"), F.expr(" AND ".join(["a.conv_id <=> b.conv_id", *(f"a.{c} = b.{c}" for c in on)]))).select("a.*", "b.enter", "b.leave")
    made = stage(arrow_map(chunks, f"conv_id {kind}, seg int, k int, t array<double>", matrices), "matrices")
    segments = made.groupBy("conv_id", "seg").applyInPandas(inside, f"conv_id {kind}, seg int, t array<double>")
    segments = segments.groupBy("conv_id").applyInPandas(across, f"conv_id {kind}, seg int, enter int, leave int")
    steps = same(made, segments, "seg").groupBy("conv_id", "seg").applyInPandas(within, f"conv_id {kind}, seg int, k int, enter int, leave int")

    @F.pandas_udf("array<int>")
    def states(seen, enter, leave):
        import pandas as pd

        return pd.Series([trace(list(o), a, b, model) for o, a, b in zip(seen, enter, leave, strict=True)])

    return same(chunks, steps, "seg", "k").select("conv_id", "seg", "k", "lines", states("seen", "enter", "leave").alias("states"))


def _joined(recovered: DataFrame) -> DataFrame:
    """Turns of conversations in several chunks: what cuts part is put together again."""
    kind = dict(recovered.dtypes)["conv_id"]
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role") + 1)

    def pieces(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("conv_id", "seg", "k", "turn", "role", "texts")}
        for conv, seg, k, lines, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for turn, r, texts in _fragments(lines, states):
                for c, v in zip(out, (conv, seg, k, turn, r, texts), strict=True):
                    out[c].append(v)
        return out

    parts = stage(arrow_map(recovered, f"conv_id {kind}, seg int, k int, turn long, role int, texts array<string>", pieces), "fragments")
    n = parts.groupBy("conv_id", "seg", "k").agg(F.max("turn").alias("n"))
    in_task = Window.partitionBy("conv_id", "seg").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    earlier = n.groupBy("conv_id", "seg").agg(F.sum("n").alias("n")).withColumn("all", F.coalesce(F.sum("n").over(over), F.lit(0)))
    own = n.withColumn("own", F.coalesce(F.sum("n").over(in_task), F.lit(0)))
    before = own.alias("o").join(earlier.alias("e"), F.expr("o.conv_id <=> e.conv_id AND o.seg = e.seg")).select("o.conv_id", "o.seg", "o.k", (F.col("own") + F.col("all")).alias("before"))
    numbered = parts.alias("p").join(before.alias("b"), F.expr("p.conv_id <=> b.conv_id AND p.seg = b.seg AND p.k = b.k")).select("p.*", (F.col("turn") + F.col("before")).alias("turn_no"))
    turns = numbered.groupBy("conv_id", "turn_no").agg(F.min("role").alias("role"), F.array_sort(F.collect_list(F.struct("seg", "k", "texts"))).alias("p"))
    turns = turns.select("conv_id", "turn_no", role.alias("role"), F.flatten(F.col("p.texts")).alias("l"))
    turns = turns.withColumn("n_lines", F.array_max(F.transform("l", lambda x, i: F.when((i > 0) & x.rlike(r"^\s*$"), 1).otherwise(i + 1))).cast("long"))
    content = F.array_join(F.slice("l", 1, F.col("n_lines").cast("int")), "\n")
    return turns.select("conv_id", "turn_no", "role", "n_lines", content.alias("content"), F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), content, F.lit("<|im_end|>\n")).alias("chat"))


def parse(lines: DataFrame, learn: Column, chunk: int = CHUNK) -> DataFrame:
    """Turns of transcripts: conv_id, turn_no, role, n_lines, content and chat, the canonical form.

    Transcripts are pieces of raw text (conv_id, text and, where given, turn, line and state) of any
    number of lines each. ``turn`` and ``line`` only order the pieces (nulls come first; pieces at one
    place are ordered by a hash of their text). ``state`` is the true state of a piece's first line
    where known (its other lines go on with the turn), and read only where ``learn`` holds; without
    any, the prior decides. Whether a blank line stands before a line is read from the line before.
    Blank lines at the end of a turn stand between turns: they are no content and not counted. Null
    texts are empty lines, null ids form one conversation; an empty table gives no rows; other columns
    are ignored.
    """
    chunks = chunked(lines, chunk)
    model = fit(chunks, learn)
    turns = _whole(chunks.filter("NOT edge"), model)
    edge = chunks.filter("edge")
    return turns if edge.isEmpty() else turns.unionByName(_joined(recover(edge, model)))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of the conversations (conv_id, turn, role, text): pieces of text in the order of ``turn``.

    Each conversation has one of four marker styles; one turn in seven has lost its marker,
    and in half of the styles a blank line stands between turns. Null texts are empty lines.
    ``state`` is the truth about the first line of a piece, and no feature.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    words = {"system": ("System: ", "### System: ", "<|system|> ", "S: "), "user": ("User: ", "### Human: ", "<|user|> ", "Q: "), "assistant": ("Assistant: ", "### Assistant: ", "<|assistant|> ", "A: ")}
    head = F.lit("")
    known = F.lit(None).cast("int")
    for k, role in enumerate(ROLES):
        same = F.lower("role") == role
        head = F.when(same, F.element_at(F.array(*map(F.lit, words[role])), (style + 1).cast("int"))).otherwise(head)
        known = F.when(same, 2 * k).otherwise(known)
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0
    text = F.concat(F.when(lost, "").otherwise(head), F.coalesce("text", F.lit("")), F.when(style < 2, "\n").otherwise(""))
    return conversations.select("conv_id", "turn", text.alias("text"), known.alias("state"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all ``conversations``, parsed and rendered, one row per recovered turn."""
    return parse(transcripts(table(spark, sf_dir, "conversations")), F.crc32(F.col("conv_id").cast("string")) % 2 == 0)
