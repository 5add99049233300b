"""Conversation structure repair: cheapest edits by Dial's bucket queue.

A node is a place between rows and the state of the turns kept so far; edits are arcs of small
whole-number costs. Distances to the end come from a bucket queue; the audit is the walk from
the start along tight arcs that takes the least letter each time.

Rows are sorted over ranges, so a conversation of any length lies in several tasks. What may
have been cut is repaired chunk by chunk: a chunk gives the distances between its four states
at both ends, streams over chunks turn these into the distance to the end behind each chunk and
the state before it, and each chunk then makes its own part of the audit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import as_batch, bounded_batches, partitions, stage, table, to_arrow

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing kept yet, behind a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn that an edit puts in leads, and where a kept one does.
PUT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Turns to put in at the very end, by state, and what that costs.
CLOSING = {NOTHING: [], SYSTEM: ["user:", "assistant:"], USER: ["assistant:"], ASSISTANT: []}
AT_END = [INSERT * len(CLOSING[s]) for s in range(4)]
FAR = 1 << 60
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Rows and characters of a chunk.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 20
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
#: How a stop may look as the last visible character.
STOPPED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def fault(text: str, seen: bool) -> int:
    """The first fault of a row; ``seen``: role and text stood in the conversation before."""
    if not VISIBLE.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return FINE if STOPPED.search(text) else CUT_OFF


def faults(rows: list[tuple[str, str]], before: set[bytes]) -> list[int]:
    """Faults of a chunk's rows (role, text); ``before``: digests of rows of earlier chunks."""
    found, own = [], set()
    for r in rows:
        found.append(fault(r[1], r in own or bool(before) and row_digest(*r) in before))
        own.add(r)
    return found


def row_digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def arcs(state: int, role: str, kind: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that take a row of this role and fault."""
    out = [("D", DELETE, state)]
    if kind in (FINE, CUT_OFF):
        more = TRUNCATED if kind == CUT_OFF else 0
        to = KEPT.get((state, role[:1]))
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, PUT[state]))
    return out


def distances(rows: list[tuple[str, int]], tail: list[int]) -> list[list[int]]:
    """From each place and state of a chunk's rows (role, fault) to the end, given those behind the chunk."""
    n = len(rows)
    into: list[list[list[tuple[int, int]]]] = [[[] for _ in range(4)] for _ in range(n)]  # by row and next state: state and cost
    made: dict[tuple[str, int], list] = {}
    for k, (role, kind) in enumerate(rows):
        key = role[:1], kind
        if key not in made:
            made[key] = [[(s, c) for s in range(4) for _, c, to in arcs(s, role, kind) if to == t] for t in range(4)]
        into[k] = made[key]
    dist = [[FAR] * 4 for _ in range(n + 1)]
    base = min(tail)
    buckets: list[list[tuple[int, int]]] = []

    def reach(place: int, state: int, d: int) -> None:
        if d < dist[place][state]:
            dist[place][state] = d
            while len(buckets) <= d - base:
                buckets.append([])
            buckets[d - base].append((place, state))

    for s, d in enumerate(tail):
        if d < FAR:
            reach(n, s, d)
    at = 0
    while at < len(buckets):
        for place, state in buckets[at]:  # no arc of cost 0 stays at a place, but one may lead into this bucket
            if dist[place][state] != at + base:
                continue
            if place < n:
                for s, to in PUT.items():
                    if to == state:
                        reach(place, s, at + base + INSERT)
            if place:
                for s, c in into[place - 1][state]:
                    reach(place - 1, s, at + base + c)
        at += 1
    return dist


def walk(rows: list[tuple[str, str]], kinds: list[int], dist: list[list[int]], state: int) -> tuple[str, list[str], int]:
    """Audit, repaired turns and last state of a chunk entered in ``state``: along tight arcs, the least letter first."""
    audit, turns = [], []
    for k, (role, text) in enumerate(rows):
        while True:
            here = dist[k][state]
            steps = {x: to for x, c, to in arcs(state, role, kinds[k]) if here == c + dist[k + 1][to]}
            if here == INSERT + dist[k][PUT[state]]:
                steps["I"] = PUT[state]
            letter = min(steps)
            audit.append(letter)
            state = steps[letter]
            if letter != "I":
                break
            turns.append(f"{ROLE[state]}:")
        if letter == "K":
            turns.append(f"{role}:{text}")
        elif letter == "R":
            turns.append(f"{ROLE[state]}:{text}")
    return "".join(audit), turns, state


def chunk_counts(rows: list[tuple[str, str]], turns: list[int | None], kinds: list[int]) -> dict:
    """What chunks of a conversation are summed up from; rows are in order, so equal turns are neighbours."""
    known = [t for t in turns if t is not None]
    heads = [r[0][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    return {
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "distinct_turns": len(set(known)), "first_head": heads[0] if heads else None, "last_head": heads[-1] if heads else None,
        "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(CUT_OFF), "illegal": illegal,
    }


def add_counts(a: dict, b: dict) -> dict:
    """Counts of two neighbouring chunks together."""
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal", "distinct_turns")}
    out["illegal"] += a["last_head"] is not None and b["first_head"] is not None and a["last_head"] + b["first_head"] not in ("su", "ua", "au")
    out["distinct_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for c in ("turn", "head"):
        out[f"first_{c}"] = a[f"first_{c}"] if a[f"first_{c}"] is not None else b[f"first_{c}"]
        out[f"last_{c}"] = b[f"last_{c}"] if b[f"last_{c}"] is not None else a[f"last_{c}"]
    return out


def gaps(c: dict) -> int:
    return 0 if c["first_turn"] is None else c["last_turn"] - c["first_turn"] + 1 - c["distinct_turns"]


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = "counts struct<first_turn: long, last_turn: long, distinct_turns: long, first_head: string, last_head: string, blank: long, duplicate: long, truncated: long, illegal: long>"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of the damaged rows; a dropped row stays as one that is gone."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(key("text"), "[.!?]", "")).otherwise(key("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(key("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_")).drop("_")


def _cut(target: pa.Schema):
    """Sorted rows to chunks; ``edge``: perhaps not a whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId()
        now: dict | None = None
        chars, first, done = 0, True, []

        def new(conv, k: int, edge: bool) -> dict:
            return {"conv_id": conv, "seg": seg, "k": k, "edge": edge, "turns": [], "roles": [], "texts": []}

        for batch in batches:
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        done.append(now)
                    now, chars, first = new(conv, 0, first), 0, False
                elif len(now["roles"]) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                    now["edge"] = True
                    done.append(now)
                    now, chars = new(conv, now["k"] + 1, True), 0
                if not gone:
                    for c, v in (("turns", turn), ("roles", role), ("texts", text)):
                        now[c].append(v)
                    chars += len(text)
                if len(done) >= 64 or done and chars >= CHUNK_CHARS:
                    yield as_batch({f.name: [d[f.name] for d in done] for f in target}, target)
                    done = []
        if now is not None:
            now["edge"] = True
            done.append(now)
        if done:
            yield as_batch({f.name: [d[f.name] for d in done] for f in target}, target)

    return run


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of conversations, staged. Rows go by turn (nulls first), then role, then a hash of the text and the text."""
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, seg int, k int, edge boolean, turns array<long>, roles array<string>, texts array<string>"
    return stage(rows.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_cut(to_arrow(spark, schema)), schema), "conversations", "zstd")


def _map(df: DataFrame, schema: str, one) -> DataFrame:
    """``one`` turns each row, as a dict, to a dict, or None."""
    target = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in batch.to_pylist() if (x := one(r)) is not None]
            if out:
                yield as_batch({f.name: [x[f.name] for x in out] for f in target}, target)

    return df.mapInArrow(run, schema)


def _stream(df: DataFrame, schema: str, order: list, begin, step, end=None) -> DataFrame:
    """Chunks of each conversation one after the other, with a state of fixed size: ``step`` takes state and row and
    gives the new state and a row or None, ``end`` a last row. However many chunks there are, none is kept."""
    target = to_arrow(df.sparkSession, schema)
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, any_yet = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not any_yet or r["conv_id"] != conv:
                    if any_yet and end:
                        out.append(end(conv, state))
                    conv, state, any_yet = r["conv_id"], begin(), True
                state, row = step(state, r)
                if row is not None:
                    out.append(row)
            if out:
                yield as_batch({f.name: [x[f.name] for x in out] for f in target}, target)
        if any_yet and end:
            row = end(conv, state)
            yield as_batch({f.name: [row[f.name]] for f in target}, target)

    return df.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _whole(r: dict) -> dict:
    """A conversation that is one chunk."""
    rows = list(zip(r["roles"], r["texts"], strict=True))
    kinds = faults(rows, set())
    dist = distances([(role, kind) for (role, _), kind in zip(rows, kinds, strict=True)], AT_END)
    audit, turns, state = walk(rows, kinds, dist, NOTHING)
    turns += CLOSING[state]
    counts = chunk_counts(rows, r["turns"], kinds)
    return counts | {"conv_id": r["conv_id"], "gaps": gaps(counts), "cost": dist[0][NOTHING], "audit": audit + "I" * len(CLOSING[state]), "repaired_sha256": hashlib.sha256("\n".join(turns).encode()).hexdigest()}


def _same(a: DataFrame, b: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    on = F.expr("a.conv_id <=> b.conv_id AND a.seg = b.seg AND a.k = b.k")
    return a.alias("a").join(b.alias("b"), on, how).select("a.*", *[f"b.{c}" for c in columns])


def _pieces(chunks: DataFrame) -> DataFrame:
    """Conversations of several chunks."""
    kind = f"conv_id {dict(chunks.dtypes)['conv_id']}"
    place = f"{kind}, seg int, k int"
    at = lambda r, **more: {c: r[c] for c in ("conv_id", "seg", "k")} | more
    rows_of = lambda r: list(zip(r["roles"], r["texts"], strict=True))
    # digests of rows that stood in an earlier chunk of the conversation
    digests = _map(chunks, f"{place}, d array<binary>", lambda r: at(r, d=sorted({row_digest(*x) for x in rows_of(r)}))).select("conv_id", "seg", "k", F.explode("d").alias("d"))
    digests = stage(digests, "digests")
    first = stage(digests.groupBy("conv_id", "d").agg(F.min(F.struct("seg", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-rows")
    later = digests.alias("a").join(first.alias("b"), F.expr("a.conv_id <=> b.conv_id AND a.d = b.d AND struct(a.seg, a.k) > b.first")).groupBy("a.conv_id", "a.seg", "a.k").agg(F.collect_list("a.d").alias("before"))

    def summed(r: dict) -> dict:
        rows = rows_of(r)
        kinds = faults(rows, set(r["before"] or ()))
        named = [(role, x) for (role, _), x in zip(rows, kinds, strict=True)]
        ends = [distances(named, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
        return at(r, kinds=kinds, matrix=[ends[t][s] for s in range(4) for t in range(4)], counts=chunk_counts(rows, r["turns"], kinds))

    made = stage(_map(_same(chunks, later, "before", how="left"), f"{place}, kinds array<int>, matrix array<long>, {COUNTS}", summed), "matrices")

    def behind(tail: list[int], r: dict) -> tuple[list[int], dict]:
        m = r["matrix"]
        return [min(m[4 * s + t] + tail[t] for t in range(4)) for s in range(4)], at(r, tail=tail)

    tails = stage(_stream(made.select("conv_id", "seg", "k", "matrix"), f"{place}, tail array<long>", [F.desc("seg"), F.desc("k")], lambda: AT_END, behind), "tails")
    known = _same(_same(chunks, made, "kinds", "counts"), tails, "tail")

    def leads(r: dict) -> dict:
        rows, dist = rows_of(r), distances(list(zip(r["roles"], r["kinds"], strict=True)), r["tail"])
        return at(r, leads=[walk(rows, r["kinds"], dist, s)[2] for s in range(4)])

    enters = _stream(_map(known, f"{place}, leads array<int>", leads), f"{place}, enter int", ["seg", "k"], lambda: NOTHING, lambda s, r: (r["leads"][s], at(r, enter=s)))

    def part(r: dict) -> dict:
        rows, dist = rows_of(r), distances(list(zip(r["roles"], r["kinds"], strict=True)), r["tail"])
        audit, turns, state = walk(rows, r["kinds"], dist, r["enter"])
        return at(r, counts=r["counts"], cost=dist[0][r["enter"]], audit=audit, turns="\n".join(turns), n_turns=len(turns), leave=state)

    parts = stage(_map(_same(known, stage(enters, "enters"), "enter"), f"{place}, {COUNTS}, cost long, audit string, turns string, n_turns int, leave int", part), "repaired")

    def begin() -> dict:
        return {"sha": hashlib.sha256(), "n": 0, "audit": [], "counts": None, "cost": 0, "leave": NOTHING}

    def add(turns: list[str], state: dict) -> None:
        for t in turns:
            state["sha"].update((b"\n" if state["n"] else b"") + t.encode())
            state["n"] += 1

    def step(state: dict, r: dict) -> tuple[dict, None]:
        if state["counts"] is None:
            state["cost"] = r["cost"]
        if r["n_turns"]:
            add([r["turns"]], state)
        state["audit"].append(r["audit"])
        state |= {"leave": r["leave"], "counts": r["counts"] if state["counts"] is None else add_counts(state["counts"], r["counts"])}
        return state, None

    def end(conv, state: dict) -> dict:
        closing = CLOSING[state["leave"]]
        add(closing, state)
        return state["counts"] | {"conv_id": conv, "gaps": gaps(state["counts"]), "cost": state["cost"], "audit": "".join(state["audit"]) + "I" * len(closing), "repaired_sha256": state["sha"].hexdigest()}

    return _stream(parts, f"{kind}, {OUT}", ["seg", "k"], begin, step, end)


def repair(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation, and the cheapest repair of it; ``rows``: conv_id, turn, role, text, gone.

    One row per conv_id (null ids are one conversation), also where all rows are gone: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Roles and texts are not null.
    Rows of one turn go by role, then by a hash of their text, so that equal ones are neighbours. The
    hash of a conversation is one stream over its chunks in one task, by the nature of SHA-256; nothing
    is held of it but the audit. Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(rows.sparkSession)
    chunks = chunked(rows.select("conv_id", "turn", "role", "text", "gone"))
    whole = _map(chunks.filter("NOT edge"), f"conv_id {dict(rows.dtypes)['conv_id']}, {OUT}", _whole)
    return whole.unionByName(_pieces(chunks.filter("edge")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged as the contract says."""
    return repair(damage(table(spark, sf_dir, "conversations")))
