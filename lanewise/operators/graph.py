"""Groups of lists that cards connect."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.labels import key_columns
from lanewise.staging import discard, stage

#: Nodes of a group that a task holds; larger groups are joined in rounds.
HELD = 1 << 20


def _roots(n_keys: int, held: int):
    """Edges (keys, a, b), sorted by keys, to (keys, node, label, whole): the least node that the edges seen together lead to.

    A group that is read to its end in one go is ``whole``; of a larger one each part of it is a forest of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def made(keys: tuple, up: dict, whole: bool) -> pa.RecordBatch:
            nodes = list(up)
            return pa.RecordBatch.from_arrays([*(pa.array([k] * len(nodes), t) for k, t in zip(keys, kinds, strict=True)), pa.array(nodes, kind), pa.array([top(up, x) for x in nodes], kind), pa.array([whole] * len(nodes))], names=names)

        def top(up: dict, x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        first = next(batches, None)
        if first is None:
            return
        batches = itertools.chain([first], batches)
        *kinds, kind = [f.type for f in first.schema][: n_keys + 1]
        names = [*[f.name for f in first.schema][:n_keys], "node", "label", "whole"]
        for keys, edges in itertools.groupby(rows(), key=lambda r: r[:n_keys]):
            up: dict = {}
            whole = True
            for r in edges:
                a, b = r[n_keys:]
                if len(up) >= held and (a not in up or b not in up):
                    yield made(keys, up, False)
                    up, whole = {}, False
                a, b = top(up, up.setdefault(a, a)), top(up, up.setdefault(b, b))
                up[max(a, b)] = min(a, b)
            yield made(keys, up, whole)

    return run


def labels(edges: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """keys, node, label of the nodes of the edges (keys, a, b): the least node that these lead to. Nothing is null.

    A task joins the edges of a group as they come, with a memory of ``held`` nodes. Of groups with more
    nodes it makes several forests; these are joined in rounds.
    """
    kinds = dict(edges.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"node {kinds['a']}, label {kinds['a']}, whole boolean"])
    in_order = edges.select(*keys, "a", "b").distinct().repartition(*keys).sortWithinPartitions(*keys)
    found = stage(in_order.mapInArrow(_roots(len(keys), held), schema), "forests")
    done = found.filter("whole").select(*keys, "node", "label")
    several = found.filter("NOT whole").select(*keys).distinct()
    if several.isEmpty():
        return done
    large = found.join(several, keys, "left_semi").select(*keys, F.col("node").alias("a"), F.col("label").alias("b"))
    return done.join(several, keys, "left_anti").unionByName(_rounds(large, keys))


def _rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same by rounds of joins: each takes the least label of the neighbours, then the label of that label, so
    long paths halve. Rounds are staged, and the ones before deleted; only counts go to the driver."""
    pairs = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    pairs = stage(pairs, "edges")
    now = stage(edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = pairs.join(now.withColumnsRenamed({"node": "b", "label": "l"}), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = now.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = now.select(*keys, F.col("node").alias("label"), F.col("label").alias("further"))
        new = stage(step.join(jump, [*keys, "label"]).select(*keys, "node", "old", F.least("label", "further").alias("label")), "labels")
        discard(now)
        now = new.select(*keys, "node", "label")
        if new.filter("label <> old").isEmpty():
            discard(pairs)
            return now


def connected_lists(enriched: DataFrame, use: str = "id", threshold: float = 0, keys: list[str] | None = None) -> DataFrame:
    """keys, comp_id (least member), members (sorted), size, n_moves_in (events that lead to a member).

    Lists are linked by a move between them; with a threshold, by more such moves of cards
    in one direction. Ids and keys ('comb') may stand for lists.
    """
    keys = keys or ["board_id"]
    key, before, after = key_columns(use)
    pairs = enriched.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).select(*keys, F.col(after).alias("a"), F.col(before).alias("b"), "card_id")
    if threshold > 0:
        pairs = pairs.groupBy(*keys, "a", "b").agg(F.count("card_id").alias("n")).filter(F.col("n") > threshold)
    # lists as they occur, and the events that lead to them, in one pass
    role = lambda c, own, n: F.struct(F.col(c).alias("node"), F.lit(own).alias("own"), n.alias("n"))
    roles = F.array(role(key, True, F.lit(0)), role(after, False, F.col("id").isNotNull().cast("int")))
    seen = enriched.select(*keys, F.explode(roles).alias("x")).select(*keys, "x.*").filter("node IS NOT NULL").groupBy(*keys, "node").agg(F.max("own").alias("own"), F.sum("n").alias("n"))
    found = seen.join(labels(pairs, keys), [*keys, "node"], "full").filter("own OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
    return found.groupBy(*keys, F.col("label").alias("comp_id")).agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_moves_in"))
