"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts with the same set of word n-grams form a class; only classes are compared. Each of
TREES tries sorts the classes by DEPTH minimum hashes; classes that share a prefix are
candidates. The length of the prefix starts at DEPTH and is shortened until the expected
recall, over the similarities that the tries themselves show, reaches the target.
Candidates form components; inside a component, cut into blocks, all pairs are verified
exactly on their n-gram sets, and counted without a row for each pair. In components of
several blocks a set goes along as what it lacks and has more than the component's first.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, as_batch, bounded_batches, discard, partitions, release, stage, table, to_arrow
from lanewise.llm.components import components

NGRAM = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6
#: Expected share of links found, and the least for a pair that is just at the threshold.
TARGET = 0.9999
FLOOR = 0.999
#: Classes, and bytes of their sets, in a block; a component over it is verified block by block.
BLOCK, BLOCK_BYTES = 256, 32 << 20
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _hashes() -> dict[str, int]:
    return {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words; the memory of hashes is bounded."""
    known = _hashes()
    if len(known) > 1 << 16:
        known.clear()
    out = []
    for w in WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text is one n-gram, none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(n, len(h))
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = (s ^ (s >> np.uint64(31))) * MIX + h[k : len(h) - n + 1 + k]
    s ^= s >> np.uint64(29)
    return np.unique(s * MIX)


@functools.lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(11)
    draw = lambda: rng.randint(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)[:, None]
    return draw() | np.uint32(1), draw()


def signature(s: np.ndarray) -> bytes:
    """Minimum hashes, as big-endian bytes, so that prefixes of bytes are prefixes of hashes."""
    a, b = _permutations()
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(best, (a * x[k : k + 1024] + b).min(axis=1), out=best)
    return best.astype(">u4").tobytes()


def found(s: float, depth: int) -> float:
    """Chance that two sets of similarity s share a prefix of this depth in some trie."""
    return 1 - (1 - s**depth) ** TREES


def choose_depth(similarities: dict[float, int], threshold: float, target: float = TARGET, floor: float = FLOOR) -> int:
    """The longest prefix whose expected recall reaches the target.

    ``similarities``: how many candidates at full depth have about which similarity. Each
    stands for 1 / found(s, DEPTH) links, since so many were there to be found. Estimates up to
    two standard errors under the threshold count as links at it.
    """
    error = 2 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    links: dict[float, float] = {}
    for s, n in similarities.items():
        if s >= threshold - error:
            s = max(s, threshold)
            links[s] = links.get(s, 0.0) + n / found(s, DEPTH)
    for depth in range(DEPTH, 1, -1):
        total = sum(links.values())
        recall = sum(w * found(s, depth) for s, w in links.items()) / total if total else 1.0
        if recall >= target and found(threshold, depth) >= floor:
            return depth
    return 1


def _nodes(classes: DataFrame, depth: int) -> DataFrame:
    """(key, node) for each trie: node is the prefix of this depth."""
    node = [F.xxhash64(F.lit(t), F.substring("sig", 4 * DEPTH * t + 1, 4 * depth)) for t in range(TREES)]
    return classes.select("key", F.explode(F.array(*node)).alias("node"))


def _stars(classes: DataFrame, depth: int) -> DataFrame:
    """Candidates as stars: (u, v) where v is the least class below the same node."""
    rows = _nodes(classes, depth)
    heads = rows.groupBy("node").agg(F.min("key").alias("v"), F.count("*").alias("n")).filter("n > 1").select("node", "v")
    return rows.join(heads, "node").filter("key <> v").select(F.col("key").alias("u"), "v").distinct()


def _similarities(classes: DataFrame, stars: DataFrame) -> dict[float, int]:
    """Histogram of the similarities that signatures show, over all stars."""
    sigs = classes.select("key", "sig")
    pairs = stars.join(sigs.select(F.col("key").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("key").alias("v"), F.col("sig").alias("b")), "v")

    @F.pandas_udf("double")
    def agreement(a, b):
        import pandas as pd

        return pd.Series([round(float((np.frombuffer(x, ">u4") == np.frombuffer(y, ">u4")).mean()), 2) for x, y in zip(a, b, strict=True)])

    return {r["s"]: r["count"] for r in pairs.select(agreement("a", "b").alias("s")).groupBy("s").count().collect()}


def links_within(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, ratio: Fraction, sizes: np.ndarray | None = None, lacks: np.ndarray | int = 0, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each set, and the least index it is joined to. side: 0 or 1, only pairs across count.

    ``sets`` may be differences to a set of ``first`` values: then ``sizes`` are those of the whole sets, and
    ``lacks`` tells how many values of the first set each has not.
    """
    n = len(sets)
    own = np.array([len(s) for s in sets], np.int64)
    sizes = own if sizes is None else sizes
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), own)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [k, k + width])
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], column[a:b] - k] = 1
        common += x @ x.T
    lacks = np.broadcast_to(np.asarray(lacks), n)
    common = np.rint(common).astype(np.int64) + first - lacks[:, None] - lacks[None, :]
    linked = ratio.denominator * common >= ratio.numerator * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return linked @ copies, label


def _verify(schema: pa.Schema, ratio: Fraction):
    """Rows sorted by (comp, i, j) to links and label of each member of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            held.sort(key=lambda r: r[3])
            sets = [np.frombuffer(r[5], np.uint64) for r in held]
            sizes, lacks = (np.array([r[k] for r in held], np.int64) for k in (8, 9))
            copies = np.array([r[4] for r in held], np.int64)
            side = None if held[0][1] == held[0][2] else np.array([r[6] == held[0][1] for r in held]).astype(int)
            links, label = links_within(sets, copies, side, ratio, sizes, lacks, held[0][10])
            return as_batch({"key": [r[3] for r in held], "links": links, "label": [held[k][3] for k in label], "alone": [r[7] for r in held]}, schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield close()
                    held = []
                if not held or row[3] != held[-1][3]:  # rows may repeat a representative's id and text
                    held.append(row)
        if held:
            yield close()

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):

    doc_id, class_id (least doc_id with the same set of n-grams), n_copies (rows of that
    class), n_links (other rows whose similarity is at least the threshold, those of the
    class included) and group_id (least doc_id that links lead to). Texts without words,
    null ones too, are linked to nothing: class_id and group_id are their own doc_id. Null
    doc_ids are never a class_id while the class has another. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    ratio = Fraction(threshold).limit_denominator(10_000)
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.md5(text).alias("md5"), text.alias("text"))

    def sign(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "md5": batch.column(1), "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "n": [len(s) for s in sets], "sig": [signature(s) if len(s) else None for s in sets]}

    signed = stage(arrow_map(source, f"doc_id {kind}, md5 string, key binary, n long, sig binary", sign), "signatures")
    per_class = signed.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "md5")).alias("rep"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    classes = stage(per_class, "classes")
    stars = stage(_stars(classes, DEPTH), "stars")
    release(spark)
    depth = choose_depth(_similarities(classes, stars), threshold)
    if depth < DEPTH:
        stars = stage(_stars(classes, depth), "stars")
        release(spark)
    members = components(stars).select(F.col("v").alias("key"), F.col("label").alias("comp")).join(classes.drop("sig", "class_id"), "key")
    members = stage(members.select("comp", "key", "copies", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.md5").alias("md5")), "members")
    blocks = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocks = stage(blocks, "blocks")
    placed = members.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    text_of = source.alias("d").join(placed.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.md5 = m.md5")).select("m.comp", "m.blocks", "m.block", "m.key", "m.copies", "d.text")

    def sets(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(k) for k, n in enumerate(("comp", "blocks", "block", "key", "copies"))}
        return out | {"s": [shingles(t).tobytes() for t in batch.column(5).to_pylist()]}

    with_sets = stage(arrow_map(text_of, "comp binary, blocks int, block int, key binary, copies long, s binary", sets), "sets")
    discard(members)
    release(spark)
    plain = with_sets.filter("blocks = 1").withColumns({"size": F.octet_length("s") / 8, "lacks": F.lit(0), "first": F.lit(0)})
    large = with_sets.filter("blocks > 1")
    first = stage(large.filter("key = comp").groupBy("comp").agg(F.min("s").alias("of")), "first-sets")

    def differences(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(n) for n in ("comp", "blocks", "block", "key", "copies")} | {"s": [], "size": [], "lacks": [], "first": []}
        for s, of in zip(batch.column("s").to_pylist(), batch.column("of").to_pylist(), strict=True):
            s, of = np.frombuffer(s, np.uint64), np.frombuffer(of, np.uint64)
            lacks = np.setdiff1d(of, s, assume_unique=True)
            for k, v in (("s", np.concatenate([lacks, np.setdiff1d(s, of, assume_unique=True)]).tobytes()), ("size", len(s)), ("lacks", len(lacks)), ("first", len(of))):
                out[k].append(v)
        return out

    differ = "comp binary, blocks int, block int, key binary, copies long, s binary, size long, lacks long, first long"
    apart = arrow_map(large.join(first, "comp"), differ, differences)
    kinds = [F.col(c).cast(t) for c, t in (x.split(" ") for x in differ.split(", "))]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = plain.select(kinds).unionByName(apart).select("*", other).select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "copies", "s", "block", (F.col("blocks") == 1).alias("alone"), "size", "lacks", "first")
    groups = spread.repartition(partitions(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "key")
    schema = "key binary, links long, label binary, alone boolean"
    checked = stage(groups.mapInArrow(_verify(to_arrow(spark, schema), ratio), schema), "links")
    discard(with_sets)
    release(spark)
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    alone = checked.filter("alone").select("key", "label")
    large = checked.filter("NOT alone AND key <> label").select(F.col("key").alias("u"), F.col("label").alias("v"))
    labels = alone if large.isEmpty() else alone.unionByName(components(large).select(F.col("v").alias("key"), "label"))
    info = classes.select("key", "copies", "class_id").join(links, "key", "left").join(labels.distinct(), "key", "left")
    info = stage(info.select("key", "copies", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "key").alias("label")), "classes")
    groups_of = info.groupBy("label").agg(F.min("class_id").alias("group_id"), F.count("*").alias("size"))
    several = groups_of.filter("size > 1").select("label", "group_id")
    info = info.join(several, "label", "left").select("key", "class_id", F.col("copies").alias("n_copies"), "n_links", F.coalesce("group_id", "class_id").alias("group_id"))
    full = signed.filter("key IS NOT NULL").select("doc_id", "key").join(info, "key").drop("key")
    bare = signed.filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"))
    return full.unionByName(bare)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 5-grams of all ``documents``, similarity 0.8 or more."""
    return jaccard_join(table(spark, sf_dir, "documents", spread=True))


OP5_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
     g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
     k AS MATERIALIZED (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS key, count(*) AS n FROM g GROUP BY doc_id),
     c AS MATERIALIZED (SELECT key, min(doc_id) AS class_id, count(*) AS n_copies, any_value(n) AS n FROM k GROUP BY key),
     r AS MATERIALIZED (SELECT c.class_id, g.g FROM c JOIN g ON g.doc_id = c.class_id),
     p AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b, count(*) AS m FROM r a JOIN r b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
     l AS MATERIALIZED (SELECT a, b, y.n_copies AS copies FROM p JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE 10 * m >= 8 * (x.n + y.n - m)),
     reach(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
     q AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
     t AS (SELECT a, sum(copies) AS links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, coalesce(n_copies, 1)::BIGINT AS n_copies,
       (coalesce(links, 0) + coalesce(n_copies, 1) - 1)::BIGINT AS n_links, coalesce(group_id, w.doc_id) AS group_id
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.key = k.key LEFT JOIN t ON t.a = c.class_id LEFT JOIN q ON q.a = c.class_id
"""
