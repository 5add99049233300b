"""MinHash near-dedup with min-max hashing.

Under each permutation both the least and the greatest hash of a set are kept: either agrees
between two sets with the chance of their similarity, so one evaluation gives two values of the
signature. Bands of the signature give candidates, and these components.

Only components of true links are asked for, so large groups of candidates are not verified pair
by pair: each group is dealt into slices that share a few leaders, and all pairs of a slice are
verified on their full sets. Slices are then connected by their leaders. Only classes outside the
largest connected part of their group still have pairs that matter; these are verified against
all other slices, so that no link between different parts is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, as_batch, bounded_batches, discard, partitions, stage, table, to_arrow
from lanewise.llm.components import components
from lanewise.llm.jaccard_join import links_within

NGRAM = 3
THRESHOLD = 0.85
#: Two values each; in bands of so many. A pair at the threshold misses all 28 bands once in 570,000.
PERMUTATIONS, ROWS = 84, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Classes, and bytes of their sets, in a slice of a group, and leaders that all slices of it have.
SLICE, SLICE_BYTES, LEADERS = 256, 32 << 20, 16
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _hashes() -> dict[bytes, int]:
    return {}


def shingles(text: bytes, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words of UTF-8 text, A-Z lower-cased; fewer words are one run."""
    known = _hashes()
    if len(known) > 1 << 16:  # a bounded memory of words
        known.clear()
    out = []
    for w in text.lower().split():  # of bytes: A-Z, and at \x20 and \x09-\x0D only
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    h = np.array(out, np.uint64)
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
    rng = np.random.RandomState(23)
    draw = lambda: rng.randint(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
    return draw() | np.uint32(1), draw()


def signature(s: np.ndarray) -> np.ndarray:
    """The minima, then the maxima, of the set under each permutation."""
    a, b = _permutations()
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for k in range(0, len(x), 1024):
        h = a * x[k : k + 1024] + b
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(s: np.ndarray) -> list[int]:
    """A hash of each band, with its number."""
    rows = signature(s).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) - 2**63 for k, r in enumerate(rows)]


def _stars(classes: DataFrame) -> DataFrame:
    """Candidates: (u, v), v being the least class in a band of u. Both sides are staged, so that Spark can split a hot band."""
    rows = stage(classes.select("key", F.explode("bands").alias("band")), "bands")
    heads = stage(rows.groupBy("band").agg(F.min("key").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")
    return rows.join(heads, "band").filter("key <> v").select(F.col("key").alias("u"), "v")


def _verify(target: pa.Schema, ratio: Fraction):
    """Rows (comp, i, j, key, slice, s), sorted by comp, i, j and key, to (comp, key, label): the least key that links of the group lead to.

    With i = j all pairs of the group are looked at, else those across.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            sets = [np.frombuffer(r[5], np.uint64) for r in held]
            side = None if held[0][1] == held[0][2] else np.array([r[4] == held[0][1] for r in held]).astype(int)
            _, label = links_within(sets, np.ones(len(held), np.int64), side, ratio)
            return as_batch({"comp": [r[0] for r in held], "key": [r[3] for r in held], "label": [held[k][3] for k in label]}, target)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield close()
                    held = []
                if not held or row[3] != held[-1][3]:  # a leader may come twice: as such, and by its own slice
                    held.append(row)
        if held:
            yield close()

    return run


def _linked(groups: DataFrame, ratio: Fraction) -> DataFrame:
    spark = groups.sparkSession
    schema = "comp binary, key binary, label binary"
    order = ["comp", "i", "j", "key"]
    rows = groups.select("comp", "i", "j", "key", "slice", "s").repartition(partitions(spark), "comp", "i", "j").sortWithinPartitions(*order)
    return stage(rows.mapInArrow(_verify(to_arrow(spark, schema), ratio), schema), "links")


def connected(members: DataFrame, ratio: Fraction) -> DataFrame:
    """(key, label) of classes that are linked to others; ``members``: comp, key, s (a group of candidates, a class, its set)."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / SLICE, F.sum(F.octet_length("s")) / SLICE_BYTES)).cast("int").alias("slices"))
    sizes = stage(sizes, "slices")
    dealt = members.join(sizes, "comp").withColumn("slice", F.pmod(F.xxhash64("key", F.lit(3)), F.col("slices")).cast("int"))
    large = dealt.filter("slices > 1")
    # about so many for each group, by lot: more or fewer only change how much is left to look at below
    leaders = large.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.col("n")) < LEADERS).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    columns = ["comp", "key", "s", "slice"]
    own = dealt.select(columns).unionByName(leaders.select(columns)).withColumns({"i": F.col("slice"), "j": F.col("slice")})
    first = _linked(own, ratio)
    if sizes.filter("slices > 1").isEmpty():
        return first.select("key", "label")
    # a group of one slice is done; the others have their leaders in all of theirs
    several = sizes.filter("slices > 1").select("comp")
    alone = first.join(several, "comp", "left_anti").select("key", "label")
    links = first.join(several, "comp", "left_semi").filter("key <> label").select(F.col("key").alias("u"), F.col("label").alias("v"))
    parts = stage(components(links).select(F.col("v").alias("key"), "label"), "parts")
    # classes of large groups by connected part; those outside the largest part of their group have pairs left to look at
    placed = stage(large.select("comp", "key").join(parts, "key", "left").select("comp", "key", F.coalesce("label", "key").alias("label")), "placed")
    largest = placed.groupBy("comp", "label").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("parts"), (F.sum("size") - F.max("size")).alias("outside"))
    largest = stage(largest.filter("parts > 1").select("comp", "main", F.ceil(F.col("outside") / SLICE).cast("int").alias("left")), "largest")
    if largest.isEmpty():
        return alone.unionByName(parts)
    # what is outside gets slices of its own, numbered after the others
    again = large.join(largest, "comp").join(placed, ["comp", "key"])
    last = F.col("slices") + F.col("left") - 1
    again = again.withColumn("slice", F.when(F.col("label") == F.col("main"), F.col("slice")).otherwise(F.col("slices") + F.pmod(F.xxhash64("key", F.lit(5)), F.col("left")).cast("int")))
    again = again.withColumn("other", F.explode(F.when(F.col("slice") < F.col("slices"), F.sequence("slices", last)).otherwise(F.sequence(F.lit(0), last))))
    pairs = again.select(*columns, F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"))
    found = _linked(pairs, ratio).filter("key <> label")
    # what is left to connect are the parts
    named = placed.select("key", "label")
    found = found.select("key", F.col("label").alias("to")).join(named.withColumnRenamed("label", "u"), "key").join(named.select(F.col("key").alias("to"), F.col("label").alias("v")), "to")
    merged = components(found.select("u", "v")).select(F.col("v").alias("label"), F.col("label").alias("merged"))
    return alone.unionByName(placed.join(merged, "label", "left").select("key", F.coalesce("merged", "label").alias("label")))


def minmax_dedup(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id and kept.

    Rows are linked whose sets of word n-grams have at least the similarity ``threshold``; component_id
    is the least doc_id that links lead to, and kept tells whether that is the row's own. Texts without
    words, null ones too, have an empty set, are linked to nothing and kept. Null doc_ids are never a
    component_id where the component has another; rows that share a doc_id are rows of their own. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    ratio = Fraction(threshold).limit_denominator(10_000)
    text = F.coalesce("text", F.lit("")).cast("binary")
    source = docs.select("doc_id", F.md5(text).alias("md5"), text.alias("text"))

    def sign(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, ngram) for t in batch.column("text").to_pylist()]
        full = lambda f: [f(s) if len(s) else None for s in sets]
        return {"doc_id": batch.column("doc_id"), "md5": batch.column("md5"), "n": [len(s) for s in sets], "key": full(lambda s: xxhash.xxh3_128_digest(s.tobytes())), "bands": full(bands)}

    signed = stage(arrow_map(source, f"doc_id {kind}, md5 string, n long, key binary, bands array<bigint>", sign), "signatures")
    classes = signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "md5")).alias("rep"), F.min("bands").alias("bands"))
    classes = stage(classes, "classes")
    groups = components(_stars(classes)).select(F.col("v").alias("key"), F.col("label").alias("comp"))
    members = stage(groups.join(classes, "key").select("comp", "key", "rep.doc_id", "rep.md5"), "members")
    texts = source.alias("d").join(members.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.md5 = m.md5")).select("m.comp", "m.key", "d.text")

    seen: set[bytes] = set()  # of a task: rows may repeat a representative's id and text

    def sets(batch: pa.RecordBatch) -> dict:
        new = [k for k, key in enumerate(batch.column("key").to_pylist()) if not (key in seen or seen.add(key))]
        batch = batch.take(pa.array(new, pa.int64()))
        return {"comp": batch.column("comp"), "key": batch.column("key"), "s": [shingles(t, ngram).tobytes() for t in batch.column("text").to_pylist()]}

    with_sets = stage(arrow_map(texts, "comp binary, key binary, s binary", sets), "sets")
    labels = connected(with_sets, ratio)
    known = stage(classes.select("key", "class_id").join(labels, "key", "left").select("key", "class_id", F.coalesce("label", "key").alias("label")), "labels")
    least = known.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("size")).filter("size > 1").drop("size")
    known = stage(known.join(least, "label", "left").select("key", F.coalesce("component_id", "class_id").alias("component_id")), "component-ids")
    for old in (with_sets, members):
        discard(old)
    full = signed.select("doc_id", "n", "key").join(known, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-grams of all ``documents``, similarity 0.85 or more."""
    return minmax_dedup(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
     k AS MATERIALIZED (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS key, count(*) AS n FROM g GROUP BY doc_id),
     c AS MATERIALIZED (SELECT key, min(doc_id) AS class_id, any_value(n) AS n FROM k GROUP BY key),
     r AS MATERIALIZED (SELECT c.class_id, g.g FROM c JOIN g ON g.doc_id = c.class_id),
     p AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b, count(*) AS m FROM r a JOIN r b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
     l AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
     reach(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
     q AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, coalesce(q.component_id, w.doc_id) AS component_id, coalesce(q.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.key = k.key LEFT JOIN q ON q.a = c.class_id
"""
