"""Filter interaction audit on a packed bitmap index.

Each partition packs which rows fail which filter, and which are labelled, into bitsets, part
by part. For every subset of filters that may have run before (a prefix), AND-NOT gives the
rows that are still there, and a popcount what each other filter removes of them. Counts of
partitions are summed by Spark; all orders of the filters are read off these sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, as_batch, bounded_batches, stage, table, to_arrow

FILTERS = "ABCDE"
PREFIXES = 1 << len(FILTERS)
#: Rows that a task holds, one byte and a part each, before it packs and counts them.
HELD = 1 << 18
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"


def failures(text: bytes, chars: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails; each is defined without a division."""
    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    upper = len(text) - len(text.translate(None, UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * chars) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def subset_counts(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of rows with bits ``fails``: [prefix, filter] to how many survive the prefix, of these fail the filter, and of these are good, and toxic."""
    bits = np.packbits((fails[None, :] >> np.arange(len(FILTERS))[:, None] & 1).astype(bool), axis=1)
    marks = np.packbits(np.stack([good, toxic]).astype(bool), axis=1)
    alive = np.empty((PREFIXES, bits.shape[1]), np.uint8)
    alive[0] = np.packbits(np.ones(len(fails), bool))
    for s in range(1, PREFIXES):
        top = s.bit_length() - 1
        alive[s] = alive[s ^ (1 << top)] & ~bits[top]
    out = np.zeros((PREFIXES, len(FILTERS), 4), np.int64)
    out[:, :, 0] = np.bitwise_count(alive).sum(axis=1, dtype=np.int64)[:, None]
    for f in range(len(FILTERS)):
        removed = alive & bits[f]
        out[:, f, 1] = np.bitwise_count(removed).sum(axis=1, dtype=np.int64)
        for m in range(2):
            out[:, f, 2 + m] = np.bitwise_count(removed & marks[m]).sum(axis=1, dtype=np.int64)
    return out


#: Prefixes and filters that are not in them.
CASES = [(s, f) for s in range(PREFIXES) for f in range(len(FILTERS)) if not s >> f & 1]


def _index(target: pa.Schema):
    """Rows (part, fails, good, toxic) to counts for each part and case."""
    at = tuple(np.array(CASES).T)

    def count(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        part = pc.dictionary_encode(rows.column("part")).combine_chunks()
        code = part.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        values = [rows.column(c).to_numpy()[order] for c in ("fails", "good", "toxic")]
        ends = np.cumsum(np.bincount(code))
        n = np.concatenate([subset_counts(*(v[a:b] for v in values))[at] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        prefix, which = (np.tile(x, len(ends)) for x in at)
        return as_batch({"part": pa.array(np.repeat(part.dictionary.to_numpy(zero_copy_only=False), len(CASES)), pa.string()), "prefix": prefix, "filter": which} | {c: n[:, k] for k, c in enumerate(("alive", "removed", "good_lost", "toxic_lost"))}, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield count(held)
                held = []
        if sum(b.num_rows for b in held):
            yield count(held)

    return run


def bitmap_counts(rows: DataFrame) -> DataFrame:
    """part, prefix, filter to alive, removed, good_lost, toxic_lost; ``rows``: part, fails, good, toxic."""
    schema = "part string, prefix int, filter int, alive long, removed long, good_lost long, toxic_lost long"
    counted = rows.mapInArrow(_index(to_arrow(rows.sparkSession, schema)), schema)
    return counted.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("alive", "removed", "good_lost", "toxic_lost")])


def judged(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, fails (a bit for each filter), good and toxic of each row of ``docs``.

    E is failed by rows whose text is that of a row with a smaller doc_id; a null doc_id is never
    smaller and never fails E. Of several labels for a document any 1 counts.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def features(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        raw = pc.cast(texts, pa.binary()).to_pylist()
        fails = [failures(b, n) for b, n in zip(raw, pc.utf8_length(texts).to_pylist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "fails": fails, "digest": [hashlib.sha256(b).digest() for b in raw]}

    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(arrow_map(own, f"doc_id {kind}, part string, fails int, digest binary", features), "filters")
    # both are staged, so that Spark can split the rows of a text, or of an id, that very many rows share
    first = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id"), "first-ids")
    marked = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    marked = stage(marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "marks")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    found = rows.join(first, "digest", "left").join(marked, "doc_id", "left")
    return found.select("part", (F.col("fails") + copy).alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What filters A to E remove, in each of their 120 orders; one row per part, order and step.

    ``docs``: doc_id, text and the column ``part`` (nulls: an empty string); ``labels``: doc_id,
    quality, toxic. Other columns are ignored, null texts are empty; repeated rows all count, and
    rows of one doc_id are no copies of each other. Columns: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = bitmap_counts(judged(docs, labels, part))
    # 16 rows for each part and filter, one for each prefix
    same = Window.partitionBy("part", "filter")
    total = lambda c: F.sum(c).over(same)
    size = F.bit_count("prefix")
    orders_with = F.element_at(F.array(*map(F.lit, (24, 6, 4, 6, 24))), size + 1)  # of the filters before, and of those after
    counts = counts.withColumns({
        "fails": total(F.when(size == 0, F.col("removed"))),
        "unique_fails": total(F.when(size == len(FILTERS) - 1, F.col("removed"))),
        "shapley": total(F.col("removed") * orders_with),
    })
    steps = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(len(o))]
    orders = spark.createDataFrame(steps, "filter_order string, step int, prefix int, filter int")  # 600 rows
    found = counts.join(F.broadcast(orders), ["prefix", "filter"])
    return found.select("part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by source, with ``labels``."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
     m AS MATERIALIZED (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
     f AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
            + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS fails
          FROM w LEFT JOIN m USING (doc_id)),
     g AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
     l(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
           WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
     s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prefix FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS MATERIALIZED (SELECT part, filter_order, step::INT AS step, bit,
            sum(CASE WHEN fails & (prefix | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN fails & prefix = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN fails & prefix > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN fails & prefix = 0 AND fails & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN fails & prefix = 0 AND fails & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
