"""Toxicity by a factorization machine (Spark ML) over hashed terms.

The machine gets the slots of hashed terms that tell something about the label: alone, or in
pairs. A pair counts if its presence tells twice as much as that of either term, so a group
mention that is as common in clean texts enters through the insults it stands with.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import bounded_batches, stage, table

#: Terms are hashed to so many slots.
SLOTS = 2**22
#: Of these, so many at most enter by themselves, and so many by pairs.
FEATURES, PAIRED = 512, 256
#: Least likelihood ratio of a term, and what a pair must tell more than its terms, so that small samples do not learn chance terms.
SIGNIFICANT = 25.0
#: Pairs are counted among so many slots, those in most toxic documents but not in over half of all.
CANDIDATES = 1024
STEMS = (2, 3, 4)
WORD = re.compile(r"[^\W_]+")
#: Bound of the labelled sample that is learnt from (documents, half of it for each label).
SAMPLE_ROWS = 16_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int) -> DataFrame:
    """Up to ``rows`` / 2 documents of either label for which ``learn`` holds: doc_id, text, y."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = None
    for y in (0, 1):
        half = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        pick = half if pick is None else pick.unionByName(half)
    # at most `rows` ids: 16 bytes each
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id")


def slot(term: str) -> int:
    return zlib.crc32(term.encode()) % SLOTS


def terms(word: str) -> list[str]:
    """A word and its first 2, 3 and 4 letters, which words made from one stem share."""
    return [word, *(f"^{word[:k]}" for k in STEMS)]


@functools.lru_cache(maxsize=1 << 17)
def word_slots(word: str) -> tuple[int, ...]:
    return tuple(map(slot, terms(word)))


def text_slots(text: str) -> set[int]:
    """The slots of the distinct lower-case words of a text."""
    return set().union(*map(word_slots, set(WORD.findall(text.lower()))))


def with_slots(docs: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """``docs`` with ``slots``: those that its ``text`` fills, or which of the ``chosen`` ones (by place) it fills."""
    bounded_batches(docs.sparkSession)
    place = None if chosen is None else {s: k for k, s in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def filled(text):
        import pandas as pd

        if place is None:
            return pd.Series([np.fromiter(text_slots(t), np.int32) for t in text])
        return pd.Series([np.array([place[s] for s in text_slots(t) & place.keys()], np.int32) for t in text])

    return docs.withColumn("slots", filled("text"))


def likelihood_ratio(p, n, pos: float, neg: float):
    """How much it tells that of ``n`` documents with a term (or pair) ``p`` are toxic, of ``pos`` and ``neg`` in all."""
    p, n = np.asarray(p, np.float64), np.asarray(n, np.float64)
    total = pos + neg

    def part(seen, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0.0)

    return 2 * (part(p, n * pos / total) + part(n - p, n * neg / total) + part(pos - p, (total - n) * pos / total) + part(neg - (n - p), (total - n) * neg / total))


def telling_slots(sample: DataFrame) -> list[int]:
    """Slots that tell about the label by themselves or in pairs; ``sample``: y, slots."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counts = sample.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("y").alias("p"), F.count("*").alias("n")).filter("n >= 3")
    p, n = F.col("p"), F.col("n")
    expected = n * (pos / (pos + neg))
    # a cheap bound first: what is this close to its share tells less than SIGNIFICANT
    far = counts.filter((p - expected) * (p - expected) > F.least(expected, n - expected))
    single = far.toPandas()
    single["tells"] = likelihood_ratio(single["p"], single["n"], pos, neg)
    best = single[single["tells"] >= SIGNIFICANT].sort_values(["tells", "slot"], ascending=[False, True]).head(FEATURES)
    often = [r["slot"] for r in counts.filter(n <= (pos + neg) / 2).orderBy(F.desc("p"), "slot").limit(CANDIDATES).collect()]
    return sorted({*best["slot"].astype(int), *_paired(sample, sorted(often), pos, neg)})


def _paired(sample: DataFrame, slots: list[int], pos: float, neg: float) -> list[int]:
    """Slots of pairs that tell at least twice as much as either of their terms."""
    m = len(slots)
    if not m:
        return []
    known = np.array(slots)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, m, m), np.float32)
        for batch in batches:
            for y in (0, 1):
                rows = batch.filter(pa.array(batch.column(0).to_numpy() == y))
                x = np.zeros((rows.num_rows, m), np.float32)
                lists = rows.column(1)
                flat = lists.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, flat), m - 1)
                hit = known[at] == flat
                row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
                x[row[hit], at[hit]] = 1
                both[y] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["both"])

    total = np.zeros((2, m, m), np.float64)
    for r in sample.select("y", "slots").mapInArrow(together, "both binary").toLocalIterator():
        total += np.frombuffer(r["both"], np.float32).reshape(2, m, m)
    tells = likelihood_ratio(total[1], total.sum(axis=0), pos, neg)
    alone = np.diag(tells)
    best = np.maximum(alone[:, None], alone[None, :])
    more = np.triu(tells - best, 1)
    more[(total.sum(axis=0) < 3) | (more < best)] = 0
    out: dict[int, None] = {}
    for at in np.argsort(-more, axis=None, kind="stable"):
        i, j = divmod(int(at), m)
        if more[i, j] < SIGNIFICANT or len(out) > PAIRED - 2:
            break
        out |= {slots[i]: None, slots[j]: None}
    return list(out)


def vectors(docs: DataFrame, n: int) -> DataFrame:
    """``features``: a vector of ``n``, 1 at the places that ``slots`` lists."""
    places = F.sequence(F.lit(0), F.lit(n - 1))
    # inside an array, so that the places are made once a row
    rows = F.get(F.transform(F.array("slots"), lambda hit: F.transform(places, lambda k: F.array_contains(hit, k).cast("double"))), F.lit(0))
    return docs.withColumn("features", array_to_vector(rows)).drop("slots")


def fit(sample: DataFrame):
    """Slots and the model; None if the sample lacks a label or no term tells anything."""
    sample = stage(with_slots(sample.repartition(8)).select("y", "slots"), "toxic-sample")
    if sample.select("y").distinct().count() < 2:
        return None
    slots = telling_slots(sample)
    if not slots:
        return None
    place = F.create_map(*[F.lit(x) for k, s in enumerate(slots) for x in (s, k)])
    hits = F.transform(F.array_intersect("slots", F.array(*map(F.lit, slots))), lambda s: F.element_at(place, s))
    data = vectors(sample.withColumn("slots", hits), len(slots))
    data = stage(data.select(F.col("y").cast("double").alias("label"), "features"), "toxic-vectors")
    data = VectorAssembler(inputCols=["features"], outputCol="sparse").transform(data).select("label", F.col("sparse").alias("features")).coalesce(8).cache()
    model = FMClassifier(factorSize=4, maxIter=60, stepSize=0.05, regParam=1e-3, initStd=0.01, seed=7).fit(data)
    data.unpersist()
    return slots, model


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``; other columns are ignored.

    Learns from labelled documents for which the condition ``learn`` holds. Null and empty
    texts score as the model's intercept does; without labels of both kinds, or without a term
    that tells anything, every score is the share of positive ones (0 if there are none).
    """
    found = fit(labelled(docs, labels, "toxic", learn, rows))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if found is None:
        share = labels.filter(learn).agg(F.avg("toxic")).first()[0] or 0.0
        return source.select("doc_id", F.lit(float(share)).alias("score"))
    slots, model = found
    scored = model.transform(vectors(with_slots(source, slots), len(slots)).select("doc_id", "features"))
    return scored.select("doc_id", vector_to_array("probability")[1].alias("score"))


def bucket(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; rows with crc32(doc_id) mod 3 = 1 are held out."""
    scored = toxicity(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"), bucket(3) != 1)
    return scored.select("doc_id", F.coalesce(bucket(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
