"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed lower-case words and runs of signs, trigrams of the bytes as they are, and
trigrams of classes of bytes. Counts are weighted (log, idf), each kind to unit length, and
projected on the leading right singular vectors of the sample's term matrix. These come from
subspace iteration: Spark adds up X'(XQ) over the sample's rows, the driver only turns Q.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, bounded_batches, stage, table
from lanewise.llm.toxicity import bucket, labelled

#: Bound of the labelled sample (half of it for each label), and so of what is broadcast:
#: at most 4,096 vectors of 64 floats (1 MB) and one projection of 14,336 x 64 floats (3.7 MB).
SAMPLE_ROWS = 4096
DIMS, SPARE, TURNS = 64, 16, 2
NEIGHBOURS = 25
#: Slots of words, of byte trigrams, of trigrams of byte classes.
KINDS = (8192, 4096, 2048)
TERMS = sum(KINDS)
WORD = re.compile(r"[^\W_]+|[^\w\s]+")
#: Classes of bytes: lower, upper, digit, blank, line end, non-ASCII, and each sign by itself.
CLASSES = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c == 10 else 3 if c <= 32 else 0 if c > 127 else 5 + c % 32 for c in range(256)], np.int64)
N_CLASSES = 37
#: Documents whose vectors are made at once.
BLOCK = 128


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed terms."""
    out = np.zeros((len(texts), TERMS), np.float32)
    words, raw, shapes = np.split(out, np.cumsum(KINDS)[:-1], axis=1)
    for r, text in enumerate(texts):
        for w, n in Counter(WORD.findall(text.lower())).items():
            words[r, zlib.crc32(w.encode()) % KINDS[0]] += n
        b = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
        if len(b) > 2:
            c = CLASSES[b]
            raw[r] = np.bincount((((b[:-2] << 8 | b[1:-1]) << 8 | b[2:]) * 2654435761 >> 11) % KINDS[1], minlength=KINDS[1])
            shapes[r] = np.bincount((((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]) * 2654435761 >> 7) % KINDS[2], minlength=KINDS[2])
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts by idf, each kind to unit length; empty texts stay zero."""
    x = np.log1p(counts) * idf
    for kind in np.split(x, np.cumsum(KINDS)[:-1], axis=1):
        kind /= np.maximum(np.linalg.norm(kind, axis=1, keepdims=True), 1e-9)
    return x


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    x = np.zeros((batch.num_rows, TERMS), np.float32)
    for row, at, n in zip(x, batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    return x


def fit(sample: DataFrame):
    """idf, projection, unit vectors and labels of the sample; None if it is empty."""
    kind = f"doc_id {dict(sample.dtypes)['doc_id']}, y int, at binary, n binary"

    def sparse(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0), "y": batch.column(1), "at": [], "n": []}
        texts = batch.column(2).to_pylist()
        for k in range(0, len(texts), BLOCK):
            for v in term_counts(texts[k : k + BLOCK]):
                at = np.flatnonzero(v)
                out["at"].append(at.astype(np.uint16).tobytes())
                out["n"].append(v[at].tobytes())
        return out

    rows = arrow_map(sample.select("doc_id", "y", "text"), kind, sparse)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("at", "n", "y")).alias("v")).select("doc_id", "v.*")  # of rows with one doc_id, one
    rows = stage(rows.repartition(8, "doc_id").sortWithinPartitions("doc_id"), "quality-sample")

    def add_up(of, shape: tuple) -> np.ndarray:
        """Sum over the sample's blocks of what ``of`` makes of their counts; one block's at a time comes to the driver."""

        def part(batches):
            total = np.zeros(shape, np.float64)
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK):
                    total += of(_dense(batch.slice(k, BLOCK)))
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["total"])

        total = np.zeros(shape, np.float64)
        for r in rows.select("at", "n").mapInArrow(part, "total binary").toLocalIterator():
            total += np.frombuffer(r["total"], np.float32).reshape(shape)
        return total

    size = rows.count()
    if not size:
        return None
    df = add_up(lambda x: (x > 0).sum(axis=0), (TERMS,))
    idf = (np.log((1 + size) / (1 + df)) + 1).astype(np.float32)
    q = np.linalg.qr(np.random.RandomState(5).standard_normal((TERMS, DIMS + SPARE)))[0].astype(np.float32)
    for _ in range(TURNS):
        seen = rows.sparkSession.sparkContext.broadcast(q)
        q = np.linalg.qr(add_up(lambda x, seen=seen: (w := weigh(x, idf)).T @ (w @ seen.value), q.shape))[0].astype(np.float32)
        seen.destroy()
    seen = rows.sparkSession.sparkContext.broadcast(q)

    def project(batch: pa.RecordBatch) -> dict:
        parts = [weigh(_dense(batch.slice(k, BLOCK)), idf) @ seen.value for k in range(0, batch.num_rows, BLOCK)]
        return {"y": batch.column("y"), "z": [v.astype(np.float32).tobytes() for p in parts for v in p]}

    found = [(r["y"], np.frombuffer(r["z"], np.float32)) for r in arrow_map(rows.select("y", "at", "n"), "y int, z binary", project).toLocalIterator()]
    seen.destroy()
    z = np.array([v for _, v in found])
    basis = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :DIMS].astype(np.float32)
    latent = z @ basis
    return idf, q @ basis, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9), np.array([y for y, _ in found], np.float32)


def vote(cosines: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest of each row, and all that are as near as the last of them."""
    k = min(k, len(labels))
    least = np.partition(cosines, len(labels) - k, axis=1)[:, len(labels) - k, None]
    weight = np.where(cosines >= least, np.maximum(cosines, 1e-6).astype(np.float64) ** 8, 0)
    return (weight @ labels) / weight.sum(axis=1)


def quality(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, k: int = NEIGHBOURS, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of each row, as column ``out``, which replaces one of its name.

    Labelled vectors of a sample of at most ``rows`` documents, for which ``learn`` holds, are
    broadcast; every document's cosines with all of them are computed in blocks, exactly.
    Null and empty texts get the share of label 1 in the sample; without labels, 1.
    Columns of ``docs`` other than doc_id and text pass through unread.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = fit(labelled(docs, labels, "quality", learn, rows))
    if found is None:
        return docs.withColumn(out, F.lit(1.0))
    model = spark.sparkContext.broadcast(found)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        idf, basis, known, ys = model.value
        scores = np.full(len(text), float(ys.mean()))
        for at in range(0, len(text), BLOCK):
            x = weigh(term_counts(text.iloc[at : at + BLOCK].tolist()), idf) @ basis
            norm = np.linalg.norm(x, axis=1)
            full = norm > 1e-6
            if full.any():
                scores[at : at + len(x)][full] = vote((x[full] / norm[full, None]) @ known.T, ys, k)
        return pd.Series(np.clip(scores, 0, 1))

    return docs.withColumn(out, score(F.coalesce("text", F.lit(""))))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"), bucket(5) != 0)
    return scored.select("doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
