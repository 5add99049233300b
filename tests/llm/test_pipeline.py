"""The pipeline's stages against brute-force decisions on their own inputs."""

import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import sentencepiece
from pyspark.sql import functions as F

from lanewise.llm import sentencepiece_scan
from lanewise.llm.common import stage


def kept_by_hand(rows, length=50):
    """doc_id and what is left of each text: as it is if nothing goes, without halves of characters else, None if no byte is left."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield d, t if not any(gone) else left.decode("utf-8", "ignore") if left else None


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    from lanewise.llm.decontaminate import _automaton, find_windows
    from lanewise.llm.jaccard_join import shingles

    auto = _automaton([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()], 10)
    for name, step in cp.STAGES:
        before = docs
        docs = stage(step(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == before.columns
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            texts = {r[0]: set(shingles(r[1] or "").tolist()) for r in before.select("doc_id", "text").collect()}
            root = {k: k for k in texts}

            def find(k):
                while root[k] != k:
                    k = root[k]
                return k

            keys = sorted(texts)
            for i, a in enumerate(keys):
                for b in keys[i + 1 :]:
                    if texts[a] and texts[b] and 10 * len(texts[a] & texts[b]) >= 8 * len(texts[a] | texts[b]):
                        root[max(find(a), find(b))] = min(find(a), find(b))
            assert ids == {k for k in keys if find(k) == k}
        if name == "quality classifier":
            # of labelled documents that the classifier has not seen, nearly all are judged as their label says
            known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            held = [k for k in known if zlib.crc32(str(k).encode()) % 5 == 0]
            assert sum((k in ids) == (known[k] == 1) for k in held) >= 0.85 * len(held) > 0  # the smallest table has 19 of them, and 80 to learn from
        if name == "suffix-array dedup":
            want = {k: rest for k, rest in kept_by_hand([tuple(r) for r in before.select("doc_id", "text").collect()]) if rest is not None}
            assert {r[0]: r[1] for r in docs.select("doc_id", "text").collect()} == want
        if name == "SentencePiece encoding":
            lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.DEFAULT_MODEL)
            texts = {r[0]: r[1] for r in before.select("doc_id", "text").collect()}
            for r in docs.select("doc_id", "ids").collect():
                assert lib.decode(list(r["ids"])).strip(" ") == (texts[r["doc_id"]] or "").strip(" ")
        if name == "benchmark decontamination":
            assert ids == {r[0] for r in before.select("doc_id", "text").collect() if not find_windows((r[1] or "").encode(), auto)[2]}
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] == sizes[5] > 0
    assert docs.filter("NOT round_trip").count() == 0


def test_pipeline_edges(spark, sf_dir):
    import corpus_pipeline as cp
    from edge import frame

    docs = frame(spark).withColumn("score", F.lit(5.5)).withColumn("Kept", F.lit("own")).withColumn("n_words", F.col("n_words") + 77)
    for start in (docs, docs.limit(0)):
        out = start
        for name, step in cp.STAGES:
            out = stage(step(spark, out, sf_dir), "test")
            if name != cp.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert out.filter("score <> 5.5 OR Kept <> 'own' OR n_words <> 77 OR items <> 'kept' OR spans <> 'n'").isEmpty()
        assert out.count() <= start.count()
