"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import bounded_batches, discard, stage, table, unused

WINDOW = 10
#: Bytes of benchmark text in one automaton (it takes about 60 times that in memory).
#: A larger benchmark is dealt by item over several, and the documents scanned once for each.
MAX_BYTES = 4_000_000
#: Word bytes stay (A-Z as a-z), all others become blanks: [0-9a-z] and all bytes over 0x7F.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def _automaton(items: list[tuple[int, str]], window: int):
    """Patterns are windows between blanks; a value holds (words, items) of a pattern."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        for i in range(max(1, len(words) - window + 1)) if words else ():
            part = words[i : i + window]
            found.setdefault(" " + b" ".join(part).decode("latin-1") + " ", (len(part), set()))[1].add(item)
    auto = ahocorasick.Automaton()
    for pattern, (n, ids) in found.items():
        auto.add_word(pattern, (n, len(pattern), tuple(ids)))
    if found:
        auto.make_automaton()
    return auto


def find_windows(data: bytes, auto) -> tuple[int, np.ndarray, set, list[tuple[int, int]]]:
    """Number of words, those that are hit, the items, and hit runs as byte offsets of the original."""
    folded = data.translate(FOLD)
    words = folded.split()
    hits, items = [], set()
    if words and len(auto):
        for end, (n, size, ids) in auto.iter(" " + b" ".join(words).decode("latin-1") + " "):
            hits.append((end - size + 1, n))
            items.update(ids)
    mask = np.zeros(len(words) + 1, np.int64)
    if hits:
        starts = np.cumsum([0] + [len(w) + 1 for w in words])  # of the blank before each word
        at = np.searchsorted(starts, np.array([s for s, _ in hits]))
        np.add.at(mask, at, 1)
        np.add.at(mask, at + np.array([n for _, n in hits]), -1)
    hit = np.flatnonzero(np.cumsum(mask)[:-1] > 0)
    return len(words), hit, items, hit_runs(folded, hit)


def hit_runs(folded: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words (numbers, ascending), as byte offsets of the original."""
    if not len(hit):
        return []
    blank = np.frombuffer(folded, np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    left, right = edge[::2], edge[1::2]  # where the words lie in the original
    new = np.flatnonzero(np.diff(hit) > 1) + 1
    return [(int(left[a]), int(right[b])) for a, b in zip(hit[[0, *new]], hit[[*(new - 1), -1]], strict=True)]


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All columns of ``docs`` and five more, which replace columns of their name:

    n_words, n_hit, n_items, items (ids sorted as strings) and spans. A window is ``window``
    consecutive words of an item; shorter items are one window. spans are the hit runs as
    [start, stop) byte offsets of the original UTF-8 text. Null and empty texts have no
    words; null item texts and empty benchmarks hit nothing; items with a null id hit words
    but are not listed; repeated rows of either table do not matter. A benchmark over
    ``max_bytes`` is dealt by hash over several automata of about half that size; the
    results are the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    added = ["n_words", "n_hit", "n_items", "items", "spans"]
    plain = [c for c in docs.columns if c not in added]
    found, more = unused(docs, "found"), unused(docs, "more")
    text = F.coalesce("text", F.lit(""))
    span = "array<struct<start:bigint,stop:bigint>>"
    as_rows = lambda runs: [{"start": a, "stop": b} for a, b in runs]

    def scan(auto):
        @F.pandas_udf(f"n_words bigint, hit array<int>, items array<string>, spans {span}")
        def windows(texts):
            import pandas as pd

            rows = [find_windows(t.encode(), auto.value) for t in texts]
            return pd.DataFrame({"n_words": [r[0] for r in rows], "hit": [r[1] for r in rows], "items": [sorted(str(x) for x in r[2] if x is not None) for r in rows], "spans": [as_rows(r[3]) for r in rows]})

        return windows(text)

    @F.pandas_udf(span)
    def merged(texts, hits):
        import pandas as pd

        return pd.Series([as_rows(hit_runs(t.encode().translate(FOLD), np.asarray(h))) for t, h in zip(texts, hits, strict=True)])

    known = bench.select("item_id", "text").filter("text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if size <= max_bytes else -(-2 * size // max_bytes)
    for k in range(n):  # the driver holds one slice of the benchmark, a worker one automaton at a time
        items = [tuple(r) for r in known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
        auto = spark.sparkContext.broadcast(_automaton(items, window))
        if k == 0:
            out = docs.select(*plain, scan(auto).alias(found))
        else:
            union = lambda f: F.array_sort(F.array_union(f"{found}.{f}", f"{more}.{f}")).alias(f)
            out = last.withColumn(more, scan(auto))
            out = out.withColumn(found, F.struct(F.col(f"{found}.n_words").alias("n_words"), union("hit"), union("items"))).drop(more)
        if n > 1:
            staged = stage(out, "hits")
            auto.destroy()
            if k:
                discard(last)
            last = out = staged
    count = lambda f: F.size(f"{found}.{f}").cast("long")
    spans = F.col(f"{found}.spans") if n == 1 else merged(text, F.col(f"{found}.hit"))
    return out.select(*plain, f"{found}.n_words", count("hit").alias("n_hit"), count("items").alias("n_items"), f"{found}.items", spans.alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    found = decontaminate(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT r, i, n, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
     h AS (SELECT r, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
     hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
     it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
