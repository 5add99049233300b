"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import arrow_map, bounded_batches, table

#: Vocabulary used where none is named; see the README of the public tokenizers.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths are summed up in blocks of this many, so that no window holds all of them.
BLOCK = 1024
#: White space from so many characters on goes past the tokenizer's pattern, which overflows its stack on a run of a million.
RUN = 4096
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str) -> int:
    """Tokens of a text. The pattern makes one piece of a run of white space, but for its last character where
    something follows; a long run is given to the merges as that piece, so counts are those of the whole text."""
    n = at = 0
    for m in LONG_RUN.finditer(text):
        stop = m.end() - (m.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : stop]))
        at = stop
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def token_counts(docs: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """doc_id, n_tokens of every whole text (null and empty texts: 0); other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> dict:
        encoding = _encoding(ranks)
        return {"doc_id": batch.column(0), "n_tokens": [count_tokens(encoding, t) if t else 0 for t in batch.column(1).to_pylist()]}

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long", rows)


def length_histogram(counts: DataFrame) -> DataFrame:
    """For each encoded length that occurs, used as a context limit:

    n_docs of that length, n_longer (documents over the limit), total_tokens (of all
    documents), kept_tokens (when longer ones are truncated to the limit), lost_tokens, and
    share (of documents at or under the limit; the q-quantile is the first length with
    share >= q). An empty table gives no rows.
    """
    hist = counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # one row for each 1,024 lengths: few, whatever the number of documents
    blocks = blocks.select("block", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"), F.sum("docs").over(every).alias("all_docs"), F.sum("tokens").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    suffix = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    joined = hist.withColumn("n_longer", suffix("n_docs")).withColumn("longer_tokens", suffix("tokens")).join(blocks, "block")
    longer, lost = F.col("n_longer") + F.col("docs_above"), F.col("longer_tokens") + F.col("tokens_above")
    over = lost - F.col("n_tokens") * longer
    return joined.select("n_tokens", "n_docs", longer.alias("n_longer"), "total_tokens", (F.col("total_tokens") - over).alias("kept_tokens"), over.alias("lost_tokens"), (1 - longer / F.col("all_docs")).alias("share"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """n_longer, kept_tokens and lost_tokens for any context limits, from the histogram alone."""
    tokens, docs = F.col("n_tokens"), F.col("n_docs")
    aggs: list[Column] = []
    for k in limits:
        aggs.append(F.struct(F.lit(k).cast("long").alias("context"), F.coalesce(F.sum(F.when(tokens > k, docs)), F.lit(0)).alias("n_longer"), F.coalesce(F.sum(F.least(tokens, F.lit(k)) * docs), F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(F.when(tokens > k, (tokens - k) * docs)), F.lit(0)).alias("lost_tokens")).alias(f"k{k}"))
    return histogram.agg(*aggs).select(F.inline(F.array(*[f"k{k}" for k in limits])))


def quantiles(histogram: DataFrame, qs: list[float]) -> DataFrame:
    """The smallest length at or under which a share q of the documents lies."""
    return histogram.agg(*[F.min(F.when(F.col("share") >= q, F.col("n_tokens"))).alias(f"q{q}") for q in qs])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all ``documents``, with its suffix sums."""
    return length_histogram(token_counts(table(spark, sf_dir, "documents", spread=True)))
