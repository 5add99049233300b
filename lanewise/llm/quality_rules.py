"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
NGRAM = 5
#: Rows on which costs and selectivities are estimated; verdicts never depend on them.
SAMPLE_ROWS = 2000
#: Times that each rule is tried on them.
RUNS = 3

# A rule is true where a text is bad. The rules see `text`, `words` and the base columns.


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def default_rules() -> dict[str, Column]:
    return {
        "symbols_per_word": F.col("n_symbols") > 0.3 * F.col("n_words"),
        "mean_word_length": ~F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words")),
        "repeated_lines": F.col("n_dup_lines") > 0.3 * F.col("n_lines"),
        "capitals": F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) > 0.5 * _letters(F.col("text")),
        "few_letters": _letters(F.col("text")) < 0.6 * F.col("word_chars"),
        "one_word_repeated": F.size(F.array_distinct("words")) < 0.1 * F.least(F.col("n_words"), F.lit(500)),
        "exclamations": F.length("text") - F.length(F.translate("text", "!", "")) > 0.3 * F.col("n_words"),
    }


def base_columns(docs: DataFrame) -> DataFrame:
    """The whole text's words and the counts that the contract names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("words"))
    out = out.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.translate("text", SPACE, "")).cast("long"), "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"), "lines": F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)})
    out = out.withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    return out.withColumn("n_repeat_words", repeat_words(F.col("words"))).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur at least twice in the text.

    Windows are compared by 64-bit hash. Sorting the hashes finds the repeated ones; the
    few texts that have any sort (hash, position) pairs too, and add up min(5, distance to
    the next repeated window) over the positions, so the work is n log n for any text.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - NGRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(NGRAM)]))
    return F.when(F.size(words) < NGRAM, F.lit(0)).otherwise(_repeats(windows)).cast("long")


def _repeats(windows: Column) -> Column:
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twin = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        at = F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(NGRAM), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, F.get(F.transform(F.array(pairs), covered), F.lit(0))).otherwise(0)


def estimate(docs: DataFrame, rules: dict[str, Column], rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds and share rejected of each rule, over a sample of about ``rows`` rows."""
    total = docs.count()
    if not total:
        return dict.fromkeys(rules, (1.0, 0.0))
    sample = base_columns(docs.sample(min(1.0, rows / total), seed=7)).cache()
    n = max(1, sample.count())
    found = {}

    def least(rule: Column) -> tuple[float, int]:
        """The shortest of several runs, as the first one compiles."""
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = sample.filter(rule).count()
            times.append(time.perf_counter() - began)
        return min(times), rejected

    idle, _ = least(F.col("n_words") < 0)  # what a run costs besides its rule
    for name, rule in rules.items():
        seconds, rejected = least(rule)
        found[name] = (max(seconds - idle, 1e-3), rejected / n)
    sample.unpersist()
    return found


def order(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejection for its cost first; ties by name."""
    return sorted(estimates, key=lambda k: (-estimates[k][1] / max(estimates[k][0], 1e-6), k))


def quality_cascade(docs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs`` with the base counts, base_failed and kept.

    A text is kept if it passes the base check and every rule. The rules form one CASE
    expression, so a text that fails one is not tried on the costlier ones behind it.
    Null texts have no words and fail the base check; an empty table gives no rows;
    repeated rows are judged one by one; other columns of ``docs`` are ignored.
    """
    rules = default_rules() if rules is None else rules
    base = base_columns(docs)
    names = order(estimate(docs, rules))
    kept = F.when(F.col("base_failed"), False)
    for name in names:
        kept = kept.when(rules[name], False)
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.otherwise(True).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over all ``documents``."""
    return quality_cascade(table(spark, sf_dir, "documents", spread=True))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
     b AS (SELECT *, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                  length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters FROM w),
     g AS (SELECT r, i, words[i:i+4] AS gram FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)),
     g2 AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
     c AS (SELECT r, count(DISTINCT i + k) AS n FROM g2, range(0, 5) AS t(k) GROUP BY r),
     m AS (SELECT b.*, coalesce(c.n, 0) AS n_repeat_words FROM b LEFT JOIN c USING (r)),
     f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3 * n_words OR NOT word_chars BETWEEN 2 * n_words AND 20 * n_words
            OR n_dup_lines > 0.3 * n_lines OR length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 0.5 * letters
            OR letters < 0.6 * word_chars OR len(list_distinct(words)) < 0.1 * least(n_words, 500)
            OR length(text) - length(replace(text, '!', '')) > 0.3 * n_words) AS kept
FROM f
"""
