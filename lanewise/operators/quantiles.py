"""Exact quantiles of groups of any size.

An aggregate that gathers a group's values in one buffer does for a board, not for a corpus. Here the
values are numbers of 64 bits in the order of the values, and each pass fixes 16 bits of every quantile
asked for: counts by the next 16 bits, within the prefixes that are still wanted, tell where the rank lies.
A pass groups before it shuffles, and no group is over 65,536 counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.labels import rounded
from lanewise.staging import discard, stage

BITS = 16
PASSES = 64 // BITS
SIGN = -(2**63)


def ordered(values):
    """Doubles (a numpy array) as whole numbers in the same order; both zeros are one."""
    import numpy as np

    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(SIGN), bits)


def values_of(orders):
    """The doubles of :func:`ordered`."""
    import numpy as np

    return np.where(orders < 0, ~(orders ^ np.int64(SIGN)), orders).view(np.float64)


def _mapped(f, kind: str, column):
    """``f`` over a numeric column."""

    @F.pandas_udf(kind)
    def run(x):
        import pandas as pd

        return pd.Series(f(x.to_numpy()))

    return run(column)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and by the names of ``shares`` the interpolated quantiles of ``value`` (nulls do not count) of each group."""
    known = rows.select(*keys, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    # the sign turned over, so that a prefix of the bits is a number in the same order
    data = stage(known.select(*keys, _mapped(ordered, "long", "x").alias("o")).withColumn("o", F.col("o").bitwiseXOR(F.lit(SIGN))), "orders")
    sizes = data.groupBy(*keys).agg(F.count("*").alias("n"))
    ends = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(share).alias("share"), F.lit(up).alias("up")) for name, share in shares.items() for up in (False, True)])).alias("t")
    at = F.col("share") * (F.col("n") - 1)
    wanted = sizes.select(*keys, "n", ends).select(*keys, "n", "t.*").withColumns({"rank": F.when(F.col("up"), F.ceil(at)).otherwise(F.floor(at)), "prefix": F.lit(0).cast("long")})
    for k in range(1, PASSES + 1):
        wanted = stage(wanted, "wanted-ranks")
        prefix = F.lit(0).cast("long") if k == 1 else F.shiftrightunsigned("o", 64 - BITS * (k - 1))
        inside = data.select(*keys, prefix.alias("prefix"), F.shiftrightunsigned("o", 64 - BITS * k).alias("next"))
        if k > 1:
            inside = inside.join(wanted.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
        counts = inside.groupBy(*keys, "prefix", "next").agg(F.count("*").alias("c"))
        below = F.sum("c").over(Window.partitionBy(*keys, "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        found = wanted.join(counts.withColumn("below", below), [*keys, "prefix"]).filter("below <= rank AND rank < below + c")
        wanted = found.select(*keys, "n", "name", "share", "up", (F.col("rank") - F.col("below")).alias("rank"), F.col("next").alias("prefix"))
    ends = wanted.withColumn("x", _mapped(values_of, "double", F.col("prefix").bitwiseXOR(F.lit(SIGN))))
    at = F.col("share") * (F.col("n") - 1)
    pairs = ends.groupBy(*keys, "n", "name", "share").agg(F.max(F.when(~F.col("up"), F.col("x"))).alias("low"), F.max(F.when(F.col("up"), F.col("x"))).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high"))
    out = stage(pairs.withColumn("q", between).groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares]), "quantiles")
    discard(data)
    return out


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, std (of the sample), min, p25, p50, p75 and max of ``value``, rounded; groups of any size."""
    x = F.col(value).cast("double")
    plain = rows.groupBy(*keys).agg(F.count(x).alias("n"), rounded(F.avg(x), "mean"), rounded(F.stddev_samp(x), "std"), rounded(F.min(x), "min"), rounded(F.max(x), "max"))
    found = quantiles(rows, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    joined = plain.alias("a").join(found.alias("b"), same, "left")
    return joined.select(*[f"a.{k}" for k in keys], "a.n", "a.mean", "a.std", "a.min", *[rounded(F.col(f"b.{p}"), p) for p in ("p25", "p50", "p75")], "a.max")
