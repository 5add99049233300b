"""Quantiles by passes over bits against the aggregate that gathers values."""

import numpy as np
from pyspark.sql import functions as F

from lanewise.functions.labels import describe
from lanewise.operators import quantiles


def test_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf])
    o = quantiles.ordered(x)
    assert (np.diff(o) >= 0).all() and o[4] == o[5] and (np.diff(o)[[k for k in range(10) if k != 4]] > 0).all()
    assert (quantiles.values_of(o) == x).all()


def test_describe_equals_percentile(spark):
    rng = np.random.RandomState(1)
    rows = [("one", "x", 3.5), ("none", "x", None), ("two", "x", -1.0), ("two", "x", 2.0)]
    rows += [("ties", "x", float(v)) for v in rng.randint(-2, 3, 500)] + [("wide", "y", float(v)) for v in rng.randn(800) * 10.0 ** rng.randint(-8, 9, 800)] + [("wide", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, v double").repartition(5)
    got = sorted(map(str, quantiles.describe(df, ["a"], "v").collect()))
    assert got == sorted(map(str, df.groupBy("a").agg(*describe("v")).collect())) and len(got) == 5
    assert quantiles.describe(df.limit(0), ["a"], "v").count() == 0
    whole = quantiles.quantiles(df.withColumn("k", F.lit(1)), ["k"], "v", {"q": 0.9}).first()
    assert whole["q"] == df.agg(F.percentile("v", 0.9)).first()[0]
