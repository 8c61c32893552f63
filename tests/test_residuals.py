"""Joins whose driver is not the same when it is computed twice."""

import random

from pyspark.sql import functions as F

from tributary.operators import combine


def test_a_driver_that_differs_by_run_keeps_one_row_each(spark):
    """Means of doubles differ in their last bits with the order of their parts; here all of it differs."""
    noise = F.udf(lambda k: random.SystemRandom().random(), "double").asNondeterministic()
    left = spark.range(200).withColumn("mean", noise("id"))
    right = spark.range(400).selectExpr("id % 200 AS k", "id AS v", "id AS _ord")
    for match in ("first", "collect"):
        body = "emit id = a.id\nemit v = " + ("b.v" if match == "first" else "b.length()")
        got = combine.combine({"a": left, "b": right}, "a.id == b.k and b.v + 2.0 > a.mean", body, match=match).collect()
        assert sorted((r.id, r.v) for r in got) == [(i, i if match == "first" else 2) for i in range(200)]
