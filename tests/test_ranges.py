"""Range joins where matches are many: what they read, form and shuffle follows their inputs."""

import random

from pyspark.sql import functions as F

from tributary.operators import combine

WHERE = "a.x >= b.lo and a.x < b.hi"


def sides(spark, points=400, spans=500):
    """Spans that nearly all hold nearly all points, some of no length, open or with ends that are no numbers."""
    r = random.Random(5)
    inf, nan = float("inf"), float("nan")
    a = [(i, r.choice([r.uniform(400, 600), 500.0, 1e17 * r.random()])) for i in range(points)] + [(-1, None), (-2, nan), (-3, inf), (-4, -inf)]
    b = [(i, r.uniform(0, 450), r.uniform(550, 900)) for i in range(spans)]
    b += [(i, x, x + w) for i, x, w in ((spans + i, r.uniform(400, 600), r.choice([0.0, 1e-9, 0.25, 3.0])) for i in range(60))]
    b += [(-9, 500.0, 500.0), (-8, None, 3.0), (-7, nan, 900.0), (-6, 0.0, nan), (9000, -inf, 410.0), (9001, 590.0, inf), (9002, 1e16, 9e16)]
    left = spark.createDataFrame(a, "id long, x double").repartition(3)
    right = spark.createDataFrame(b, "k long, lo double, hi double").repartition(3).withColumn("_ord", F.col("k"))
    found = {i: [k for k, lo, hi in b if None not in (x, lo, hi) and lo <= x < hi] for i, x in a}
    return left, right, found


def test_first_of_a_range_forms_no_pairs(spark):
    left, right, found = sides(spark)
    for miss in ("null_fields", "skip"):
        got = combine.combine({"a": left, "b": right}, WHERE, "emit id = a.id\nemit k = b.k", on_miss=miss)
        want = [(i, min(m, default=None)) for i, m in found.items() if m or miss != "skip"]
        assert sorted((r.id, r.k) for r in got.collect()) == sorted(want)
    # The rows that the least is sought among, where 160,000 pairs match.
    scope, sided = {}, {}
    for name, df in (("a", left.where("x between 400 and 600")), ("b", right.where("k between 0 and 499"))):
        sided[name], scope[name] = combine._side(df, name)
    scope = combine.Scope({}, inputs=scope)
    p = combine.predicate(combine.parse_expression(WHERE), scope, "b")
    x, *ends = combine._held_by(p, scope)
    rows = combine._least(sided["a"], combine._number(x), sided["b"], tuple(ends), p.whole, F.col("b__k"), True).count()
    assert sum(len(m) for m in found.values()) > 100_000 and rows < 20 * 400


def test_pairs_of_small_inputs_come_from_many_tasks(spark):
    """As many as are set for pairs, though the inputs would fit one."""
    left, right, found = sides(spark)
    body = "emit id = a.id\nemit k = b.k"
    df = combine.combine({"a": left, "b": right}, WHERE, body, match="all", on_miss="skip").withColumn("task", F.spark_partition_id())
    rows = df.collect()
    assert sorted((r.id, r.k) for r in rows) == sorted((i, k) for i, m in found.items() for k in m)
    assert len({r.task for r in rows}) > 8


def test_missed_ranges_are_found_without_shuffling_pairs(spark):
    """Repeated drivers, misses once each, and nothing after the pairs but the projection."""
    left, right, found = sides(spark)
    body = "emit id = a.id\nemit k = b.k"
    df = combine.combine({"a": left.union(left.where("id < 3")), "b": right}, WHERE, body, match="all")
    want = [(i, k) for i, m in found.items() for _ in range(1 + (0 <= i < 3 or i < 0)) for k in (m or [-99])]
    assert sorted((r.id, -99 if r.k is None else r.k) for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(_held")]
    assert "Aggregate" not in above and "Join" not in above and "Union" not in above
