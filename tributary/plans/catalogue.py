"""Queries of the engine and, for each, the same question in plain SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.compiler import literal
from tributary.functions.syntax import parse_expression
from tributary.operators import aggregate as A
from tributary.operators import combine as C
from tributary.operators import rows as R
from tributary.plans.pipeline import Pipeline
from tributary.sources import interchange, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """A data directory's tables, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def folder(self) -> str:
        """A fresh path that driver and executors see: below spark.checkpoint.dir, or where all run in one process, a temporary one."""
        base = self._spark.conf.get("spark.checkpoint.dir", None) or self._spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            base = tempfile.mkdtemp(prefix="sinks-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        return f"{base.rstrip('/')}/out-{uuid.uuid4().hex}"


def query(sql: str | None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue,
          avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship(t):
    """Filter, computed column, grouped sums and averages: reads seven of eleven columns, one shuffle of a few rows a task."""
    rows = t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return A.aggregate(rows, ["l_returnflag", "l_linestatus"], """
        let net = l_extendedprice * (1.0 - l_discount)
        emit sum_qty = sum(l_quantity)
        emit revenue = sum(net)
        emit avg_qty = avg(l_quantity)
        emit n = count(*)""")


@query("SELECT *, c_acctbal * 2 AS twice, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'some' ELSE 'none' END AS class FROM customer WHERE c_acctbal > -500")
def transform_widen(t):
    return R.transform(t.customer, """
        filter c_acctbal > -500
        let x = c_acctbal * 2.0
        emit twice = x
        emit class = match { c_acctbal > 5000 => "rich", c_acctbal > 0 => "some", _ => "none" }""")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_all(t):
    return R.transform(t.customer.select("c_mktsegment", "c_nationkey"), "distinct")


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def distinct_by(t):
    return R.transform(t.customer, "distinct by c_nationkey", order="c_custkey").select("c_nationkey", "c_custkey")


@query("SELECT event_id, unnest(string_split(event_type, 'i')) AS part FROM events")
def emit_each(t):
    rows = t.events.select("event_id", "event_type")
    return R.transform(rows, 'emit each p in event_type.split("i") {\n emit part = p\n}').select("event_id", "part")


@query("SELECT p_partkey, upper(x) AS word FROM part LEFT JOIN (SELECT p_partkey AS k, unnest(list_filter(string_split(p_name, ' '), lambda w: len(w) > 5)) AS x FROM part) ON k = p_partkey")
def emit_each_outer(t):
    return R.transform(t.part, 'let long = p_name.split(" ").filter(w => w.length() > 5)\nemit each p in long outer {\n emit word = p.upper()\n}').select("p_partkey", "word")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'default' END AS branch FROM orders""")
def route_exclusive(t):
    out = R.route(t.orders, {"big": "o_totalprice > 300000", "done": 'o_orderstatus == "F"'})
    return R.merge([df.select("o_orderkey", F.lit(k).alias("branch")) for k, df in out.items()])


@query("""SELECT o_orderkey, 'big' AS branch FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'done' FROM orders WHERE o_orderstatus = 'F'
          UNION ALL SELECT o_orderkey, 'default' FROM orders WHERE NOT (o_totalprice > 300000) AND o_orderstatus <> 'F'""")
def route_inclusive(t):
    out = R.route(t.orders, {"big": "o_totalprice > 300000", "done": 'o_orderstatus == "F"'}, mode="inclusive")
    return R.merge([df.select("o_orderkey", F.lit(k).alias("branch")) for k, df in out.items()])


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def merge_concat(t):
    return R.merge([t.customer.selectExpr("c_custkey AS id", "c_name AS name"), t.supplier.selectExpr("s_suppkey AS id", "s_name AS name")])


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def merge_interleave_distinct(t):
    both = R.merge([t.supplier.selectExpr("s_nationkey AS k"), t.customer.where("c_acctbal > 9000").selectExpr("c_nationkey AS k")], "interleave", seed=3)
    return R.transform(both, "distinct")


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 400000 THEN 0.0 ELSE o_totalprice END AS o_totalprice, false AS _synthetic,
          NULL::VARCHAR AS _synthesized_by, CASE WHEN o_totalprice > 400000 THEN 'cap' END AS _mutated_by FROM orders
          UNION ALL SELECT -o_orderkey, o_orderpriority, o_totalprice, true, 'copy', NULL FROM orders WHERE o_orderstatus = 'P'""")
def reshape_rules(t):
    out = R.reshape(t.orders, ["o_custkey"], [
        {"name": "cap", "when": "o_totalprice > 400000", "mutate": {"o_totalprice": "0.0"}},
        {"name": "copy", "when": 'o_orderstatus == "P"', "synthesize": {"copy_from": "trigger", "overrides": {"o_orderkey": "-o_orderkey"}}},
    ])
    return out.select("o_orderkey", "o_orderpriority", "o_totalprice", "_synthetic", "_synthesized_by", "_mutated_by")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000 OR count(*) < 5)")
def cull_groups(t):
    return R.cull(t.orders, ["o_custkey"], ["sum(o_totalprice) > 3000000", "count(*) < 5"])[0].select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < 5) GROUP BY 1")
def cull_removed(t):
    return R.cull(t.orders, ["o_custkey"], ["count(*) < 5"])[1].groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN NOT c_acctbal > 0 THEN 'positive' ELSE 'short' END AS _failed_rule FROM customer WHERE NOT (c_acctbal > 0) OR NOT (length(c_mktsegment) > 8)")
def validations(t):
    rules = [{"name": "positive", "check": "c_acctbal > 0"}, {"name": "short", "check": "c_mktsegment.length() > 8"}, {"name": "w", "severity": "warn", "check": "c_nationkey > 3"}]
    return R.validate(t.customer, rules)[1].select("c_custkey", "_failed_rule")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def correlated_dead_letters(t):
    return R.dead_letter(t.lineitem, F.col("l_quantity") > 48, ["l_orderkey"])[1].select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE NOT o_totalprice > 400000 GROUP BY 1")
def retraction(t):
    good, _ = R.dead_letter(t.orders, F.col("o_totalprice") > 400000)
    return A.aggregate(good, ["o_custkey"], "emit total = sum(o_totalprice)")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def combine_first(t):
    return C.combine({"o": t.orders, "c": t.customer}, "o.o_custkey == c.c_custkey", "emit o_orderkey = o.o_orderkey\nemit c_name = c.c_name\nemit c_mktsegment = c.c_mktsegment")


@query("SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
def combine_first_residual(t):
    orders = t.orders.withColumn("_ord", F.col("o_orderkey"))
    return C.combine({"c": t.customer, "o": orders}, "c.c_custkey == o.o_custkey and o.o_totalprice > 200000", "emit c_custkey = c.c_custkey\nemit first_order = o.o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 40")
def combine_all_skip(t):
    return C.combine({"c": t.customer, "o": t.orders}, "c.c_custkey == o.o_custkey", "filter o.o_totalprice > c.c_acctbal * 40.0\nemit c_custkey = c.c_custkey\nemit o_orderkey = o.o_orderkey", match="all", on_miss="skip")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
def combine_all_null_fields(t):
    return C.combine({"c": t.customer, "o": t.orders}, "c.c_custkey == o.o_custkey and o.o_totalprice > c.c_acctbal * 40.0", "emit c_custkey = c.c_custkey\nemit o_orderkey = o.o_orderkey", match="all")


@query("SELECT n_nationkey, count(s_suppkey) AS n, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def combine_collect(t):
    supplier = t.supplier.withColumn("_ord", F.col("s_suppkey"))
    return C.combine({"n": t.nation, "s": supplier}, "n.n_nationkey == s.s_nationkey", 'emit n_nationkey = n.n_nationkey\nemit n = s.length()\nemit ids = s.map(x => x.s_suppkey).join(",")', match="collect")


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def combine_nary(t):
    return C.combine({"l": t.lineitem, "s": t.supplier, "n": t.nation}, "l.l_suppkey == s.s_suppkey and s.s_nationkey == n.n_nationkey", "emit l_orderkey = l.l_orderkey\nemit l_linenumber = l.l_linenumber\nemit n_name = n.n_name", match="all", on_miss="skip")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def combine_anti(t):
    return C.anti(t.customer, t.orders, {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def combine_semi(t):
    return C.semi(t.customer, t.orders, {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT event_id, p_partkey FROM events JOIN part ON value >= p_retailprice / 10 AND value < p_retailprice / 10 + p_size")
def combine_pure_range(t):
    part = t.part.selectExpr("p_partkey", "p_retailprice / 10 AS lo", "p_retailprice / 10 + p_size AS hi")
    return C.combine({"e": t.events, "p": part}, "e.value >= p.lo and e.value < p.hi", "emit event_id = e.event_id\nemit p_partkey = p.p_partkey", match="all", on_miss="skip")


@query("SELECT l_orderkey, l_linenumber, o_orderkey AS hit FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate")
def combine_equi_range(t):
    return C.combine({"l": t.lineitem, "o": t.orders}, "l.l_orderkey == o.o_orderkey and l.l_shipdate > o.o_orderdate", "emit l_orderkey = l.l_orderkey\nemit l_linenumber = l.l_linenumber\nemit hit = o.o_orderkey", match="all")


@query("SELECT count(*) AS n, count(c_acctbal) AS m, sum(c_custkey)::BIGINT AS s, avg(c_acctbal) AS a, min(c_name) AS lo, max(c_name) AS hi FROM customer")
def aggregate_global(t):
    return A.aggregate(t.customer, [], "emit n = count(*)\nemit m = count(c_acctbal)\nemit s = sum(c_custkey)\nemit a = avg(c_acctbal)\nemit lo = min(c_name)\nemit hi = max(c_name)")


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN c_nationkey > 12 THEN NULL ELSE c_nationkey END AS k FROM customer) GROUP BY k")
def aggregate_null_key(t):
    return A.aggregate(R.transform(t.customer, "emit k = if c_nationkey > 12 then null else c_nationkey"), ["k"], "emit n = count(*)")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def aggregate_collect(t):
    held = A.aggregate(t.orders, ["o_custkey"], "emit all = collect(o_orderkey)", order="o_orderkey")
    return R.transform(held, 'emit ids = all.join(",")').select("o_custkey", "ids")


@query("SELECT l_suppkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS price, (max(l_quantity) - min(l_quantity)) / count(*) AS spread FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def aggregate_weighted_having(t):
    out = A.aggregate(t.lineitem, ["l_suppkey"], "emit price = weighted_avg(l_extendedprice, l_quantity)\nemit spread = (max(l_quantity) - min(l_quantity)) / count(*)\nemit n = count(*)")
    return R.transform(out, "filter n > 10").drop("n")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL")
def window_tumbling(t):
    return A.time_window(t.events, "ts", {"tumbling": "1h"}, ["event_type"], "emit n = count(*)\nemit v = sum(value)", bounds=True)


@query("""SELECT make_timestamp((k * 900000000)::BIGINT) AS window_start, event_type, count(*) AS n FROM (SELECT event_type, epoch_us(ts) AS u,
          unnest(range((floor((epoch_us(ts) - 3600000000) / 900000000) + 1)::BIGINT, (floor(epoch_us(ts) / 900000000) + 1)::BIGINT)) AS k FROM events) GROUP BY ALL""")
def window_hopping(t):
    return A.time_window(t.events, "ts", {"hopping": ["1h", "15m"]}, ["event_type"], "emit n = count(*)", bounds=True)


@query("""SELECT make_timestamp((k * 7200000000)::BIGINT) AS window_start, count(*) AS n FROM (SELECT epoch_us(ts) // 7200000000 AS k, epoch_us(ts) AS u FROM events)
          WHERE u - k * 7200000000 < 1800000000 GROUP BY ALL""")
def window_hopping_gaps(t):
    return A.time_window(t.events, "ts", {"hopping": ["30m", "2h"]}, [], "emit n = count(*)", bounds=True)


@query("""WITH d AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events),
          g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM d) SELECT user_id, min(ts) AS window_start, count(*) AS n, max(value) AS top FROM g GROUP BY user_id, s""")
def window_session(t):
    return A.time_window(t.events, "ts", {"session": "2h"}, ["user_id"], "emit n = count(*)\nemit top = max(value)", bounds=True)


@query("""WITH o AS (SELECT *, epoch_us(ts) AS u FROM events), m AS (SELECT *, max(u) OVER (PARTITION BY user_id ORDER BY event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS w FROM o)
          SELECT event_id FROM m WHERE (u // 3600000000 + 1) * 3600000000 <= w""")
def window_late_rows(t):
    """Arrival shuffled on purpose: by type, then id, so that many rows come after their window closed."""
    rows = t.events.withColumn("at", F.struct("event_type", "event_id"))
    return A.late_rows(rows, "ts", {"tumbling": "1h"}, {"order": "at", "delay": "10m", "shard": "user_id"}).select("event_id")


_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query(f"""SELECT o_orderkey, sum(o_totalprice) OVER ({_W} {_ALL}) AS s, sum(o_totalprice) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cs, avg(o_totalprice) OVER ({_W} {_ALL}) AS a,
           min(o_totalprice) OVER ({_W} {_ALL}) AS lo, max(o_totalprice) OVER ({_W} {_ALL}) AS hi, count(*) OVER ({_W} {_ALL}) AS n FROM orders""")
def analytic_aggregates(t):
    return R.transform(t.orders, """
        emit s = $window.sum(o_totalprice)
        emit cs = $window.cumulative_sum(o_totalprice)
        emit a = $window.avg(o_totalprice)
        emit lo = $window.min(o_totalprice)
        emit hi = $window.max(o_totalprice)
        emit n = $window.count()""", analytic={"group_by": ["o_custkey"], "sort_by": ["o_orderdate", "o_orderkey"]}).select("o_orderkey", "s", "cs", "a", "lo", "hi", "n")  # fmt: skip


@query(f"""SELECT o_orderkey, row_number() OVER ({_W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
           lag(o_totalprice) OVER ({_W}) AS before, lead(o_totalprice, 2) OVER ({_W}) AS after2, first_value(o_orderkey) OVER ({_W} {_ALL}) AS f, last_value(o_orderkey) OVER ({_W} {_ALL}) AS l FROM orders""")
def analytic_ranks(t):
    rows = R.transform(t.orders, "emit rk = $window.rank()\nemit dr = $window.dense_rank()", analytic={"group_by": ["o_custkey"], "sort_by": ["o_orderpriority"]})
    return R.transform(rows, """
        emit rn = $window.row_number()
        emit before = $window.lag().o_totalprice
        emit after2 = $window.lead(2).o_totalprice
        emit f = $window.first_value(o_orderkey)
        emit l = $window.last().o_orderkey""", analytic={"group_by": ["o_custkey"], "sort_by": ["o_orderdate", "o_orderkey"]}).select("o_orderkey", "rn", "rk", "dr", "before", "after2", "f", "l")  # fmt: skip


@query("""SELECT o_orderkey, bool_or(o_totalprice > 300000) OVER (PARTITION BY o_custkey) AS some, bool_and(o_totalprice > 50000) OVER (PARTITION BY o_custkey) AS every,
          NOT bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS none FROM orders""")
def analytic_predicates(t):
    return R.transform(t.orders, 'emit some = $window.any(o_totalprice > 300000)\nemit every = $window.every(o_totalprice > 50000)\nemit none = $window.not_exists(o_orderstatus == "P")', analytic={"group_by": ["o_custkey"]}).select("o_orderkey", "some", "every", "none")


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS every, max(k) AS kinds FROM (SELECT *, len(list_distinct(list(o_orderstatus) OVER (PARTITION BY o_custkey))) AS k FROM orders) GROUP BY 1")
def analytic_collect(t):
    rows = R.transform(t.orders, 'emit every = $window.collect(o_orderstatus).join("")\nemit kinds = $window.distinct(o_orderstatus).length()', analytic={"group_by": ["o_custkey"], "sort_by": ["o_orderkey"]})
    return rows.groupBy("o_custkey").agg(F.first("every").alias("every"), F.first("kinds").alias("kinds"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_k_per_group(t):
    return R.transform(t.orders, "emit rn = $window.row_number()\nfilter rn <= 3", analytic={"group_by": ["o_custkey"], "sort_by": [{"field": "o_totalprice", "order": "desc"}, "o_orderkey"]}).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def sort_and_take(t):
    return R.sort(t.customer, [{"field": "c_acctbal", "order": "desc"}, "c_custkey"]).select("c_custkey", "c_acctbal").limit(50)


@query("""SELECT p_partkey, upper(p_name) AS up, substr(p_name, 3, 4) AS sub, left(p_name, 2) AS l, right(p_name, 2) AS r, lpad(p_brand, 12, '*') AS pad, reverse(p_name) AS rev, length(p_name) AS len,
          replace(p_name, 'w', 'W') AS rep, starts_with(p_type, 'ECO') AS sw, contains(p_name, 'get') AS has, regexp_matches(p_brand, '#1') AS m, nullif(regexp_extract(p_brand, '#(\\d)', 1), '') AS cap,
          concat(p_name, '-', p_size::VARCHAR) AS cat, repeat('ab', 2) AS twice FROM part""")
def functions_string(t):
    return R.transform(t.part, r"""
        emit up = p_name.upper()
        emit sub = p_name.substring(2, 4)
        emit l = p_name.left(2)
        emit r = p_name.right(2)
        emit pad = p_brand.pad_left(12, "*")
        emit rev = p_name.reverse()
        emit len = p_name.length()
        emit rep = p_name.replace("w", "W")
        emit sw = p_type.starts_with("ECO")
        emit has = p_name.contains("get")
        emit m = p_brand.matches("#1")
        emit cap = p_brand.capture("#(\\d)", 1)
        emit cat = p_name.concat("-", p_size)
        emit twice = "ab".repeat(2)""").select("p_partkey", "up", "sub", "l", "r", "pad", "rev", "len", "rep", "sw", "has", "m", "cap", "cat", "twice")  # fmt: skip


@query("""SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, greatest(least(c_acctbal, 1000), 0) AS cl, (c_custkey // 7)::BIGINT AS d, c_custkey % 7 AS m,
          CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal)::BIGINT ELSE floor(c_acctbal)::BIGINT END AS i, least(c_acctbal, c_nationkey) AS lo FROM customer""")
def functions_numeric(t):
    return R.transform(t.customer, """
        emit a = c_acctbal.abs()
        emit c = c_acctbal.ceil()
        emit f = c_acctbal.floor()
        emit cl = c_acctbal.clamp(0, 1000)
        emit d = c_custkey / 7
        emit m = c_custkey % 7
        emit i = c_acctbal.to_int()
        emit lo = c_acctbal.min(c_nationkey)""").select("c_custkey", "a", "c", "f", "cl", "d", "m", "i", "lo")  # fmt: skip


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS mo, day(o_orderdate) AS d, hour(o_orderdate) AS h, (o_orderdate + INTERVAL 10 DAY) AS later, strftime(o_orderdate, '%d/%m/%Y') AS txt,
          NULL::BIGINT AS dm, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS dd FROM orders""")
def functions_date(t):
    rows = t.orders.withColumn("day_only", F.to_date("o_orderdate"))
    return R.transform(rows, """
        emit y = o_orderdate.year()
        emit mo = o_orderdate.month()
        emit d = o_orderdate.day()
        emit h = o_orderdate.hour()
        emit later = o_orderdate.add_days(10)
        emit txt = o_orderdate.format_date("%d/%m/%Y")
        emit dm = o_orderdate.diff_months(o_orderdate)
        emit dd = day_only.diff_days(#1995-01-01#)""").select("o_orderkey", "y", "mo", "d", "h", "later", "txt", "dm", "dd")  # fmt: skip


@query("""SELECT event_id, try_cast(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, value::VARCHAR IS NOT NULL AS has, coalesce(nullif(event_type, 'error'), 'E') AS e, 'float' AS t,
          event_type = 'click' AND value > 10 AS both, NULL::BIGINT AS bad FROM events""")
def functions_convert(t):
    return R.transform(t.events, r"""
        emit k = props.capture("(\\d+)", 1).try_int()
        emit has = not value.is_null()
        let n = if event_type == "error" then null else event_type
        emit e = n ?? "E"
        emit t = value.type_of()
        emit both = event_type == "click" and value > 10
        emit bad = event_type.try_int()""").select("event_id", "k", "has", "e", "t", "both", "bad")  # fmt: skip


@query("""SELECT p_partkey, len(string_split(p_name, ' ')) AS n, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x)), 'string_agg', '+') AS j, string_split(p_name, ' ')[1] AS first, NULL::VARCHAR AS far,
          len(list_filter(string_split(p_name, ' '), lambda x: x LIKE 'w%')) > 0 AS any, p_size + 1 AS got FROM part""")
def functions_collections(t):
    return R.transform(t.part, """
        let w = p_name.split(" ")
        emit n = w.length()
        emit j = w.map(x => x.upper()).join("+")
        emit first = w[0]
        emit far = w[99]
        emit any = w.any(x => x.starts_with("w"))
        let m = {"a": p_size, "b": p_name}
        emit got = m.set("c.d", m["a"] + 1)["c"]["d"]""").select("p_partkey", "n", "j", "first", "far", "any", "got")  # fmt: skip


@query("SELECT o_orderkey, o_totalprice * 2 + 1 AS v, 'F' = o_orderstatus AS same FROM orders")
def modules_and_variables(t):
    fn = {"twice": (["x"], parse_expression("x * 2.0"))}
    return R.transform(t.orders, "emit v = twice(o_totalprice) + $vars.one\nemit same = $vars.flag == o_orderstatus", functions=fn, variables={"$vars.one": literal(1), "$vars.flag": literal("F")}).select("o_orderkey", "v", "same")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer")
def sink_projection(t):
    return R.project(t.customer, {"c_custkey": "id", "c_name": "name"}, exclude=["c_acctbal", "c_nationkey"])


@query("SELECT p_partkey, round_even(p_retailprice / 7, 2) AS x FROM part")
def sink_decimal_scale(t):
    rows = t.part.select("p_partkey", (F.col("p_retailprice").cast("double") / 7).cast("decimal(38,18)").alias("x"))
    return R.scale_decimals(rows, {"x": 2}).withColumn("x", F.col("x").cast("double"))


@query("SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part")
def split_to_rows(t):
    return R.split_to_rows(t.part.select("p_partkey", "p_type", "p_name"), "p_name", position="pos", sep=" ")


@query("SELECT o_custkey, string_agg(o_orderstatus, ';' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1")
def join_values(t):
    held = A.aggregate(t.orders, ["o_custkey"], "emit s = collect(o_orderstatus)", order="o_orderkey")
    return R.join_values(held, "s")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, c AS lines, q AS total FROM lineitem JOIN (SELECT l_orderkey AS k, count(*) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON k = l_orderkey")
def envelope_totals(t):
    body = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    footer = A.envelope_footer(body, ["l_orderkey"], {"lines": "count(*)", "total": "sum(l_quantity)"})
    return A.with_header(body, footer, ["l_orderkey"]).drop("l_quantity")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand")
def composition(t):
    """A sub-pipeline is a function over frames; Catalyst sees one plan."""

    def counted(df: DataFrame, key: str) -> DataFrame:
        return R.sort(A.aggregate(df, [key], "emit n = count(*)"), [{"field": "n", "order": "desc"}, key])

    return counted(t.part, "p_brand")


@query("SELECT l_orderkey, n, o_orderdate FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN orders ON l_orderkey = o_orderkey")
def combine_first_after_aggregate(t):
    lines = A.aggregate(t.lineitem, ["l_orderkey"], "emit n = count(*)")
    return C.combine({"l": lines, "o": t.orders}, "l.l_orderkey == o.o_orderkey", "emit l_orderkey = l.l_orderkey\nemit n = l.n\nemit o_orderdate = o.o_orderdate")


@query("""SELECT l_orderkey, l_suppkey, n, o_custkey, s_name FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
          LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def combine_first_nary(t):
    lines = A.aggregate(t.lineitem, ["l_orderkey", "l_suppkey"], "emit n = count(*)")
    body = "emit l_orderkey = l.l_orderkey\nemit l_suppkey = l.l_suppkey\nemit n = l.n\nemit o_custkey = o.o_custkey\nemit s_name = s.s_name"
    return C.combine({"l": lines, "o": t.orders, "s": t.supplier}, "l.l_orderkey == o.o_orderkey and l.l_suppkey == s.s_suppkey", body)


@query("""SELECT k AS o_custkey, min(o_orderkey) AS above FROM (SELECT o_custkey AS k, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
          LEFT JOIN orders ON o_custkey = k AND o_totalprice > mean * 1.5 GROUP BY 1""")
def combine_first_residual_after_aggregate(t):
    means = A.aggregate(t.orders, ["o_custkey"], "emit mean = avg(o_totalprice)")
    orders = t.orders.withColumn("_ord", F.col("o_orderkey"))
    return C.combine({"m": means, "o": orders}, "m.o_custkey == o.o_custkey and o.o_totalprice > m.mean * 1.5", "emit o_custkey = m.o_custkey\nemit above = o.o_orderkey")


@query("""SELECT c_custkey, n_name, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS ids FROM customer JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 30 GROUP BY ALL""")
def combine_collect_after_join(t):
    known = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t.orders.withColumn("_ord", F.col("o_orderkey"))
    body = 'emit c_custkey = c.c_custkey\nemit n_name = c.n_name\nemit n = o.length()\nemit ids = o.map(x => x.o_orderkey).join(",")'
    return C.combine({"c": known, "o": orders}, "c.c_custkey == o.o_custkey and o.o_totalprice > c.c_acctbal * 30.0", body, match="collect")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_acctbal - 20 < p_retailprice + p_size AND p_retailprice < s_acctbal + 20")
def combine_overlap(t):
    spans = t.supplier.selectExpr("s_suppkey", "s_acctbal - 20 AS start", "s_acctbal + 20 AS fin")
    parts = t.part.selectExpr("p_partkey", "p_retailprice AS start", "p_retailprice + p_size AS fin")
    return C.combine({"s": spans, "p": parts}, "s.start < p.fin and p.start < s.fin", "emit s_suppkey = s.s_suppkey\nemit p_partkey = p.p_partkey", match="all", on_miss="skip")


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey * 400 > s_acctbal")
def combine_one_inequality(t):
    nation = t.nation.selectExpr("n_nationkey", "n_nationkey * 400 AS most")
    return C.combine({"n": nation, "s": t.supplier}, "n.most > s.s_acctbal", "emit n_nationkey = n.n_nationkey\nemit s_suppkey = s.s_suppkey", match="all", on_miss="skip")


@query("""SELECT c_custkey, min(p_partkey) AS p_partkey FROM customer LEFT JOIN part ON c_acctbal >= p_retailprice AND c_acctbal < p_retailprice + p_size GROUP BY 1""")
def combine_range_first(t):
    parts = t.part.selectExpr("p_partkey", "p_retailprice AS lo", "p_retailprice + p_size AS hi", "p_partkey AS _ord")
    return C.combine({"c": t.customer, "p": parts}, "c.c_acctbal >= p.lo and c.c_acctbal < p.hi", "emit c_custkey = c.c_custkey\nemit p_partkey = p.p_partkey")


@query("SELECT c_custkey, p_partkey FROM customer LEFT JOIN part ON c_acctbal >= p_retailprice AND c_acctbal < p_retailprice + p_size")
def combine_range_null_fields(t):
    parts = t.part.selectExpr("p_partkey", "p_retailprice AS lo", "p_retailprice + p_size AS hi")
    return C.combine({"c": t.customer, "p": parts}, "c.c_acctbal >= p.lo and c.c_acctbal < p.hi", "emit c_custkey = c.c_custkey\nemit p_partkey = p.p_partkey", match="all")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def combine_anti_some(t):
    return C.anti(t.customer, t.orders.where("o_totalprice > 200000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey > 12 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -990)) OR (c_nationkey <= 12 AND c_acctbal < -990)")
def dead_letters_null_key(t):
    """Rows whose key is null have no peers."""
    rows = R.transform(t.customer, "emit k = if c_nationkey > 12 then c_nationkey else null")
    return R.dead_letter(rows, F.col("c_acctbal") < -990, ["k"])[1].select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F')")
def reshape_rejects(t):
    rules = [{"name": "cap", "when": "o_totalprice > 400000", "mutate": {"o_totalprice": "0.0"}}, {"name": "done", "when": 'o_orderstatus == "F"', "mutate": {"o_totalprice": "1.0"}}]
    return R.reshape_split(t.orders, ["o_custkey"], rules)[1].select("o_orderkey")


@query("SELECT c_custkey, n, most FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def cross_source_window(t):
    return A.cross_source(t.customer, t.orders, {"c_custkey": "o_custkey"}, "emit n = count(*)\nemit most = max(o_totalprice)").select("c_custkey", "n", "most")


@query("""WITH d AS (SELECT *, epoch_us(ts) AS u, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events),
          g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM d), e AS (SELECT *, max(u) OVER (PARTITION BY user_id, s) + 7200000000 AS fin FROM g),
          m AS (SELECT *, max(u) OVER (PARTITION BY user_id ORDER BY event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS w FROM e)
          SELECT event_id FROM m WHERE fin <= w""")
def session_late_rows(t):
    rows = t.events.withColumn("at", F.struct("event_type", "event_id"))
    return A.late_rows(rows, "ts", {"session": "2h"}, {"order": "at", "delay": "10m", "shard": "user_id"}, ["user_id"]).select("event_id")


@query("""SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal * 10) + 0.5) / 10 AS one, sign(c_acctbal / 7) * floor(abs(c_acctbal / 7) + 0.5) AS whole, least(c_acctbal, 1.5) AS lo, greatest(c_acctbal, 1.5) AS hi FROM customer""")
def functions_rounding(t):
    return R.transform(t.customer, "emit one = c_acctbal.round(1)\nemit whole = (c_acctbal / 7.0).round()\nemit lo = c_acctbal.min(1.5)\nemit hi = c_acctbal.max(1.5)").select("c_custkey", "one", "whole", "lo", "hi")


@query("""SELECT p_partkey, p_size::DOUBLE AS f, try_cast(p_size::VARCHAR || '.25' AS DOUBLE) AS g, NULL::DOUBLE AS h, p_size > 25 AS b, DATE '2024-01-01' + p_size::INT AS d, p_size % 2 = 0 AS even,
          p_size::VARCHAR || 'x' AS s, coalesce(NULL, p_size) AS c, false AS e, trim('  ' || p_name || ' ') AS trimmed FROM part""")
def functions_conversions(t):
    return R.transform(t.part, """
        emit f = p_size.to_string().to_float()
        emit g = p_size.to_string().concat(".25").try_float()
        emit h = p_name.try_float()
        emit b = (if p_size > 25 then "yes" else "0").to_bool()
        emit d = "2024-01-01".to_date().add_days(p_size)
        emit even = (p_size % 2).to_string().replace("1", "no").replace("0", "yes").try_bool()
        emit s = p_size.to_string() + "x"
        emit c = p_name.try_int().catch(p_size)
        emit e = p_name.is_empty()
        emit trimmed = "  ".concat(p_name, " ").trim()""").select("p_partkey", "f", "g", "h", "b", "d", "even", "s", "c", "e", "trimmed")  # fmt: skip


@query("""SELECT p_partkey, 'f' || p_size || '.tar.gz' AS name, 'f' || p_size || '.tar' AS stem, 'gz' AS ext, '/data/' || p_brand AS up, p_brand AS dir FROM part""")
def functions_paths(t):
    return R.transform(t.part, """
        let path = "/data/".concat(p_brand, "/f", p_size, ".tar.gz")
        emit name = path.file_name()
        emit stem = path.file_stem()
        emit ext = path.extension()
        emit up = path.parent()
        emit dir = path.parent_name()""").select("p_partkey", "name", "stem", "ext", "up", "dir")  # fmt: skip


@query("""SELECT p_partkey, array_to_string(list_filter(w, lambda x: len(x) > 5), '+') AS long, list_filter(w, lambda x: len(x) > 5)[1] AS first, array_to_string(flatten(list_transform(w, lambda x: [x, x])), '+') AS twice,
          array_to_string(w[2:], '+') AS rest FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def functions_lists(t):
    return R.transform(t.part, """
        let w = p_name.split(" ")
        emit long = w.filter(x => x.length() > 5).join("+")
        emit first = w.find(x => x.length() > 5)
        emit twice = w.flat_map(x => [x, x]).join("+")
        emit rest = w.remove(0).join("+")""").select("p_partkey", "long", "first", "twice", "rest")  # fmt: skip


@query("SELECT p_partkey, 'a+b' AS k, p_size + 1 AS merged, 'b' AS left, p_size::VARCHAR || '+' || p_name AS v, p_brand AS kept FROM part")
def functions_maps(t):
    return R.transform(t.part, """
        let m = {"a": p_size, "b": p_name}
        emit k = m.keys().join("+")
        emit merged = m.merge({"a": p_size + 1})["a"]
        emit left = m.remove_field("a").keys().join("+")
        emit v = m.values().join("+")
        emit kept = m.set("x.y", p_brand).unset("a")["x"]["y"]""").select("p_partkey", "k", "merged", "left", "v", "kept")  # fmt: skip


_CUSTOMER = [{"name": "c_custkey", "type": "int"}, {"name": "c_name"}, {"name": "c_nationkey", "type": "int"}, {"name": "c_acctbal", "type": "float"}, {"name": "c_mktsegment"}]


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    """Written as CSV with a delimiter of its own, found by a glob, read and coerced to the schema."""
    path = writers.write(t.customer, t.folder(), "csv", delimiter="|", sort_order=["c_custkey"])
    raw = readers.read_csv(t._spark, readers.find_files(t._spark, {"glob": f"{path}/*.csv"}), _CUSTOMER, delimiter="|", multi_line=False)
    return readers.coerce(raw, _CUSTOMER, "drop")[0].drop("_file")


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal::DECIMAL(38,2), 2)::DOUBLE AS bal FROM customer")
def json_fan_out(t):
    """Decimals, and a folder for each segment."""
    rows = t.customer.selectExpr("c_custkey", "c_name", "c_mktsegment", "cast(c_acctbal as decimal(38,2)) AS bal")
    path = writers.write(rows, t.folder(), "json", fan_out=["c_mktsegment"])
    schema = [{"name": "c_custkey", "type": "int"}, {"name": "c_name"}, {"name": "bal", "type": "decimal", "scale": 2}]
    raw = t._spark.read.schema("c_custkey string, c_name string, bal string, c_mktsegment string").json(path)
    return readers.coerce(raw, schema)[0].withColumn("bal", F.col("bal").cast("double"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def json_array_round_trip(t):
    path = writers.write(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), t.folder(), "json", layout="array")
    schema = [{"name": "s_suppkey", "type": "int"}, {"name": "s_name"}, {"name": "s_nationkey", "type": "int"}]
    raw = readers.read_json(t._spark, readers.find_files(t._spark, {"glob": f"{path}/part-*"}), schema, layout="array", declared_only=True)
    return readers.coerce(raw, schema, "drop")[0].drop("_file")


@query("SELECT p_partkey, p_name, p_size FROM part")
def xml_round_trip(t):
    path = writers.write(t.part.select("p_partkey", "p_name", "p_size"), t.folder(), "xml", root="parts", record="part")
    schema = [{"name": "p_partkey", "type": "int"}, {"name": "p_name"}, {"name": "p_size", "type": "int"}]
    return readers.coerce(readers.read_xml(t._spark, [path], "part"), schema, "drop")[0].drop("_file")


@query("SELECT s_suppkey, s_name FROM supplier")
def fixed_width_round_trip(t):
    schema = [{"name": "s_suppkey", "type": "int", "start": 0, "width": 12}, {"name": "s_name", "start": 12, "width": 30}]
    path = writers.write(t.supplier.select("s_suppkey", "s_name"), t.folder(), "fixed_width", schema=schema)
    raw = readers.read_fixed_width(t._spark, [path], schema).withColumn("s_suppkey", F.trim("s_suppkey"))
    return readers.coerce(raw, schema, "drop")[0].drop("_file")


@query("SELECT 'REC' AS tag, s_suppkey::VARCHAR AS id, s_name || '+''?:' AS name FROM supplier")
def segments_round_trip(t):
    """Marks of the format inside a value are escaped on the way out and come back."""
    rows = t.supplier.select(F.lit("REC").alias("tag"), F.array(F.col("s_suppkey").cast("string"), F.concat("s_name", F.lit("+'?:"))).alias("elements"))
    path = writers.write(rows, t.folder(), "segments", segments="edifact")
    back = readers.read_segments(t._spark, readers.find_files(t._spark, {"glob": f"{path}/part-*"}), "edifact")
    return back.select("tag", F.col("elements")[0].alias("id"), F.col("elements")[1].alias("name"))


@query("SELECT p_partkey, pos, w || ';x\\' AS w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part)")
def escaped_values(t):
    """Elements that hold the delimiter and a backslash, joined with escapes and split again."""
    held = t.part.select("p_partkey", F.transform(F.split("p_name", " "), lambda x: F.concat(x, F.lit(";x\\"))).alias("w"))
    joined = R.join_values(held, "w", on_conflict="escape")
    return R.split_to_rows(joined.withColumn("w", readers.split_values(F.col("w"), ";", "escape")), "w", position="pos")


@query("""WITH RECURSIVE s AS (SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY c_nationkey) AS k FROM customer GROUP BY 1),
          r AS (SELECT g, k, 0 AS part, n AS held FROM s WHERE k = 1 UNION ALL SELECT s.g, s.k, CASE WHEN r.held >= 100 THEN r.part + 1 ELSE r.part END, CASE WHEN r.held >= 100 THEN s.n ELSE r.held + s.n END FROM r JOIN s ON s.k = r.k + 1)
          SELECT c_custkey, part AS _part FROM customer JOIN r ON g = c_nationkey""")
def files_of_whole_groups(t):
    return writers.cut_by_group(t.customer, "c_nationkey", 100).select("c_custkey", "_part")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9990)")
def document_dead_letters(t):
    """A bad row takes its document along; the plan is data."""
    spec = {"nodes": [
        {"name": "in", "kind": "source", "table": "customer"},
        {"name": "d", "kind": "dead_letter", "input": "in", "granularity": "document", "grain": "c_mktsegment", "when": "c_acctbal > 9990"},
    ]}
    return Pipeline(t._spark, spec, {"customer": t.customer}).build()["d.dead"].select("c_custkey")


@query("SELECT n_name, sum(o_totalprice) * 2 AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pipeline_composition(t):
    """A sub-pipeline as a node, after a combine."""
    inner = {"nodes": [
        {"name": "i", "kind": "source", "table": "x"},
        {"name": "s", "kind": "aggregate", "input": "i", "group_by": ["n_name"], "program": "emit total = sum(price)"},
        {"name": "o", "kind": "sink", "input": "s"},
    ]}
    spec = {"nodes": [
        *[{"name": n, "kind": "source", "table": n} for n in ("orders", "customer", "nation")],
        {"name": "c", "kind": "combine", "inputs": {"o": "orders", "c": "customer", "n": "nation"}, "match": "all", "on_miss": "skip",
         "where": "o.o_custkey == c.c_custkey and c.c_nationkey == n.n_nationkey", "body": "emit n_name = n.n_name\nemit price = o.o_totalprice"},
        {"name": "k", "kind": "composition", "inputs": {"x": "c"}, "pipeline": inner},
        {"name": "t", "kind": "transform", "input": "k", "program": "emit total = total * 2.0"},
    ]}
    return Pipeline(t._spark, spec, {n: getattr(t, n) for n in ("orders", "customer", "nation")}).build()["t"]


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'n' WHEN p_size = 10 THEN 'q' END AS field, CASE WHEN p_size % 2 = 0 AND p_size <> 10 THEN 1000 // abs(p_size - 10) END AS q,
          CASE WHEN p_size % 2 = 1 THEN 'to_int: ' || p_name WHEN p_size = 10 THEN 'division by zero' END AS detail FROM part""")
def transform_dead_letters(t):
    """Rows at which a program fails, on a port of their own, with the statement that failed; the plan is data."""
    spec = {"on_error": "continue", "nodes": [
        {"name": "in", "kind": "source", "table": "part"},
        {"name": "t", "kind": "transform", "input": "in", "program": '''
            let text = if p_size % 2 == 0 then p_size.to_string() else p_name
            emit n = text.to_int()
            emit q = if n == 10 then 1000 / (n - 10) else 1000 / (n - 10).abs()'''},
    ]}
    ports = Pipeline(t._spark, spec, {"part": t.part}).build()
    none = F.lit(None).cast("string")
    good = ports["t"].select("p_partkey", none.alias("field"), "q", none.alias("detail"))
    return good.unionByName(ports["t.failed"].select("p_partkey", F.col("_error_field").alias("field"), F.lit(None).cast("long").alias("q"), F.col("_detail").alias("detail")))


@query("""SELECT c_custkey FROM customer WHERE substr(c_name, 1, 1) = 'C' AND c_custkey % 5 = 0""")
def expansion_dead_letters(t):
    """One bad element of an expansion takes its whole row along."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("1"), F.lit("x"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("l"))
    return R.transform_split(rows, "emit each x in l { emit v = x.to_int() }")[1].select("c_custkey")


@query("""SELECT p_partkey, 'a=' || p_size || ',b=9,c=3' AS merged, p_size + 5 AS kept, 'b' AS rest, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'a' END AS dynamic FROM part""")
def functions_map_columns(t):
    """Maps whose keys only the rows know: merge, set and unset, with keys that are expressions."""
    rows = t.part.withColumn("m", F.create_map(F.lit("a"), F.col("p_size").cast("long"), F.lit("b"), F.lit(2).cast("long")))
    return R.transform(rows, """
        let w = m.merge({"b": 9, "c": 3})
        emit merged = ["a", "b", "c"].map(k => k + "=" + w[k].to_string()).join(",")
        emit kept = m.set("z", p_size + 5)["z"]
        emit rest = m.unset("a").keys().join(",")
        emit dynamic = m.unset(if p_size % 2 == 0 then "a" else "b").keys().join(",")""").select("p_partkey", "merged", "kept", "rest", "dynamic")  # fmt: skip


@query("SELECT o_orderkey, o_totalprice * 1.21 * 2.0 AS gross, 1.21 AS rate, o_custkey + 2 AS twice FROM orders")
def modules_that_use_others(t):
    """Constants and functions of modules, one of which uses the other, and state that a row keeps between programs."""
    spec = {
        "modules": {
            "tax": {"lets": {"rate": "0.21", "factor": "1.0 + rate"}},
            "price": {"use": {"t": "tax"}, "functions": {"gross": {"params": ["x"], "body": "x * t.factor * two()"}, "two": {"params": [], "body": "2.0"}}},
        },
        "nodes": [
            {"name": "in", "kind": "source", "table": "orders"},
            {"name": "a", "kind": "transform", "input": "in", "program": "emit gross = price.gross(o_totalprice)\nemit rate = tax.factor\nemit $record.next = o_custkey + 1"},
            {"name": "b", "kind": "transform", "input": "a", "program": "emit twice = $record.next + 1"},
        ],
    }
    return R.project(Pipeline(t._spark, spec, {"orders": t.orders}).build()["b"]).select("o_orderkey", "gross", "rate", "twice")


def _supplier_segments(t):
    rows = t.supplier.select("s_nationkey", "s_suppkey", F.explode(F.array(F.struct(F.lit("NAD").alias("seg_id"), F.col("s_name").alias("e01")), F.struct(F.lit("ADR").alias("seg_id"), F.lit("a'b+c?").alias("e01")))).alias("x"))
    return rows.select(F.concat(F.lit("R"), "s_nationkey").alias("ref"), F.concat(F.lit("M"), "s_suppkey").alias("msg_ref"), "x.*", F.struct("s_suppkey", "x.seg_id").alias("at"))


@query("SELECT 'M' || s_suppkey AS msg_ref, seg_id, CASE seg_id WHEN 'UNH' THEN 'M' || s_suppkey WHEN 'NAD' THEN s_name ELSE 'a''b+c?' END AS e01, 'R' || s_nationkey AS ref, 'ME' AS sender FROM supplier, (VALUES ('UNH'), ('NAD'), ('ADR')) v(seg_id)")
def edifact_round_trip(t):
    """Interchanges with headers and trailers made by the sink; the source checks counts and references, programs read the header."""
    path = interchange.write_messages(_supplier_segments(t), t.folder(), "edifact", "ref", "at", ["UNOC:3", "ME", "YOU", "240101:1200"], message_type="PARTIN:D:96A:UN")
    spec = {"nodes": [
        {"name": "in", "kind": "source", "format": "edifact", "envelope": True, "files": {"glob": f"{path}/ref=*/part-*"}},
        {"name": "t", "kind": "transform", "input": "in", "program": "emit sender = $doc.interchange.e02\nemit ref = $doc.interchange.e05"},
    ]}
    return Pipeline(t._spark, spec).build()["t"].select("msg_ref", "seg_id", "e01", "ref", "sender")


@query("SELECT 'M' || s_suppkey AS set_ref, 'G' || s_suppkey % 3 AS group_ref, seg_id, CASE seg_id WHEN 'ST' THEN '850' ELSE s_name END AS e01 FROM supplier, (VALUES ('ST'), ('N1')) v(seg_id)")
def x12_round_trip(t):
    """Three levels: interchange, groups, sets."""
    rows = t.supplier.select("s_nationkey", F.concat(F.lit("G"), F.col("s_suppkey") % 3).alias("group_ref"), F.concat(F.lit("M"), "s_suppkey").alias("set_ref"), F.lit("N1").alias("seg_id"), F.col("s_name").alias("e01"))
    rows = rows.withColumn("at", F.struct("group_ref", "set_ref"))
    head = ["00", " " * 10, "00", " " * 10, "ZZ", "ME".ljust(15), "ZZ", "YOU".ljust(15), "240101", "1200", "U", "00401", "", "0", "P", ":"]
    rows = rows.withColumn("control", F.lpad(F.col("s_nationkey").cast("string"), 9, "0"))
    path = interchange.write_messages(rows, t.folder(), "x12", "control", "at", head, ["PO", "ME", "YOU", "20240101", "1200", "", "X", "004010"], "850")
    good, _ = interchange.read_messages(t._spark, readers.find_files(t._spark, {"glob": f"{path}/control=*/part-*"}), "x12")
    return good.select("set_ref", "group_ref", "seg_id", "e01")
