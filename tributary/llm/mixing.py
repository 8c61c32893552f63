"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import WORD, partitions, prepare, stored, text_key, text_of

def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> source, source_size, target.

    One row per source. Sources weigh by their place in code point order, null
    last. A target is min(cap * size, level * weight) with the level at which
    the targets make up share of all sizes: what reshares the excess of
    full sources, by weight, until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source and seed, the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """id, h, source, size, source_size, target, copies: how often the mix emits each document (h: a hash of its text).

    Within a source each document is due target / source_size copies. Documents
    stand in order of size, then id; the due copies are summed along that order,
    a random offset is added, and a document is emitted once for each whole
    number that its sum crosses. Neighbours are of like size, so the words taken
    stay close to the target.

    Places come from a range partitioning by source, size, id, hash and a row
    number, so no task holds a source, whichever of these repeat or are null
    throughout: a place is the row's place in its partition, and the rows that its source
    has in partitions before. Null ids come first, then by the text's hash. Null text
    has size 0, a null source is a source of its own, a source of size 0 has target 0
    and emits nothing. Repeated rows are separate documents. An empty table
    gives no rows. Columns other than the three named are not looked at.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_key(text_of(text_col)).alias("h"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["source", "size", "id", "h", "tie"]
    dealt = stored(rows, "sizes").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    # Numbers of partitions and rows hold for this table only, so it is stored before they are used.
    dealt = stored(dealt.select("id", "h", "source", "size", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("at")), "places")
    heads = dealt.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lead"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = targets(heads.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"{c}_r" if c in keys else c) for c in right.columns])
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys])
        return left.join(right, cond, "inner").drop(*[f"{k}_r" for k in keys])

    heads = joined(heads.select("source", "part", "lead", "earlier"), totals, ["source"])
    out = joined(dealt, heads, ["source", "part"])
    rank = F.col("earlier") + F.col("at") - F.col("lead") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = lambda r: F.floor(offset(F.col("source"), seed) + rate * r)
    return out.select("id", "h", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (due(rank) - due(rank - 1)).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix emits it.

    Rows equal in id, text and source are emitted from one of them, together as
    often as all of them are due. Rows without words are emitted by their place like
    others; a source without any words is emitted not at all. An empty table
    gives no rows; columns that share a name with what the operator makes pass
    as they are.
    """
    due = mix(docs, id_col, text_col, source_col, **how).where("copies > 0")
    due = due.groupBy(F.struct("h", "id", "source").alias("_key")).agg(F.sum("copies").cast("int").alias("_n"))
    key = F.struct(text_key(text_of(text_col)).alias("h"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    once = rows.groupBy("_key").agg(F.first("_row").alias("_row")).join(due, "_key")
    return once.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST(CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS weight,
         CAST(2.0 AS DOUBLE) * source_size AS most FROM s
), r AS (
  SELECT *, most / weight AS ratio, CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s) AS budget FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), t AS (
  SELECT source, source_size,
         least(most, coalesce((SELECT max(lev) FROM l WHERE lev <= ratio) * weight, most)) AS target FROM l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('17:' || coalesce('=' || d.source, 'null')), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(off + rate * n) - floor(off + rate * (n - 1)) AS BIGINT) * size AS taken FROM k
"""
