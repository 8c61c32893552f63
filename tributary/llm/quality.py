"""Quality by importance resampling.

Two bags of hashed word unigrams and bigrams, one of target text and one of all
text, give each document a log likelihood ratio. Adding Gumbel noise and taking
the largest sums draws documents without replacement, each with a chance in
proportion to its weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import arrow, pieces, prepare, rows_of, stored, text_buffer, text_of
from tributary.llm.hashing import lowered, shingles, word_hashes, word_spans

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Share of the documents that is drawn.
KEEP = 0.8

COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()), ("key", pa.int64())])


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, the row of each, and a hash of each row's words."""
    data, offsets = text_buffer(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    pairs = shingles(words, 2)
    same = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
    buckets = np.concatenate([words, pairs[same]]) % np.uint64(BUCKETS)
    whole = np.zeros(len(column), np.uint64)
    np.add.at(whole, row, words * np.uint64(2) + np.uint64(1))
    return buckets.astype(np.int64), np.concatenate([row, row[:-1][same]]), whole


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """(2, BUCKETS): n-grams of all rows and of those with good. Counted where the rows are; at most BUCKETS rows come back."""

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for b in pieces(whole):
                buckets, row, _ = gram_buckets(b.column("text"))
                good = np.asarray(b.column("good").to_numpy(zero_copy_only=False), bool)
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                total[1] += np.bincount(buckets[good[row]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield rows_of({"bucket": at, "raw": total[0][at], "target": total[1][at]}, COUNTS)

    got = arrow(rows, "quality", count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, got["bucket"].to_numpy(np.int64)] = got[["raw", "target"]].to_numpy(np.int64).T
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all), each smoothed by one part in a thousand of the other text."""
    raw, target = counts.astype(np.float64)
    both = (raw + 1) / (raw.sum() + BUCKETS)
    p_raw = 0.999 * raw / max(raw.sum(), 1) + 0.001 * both
    p_target = 0.999 * target / target.sum() + 0.001 * both if target.sum() else p_raw
    return np.log(p_target) - np.log(p_raw)




def top(scored: DataFrame, score: str, tie: list[str], k: int) -> DataFrame:
    """scored with a boolean column selected: the k largest by score, then by tie ascending.

    The k-th value is found by counting: passes over ever finer bins, each of at
    most 4096 counts, until few enough rows lie in the bin that it falls in. Those
    alone are sorted. Nothing but counts comes to the driver.
    """
    low, high, n_all = scored.agg(F.min(score), F.max(score), F.count(F.lit(1))).first()
    if k >= n_all or low is None:
        return scored.withColumn("selected", F.lit(k >= n_all))
    above, bins = 0, 4096
    for _ in range(8):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(score) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        rows = scored.where((F.col(score) >= F.lit(low)) & (F.col(score) <= F.lit(high))).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high, inside = r.lo, r.hi, r.n
                break
            above += r.n
        if inside <= 10_000 or low == high:
            break
    edge = scored.where((F.col(score) >= F.lit(low)) & (F.col(score) <= F.lit(high))).select(score, *tie)
    last = edge.orderBy(F.col(score).desc(), *[F.col(c).asc_nulls_last() for c in tie]).limit(k - above)
    last = last.withColumn("n", F.row_number().over(Window.orderBy(F.col(score).desc(), *[F.col(c).asc_nulls_last() for c in tie])))
    cut = last.orderBy(F.col("n").desc()).limit(1).first()
    after = F.lit(False)
    same = F.col(score) == F.lit(cut[score])
    for c in tie:
        value = cut[c]
        after = after | (same & (F.coalesce(F.col(c) < F.lit(value), F.lit(False)) if value is not None else F.col(c).isNotNull()))
        same = same & F.col(c).eqNullSafe(F.lit(value))
    return scored.withColumn("selected", (F.col(score) > F.lit(cut[score])) | after | same)


def resample(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, seed: int = 23
) -> DataFrame:
    """doc_id, n_grams, log_weight, score (log_weight plus Gumbel noise), selected: one row per input row.

    target_ids (one column) names rows of good text; all of them fit the target
    model. The model of all text counts every row. Noise
    comes from the id, a hash of the words and the seed, so reruns agree; rows
    that repeat share their fate, and the draw may pass its size by their number.
    Null and empty texts weigh 0. Without target rows every weight is 0 and
    the draw is uniform. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    (name,) = target_ids.columns
    ids = target_ids.select(F.col(name).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # always a shuffle, in which null ids are spread: the good ids grow with the labels
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    good = ids.select("doc_id", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("good")).hint("merge")
    marked = rows.withColumn("spread", spread).join(good, ["doc_id", "spread"], "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = spark.sparkContext.broadcast(log_ratio(bucket_counts(marked)))

    def weigh(batches):
        for whole in batches:
            for b in pieces(whole):
                buckets, row, key = gram_buckets(b.column("text"))
                n = np.bincount(row, minlength=b.num_rows)
                w = np.bincount(row, ratio.value[buckets], minlength=b.num_rows)
                yield rows_of({"doc_id": b.column("doc_id"), "n_grams": n, "log_weight": w, "key": key.view(np.int64)}, WEIGHTS)

    weighed = arrow(rows, "quality", weigh, "doc_id long, n_grams long, log_weight double, key long")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    weighed = stored(weighed.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    k = round(keep * weighed.count())
    return top(weighed, "score", ["doc_id", "key"], k).drop("key")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels.where("quality = 1").select("doc_id"))
