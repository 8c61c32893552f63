"""Exact top-k inner products over a bit-sliced index.

A segment of the index holds, for each dimension, the upper bits of its rows'
integers as bitmaps. A query adds them, weighted by its own integers, with
carry-save bitmap adders: the result is a bit-sliced coarse score of every row.
From its most significant slice downward the k-th largest coarse score is read
off; rows whose coarse score could still reach it, given what the dropped bits
may add, are scored exactly.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import arrow, on_leaving, partitions, prepare, rows_of, scratch, stored

#: Rows of a segment, queries of a block, low bits that slices leave out, segments that one task holds, and tasks that share a group of segments.
SEGMENT, BLOCK, DROPPED, HELD, SPREAD = 16_384, 128, 3, 4, 16
#: Rows with |components| above this don't slice well: they are scored one by one, with Python's integers.
LARGEST = 1 << 40

SEGMENTS = pa.schema([("dim", pa.int32()), ("path", pa.string()), ("rows", pa.int64())])
BLOCKS = pa.schema([("dim", pa.int32()), ("uid", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND = pa.schema([("uid", pa.string()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.int32())])


class Segment:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dropped: int = DROPPED):
        """vectors: (rows, dims) int64."""
        self.ids, self.vectors, self.dropped = ids, vectors, dropped
        self.most = int(np.abs(vectors).max())
        coarse = vectors >> dropped
        self.low = coarse.min(0)
        lifted = (coarse - self.low).astype(np.uint64)
        bits = int(lifted.max()).bit_length()
        pad = -len(ids) % 64
        self.words = (len(ids) + pad) // 64
        self.slices = np.empty((vectors.shape[1], bits, self.words), np.uint64)
        for k in range(bits):
            on = ((lifted >> np.uint64(k)) & np.uint64(1)).astype(bool).T
            packed = np.packbits(np.pad(on, ((0, 0), (0, pad))), axis=1, bitorder="little")
            self.slices[:, k] = np.ascontiguousarray(packed).view(np.uint64)
        self.real = np.packbits(np.arange(len(ids) + pad) < len(ids), bitorder="little").view(np.uint64)

    def coarse_sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of sum |q| * (lifted value, or its complement where q is negative): (queries, words) each."""
        columns: dict[int, list[np.ndarray]] = {}

        def put(c: int, x: np.ndarray) -> None:
            held = columns.setdefault(c, [])
            held.append(x)
            if len(held) == 3:
                a, b, d = held
                half = a ^ b
                columns[c] = [half ^ d]
                put(c + 1, (a & b) | (half & d))

        size = np.abs(queries).astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        for d in range(queries.shape[1]):
            flip = np.where(queries[:, d] < 0, full, np.uint64(0))[:, None]
            turned = [self.slices[d, k][None] ^ flip for k in range(self.slices.shape[1])]
            for j in range(int(size[:, d].max()).bit_length()):
                bit = np.where((size[:, d] >> np.uint64(j)) & np.uint64(1), full, np.uint64(0))[:, None]
                for k, s in enumerate(turned):
                    put(j + k, s & bit)
        out, carry, c = [], None, 0
        none = np.zeros((len(queries), self.words), np.uint64)
        while c <= max(columns, default=-1) or carry is not None:
            held = columns.get(c, [])
            a, b = (held + [none, none])[:2]
            x = a ^ b
            out.append(x if carry is None else x ^ carry)
            carry = (a & b) if carry is None else (a & b) | (x & carry)
            c += 1
            if c > max(columns, default=-1) and not carry.any():
                carry = None
        return out

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that may be among its k best: by slices from the most significant down."""
        slices = self.coarse_sums(queries)
        n = len(queries)
        within, sure = np.broadcast_to(self.real, (n, self.words)).copy(), np.zeros((n, self.words), np.uint64)
        threshold = np.zeros(n, object)
        for i in range(len(slices) - 1, -1, -1):
            on = within & slices[i]
            enough = np.bitwise_count(sure | on).sum(1) >= min(k, len(self.ids))
            threshold = threshold + enough.astype(object) * (1 << i)
            sure = np.where(enough[:, None], sure, sure | on)
            within = np.where(enough[:, None], on, within & ~slices[i])
        slack = ((1 << self.dropped) - 1) * np.abs(queries).sum(1).astype(object)
        floor = [max(0, int(t) - (-(-int(s) >> self.dropped) + 1)) for t, s in zip(threshold, slack, strict=True)]
        more, same = np.zeros((n, self.words), np.uint64), np.broadcast_to(self.real, (n, self.words)).copy()
        for i in range(len(slices) - 1, -1, -1):
            bit = np.array([(f >> i) & 1 for f in floor], bool)[:, None]
            more = np.where(bit, more, more | (same & slices[i]))
            same = np.where(bit, same & slices[i], same & ~slices[i])
        found = np.unpackbits((more | same).view(np.uint8), axis=1, bitorder="little")
        return [np.flatnonzero(f) for f in found]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query its k best (vec_id, score) here, rows with the query's own id left out; ties to the smaller id."""
        own, counts = np.unique(self.ids, return_counts=True)
        at = np.searchsorted(own, ids)
        mine = np.where((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == ids), counts[np.minimum(at, len(own) - 1)], 0)
        out = []
        for q, rows, i in zip(queries, self.candidates(queries, k + int(mine.max())), ids, strict=True):
            rows = rows[self.ids[rows] != i]
            if not self._fits(q):
                out.append(exact(self.ids[rows], self.vectors[rows], q, k))
                continue
            score = self.vectors[rows] @ q
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append([(int(self.ids[rows[b]]), int(score[b])) for b in best])
        return out

    def _fits(self, q: np.ndarray) -> bool:
        """Whether no score of q, nor a part of its sum, can pass 64 bits."""
        return len(q) * self.most * int(np.abs(q).max()) < 1 << 63


def exact(ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) by Python's integers; vectors and q hold whole numbers of any size."""
    mine = [int(x) for x in q]
    scores = [(int(i), sum(int(x) * y for x, y in zip(v, mine, strict=True))) for i, v in zip(ids, vectors, strict=True)]
    return sorted(scores, key=lambda x: (-x[1], x[0]))[:k]


class Held:
    """A segment as stored: rows that slice, and those with a component above LARGEST."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        """vectors: (rows, dims) float64, whole numbers."""
        wide = np.abs(vectors).max(1) > LARGEST
        self.ids, self.vectors = ids[wide], vectors[wide]
        self.sliced = None if wide.all() else Segment(ids[~wide], vectors[~wide].astype(np.int64))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """As Segment.search, for queries (float64, whole numbers) of any size."""
        wide = np.abs(queries).max(1) > LARGEST
        out: list[list[tuple[int, int]]] = [[] for _ in ids]
        plain = np.flatnonzero(~wide)
        if self.sliced is not None and len(plain):
            for n, got in zip(plain, self.sliced.search(ids[plain], queries[plain].astype(np.int64), k), strict=True):
                out[n] = got
        for n, (i, q) in enumerate(zip(ids, queries, strict=True)):
            others = [(self.ids, self.vectors)] if len(self.ids) else []
            if wide[n] and self.sliced is not None:
                others.append((self.sliced.ids, self.sliced.vectors))
            for names, vectors in others:
                out[n] = sorted(out[n] + exact(names[names != i], vectors[names != i], q, k), key=lambda x: (-x[1], x[0]))[:k]
        return out


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """floor(scale * x) of every vector, as float64, which holds it exactly; None where a vector is null or has a null or non-finite component, or none at all."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = v.values if v.is_valid else None
        if x is None or x.null_count or not len(x):
            out.append(None)
            continue
        y = np.floor(scale * x.to_numpy(zero_copy_only=False).astype(np.float64))
        if not np.isfinite(y).all():
            out.append(None)
            continue
        out.append(y)
    return out


def _taken(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))


def _runs(batches, scale: float, size: int):
    """(dim, ids, vectors) of at most size rows each, from a task's rows."""
    held: dict[int, list] = {}
    for b in batches:
        for i, v in zip(b.column("id").to_pylist(), integers(b.column("v"), scale), strict=True):
            if v is None:
                continue
            mine = held.setdefault(len(v), [])
            mine.append((i, v))
            if len(mine) == size:
                yield len(v), np.array([x[0] for x in mine]), np.stack([x[1] for x in mine])
                held[len(v)] = []
    for dim, mine in held.items():
        if mine:
            yield dim, np.array([x[0] for x in mine]), np.stack([x[1] for x in mine])


def build(rows: DataFrame, folder: str, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """Writes the index, a file for each segment, without a shuffle; returns dim, path, rows."""

    def make(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for dim, ids, vectors in _runs(batches, scale, SEGMENT):
            name = f"{uuid.uuid4().hex}.npz"
            held = io.BytesIO()
            np.savez(held, ids=ids, vectors=vectors)
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(held.getvalue())
            yield rows_of({"dim": [dim], "path": [f"{folder}/{name}"], "rows": [len(ids)]}, SEGMENTS)

    return stored(arrow(_taken(rows, id_col, vector_col), "topk", make, "dim int, path string, rows long"), "segments")


def _long(score: int) -> tuple[int, int]:
    """A score, or the nearest long, and on which side of the longs it lies: an error only if it is among a query's k best."""
    held = max(-(1 << 63), min(score, (1 << 63) - 1))
    return held, (score > held) - (score < held)


_loaded: dict[str, Held] = {}
on_leaving("topk", _loaded.clear)


def _segment(path: str) -> Held:
    if path not in _loaded:
        while len(_loaded) >= HELD:
            _loaded.pop(next(iter(_loaded)))
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as f, np.load(io.BytesIO(f.read())) as x:
            _loaded[path] = Held(x["ids"], x["vectors"])
    return _loaded[path]


def search(index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of the index for every query row.

    Every block of queries meets every segment of its dimension: groups of HELD
    segments are numbered, blocks go to each group, and a task keeps its
    segments while blocks pass. A null id, or a vector that is null, empty or
    holds a null or a non-finite component, takes no part on either side;
    rows with the query's own id are never its results; ties go to the smaller id;
    a query row that repeats is answered once for each row, in equal ranks.
    """
    spark = prepare(index.sparkSession)

    def pack(batches):
        for dim, ids, vectors in _runs(batches, scale, BLOCK):
            yield rows_of({"dim": [dim], "uid": [uuid.uuid4().hex], "ids": [ids.astype("<i8").tobytes()], "vectors": [vectors.astype("<f8").tobytes()]}, BLOCKS)

    few = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + index.count() // 4))
    blocks = stored(arrow(_taken(queries, id_col, vector_col).coalesce(few), "topk", pack, "dim int, uid string, ids binary, vectors binary"), "queries")
    placed = index.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy("path")) - 1)
    groups = placed.groupBy("dim", F.floor(F.col("n") / HELD).alias("g")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    last = groups.groupBy("dim").agg(F.max("g").alias("last"))
    dealt = blocks.join(last, "dim").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    # A group of segments is read by as many tasks as there are for it: blocks are spread, and meet the group in one stretch.
    pairs = dealt.join(groups, ["dim", "g"])
    pairs = pairs.repartition(partitions(spark), "dim", "g", F.pmod(F.xxhash64("uid"), F.lit(SPREAD)))
    pairs = pairs.sortWithinPartitions("dim", "g").select("dim", "uid", "ids", "vectors", "paths")

    def look(batches):
        for b in batches:
            for dim, uid, ids, vectors, paths in zip(*(b.column(c).to_pylist() for c in ("dim", "uid", "ids", "vectors", "paths")), strict=True):
                names, q = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)
                best: list[list[tuple[int, int]]] = [[] for _ in names]
                for path in paths:
                    for n, got in enumerate(_segment(path).search(names, q, k)):
                        best[n] = sorted(best[n] + got, key=lambda x: (-x[1], x[0]))[:k]
                flat = [(f"{uid}-{n}", int(names[n]), i, *_long(x)) for n, rows in enumerate(best) for i, x in rows]
                if flat:
                    yield rows_of(dict(zip(FOUND.names, map(list, zip(*flat, strict=True)), strict=True)), FOUND)

    found = arrow(pairs, "topk", look, "uid string, query_id long, vec_id long, score long, over int")
    order = Window.partitionBy("uid").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id")
    fault = F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id"), F.lit(" does not fit a long"))).cast("long")
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(fault).alias("score")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build(rows, scratch(spark, "index"), "vec_id", "embedding")
    return search(index, rows.where("vec_id % 50 = 0"), "vec_id", "embedding")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
