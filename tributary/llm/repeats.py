"""Where a table's texts repeat a window of fixed length, found without comparing texts with each other.

Each window belongs to an anchor: the smallest hash of the short grams inside
it. Equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a text becomes a few runs of windows. Runs whose anchor no other
run has can't repeat and go no further. The rest are cut out, with the bytes
they cover, and meet in the shard of their anchor, where an index of the shard
decides.

An anchor with very many runs would overload one task. Of its runs, equal ones
are combined before the shuffle and only the earliest of each goes to the
index. Should even the distinct ones be too many for a shard, their windows
are told apart by 128-bit hashes, which are combined in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import arrow, partitions, pieces, rows_of, text_buffer
from tributary.llm.hashing import between, grams, mixed, shingles, sliding_min, sums, word_hashes, word_spans

#: Runs of an anchor beyond which equal ones are combined first, and beyond which no shard holds the rest.
HOT, HUGE = 1000, 20_000
#: Bytes of excerpts that an index is made of (or one anchor, if that has more), and units that are hashed at a time.
SHARD, STRETCH = 1 << 20, 1 << 17
#: Windows in a run at most; longer runs (of constant text) are cut.
RUN = 1024

ANCHORS = pa.schema([("key", pa.int64()), ("h", pa.binary()), ("run", pa.int64()), ("m", pa.int32())])
CUT = pa.schema([("key", pa.int64()), ("h", pa.binary()), ("id", pa.int64()), ("a", pa.int32()), ("size", pa.int32()), ("huge", pa.bool_()), ("excerpt", pa.binary())])
ROWS = ["key", "h", "id", "a", "excerpt"]
WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("h", pa.binary()), ("a", pa.int32())])
SPANS = pa.schema([("h", pa.binary()), ("s", pa.int32()), ("e", pa.int32())])


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    window: int
    gram: int
    words: bool

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple | None]:
        """Units of all rows, the first of each row, the bytes, and for words their spans."""
        data, offsets = text_buffer(column)
        if not self.words:
            return data, offsets, data, None
        starts, ends, first = word_spans(data, offsets)
        return word_hashes(data, starts, ends), first, data, (starts, ends)

    def grams(self, units: np.ndarray) -> np.ndarray:
        return shingles(units, self.gram) if self.words else grams(units, self.gram)


def runs(unit: Unit, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last window (by its first unit in the row), anchor, and 2 if the anchor's gram stands in the run twice (else 1).

    A run with its gram at one place only has no two equal windows of its own.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(units), STRETCH):
        part = units[low : low + STRETCH + unit.window - 1]
        gram, width = unit.grams(part), unit.window - unit.gram + 1
        key = sliding_min(gram, width)
        if not len(key):
            continue
        at = np.arange(low, low + len(key))
        row = np.searchsorted(first, at, side="right") - 1
        good = at + unit.window <= first[row + 1]
        at, row, key = at[good], row[good], key[good]
        if not len(at):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1) | (np.diff(row) != 0)])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(at)))
        if size.max() > RUN:
            begin = np.concatenate([np.arange(b, b + s, RUN) for b, s in zip(begin, size, strict=True)])
            size = np.diff(np.append(begin, len(at)))
        twice = np.empty(len(begin), np.int64)
        around = np.lib.stride_tricks.sliding_window_view(gram, width)
        for i in range(0, len(begin), 4096):
            b = begin[i : i + 4096]
            lead, k = at[b] - low, key[b][:, None]
            tail = lead + size[i : i + 4096] - 1
            left, right = (around[lead] == k).argmax(1), width - 1 - (around[tail] == k)[:, ::-1].argmax(1)
            twice[i : i + 4096] = 1 + (lead + left != tail + right)
        a = at[begin] - first[row[begin]]
        out.append((row[begin], a, a + size - 1, key[begin], twice))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


#: excerpts of whole anchors: (key, h, id, a, bytes) -> for each a boolean array, true for windows to be reported.
Index = Callable[[list[tuple]], list[np.ndarray]]


def repeated(texts: DataFrame, unit: Unit, index: Index, first_stays: bool) -> DataFrame:
    """h, spans (array of first and last window start): the windows that index reports.

    texts: h, text, first_id and copies, from unique_texts, one row per distinct
    text and partitioned by h. With first_stays the window that comes first, by
    first_id, h and start, is not reported. All columns of texts are read each
    time, so that its shuffle is made once.
    """
    spark, limits = texts.sparkSession, (HOT, HUGE)

    def find(batches):
        for whole in batches:
            for b in pieces(whole):
                row, a, z, key, m = runs(unit, *unit.of(b.column("text"))[:2])
                h = b.column("h").take(pa.array(row))
                yield rows_of({"key": key.view(np.int64), "h": h, "run": (a << 11) | (z - a + 1), "m": m}, ANCHORS)

    anchors = arrow(texts, "repeats", find, "key long, h binary, run long, m int")
    shared = anchors.groupBy("key").agg(F.sum("m").alias("n")).where("n > 1")
    some = anchors.select("key", "h", "run").join(shared, "key").groupBy("h").agg(F.collect_list(F.struct("key", "run", "n")).alias("runs"))
    held = texts.join(some, "h")

    def cutter(hot: bool):
        def cut(batches):
            for whole in batches:
                for b in pieces(whole):
                    yield cut_runs(unit, b, hot, limits)

        return cut

    ddl = "key long, h binary, id long, a int, size int, huge boolean, excerpt binary"
    excerpts = arrow(held, "repeats", cutter(False), ddl).select(*ROWS)
    many = arrow(held.where(F.exists("runs", lambda x: x["n"] > HOT)), "repeats", cutter(True), ddl)
    many = many.withColumn("e", F.md5("excerpt"))
    where = F.struct("id", "h", "a")
    distinct = many.groupBy("key", "e", "huge").agg(F.min(where).alias("lead"), F.first("excerpt").alias("excerpt"), F.count(F.lit(1)).alias("n"))
    leads = distinct.where("not huge").select("key", "lead.h", "lead.id", "lead.a", "excerpt")

    def decide(batches):
        rows: list[tuple] = []
        size = 0

        def report(ready: list[tuple]):
            out: dict[str, list] = {f.name: [] for f in SPANS}
            for x, flags in zip(ready, index(ready), strict=True):
                for s, e in spans_of(flags):
                    out["h"].append(x[1])
                    out["s"].append(x[3] + s)
                    out["e"].append(x[3] + e)
            return rows_of(out, SPANS)

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ROWS), strict=True):
                if size > SHARD and x[0] != rows[-1][0]:
                    yield report(rows)
                    rows, size = [], 0
                rows.append(x)
                size += len(x[4])
        if rows:
            yield report(rows)

    shards = excerpts.unionByName(leads).repartition(partitions(spark), "key").sortWithinPartitions("key")
    indexed = arrow(shards, "repeats", decide, "h binary, s int, e int")

    members = many.select("key", "e", "h", "id", "a", "size").join(distinct.select("key", "e", "lead", "n"), ["key", "e"])
    lead = (F.col("id") == F.col("lead.id")) & (F.col("h") == F.col("lead.h")) & (F.col("a") == F.col("lead.a"))
    copies = members.where(~lead if first_stays else F.col("n") > 1).select("h", F.col("a").alias("s"), (F.col("a") + F.col("size") - 1).alias("e"))

    def split(batches):
        for whole in batches:
            for h, i, a, piece in zip(*(whole.column(c).to_pylist() for c in ("h", "id", "a", "excerpt")), strict=True):
                mine = unit.of(pa.array([piece], pa.binary()).cast(pa.large_binary()))[0].astype(np.uint64)
                c, d = sums(mixed(mine)), sums(mixed(mine + np.uint64(0x51ED27)))
                at = np.arange(len(mine) - unit.window + 1)
                one, two = between(c, at, at + unit.window), between(d, at, at + unit.window)
                n = len(at)
                yield rows_of({"w1": one.view(np.int64), "w2": two.view(np.int64), "id": np.full(n, i), "h": [h] * n, "a": a + at}, WINDOWS)

    windows = arrow(distinct.where("huge").select("lead.h", "lead.id", "lead.a", "excerpt"), "repeats", split, "w1 long, w2 long, id long, h binary, a int")
    known = windows.groupBy("w1", "w2").agg(F.min(where).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(known, ["w1", "w2"])
    if first_stays:
        again = again.where(~lead)
    single = again.select("h", F.col("a").alias("s"), F.col("a").alias("e"))
    return indexed.unionByName(copies).unionByName(single).groupBy("h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def cut_runs(unit: Unit, b: pa.RecordBatch, hot: bool, limits: tuple[int, int]) -> pa.RecordBatch:
    """The runs of a batch's rows (those of anchors beyond HOT, or the others), each with the bytes that its windows cover.

    Words stand with one space between.
    """
    _, first, data, spans = unit.of(b.column("text"))
    raw = data.tobytes()
    found = b.column("runs")
    sizes = np.diff(found.offsets.to_numpy())
    flat = found.flatten()
    key, run, n = (flat.field(i).to_numpy() for i in range(3))
    row = np.repeat(np.arange(b.num_rows), sizes)
    take = (n > limits[0]) == hot
    key, run, n, row = key[take], run[take], n[take], row[take]
    a, size = run >> 11, run & 2047
    low = first[row] + a
    high = low + size + unit.window - 1
    if unit.words:
        starts, ends = spans
        s, e = starts[low], ends[high - 1]
        inside = np.concatenate([[0], np.cumsum(ends - starts)])
        tight = inside[high] - inside[low] + (high - low - 1) == e - s
        plain = raw.translate(_ONE_SPACE)
        cut = [
            plain[p:q] if t else b" ".join([raw[x:y] for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)])
            for p, q, t, i, j in zip(s.tolist(), e.tolist(), tight.tolist(), low.tolist(), high.tolist(), strict=True)
        ]
    else:
        cut = [raw[p:q] for p, q in zip(low.tolist(), high.tolist(), strict=True)]
    at = pa.array(row)
    return rows_of({"key": key, "h": b.column("h").take(at), "id": b.column("first_id").take(at), "a": a, "size": size, "huge": n > limits[1], "excerpt": cut}, CUT)


_ONE_SPACE = bytes(32 if x in (9, 10, 11, 12, 13) else x for x in range(256))


def covered(n: int, window: int, spans: list | None) -> np.ndarray:
    """Which of n units lie in a reported window."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        s, e = np.array([(x["s"], x["e"]) for x in spans], np.int64).T
        np.add.at(edge, s, 1)
        np.add.at(edge, e + window, -1)
    return np.cumsum(edge[:-1]) > 0
