"""N-gram Jaccard join by grouped prefixes.

A document is its set of word shingles. Two sets that overlap enough share
shingles among the first of each in a common order, and how many at least
follows from their sizes. Documents with equal sets are one class, classes with
equal size and equal prefix one group; only groups are matched. The order puts
shingles of crowded sketch slots last, so prefixes hold rare ones.

Matching goes in two steps, so that a group of near copies never forms all its
pairs. First every group meets the smallest group of most of its prefix
shingles; pairs that count enough common shingles are verified on whole sets.
Then pairs of what is still apart, and counts enough common shingles, are
verified too, whichever shingle they meet at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow, partitions, pieces, prepare, rows_of, stored, text_buffer, text_key, text_of
from tributary.llm.components import components
from tributary.llm.hashing import lowered, mixed, shingles, word_hashes, word_spans

WORDS, SIMILARITY = 5, 75
#: Slots of the sketch that orders shingles (its size is fixed, whatever the corpus), and slots in one of its rows.
SLOTS, SLICE = 1 << 22, 1 << 12
#: Slices in which a worker sorts its part of the prefix shingles, and marks on their places.
FINE, FREE, KNOWN = 16, np.uint32(1 << 31), np.uint32(1 << 30)

COUNTS = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("n", pa.int32()), ("cid", pa.int64()), ("gid", pa.int64()), ("prefix", pa.binary())])
DEALT = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("gids", pa.binary()), ("places", pa.binary())])
ENTRIES = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("place", pa.int32())])
WHOLE = pa.schema([("cid", pa.int64()), ("set", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


def row_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows, the first of each row, and the hash of every shingle by its first word (some go over a row's end)."""
    data, offsets = text_buffer(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    return words, first, shingles(words, WORDS)


def document_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted. Fewer words than a shingle has make one of all of them; none, none."""
    words, first, every = row_shingles(column)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(every[a : b - WORDS + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in words[a:b]:
                x = shingles(np.array([x[0], w], np.uint64), 2)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap_needed(n: Column, m: Column) -> Column:
    """Smallest intersection of sets of n and m with 100 * intersection >= 75 * union."""
    return F.ceil((n + m) * F.lit(SIMILARITY) / F.lit(100.0 + SIMILARITY) - F.lit(1e-9)).cast("long")


def prefix_size(n):
    return n - -(-SIMILARITY * n // 100) + 1


def slot_order(docs: DataFrame, text_col: str) -> np.ndarray:
    """For each sketch slot twice the binary logarithm, rounded, of how many shingles of all documents fall into it.

    Tasks count, slices of their counts are summed where they meet, and SLOTS
    bytes come to the driver.
    """

    def count(batches):
        total = np.zeros(SLOTS, np.uint32)
        for whole in batches:
            for b in pieces(whole):
                _, first, every = row_shingles(b.column("text"))
                own = np.ones(len(every), bool)
                for k in range(1, WORDS):
                    over = first[1:] - k
                    own[over[(over >= 0) & (over < len(own))]] = False
                total += np.bincount((every[own] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        small = total.astype("<u4").reshape(-1, SLICE)
        yield rows_of({"slice": range(len(small)), "counts": [x.tobytes() for x in small]}, COUNTS)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(x, "<u4").astype(np.int64)
        yield rows_of({"slice": list(held), "counts": [np.round(2 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in held.values()]}, COUNTS)

    rows = arrow(docs.select(text_of(text_col).alias("text")), "jaccard", count, "slice int, counts binary")
    rows = arrow(rows.repartition(min(SLOTS // SLICE, partitions(docs.sparkSession)), "slice"), "jaccard", add, "slice int, counts binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in rows.collect():
        out[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, np.uint8)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, order) -> DataFrame:
    """doc_id, h, n, cid (class of equal sets), gid (group of equal size and prefix), prefix (40 bits a shingle)."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("h"))

    def look(batches):
        rank = order.value
        for whole in batches:
            for b in pieces(whole):
                out: dict[str, list] = {"n": [], "cid": [], "gid": [], "prefix": []}
                for x in document_sets(b.column("text")):
                    n = len(x)
                    place = (rank[(x % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                    first = x[np.argsort(place)[: prefix_size(n)]] if n else x
                    out["n"].append(n)
                    out["cid"].append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                    out["gid"].append(int.from_bytes(hashlib.blake2b(first.tobytes() + bytes(str(n), "ascii"), digest_size=8).digest(), "little", signed=True))
                    out["prefix"].append(first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                yield rows_of({"doc_id": b.column("doc_id"), "h": b.column("h"), **out}, SETS)

    return arrow(rows, "jaccard", look, "doc_id long, h binary, n int, cid long, gid long, prefix binary")


def numbers(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros((len(tokens), 8), np.uint8)
    out[:, :5] = tokens
    return out.view("<u8").ravel()


def _entries(groups: DataFrame) -> DataFrame:
    """token, gid and place in the prefix (from 0) for every prefix shingle that two groups share.

    Tasks send packs of shingles, group ids and places, dealt by shingle; a
    worker holds its part as numbers and sorts a slice of it at a time. Of the
    groups that share a shingle within a batch only the first goes to the
    shingle's part, marked KNOWN; the others need no decision and are dealt by
    group, marked FREE. So a shingle of a third of all groups costs its part an
    entry a batch, and no pairs are formed here.
    """
    spark = groups.sparkSession
    parts = max(partitions(spark), 16)

    def deal(batches):
        for b in batches:
            raw = b.column("prefix").to_pylist()
            tokens = numbers(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5))
            sizes = np.array([len(x) // 5 for x in raw], np.int64)
            gids = np.repeat(b.column("gid").to_numpy(), sizes)
            places = np.arange(len(gids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            by = np.argsort(tokens, kind="stable")
            tokens, gids, places = tokens[by], gids[by], places[by].astype(np.uint32)
            same = np.append(tokens[1:] == tokens[:-1], False)
            free = np.concatenate([[False], same[:-1]]) if len(same) else same
            places |= np.where(free, FREE, np.where(same, KNOWN, np.uint32(0)))
            part = mixed(np.where(free, tokens ^ mixed(gids.view(np.uint64)), tokens)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            use, at = np.unique(part[by], return_index=True)
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(by)], strict=True)) if len(use) else []
            raw5 = tokens[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            gids, places = gids[by].astype("<i8"), places[by].astype("<u4")
            yield rows_of(
                {
                    "part": use.astype(np.int32),
                    "tokens": [raw5[x:y].tobytes() for x, y in cuts],
                    "gids": [gids[x:y].tobytes() for x, y in cuts],
                    "places": [places[x:y].tobytes() for x, y in cuts],
                },
                DEALT,
            )

    def decided(mine: list):
        every = [np.concatenate(x) for x in zip(*mine, strict=True)]
        mine.clear()
        slices = every[0] % np.uint64(FINE)
        for k in range(FINE):
            tokens, gids, places = (x[slices == k] for x in every)
            if not len(tokens):
                continue
            by = np.lexsort((gids, tokens))
            tokens, gids, places = tokens[by], gids[by], places[by]
            one = np.cumsum(np.concatenate([[0], tokens[1:] != tokens[:-1]]))
            # A shingle of a KNOWN entry is shared, and so is one that stands here twice.
            good = (places & FREE != 0) | ((np.bincount(one) > 1) | (np.bincount(one, places & KNOWN != 0) > 0))[one]
            yield rows_of({"token": tokens[good].astype(np.int64), "gid": gids[good], "place": (places[good] & ~(FREE | KNOWN)).astype(np.int32)}, ENTRIES)

    def meet(batches):
        held, mine = None, []
        for b in batches:
            for k, t, g, p in zip(*(b.column(c).to_pylist() for c in DEALT.names), strict=True):
                if mine and k != held:
                    yield from decided(mine)
                held = k
                mine.append((numbers(np.frombuffer(t, np.uint8).reshape(-1, 5)), np.frombuffer(g, "<i8"), np.frombuffer(p, "<u4")))
        if mine:
            yield from decided(mine)

    dealt = arrow(groups.select("gid", "prefix"), "jaccard", deal, "part int, tokens binary, gids binary, places binary")
    return arrow(dealt.repartition(parts, "part").sortWithinPartitions("part"), "jaccard", meet, "token long, gid long, place int")


def _fits(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(n, m) >= overlap_needed(n, m)


def _rest(k: Column) -> Column:
    """What the prefix of a set of k leaves out."""
    return F.ceil(k * F.lit(SIMILARITY) / F.lit(100.0) - F.lit(1e-9)).cast("long") - 1


def _counted(met: DataFrame) -> DataFrame:
    """a, b, c of those rows a, n, b, m (one for each prefix shingle that two groups share) whose number c links need."""
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    n, m = F.col("n"), F.col("m")
    return pairs.where(F.col("c") >= overlap_needed(n, m) - F.greatest(_rest(n), _rest(m))).select("a", "b", "c")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs a, b of classes those that link, by their whole sets, which are made anew from one text (h, text) of each class."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = classes.select("h", "cid").join(ends, "cid")

    def whole(batches):
        for w in batches:
            for b in pieces(w):
                yield rows_of({"cid": b.column("cid"), "set": [x.astype("<u8").tobytes() for x in document_sets(b.column("text"))]}, WHOLE)

    shown = texts.join(wanted, "h").dropDuplicates(["h"]).select("cid", "text")
    sets = arrow(shown, "jaccard", whole, "cid long, set binary").repartition(partitions(texts.sparkSession), "cid")

    def check(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                good.append(100 * both >= SIMILARITY * (len(p) + len(q) - both))
            good = np.array(good, bool)
            yield rows_of({"a": a[good], "b": b[good]}, LINKS)

    both = pairs.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return arrow(both, "jaccard", check, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, h, n_shingles, class_id of every row; class_id, root of every class that links with another.

    Classes stand for equal sets. Rows that repeat fall into one class. Rows
    without words have a null class and link with nothing. Ids may be null or
    repeat. An empty table gives no rows. Columns other than the two named
    are not looked at. Set and group ids are 64-bit hashes.
    """
    spark = prepare(docs.sparkSession)
    order = spark.sparkContext.broadcast(slot_order(docs, text_col))
    rows = stored(_classes(docs, id_col, text_col, order), "shingled")
    some = rows.where("n > 0")
    classes = some.groupBy("cid").agg(F.first("n").alias("n"), F.first("gid").alias("gid"), F.min("h").alias("h"))
    groups = some.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = stored(_entries(groups), "entries")
    sizes = stored(classes, "classes")

    # Step one: each group and the hub that it shares most with; in a group, each class and the smallest. A
    # shingle's hub is the group that shares most of its own prefix: an original rather than an edited copy.
    by_group = sizes.groupBy("gid").agg(F.first("n").cast("long").alias("n"), F.min("cid").alias("lead"), F.count(F.lit(1)).alias("classes"))
    by_group = stored(by_group, "groups")
    shared = entries.groupBy("gid").agg(F.count(F.lit(1)).alias("s")).join(by_group.select("gid", "n"), "gid")
    part = F.col("s") / (F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY) / F.lit(100.0) - F.lit(1e-9)) + 1)
    sized = entries.join(shared.select("gid", "n", part.alias("part")), "gid")
    # Stored, so that both sides of the join are plain shuffles and a common shingle's groups can be split.
    hubs = stored(sized.groupBy("token").agg(F.max(F.struct("part", "gid", "n")).alias("hub")), "hubs")
    met = sized.join(hubs, "token").select(F.col("gid").alias("a"), "n", F.col("hub.gid").alias("b"), F.col("hub.n").alias("m"))
    met = met.where((F.col("a") != F.col("b")) & _fits(F.col("n"), F.col("m")))
    best = _counted(met).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    lead = by_group.select("gid", "lead")
    between = best.join(lead.withColumnsRenamed({"gid": "a", "lead": "x"}), "a").join(lead.withColumnsRenamed({"gid": "b", "lead": "y"}), "b")
    inside = sizes.join(by_group.where("classes > 1").select("gid", "lead"), "gid").where("cid <> lead")
    first = between.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(inside.select(F.col("cid").alias("a"), F.col("lead").alias("b")))

    texts = docs.select(text_key(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    links = stored(_verified(first, sizes, texts), "links")
    roots = components(links)

    # Step two: groups that share shingles, but not yet a component.
    labelled = sizes.join(roots.withColumnsRenamed({"id": "cid"}), "cid", "left").select("gid", "cid", F.coalesce("root", "cid").alias("root"))
    labelled = stored(labelled, "labelled")
    of_group = labelled.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    marked = entries.join(of_group.join(by_group.select("gid", "n"), "gid"), "gid")
    open_ = stored(marked.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("u")).where("l <> u").select("token"), "open")
    marked = marked.join(open_, "token")
    columns, sides = ("gid", "n", "low", "high", "place"), (("a", "n", "la", "ha", "i"), ("b", "m", "lb", "hb", "j"))
    left, right = (marked.select("token", *[F.col(c).alias(x) for c, x in zip(columns, side, strict=True)]) for side in sides)
    n, m = F.col("n"), F.col("m")
    # Linked sets share one of their first n - need + 1 and m - need + 1 shingles: of the need common ones at most
    # need - 1 lie beyond the stretch that ends first.
    need = overlap_needed(n, m)
    early = (F.col("i") <= n - need) & (F.col("j") <= m - need)
    apart = (F.col("la") != F.col("lb")) | (F.col("la") != F.col("ha")) | (F.col("lb") != F.col("hb"))
    met = left.join(right, "token").where((F.col("a") < F.col("b")) & apart & _fits(n, m) & early)
    met = met.select("a", "b").distinct()
    member = labelled.select("gid", "cid", "root")
    pairs = met.select("a", "b").unionByName(of_group.where("low <> high").select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    pairs = pairs.join(member.withColumnsRenamed({"gid": "a", "cid": "x", "root": "rx"}), "a").join(member.withColumnsRenamed({"gid": "b", "cid": "y", "root": "ry"}), "b")
    pairs = pairs.where("rx <> ry and (a <> b or x < y)").select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = stored(_verified(pairs, sizes, texts), "links")
    final = components(links.unionByName(more)) if more.limit(1).count() else roots
    members = rows.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("class_id"))
    return members, final.select(F.col("id").alias("class_id"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component_id: the smallest id that links reach, the row's own included (null only if all are null)."""
    members, roots = link(docs, id_col, text_col)
    labelled = members.join(roots, "class_id", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "class_id"))
    least = stored(labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return labelled.join(least, "root", "left").select("doc_id", "h", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: of each one the row with the smallest id.

    Null ids come last; among equal ids the smallest hash of the text decides, and
    of rows equal in both one stays. Rows without words stay, but for such
    repeats.
    """
    members, roots = link(docs, id_col, text_col)
    labelled = members.join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    linked = labelled.where("root is not null").groupBy("root").agg(F.min(place).alias("p")).select("p.doc_id", "p.h")
    stay = linked.unionByName(labelled.where("root is null").select("doc_id", "h").distinct())
    stay = stay.select(F.struct("h", "doc_id").alias("_key"), F.lit(True).alias("_stays"))
    key = F.struct(text_key(text_of(text_col)).alias("h"), F.col(id_col).cast("long").alias("doc_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    return rows.join(stay, "_key").dropDuplicates(["_key"]).select("_row.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
