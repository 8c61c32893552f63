"""Word-level dedup: every 20-word string goes wherever it starts again after its first start.

Each shard of the corpus (see repeats) gets a compressed FM-index, a wavelet
matrix over the Burrows-Wheeler transform, of those stretches of its excerpts
that hold no gram of words which the shard has only once. The excerpts are
streamed against it: backward search gives the matching statistics of their
windows, most of which end short of the threshold, a window's length; intervals of
those that reach it are traced to where they start first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import WORD, arrow, pieces, prepare, rows_of, stored, text_buffer, text_key, text_of, unique_texts
from tributary.llm.hashing import mixed, word_spans
from tributary.llm.repeats import Unit, covered, repeated
from tributary.llm.suffix import FmIndex

LENGTH, GRAM = 20, 4


def stretches_of(symbol: np.ndarray, sequence: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, in order, of runs of at least `least` nonzero symbols in one sequence, and the run of each place."""
    good = symbol > 0
    fresh = np.concatenate([[True], (sequence[1:] != sequence[:-1]) | (good[1:] != good[:-1])])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(symbol)))
    long = good[begin] & (size >= least)
    return np.flatnonzero(np.repeat(long, size)), np.repeat(np.arange(int(long.sum())), size[long])


def shard_repeats(length: int):
    """Marks the windows of excerpts that start earlier in the shard, by (id, h, start).

    Symbols are grams of a few words, a gram's length apart, so a window is a
    pattern of few symbols; the grams of each phase are a sequence of their own. A
    gram that occurs once is no symbol of the index, and no window with it
    repeats. Equal excerpts enter once, as the earliest of them.
    """
    size = next(s for s in (5, 4, 3, 2, 1) if length % s == 0)
    steps = length // size

    def repeats_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word of excerpts end to end whether the window there starts earlier too."""
        base = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(words)) - base[owner]
        again = np.zeros(len(words), bool)
        gram_at = np.flatnonzero(offset + size <= lengths[owner])
        joint = np.zeros(len(gram_at), np.uint64)
        for j in range(size):
            joint = mixed(joint + words[gram_at + j].astype(np.uint64))
        _, inverse, count = np.unique(joint, return_inverse=True, return_counts=True)
        name = np.where(count > 1, np.cumsum(count > 1), 0)
        unknown = int(name.max(initial=0)) + 1
        sequence = owner[gram_at] * size + offset[gram_at] % size
        by = np.lexsort((offset[gram_at], sequence))
        symbol = name[inverse]
        kept, run = stretches_of(symbol[by], sequence[by], steps)
        if not len(kept):
            return again
        spot = np.arange(len(kept)) + run
        text = np.zeros(len(kept) + int(run[-1]) + 1, np.int64)
        text[spot] = symbol[by][kept]
        place = np.zeros(len(text), np.int64)
        place[spot] = gram_at[by][kept]
        zero = np.flatnonzero(text == 0)
        fm = FmIndex(text, zero[np.searchsorted(zero, np.arange(len(text)))] + 1)
        stream = np.full(len(words), unknown, np.int64)
        stream[gram_at] = np.where(symbol > 0, symbol, unknown)
        starts = np.flatnonzero(offset + length <= lengths[owner])
        matched, lo, hi = fm.statistics(stream, starts, size, steps)
        full = matched == steps
        starts, lo, hi = starts[full], lo[full], hi[full]
        left, inverse = np.unique(lo, return_inverse=True)
        width = np.zeros(len(left), np.int64)
        width[inverse] = hi - lo
        begin = np.cumsum(width) - width
        rows = np.arange(int(width.sum())) + np.repeat(left - begin, width)
        if len(rows):
            first = np.minimum.reduceat(place[fm.locate(rows)], begin)
            again[starts] = first[inverse] != starts
        return again

    def index(rows: list[tuple]) -> list[np.ndarray]:
        earliest: dict[bytes, tuple] = {}
        for x in rows:
            where = (x[2], x[1], x[3])
            if x[4] not in earliest or where < earliest[x[4]]:
                earliest[x[4]] = where
        distinct = sorted(earliest, key=earliest.__getitem__)
        number = {e: k for k, e in enumerate(distinct)}
        names: dict[bytes, int] = {}
        words = [np.array([names.setdefault(w, len(names) + 1) for w in e.split(b" ")], np.int64) for e in distinct]
        lengths = np.array([len(w) for w in words])
        again = repeats_of(np.concatenate(words), lengths)
        cut = [again[b : b + n - length + 1] for b, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True)]
        return [cut[number[x[4]]] if earliest[x[4]] == (x[2], x[1], x[3]) else np.ones(len(cut[number[x[4]]]), bool) for x in rows]

    return index


DONE = pa.schema(
    [("h", pa.binary()), ("n_words", pa.int64()), ("gone", pa.int64()), ("kept", pa.binary()), ("first_id", pa.int64()), ("whole", pa.bool_())]
)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (remaining words, a space between; with digest their SHA-256 in hex): one row per input row.

    Words are runs of anything but ASCII white space; null has none. First means
    smallest id (null last), then smallest hash of the text, then earliest start. Of
    equal texts the rows with the smallest id keep what is first there; rows
    with that same id and text are one document given twice and fare alike. An
    empty table gives no rows. Columns other than the two named are not looked at;
    those in carry come along as a struct named row, and then a text that loses
    nothing is kept as it stands.
    """
    prepare(docs.sparkSession)
    texts = unique_texts(docs, id_col, text_col)
    spans = repeated(texts, Unit(length, min(GRAM, length), True), shard_repeats(length), True)
    empty = hashlib.sha256(b"").hexdigest().encode() if digest else b""

    def finish(batches):
        for whole in batches:
            for b in pieces(whole):
                data, offsets = text_buffer(b.column("text"))
                starts, ends, first = word_spans(data, offsets)
                out: dict[str, list] = {f.name: [] for f in DONE}
                for r, (h, i, found) in enumerate(zip(*(b.column(c).to_pylist() for c in ("h", "first_id", "spans")), strict=True)):
                    n = int(first[r + 1] - first[r])
                    gone = covered(n, length, found)
                    stay = np.flatnonzero(~gone) + first[r]
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    if len(stay) == n and carry is not None:
                        kept = raw
                    elif len(stay) == n:
                        kept = b" ".join(raw.split())
                    else:
                        kept = b" ".join([raw[s:e] for s, e in zip((starts[stay] - offsets[r]).tolist(), (ends[stay] - offsets[r]).tolist(), strict=True)])
                    row = (h, n, n - len(stay), hashlib.sha256(kept).hexdigest().encode() if digest else kept, i, n >= length)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                yield rows_of(out, DONE)

    done = arrow(texts.join(spans, "h", "left"), "substring", finish, "h binary, n_words long, gone long, kept binary, first_id long, whole boolean")
    if digest:  # small rows; stored, so that the copies of a text can be split when they meet it
        done = stored(done, "digests")
    along = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry is not None else []
    names = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_of(text_col)).alias("h"), *along)
    later = F.col("whole") & (F.coalesce("doc_id", F.lit((1 << 63) - 1)) != F.col("first_id"))
    out = names.join(done, "h")
    n_removed, kept = F.when(later, F.col("n_words")).otherwise(F.col("gone")), F.when(later, F.lit(empty)).otherwise(F.col("kept"))
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), kept.alias("kept"), *(["row"] if carry is not None else []))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with repeats cut from the text; rows of which nothing is left go. A column of text lengths follows.

    A text that loses nothing stays as it is, white space included; one that
    loses words has the rest with a space between. Rows without words (null, empty or
    white space) lose nothing and stay. Which of equal texts is first is as in
    remove_repeats. An empty table gives no rows; columns that share a name with
    what the operator makes pass as they are.
    """
    worded = F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))
    out = remove_repeats(docs.where(worded), id_col, text_col, carry=[c for c in docs.columns if c != text_col])
    out = out.where(F.col("n_removed") < F.col("n_words"))
    text = F.col("kept").cast("string")
    new = {text_col: text} | ({length_col: F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(f"row.`{length_col}`"))} if length_col in docs.columns else {})
    out = out.select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return out.union(docs.where(~worded))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))
