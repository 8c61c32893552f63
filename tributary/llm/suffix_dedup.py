"""Byte-level dedup: every 400-byte string that starts at two or more places goes, at all of them.

Shards of the corpus (see repeats) are parsed prefix-free; the suffix arrays of
their dictionary and parse give the shard's suffixes in corpus order, where
equal strings stand side by side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow, pieces, prepare, rows_of, stored, text_buffer, text_key, text_of, unique_texts
from tributary.llm.repeats import Unit, covered, repeated
from tributary.llm.suffix import PrefixFreeParse

LENGTH, GRAM = 400, 64


def shard_repeats(length: int):
    """Marks the windows of excerpts that start at two or more places of the shard. Equal excerpts enter the parse once, by their number."""

    def index(rows: list[tuple]) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        which = [number.setdefault(x[4], len(number)) for x in rows]
        copies = np.bincount(which, minlength=len(number))
        parse = PrefixFreeParse(list(number))
        at, group = parse.classes(length)
        often = np.bincount(group, copies[parse.text[at]]) if len(at) else np.zeros(0)
        flags = np.zeros(len(parse.data), bool)
        flags[at] = often[group] > 1
        cut = [flags[s : max(s, e - length + 1)] for s, e in zip(parse.starts, parse.ends, strict=True)]
        return [cut[w] for w in which]

    return index


DONE = pa.schema([("h", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("copies", pa.int64())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes; with digest their SHA-256): one row per input row.

    Texts are UTF-8 bytes, null is empty, and no string reaches over the end of
    its document. Rows that repeat, under whatever ids, are documents of their
    own, so each is the other's copy. An empty table gives no rows. Columns
    other than the two named are not looked at. Strings are those of the input;
    kept bytes need not be valid UTF-8.
    """
    prepare(docs.sparkSession)
    texts = unique_texts(docs, id_col, text_col)
    spans = repeated(texts, Unit(length, min(GRAM, length), False), shard_repeats(length), False)

    def finish(batches):
        for whole in batches:
            for b in pieces(whole):
                data, offsets = text_buffer(b.column("text"))
                out: dict[str, list] = {f.name: [] for f in DONE}
                for r, (h, copies, found) in enumerate(zip(*(b.column(c).to_pylist() for c in ("h", "copies", "spans")), strict=True)):
                    mine = data[offsets[r] : offsets[r + 1]]
                    gone = covered(len(mine), length, found)
                    if copies > 1 and len(mine) >= length:
                        gone[:] = True
                    kept = mine[~gone].tobytes()
                    n_spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                    row = (h, len(mine), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest().encode() if digest else kept, copies)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                yield rows_of(out, DONE)

    done = arrow(texts.join(spans, "h", "left"), "suffix", finish, "h binary, n_bytes long, n_removed long, n_spans long, kept binary, copies long").drop("copies")
    if digest:  # small rows; stored, so that the copies of a text can be split when they meet it
        done = stored(done, "digests")
    names = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_of(text_col)).alias("h"))
    return names.join(done, "h").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
