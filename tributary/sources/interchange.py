"""EDIFACT and X12 with their envelopes: reading checks what trailers claim, writing makes the trailers.

A file holds one interchange and is one task's work on both sides, since counts
and references run through all of it; both sides stream, and hold no more than
a frame of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.readers import SEGMENTS, segments

#: Envelope levels from the outside: header tag, place of its reference, trailer tag, name of the reference's column.
LEVELS = {
    "edifact": [("UNB", 4, "UNZ", "interchange_ref"), ("UNH", 0, "UNT", "msg_ref")],
    "x12": [("ISA", 12, "IEA", "interchange_ref"), ("GS", 5, "GE", "group_ref"), ("ST", 1, "SE", "set_ref")],
}
_ROWS = 10_000


class Malformed(ValueError):
    pass


def body(found: list[tuple[str, list[str]]], kind: str) -> Iterator[tuple[list[str], str, list[str]]]:
    """(references of the open levels, tag, elements) of each segment inside a message, its header among them.

    Raises Malformed at the first segment that breaks the structure: one out of
    place, a trailer whose count or reference is wrong, content after the end, an
    end that doesn't come.
    """
    levels = LEVELS[kind]
    inner = len(levels) - 1
    opens, closes = {x[0]: k for k, x in enumerate(levels)}, {x[2]: k for k, x in enumerate(levels)}
    refs: list[str] = []
    counts: list[int] = []
    ended = False
    for tag, elements in found:
        if ended:
            raise Malformed(f"{tag} after the end")
        at = lambda i, e=elements: e[i].strip() if i < len(e) else ""
        if tag in opens:
            k = opens[tag]
            if len(refs) != k:
                raise Malformed(f"{tag} out of place")
            if k:
                counts[-1] += 1
            refs.append(at(levels[k][1]))
            counts.append(0)
        elif tag in closes:
            k = closes[tag]
            if len(refs) != k + 1:
                raise Malformed(f"{tag} out of place")
            ref, n = refs.pop(), counts.pop() + (k == inner)
            if not at(0).isdigit() or int(at(0)) != n:
                raise Malformed(f"{tag} counts {at(0)!r}, there are {n}")
            if at(1) != ref:
                raise Malformed(f"{tag} names {at(1)!r}, not {ref!r}")
            ended = k == 0
            continue
        elif len(refs) <= inner:
            raise Malformed(f"{tag} outside of a message")
        if len(refs) > inner:
            counts[-1] += 1
            yield list(refs), tag, elements
    if not ended:
        raise Malformed("the end is missing")


def read_messages(spark: SparkSession, paths: list[str], kind: str, max_elements: int = 32) -> tuple[DataFrame, DataFrame]:
    """(good, bad): one row a body segment, with _file, position, seg_id, its references, and elements as e01, e02, ...

    The interchange's header is the section $doc.interchange of programs. A file whose
    structure is broken is bad as a whole: a row with _error structural_validation
    and _detail, and what was read before as document_rejected. Files of no bytes are
    skipped by Spark and are in neither.
    """
    refs = [x[3] for x in LEVELS[kind]]
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(frames):
        import pandas as pd

        columns = ["_file", "position", "seg_id", "refs", "elements", "head", "_error", "_detail"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                found = segments(bytes(content).decode("utf-8"), kind)
                head = found[0][1] if found and found[0][0] == LEVELS[kind][0][0] else []
                # A first pass over the segments says whether the file is whole.
                error = None
                try:
                    for _, tag, elements in body(found, kind):
                        if len(elements) > max_elements:
                            raise Malformed(f"{tag} has over {max_elements} elements")
                except Malformed as e:
                    error = str(e)
                rejected, held, n = "document_rejected" if error else None, [], 0
                try:
                    for n, (names, tag, elements) in enumerate(body(found, kind), 1):
                        held.append((path, n, tag, names, elements, head, rejected, None))
                        if len(held) == _ROWS:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                except Malformed:
                    pass
                if error:
                    held.append((path, n + 1, None, [], [], head, "structural_validation", error))
                yield pd.DataFrame(held, columns=columns)

    rows = files.mapInPandas(parse, "_file string, position long, seg_id string, refs array<string>, elements array<string>, head array<string>, _error string, _detail string")
    named = [F.get("refs", F.lit(k)).alias(c) for k, c in enumerate(refs)]
    parts = lambda c: [F.get(c, F.lit(k)).alias(f"e{k + 1:02d}") for k in range(max_elements)]
    shown = ["_file", "position", "seg_id", *named, *parts("elements"), F.struct(*parts("head")).alias("_doc_interchange")]
    return rows.where("_error is null").select(*shown), rows.where("_error is not null").select(*shown, "_error", "_detail")


class Framer:
    """Rows of one interchange, in order, to lines with headers and trailers."""

    def __init__(self, kind: str, heads: list[list[str]], message_type: str):
        self.kind, self.heads, self.type, self.levels = kind, heads, message_type, LEVELS[kind]
        self.open: list[list] = []

    def line(self, tag: str, elements: list) -> str:
        end, sep, _, escape = SEGMENTS[self.kind]
        out = []
        for k, x in enumerate(elements):
            x = "" if x is None else str(x)
            for mark in (escape, end, sep) if escape else ():
                x = x.replace(mark, escape + mark)
            if not escape and (end in x or sep in x):
                raise ValueError(f"{tag}: element {k + 1} holds a delimiter")
            out.append(x)
        while out and not out[-1]:
            out.pop()
        return sep.join([tag, *out]) + end

    def _shut(self, down_to: int) -> Iterator[str]:
        while len(self.open) > down_to:
            ref, n = self.open.pop()
            k = len(self.open)
            yield self.line(self.levels[k][2], [str(n + (k == len(self.levels) - 1)), ref])

    def row(self, refs: list[str], tag: str, elements: list) -> Iterator[str]:
        inner = len(self.levels) - 1
        same = 0
        while same < len(self.open) and self.open[same][0] == refs[same]:
            same += 1
        header = tag == self.levels[inner][0]
        if header and same > inner:
            raise ValueError(f"{tag} {refs[inner]!r} comes twice")
        yield from self._shut(same)
        for k in range(same, inner + 1):
            name, place, _, _ = self.levels[k]
            if k < inner:
                head = list(self.heads[k])
                head += [""] * (place + 1 - len(head))
                head[place] = refs[k]
            else:
                head = elements if header else ([refs[k], self.type] if place == 0 else [self.type, refs[k]])
            if self.open:
                self.open[-1][1] += 1
            self.open.append([refs[k], int(k == inner)])
            yield self.line(name, head)
        if not header:
            self.open[-1][1] += 1
            yield self.line(tag, elements)

    def end(self) -> Iterator[str]:
        yield from self._shut(0)


def message_lines(df: DataFrame, kind: str, by: str, order: str, interchange: list[str], group: list[str] | None = None, message_type: str = "") -> DataFrame:
    """Lines of one interchange for each value of by, as (by, value), in order within a partition.

    df has seg_id, the references below the interchange's, and e01, e02, ...; a message
    goes on while its references stay. by is the interchange's reference.
    """
    names = [x[3] for x in LEVELS[kind]][1:]
    parts = sorted(c for c in df.columns if len(c) == 3 and c[0] == "e" and c[1:].isdigit())
    heads = [interchange, *([group or []] if kind == "x12" else [])]
    cols = [F.col(f"`{by}`").cast("string").alias("_by"), F.col("seg_id"), F.array(*[F.col(n).cast("string") for n in names]).alias("_refs"), F.array(*[F.col(c).cast("string") for c in parts]).alias("_parts")]
    rows = df.select(F.col(f"`{order}`").alias("_at"), *cols).repartition("_by").sortWithinPartitions("_by", "_at")

    def frame(batches):
        import pyarrow as pa

        now, framer, n = None, None, 0
        for b in batches:
            keys, lines = [], []

            def add(made, keys=keys, lines=lines):
                for x in made:
                    keys.append(now)
                    lines.append(x)

            for key, tag, refs, elements in zip(*[b.column(c).to_pylist() for c in ("_by", "seg_id", "_refs", "_parts")], strict=True):
                if framer is None or key != now:
                    if framer:
                        add(framer.end())
                    now, framer = key, Framer(kind, heads, message_type)
                add(framer.row([key, *refs], tag, elements))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(range(n, n + len(keys)), pa.int64()), pa.array(lines, pa.string())], ["_by", "_n", "value"])
            n += len(keys)
        if framer:
            last = list(framer.end())
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(last), pa.string()), pa.array(range(n, n + len(last)), pa.int64()), pa.array(last, pa.string())], ["_by", "_n", "value"])

    # The order is stated again, so that the writer, which sorts by folder, keeps it.
    return rows.mapInArrow(frame, "_by string, _n long, value string").sortWithinPartitions("_by", "_n").select(F.col("_by").alias(by), "value")


def write_messages(df: DataFrame, path: str, kind: str, by: str, order: str, interchange: list[str], group: list[str] | None = None, message_type: str = "", mode: str = "errorifexists") -> str:
    """One file a value of by, each in a folder of its own; returns the path."""
    lines = message_lines(df, kind, by, order, interchange, group, message_type)
    lines.write.mode(mode).partitionBy(by).text(path)
    return path
