"""Sources: files found by matchers, read as text columns, then coerced to a declared schema with bad rows kept aside."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.builtins import date_pattern

_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(), "date_time": T.TimestampNTZType()}


@dataclass(frozen=True)
class Field:
    """A declared column. source_name is its name in the file; multiple, a delimiter, splits a cell into an array.

    values says how a cell holds several: plain, escape (a backslash before a
    delimiter or backslash that is part of a value) or json (an array of strings).
    """

    name: str
    type: str = "string"
    nullable: bool = False
    source_name: str | None = None
    format: str | None = None
    scale: int = 18
    multiple: str | None = None
    values: str = "plain"
    start: int = 0
    width: int = 0
    justify: str | None = None

    def spark_type(self) -> T.DataType:
        of = T.DecimalType(38, self.scale) if self.type == "decimal" else _TYPES[self.type]
        return T.ArrayType(of) if self.multiple else of


def fields_of(spec: list) -> list[Field]:
    return [f if isinstance(f, Field) else Field(**({"name": f} if isinstance(f, str) else f)) for f in spec]


def cell(c: Column, f: Field) -> Column:
    """A text cell as the declared type, or null where it isn't one. Nothing is trimmed."""
    if f.type == "string":
        return c
    if f.type == "int":
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))
    if f.type == "float":
        return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))
    if f.type == "decimal":
        exact = c.try_cast(T.DecimalType(38, 18))
        return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.bround(exact, f.scale).cast(T.DecimalType(38, f.scale)))
    if f.type == "bool":
        return F.when(F.lower(c).isin("true", "1", "yes"), True).when(F.lower(c).isin("false", "0", "no"), False)
    if f.format:
        t = F.try_to_timestamp(c, F.lit(date_pattern(f.format)))
        return t.cast(_TYPES[f.type])
    if f.type == "date":
        return F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), c.try_cast("date"))
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?$"), c.try_cast("timestamp_ntz"))


def split_values(c: Column, sep: str = ";", values: str = "plain") -> Column:
    """A delimited cell as an array: what rows.join_values joins, split."""
    if values == "json":
        return F.from_json(c, "array<string>")
    if values == "escape":
        mark = re.escape(sep)
        found = F.regexp_extract_all(F.concat(c, F.lit(sep)), F.lit(rf"(?s)((?:\\.|(?!{mark})[^\\])*){mark}"), 1)
        return F.transform(found, lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1"))
    return F.split(c, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")), -1)


def coerce(df: DataFrame, schema: list, on_unmapped: str = "auto_widen", threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of text columns as the schema's types. bad has the text as it came and _error, the first field at fault.

    An empty cell is the empty string for string, null for nullable fields, and at
    fault otherwise. Columns that the schema doesn't name: auto_widen keeps them,
    drop drops them, reject refuses the input. With a threshold, a larger share of
    bad rows is an error.
    """
    fields = fields_of(schema)
    named = {f.source_name or f.name for f in fields}
    extra = [c for c in df.columns if c not in named and not c.startswith("_")]
    if extra and on_unmapped == "reject":
        raise ValueError(f"undeclared columns: {extra}")
    cols: dict[str, Column] = {}
    faults = []
    for f in fields:
        raw = F.col(f"`{f.source_name or f.name}`").cast("string") if (f.source_name or f.name) in df.columns else F.lit(None).cast("string")
        if f.multiple:
            parts = split_values(raw, f.multiple, f.values)
            out = F.transform(parts, lambda x, f=f: cell(x, f))
            bad = F.exists(F.arrays_zip(parts.alias("p"), out.alias("o")), lambda z: z["o"].isNull() & z["p"].isNotNull())
        else:
            out = cell(raw, f)
            missing = raw.isNull() | (raw == "")
            if f.nullable:
                out = F.when(raw != "", out)
                bad = ~missing & out.isNull()
            else:
                bad = F.lit(False) if f.type == "string" else missing | out.isNull()
        cols[f.name] = out.alias(f.name)
        faults.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f.name)))
    kept = [F.col(f"`{c}`") for c in df.columns if c.startswith("_")] + ([F.col(f"`{c}`") for c in extra] if on_unmapped == "auto_widen" else [])
    marked = df.withColumn("_error", F.coalesce(*faults))
    good, bad = marked.where("_error is null"), marked.where("_error is not null")
    if threshold is not None:
        n, m = marked.agg(F.count(F.lit(1)), F.count("_error")).first()
        if n and m / n > threshold:
            raise ValueError(f"{m} of {n} rows don't fit the schema")
    return good.select(*cols.values(), *kept), bad


def find_files(spark: SparkSession, spec: dict) -> list[str]:
    """Files by exactly one of path, glob, regex or paths, then exclude, sizes, times, sort_by, take_first or take_last.

    Listing goes through Hadoop's file systems, so any store that Spark reads will do.
    """
    kinds = [k for k in ("path", "glob", "regex", "paths") if k in spec]
    if len(kinds) != 1:
        raise ValueError("exactly one of path, glob, regex and paths")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[tuple[str, int, int]] = []

    def walk(base: str, recursive: bool) -> Iterator[tuple[str, int, int]]:
        where = jvm.org.apache.hadoop.fs.Path(base)
        files = where.getFileSystem(conf).listFiles(where, recursive)
        while files.hasNext():
            x = files.next()
            yield x.getPath().toString(), x.getLen(), x.getModificationTime()

    if kinds[0] in ("path", "paths"):
        for p in [spec["path"]] if "path" in spec else spec["paths"]:
            found += walk(p, spec.get("recursive", False))
    elif kinds[0] == "glob":
        where = jvm.org.apache.hadoop.fs.Path(spec["glob"])
        found = [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in where.getFileSystem(conf).globStatus(where) or [] if x.isFile()]
    else:
        base, _, pattern = spec["regex"].rpartition("/")
        found = [x for x in walk(base, spec.get("recursive", False)) if re.fullmatch(pattern, x[0].rpartition("/")[2])]
    found = [
        x
        for x in found
        if not any(fnmatch.fnmatch(x[0].rpartition("/")[2], e) for e in spec.get("exclude", []))
        and spec.get("min_size", 0) <= x[1] <= spec.get("max_size", 1 << 62)
        and spec.get("modified_after", 0) <= x[2] <= spec.get("modified_before", 1 << 62)
    ]
    found.sort(key={"name": lambda x: x[0], "size": lambda x: (x[1], x[0]), "modified": lambda x: (x[2], x[0])}[spec.get("sort_by", "name")])
    if "take_first" in spec:
        found = found[: spec["take_first"]]
    if "take_last" in spec:
        found = found[-spec["take_last"] :]
    if not found and spec.get("on_no_match", "error") == "error":
        raise FileNotFoundError(f"no file matches {spec}")
    return [x[0] for x in found]


def _file(df: DataFrame) -> DataFrame:
    return df.withColumn("_file", F.col("_metadata.file_path"))


def read_csv(
    spark: SparkSession, paths: list[str], schema: list, delimiter: str = ",", quote: str = '"', has_header: bool = True, encoding: str = "UTF-8", multi_line: bool = True
) -> DataFrame:
    """Cells as text. With a header, columns bind by name; without, by position.

    Quoted cells may hold line ends, which makes a file one task's work; set
    multi_line to false where none do, and large files are split.
    """
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("encoding", encoding).option("multiLine", multi_line)
    if has_header:
        return _file(reader.option("header", True).option("emptyValue", "").csv(paths))
    text = T.StructType([T.StructField(f.source_name or f.name, T.StringType()) for f in fields_of(schema)])
    return _file(reader.schema(text).csv(paths))


#: Control characters that stand in no JSON unescaped.
NO_LINE = "\x00\x01\x00\x02"


def read_json(spark: SparkSession, paths: list[str], schema: list, layout: str = "ndjson", record_path: str | None = None, declared_only: bool = False, sections: dict[str, str] | None = None) -> DataFrame:
    """array and ndjson layouts, or object with the dotted path of its array of records.

    sections names parts of an object by their dotted paths; programs read them on
    every record as $doc.name.field.

    Finding out what other columns there are takes a pass over the files; with
    declared_only there is none, and undeclared columns are not read. A file of
    layout array or object is one task's work and must fit its memory.
    """
    reader = spark.read.option("primitivesAsString", True)
    if declared_only and layout != "object":
        reader = reader.schema(T.StructType([T.StructField(f.source_name or f.name, T.StringType()) for f in fields_of(schema)]))
    if layout == "ndjson":
        return _file(reader.json(paths))
    # A file is one line, since no JSON holds this: the multi-line reader goes back into its file for every number that it reads as text.
    rows = _file(reader.option("lineSep", NO_LINE).json(paths))
    if layout == "object":
        parts = [F.col(path).alias(f"_doc_{name}") for name, path in (sections or {}).items()]
        rows = rows.select(F.explode(record_path).alias("_r"), "_file", *parts).select("_r.*", "_file", *[f"_doc_{name}" for name in sections or {}])
    return rows


def read_xml(spark: SparkSession, paths: list[str], record: str, attribute_prefix: str = "@", namespaces: str = "strip") -> DataFrame:
    """Elements named record, which may be a path of which the last part counts. namespaces: strip drops prefixes of names, qualify keeps them."""
    if namespaces not in ("strip", "qualify"):
        raise ValueError(f"no namespaces {namespaces!r}")
    reader = spark.read.format("xml").option("rowTag", re.split("[/.]", record)[-1]).option("attributePrefix", attribute_prefix).option("inferSchema", False)
    return _file(reader.option("ignoreNamespace", namespaces == "strip").load(paths))


def read_fixed_width(spark: SparkSession, paths: list[str], schema: list) -> DataFrame:
    """Fields by start (from 0) and width; padding at the end of a field is not part of it."""
    rows = spark.read.text(paths)
    return _file(rows).select(*[F.rtrim(F.substring("value", f.start + 1, f.width)).alias(f.source_name or f.name) for f in fields_of(schema)], "_file")


def read_multi_record(
    spark: SparkSession, paths: list[str], start: int, width: int, records: dict[str, list], header: str | None = None, trailer: str | None = None, count: str | None = None
) -> dict[str, DataFrame]:
    """Flat files of several record types, told apart by a discriminator; one frame a type, and _unknown for the rest.

    With header, trailer (discriminators) or count (the trailer's field that says
    how many body records there are), a file that has not just one of each at its
    place, that miscounts or that has records of unknown type is on the port
    rejected, line by line, with _error and _detail; nothing of it is elsewhere.
    """
    rows = _file(spark.read.text(paths)).withColumn("_kind", F.substring("value", start + 1, width))
    field = lambda f: F.rtrim(F.substring("value", f.start + 1, f.width))
    out: dict[str, DataFrame] = {}
    if header or trailer:
        known = F.col("_kind").isin(*records)
        # Lines of a split come in order, splits by where they begin.
        at = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        placed = rows.select("_file", "_kind", "value", known.alias("known"), at.alias("at"))
        checks = [F.when(~F.every("known"), F.lit("a record of unknown type"))]
        if header:
            checks.append(F.when((F.min_by("_kind", "at") != header) | (F.count_if(F.col("_kind") == header) != 1), F.lit("the header is not the one first record")))
        if trailer:
            checks.append(F.when((F.max_by("_kind", "at") != trailer) | (F.count_if(F.col("_kind") == trailer) != 1), F.lit("the trailer is not the one last record")))
        if count:
            (f,) = [f for f in fields_of(records[trailer]) if f.name == count]
            said = F.max(F.when(F.col("_kind") == trailer, F.trim(field(f)).try_cast("long")))
            there = F.count_if(~F.col("_kind").isin(*[k for k in (header, trailer) if k]))
            checks.append(F.when(F.coalesce(said != there, F.lit(True)), F.concat(F.lit("the trailer counts "), F.coalesce(said.cast("string"), F.lit("nothing")), F.lit(", there are "), there.cast("string"))))
        broken = placed.groupBy("_file").agg(F.coalesce(*checks).alias("_detail")).where("_detail is not null")
        bad = rows.join(broken, "_file")
        rows = rows.join(broken, "_file", "left_anti")
        out["rejected"] = bad.select("value", "_file", F.lit("structural_validation").alias("_error"), "_detail")
    out |= {k: rows.where(F.col("_kind") == k).select(*[field(f).alias(f.name) for f in fields_of(spec)], "_file") for k, spec in records.items()}
    out["_unknown"] = rows.where(~F.col("_kind").isin(*records)).select("value", "_file")
    return out


#: Segment terminator, element separator, component separator and escape of segment files, where a file doesn't say.
SEGMENTS = {"edifact": ("'", "+", ":", "?"), "x12": ("~", "*", ":", None), "hl7": ("\r", "|", "^", None), "swift": ("\n", ":", None, None)}


def segments(text: str, kind: str) -> list[tuple[str, list[str]]]:
    """(tag, elements) of each segment of one interchange or message."""
    end, sep, comp, escape = SEGMENTS[kind]
    if kind == "edifact" and text.startswith("UNA"):
        comp, sep, escape, end = text[3], text[4], text[6].strip() or None, text[8]
        text = text[9:]
    elif kind == "x12" and text.startswith("ISA") and len(text) > 105:
        sep, comp, end = text[3], text[104], text[105]
    elif kind == "hl7":
        text = re.sub("\r\n?|\n", "\r", text)
    elif kind == "swift":
        body = re.search(r"\{4:\r?\n(.*?)\r?\n-\}", text, re.S)
        found = re.findall(r"^:(\w+):(.*?)(?=^:\w+:|\Z)", (body[1] if body else text).replace("\r", ""), re.S | re.M)
        return [(tag, value.rstrip("\n").split("\n")) for tag, value in found]
    guard = re.escape(escape) if escape else None
    part = (lambda s, by: re.findall(rf"((?:{guard}.|[^{re.escape(by)}{guard}])*)(?:{re.escape(by)}|$)", s, re.S)[: -1 if not s.endswith(by) else None]) if guard else (lambda s, by: s.split(by))
    out = []
    for seg in part(text, end):
        seg = seg.strip("\r\n ")
        if seg:
            tag, *rest = part(seg, sep) if guard else seg.split(sep)
            out.append((tag, [re.sub(rf"{guard}(.)", r"\1", x) if guard else x for x in rest]))
    return out


def read_segments(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """One row a segment: _file, position (from 1), tag, elements. A file is one unit of work; it must fit a task."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = segments(bytes(content).decode("utf-8"), kind)
                yield pd.DataFrame({"_file": path, "position": range(1, len(rows) + 1), "tag": [r[0] for r in rows], "elements": [r[1] for r in rows]})

    return files.mapInPandas(parse, "_file string, position long, tag string, elements array<string>")


def sections(df: DataFrame, tags: list[str], section: str) -> DataFrame:
    """Body rows with a struct of their file's envelope segment(s), named section."""
    head = df.where(F.col("tag").isin(*tags)).groupBy("_file").agg(F.min_by("elements", "position").alias(section))
    return df.where(~F.col("tag").isin(*tags)).join(head, "_file", "left")


def in_order(df: DataFrame, keys: list[str], order: str, on_unsorted: str = "warn") -> DataFrame:
    """A source that declares an order: warn puts each file's rows in it, equal ones as they came; error stops at a row that breaks it."""
    if on_unsorted == "warn":
        return df.orderBy("_file", *[F.col(f"`{k}`").asc_nulls_last() for k in keys], order)
    broken = unsorted_rows(df, order, keys).select(F.lit(1)).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    return df.where(F.when(broken, F.raise_error(F.lit(f"rows are not in order of {', '.join(keys)}")).cast("boolean")).otherwise(True))


def unsorted_rows(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows that break a declared order within their file."""
    from pyspark.sql import Window

    w = Window.partitionBy("_file").orderBy(order)
    now, before = F.struct(*keys), F.lag(F.struct(*keys)).over(w)
    return df.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col("_before") > now)).drop("_before")
