"""Sinks."""

from __future__ import annotations

import datetime
import json
import re
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators.rows import project, scale_decimals, sort
from tributary.sources.readers import SEGMENTS, fields_of


#: Bytes of a file that is one array of JSON.
ARRAY_BYTES = 16 << 20


def _target(df: DataFrame, path: str, if_exists: str) -> tuple[str, str]:
    if if_exists == "unique_suffix":
        return f"{path}-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}", "errorifexists"
    return path, {"overwrite": "overwrite", "error": "errorifexists"}[if_exists]


def write(
    df: DataFrame, path: str, kind: str = "csv", *, mapping=None, exclude=None, include_unmapped=True, scales=None, sort_order=None, if_exists="error", max_records=None,
    fan_out: list[str] | None = None, delimiter=",", header=True, root="records", record="record", schema: list | None = None, segments: str | None = None, layout="ndjson", meta: bool | dict = False, preserve_nulls=False,
    attributes: list[str] | None = None, arrays: dict[str, dict] | None = None,
) -> str:
    """Projects, scales, sorts and writes; returns the path. fan_out gives each value of its columns a folder of its own.

    JSON has decimals as strings; layout array makes each file one array of
    records, of ARRAY_BYTES at most or of one record. Spark's committer makes the output appear whole or not at all. meta
    puts a sidecar of provenance beside it, with what a dict adds; rows are counted
    as they are written. A path with {source_file} or {source_path} gives each source
    file's rows a folder below what comes before it. JSON leaves null columns out
    unless preserve_nulls. XML has attributes as such, and an array by arrays'
    {field: {repeat_as, wrap_in}}: an element a value, in a container or without.
    """
    if sort_order:
        df = sort(df, sort_order)
    token = re.search(r"/?\{(source_file|source_path)\}", path)
    if token:
        if fan_out:
            raise ValueError("fan_out and a path by source file")
        whole, path, fan_out = F.col("_file"), path[: token.start()], [token[1]]
        df = df.withColumn(token[1], whole if token[1] == "source_path" else F.regexp_extract(whole, r"([^/]*?)(\.[^./]*)?$", 1))
    df = project(df, mapping, exclude, include_unmapped)
    if scales:
        df = scale_decimals(df, scales)
    path, mode = _target(df, path, if_exists)
    told, seen = df, Observation()
    if meta:
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if kind == "fixed_width":
        df = df.select(fixed_width_line(df, schema).alias("value"))
    elif kind == "segments":
        df = df.select(segment_line(segments).alias("value"))
    elif kind == "json":
        df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if isinstance(f.dataType, T.DecimalType)})
        if layout == "array":
            if fan_out or max_records:
                raise ValueError("an array of records is one file a partition: no fan_out, no max_records")
            df, kind, max_records = json_arrays(df, preserve_nulls), "lines", 1
    elif kind == "xml":
        df = xml_shape(df, attributes or [], arrays or {})
    out = df.write.mode(mode)
    if max_records:
        out = out.option("maxRecordsPerFile", max_records)
    if fan_out:
        out = out.partitionBy(*fan_out)
    if kind == "csv":
        out.option("header", header).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "json":
        out.option("ignoreNullFields", not preserve_nulls).json(path)
    elif kind == "xml":
        out.format("xml").option("rootTag", root).option("rowTag", record).option("attributePrefix", "@").option("arrayElementName", "item").save(path)
    elif kind in ("fixed_width", "segments", "lines"):
        out.text(path)
    else:
        out.format(kind).save(path)
    if meta:
        write_sidecar(told, path, dict(seen.get), **(meta if isinstance(meta, dict) else {}))
    return path


def xml_shape(df: DataFrame, attributes: list[str], arrays: dict[str, dict]) -> DataFrame:
    """Columns as the XML writer takes them: attributes by their prefix, first, and arrays named and wrapped as said. A single value counts as an array of one."""
    cols = [F.col(f"`{c}`").alias("@" + c) for c in attributes]
    for f in df.schema:
        c, how = F.col(f"`{f.name}`"), arrays.get(f.name)
        if f.name in attributes:
            continue
        if how is None:
            cols.append(c)
            continue
        if not isinstance(f.dataType, T.ArrayType):
            c = F.when(c.isNotNull(), F.array(c))
        name = how.get("repeat_as", f.name)
        cols.append(F.when(c.isNotNull(), F.struct(c.alias(name))).alias(how["wrap_in"]) if "wrap_in" in how else c.alias(name))
    return df.select(*cols)


def json_arrays(df: DataFrame, preserve_nulls: bool = False) -> DataFrame:
    """Texts that are arrays of records, one a line, of ARRAY_BYTES at most or of one record; a partition without rows is an empty one."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(not preserve_nulls).lower()}).alias("value"))
    room = ARRAY_BYTES

    def framed(batches):
        import pyarrow as pa

        whole = lambda held: pa.RecordBatch.from_arrays([pa.array(["[" + "\n,".join(held) + "\n]" if held else "[]"], pa.string())], ["value"])
        held, size, none = [], 0, True
        for b in batches:
            for x in b.column(0).to_pylist():
                more = len(x.encode()) + 2
                if held and size + more > room:
                    yield whole(held)
                    held, size = [], 0
                held.append(x)
                size, none = size + more, False
        if held or none:
            yield whole(held)

    return lines.mapInArrow(framed, "value string")


def fixed_width_line(df: DataFrame, schema: list):
    """Fields padded to their widths, at the left where justify is right, as it is for numbers unless said; a value that is too long is an error."""
    parts = []
    for f in fields_of(schema):
        text = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))
        pad = F.lpad if (f.justify or ("right" if f.type in ("int", "float", "decimal") else "left")) == "right" else F.rpad
        parts.append(F.when(F.char_length(text) <= f.width, pad(text, f.width, " ")).otherwise(F.raise_error(F.lit(f"{f.name} is over {f.width} wide")).cast("string")))
    return F.concat(*parts)


def segment_line(kind: str):
    """tag and elements as one segment with the kind's separators, escaped where the kind has an escape."""
    end, sep, comp, escape = SEGMENTS[kind]

    def guarded(x):
        for mark in [escape, end, sep] if escape else []:
            x = F.replace(x, F.lit(mark), F.lit(escape + mark))
        return x

    line = F.concat_ws(sep, F.array(F.col("tag")), F.transform("elements", guarded))
    return F.concat(line, F.lit(end if end not in "\r\n" else ""))


def dead_letter_rows(df: DataFrame, stage: str, include_reason: bool = True, include_source_row: bool = True) -> DataFrame:
    """Rows that a node set aside, with where and why: _dlq_id, _timestamp, _source_file, _stage, _trigger and, on demand, _error_category and _error_detail, then the row's own columns.

    The reason is read from the columns that dead ports carry: _error and _detail of
    programs and envelopes, _error of coercion (a field's name), _failed_rule of
    validations. Rows without any were taken along by another's failure. The id is a
    hash of stage and row, so that a task that runs again gives it again.
    """
    held = set(df.columns)
    text = lambda c: F.col(f"`{c}`").cast("string") if c in held else F.lit(None).cast("string")
    if "_failed_rule" in held:
        category, detail = F.lit("validation_failure"), F.concat(F.lit("rule "), text("_failed_rule"))
    elif "_detail" in held:
        category, detail = text("_error"), text("_detail")
    elif "_error" in held:
        category, detail = F.lit("type_coercion_failure"), F.concat(F.lit("field "), text("_error"))
    else:
        category, detail = F.lit("correlated"), F.lit(None).cast("string")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    meta = [
        F.sha2(F.concat_ws("\x1f", F.lit(stage), whole), 256).alias("_dlq_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("_dlq_timestamp"),
        F.coalesce(text("_file"), F.lit("<merged>")).alias("_dlq_source_file"),
        F.lit(stage).alias("_dlq_stage"),
        text("_failed_rule").alias("_dlq_trigger"),
    ]
    if include_reason:
        meta += [category.alias("_dlq_error_category"), detail.alias("_dlq_error_detail")]
    own = []
    for f in df.schema if include_source_row else []:
        if not f.name.startswith("_"):
            nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            own.append((F.to_json(F.col(f"`{f.name}`")) if nested else text(f.name)).alias(f.name))
    return df.select(*meta, *own)


def write_dead_letters(frames: dict[str, DataFrame], path: str, include_reason: bool = True, include_source_row: bool = True, if_exists: str = "error") -> str:
    """The dead rows of all stages as one CSV output whose source columns are all that any of them has, in order of their names."""
    parts = [dead_letter_rows(df, stage, include_reason, include_source_row) for stage, df in frames.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    meta = [c for c in out.columns if c.startswith("_dlq_")]
    path, mode = _target(out, path, if_exists)
    out.select(*meta, *[F.col(f"`{c}`") for c in sorted(set(out.columns) - set(meta))]).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def row_bytes(df: DataFrame):
    """Bytes of a row as a line of JSON, which stand for its size in any text format."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 1


def cut_by_group(df: DataFrame, group: str, max_records: int | None = None, max_bytes: int | None = None, oversize_group: str = "allow") -> DataFrame:
    """df with _part: files of whole groups in order, each closed at the first group's end at which it has max_records rows or max_bytes or more.

    oversize_group: error stops at a group that alone passes a limit; warn marks its
    rows in _oversize; allow lets it be. Rows are counted by group before anything
    is put in order. Where a file ends depends on all before it, so one task reads
    the sorted counts, a row a group, and keeps two numbers.
    """
    if max_records is None and max_bytes is None:
        raise ValueError("max_records or max_bytes")
    if oversize_group not in ("allow", "warn", "error"):
        raise ValueError(f"no oversize_group {oversize_group!r}")
    rows, room = max_records or 1 << 62, max_bytes or 1 << 62
    size = F.sum(row_bytes(df)) if max_bytes else F.lit(0).cast("long")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), size.alias("_b")).select(F.col(group).alias("_g"), "_n", "_b")

    def cut(batches):
        import pyarrow as pa

        part = held = bytes_held = 0
        for b in batches:
            parts, over = [], []
            for n, m in zip(b.column("_n").to_pylist(), b.column("_b").to_pylist(), strict=True):
                if held >= rows or bytes_held >= room:
                    part, held, bytes_held = part + 1, 0, 0
                over.append(n > rows or m > room)
                if over[-1] and oversize_group == "error":
                    raise ValueError(f"a group of {n} rows is over the limits of a file")
                parts.append(part)
                held, bytes_held = held + n, bytes_held + m
            yield pa.RecordBatch.from_arrays([b.column("_g"), pa.array(parts, pa.int32()), pa.array(over, pa.bool_())], ["_g", "_part", "_oversize"])

    kind = sizes.schema["_g"].dataType.simpleString()
    parts = sizes.orderBy("_g").coalesce(1).mapInArrow(cut, f"_g {kind}, _part int, _oversize boolean")
    if oversize_group != "warn":
        parts = parts.drop("_oversize")
    return df.join(parts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def write_sidecar(df: DataFrame, path: str, seen: dict, **more) -> str:
    """path.meta.json: what the output at path was made of and when. Written after it, so that it tells of a whole output."""
    spark = df.sparkSession
    about = {
        "output": path,
        "written_at": f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}",
        "application": spark.sparkContext.applicationId,
        "inputs": sorted(df.inputFiles()),
        "columns": {f.name: f.dataType.simpleString() for f in df.schema},
        **seen,
        **more,
    }
    jvm, target = spark.sparkContext._jvm, f"{path.rstrip('/')}.meta.json"
    where = jvm.org.apache.hadoop.fs.Path(target)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(about, indent=1), "utf-8"))
    finally:
        out.close()
    return target
