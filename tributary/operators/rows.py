"""Row-level operators: transform, route, merge, reshape, cull, validations, sorting, output projection."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.compiler import Scope, TypeFault, Value, compile_text, compile_tree, each_element, scope_of
from tributary.functions.syntax import parse_program

#: Rows that one row may become in an emit-each block.
MAX_EXPANSION = 10_000


def numbered(df: DataFrame, name: str = "_ord") -> DataFrame:
    """df with an arrival ordinal. Ids rise within and across partitions and cost no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def sort_columns(spec: list) -> list[Column]:
    """Sort keys: names, or {field, order: asc|desc, null_order: first|last|drop}; nulls last unless said otherwise."""
    out = []
    for k in spec:
        k = {"field": k} if isinstance(k, str) else k
        c, last = F.col(f"`{k['field']}`"), k.get("null_order", "last") != "first"
        desc = k.get("order", "asc") == "desc"
        out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if desc else (c.asc_nulls_last() if last else c.asc_nulls_first()))
    return out


def sort_input(df: DataFrame, spec: list) -> DataFrame:
    """Rows whose null is to be dropped by a sort key, dropped."""
    for k in spec:
        if isinstance(k, dict) and k.get("null_order") == "drop":
            df = df.where(F.col(f"`{k['field']}`").isNotNull())
    return df


def sort(df: DataFrame, spec: list, stable_by: str | None = None) -> DataFrame:
    keys = sort_columns(spec) + ([F.col(stable_by)] if stable_by else [])
    return sort_input(df, spec).orderBy(*keys)


def transform(df: DataFrame, program: str, *, variables: dict[str, Value] | None = None, functions: dict | None = None, analytic: dict | None = None, order: str | None = None, faults: bool = False) -> DataFrame:
    """Runs a program on each row: fields stay, emits add or replace, filters keep what is exactly true.

    analytic: {group_by, sort_by} for $window calls; rows with a null in group_by
    are in no partition and go (see analytic_split for keeping them aside).
    distinct keeps the first row by the column named order, or any where none is.
    emit $record.x keeps state with a row, which later programs read by that name
    and sinks leave out. faults is for transform_split.
    """
    more: dict = {"variables": variables or {}, "functions": functions or {}}
    if analytic is not None:
        df = sort_input(analytic_split(df, analytic)[0], analytic.get("sort_by", []))
        more |= {"group_by": analytic["group_by"], "sort_by": sort_columns(analytic.get("sort_by", [])) + ([F.col(order)] if order and analytic.get("sort_by") else [])}
    return _run(df, parse_program(program), more, order, faults)


def analytic_split(df: DataFrame, analytic: dict) -> tuple[DataFrame, DataFrame]:
    """Rows that have a window partition, and those with a null in its key."""
    whole = reduce(lambda a, b: a & b, [F.col(f"`{g}`").isNotNull() for g in analytic["group_by"]], F.lit(True))
    return df.where(whole), df.where(~whole)


#: What a program's faulty row carries until it is set aside.
_FAULT = "struct<category: string, detail: string, field: string>"


def transform_split(df: DataFrame, program: str, **options) -> tuple[DataFrame, DataFrame]:
    """(good, dead): transform, but a row at which the program fails goes to dead as it came, with _error, _detail and _error_field.

    Failures are strict conversions of values that don't fit, division by zero,
    overflow of whole numbers and decimals, and emit-each blocks that make over
    MAX_EXPANSION rows. Nothing that a failing row had emitted is in good, and a
    row that a filter or distinct took out before it came to the failing
    statement is in neither. Where distinct has an order, the first row counts
    that has not failed.
    """
    marked = df.withColumn("_in", F.struct(*[F.col(f"`{c}`") for c in df.columns])).withColumn("_fault", F.lit(None).cast(_FAULT))
    marked = transform(marked, program, faults=True, **options)
    good = marked.where("_fault is null").drop("_in", "_fault")
    dead = marked.where("_fault is not null").select("_in.*", F.col("_fault.category").alias("_error"), F.col("_fault.detail").alias("_detail"), F.col("_fault.field").alias("_error_field"))
    return good, dead


def _noted(faults: list, name: str) -> Column:
    """The row's fault: an earlier statement's, or the first of these."""
    made = [F.when(bad, F.struct(F.lit(category).alias("category"), detail.alias("detail"), F.lit(name).alias("field"))) for bad, category, detail in faults]
    return F.coalesce(F.col("_fault"), *made)


def _body_faults(body: list, scope: Scope) -> None:
    """Adds to scope.faults what can fail in an emit-each block, for one element."""
    for st in body:
        if st[0] in ("let", "emit"):
            v = compile_tree(st[2], scope)
            held = scope.lets if st[0] == "let" else scope.fields
            held = held | {st[1]: Value(v.col, v.type)}
            scope = replace(scope, lets=held) if st[0] == "let" else replace(scope, fields=held)
        elif st[0] == "each":
            _each_faults(st, compile_tree(st[2], scope), scope)


def _each_faults(st: tuple, v: Value, scope: Scope) -> None:
    _, var, _, outer, body = st
    if isinstance(v.type, T.NullType) or scope.faults is None:
        return
    if not isinstance(v.type, T.ArrayType):
        raise TypeFault(f"emit each needs an array, not {v.kind}")
    over = F.coalesce(F.size(v.col), F.lit(0)) > MAX_EXPANSION
    scope.faults.append((F.coalesce(over, F.lit(False)), "expansion_limit_exceeded", F.lit("an emit-each block makes too many rows")))
    items = F.when(F.size(v.col) > 0, v.col).otherwise(F.array(F.lit(None).cast(v.type.elementType))) if outer else v.col
    each_element(scope, items, lambda inner, x: _body_faults(body, inner.inner(**{var: Value(x, v.type.elementType)})))


def _run(df: DataFrame, program: list, more: dict, order: str | None, split: bool = False) -> DataFrame:
    """The program's statements in turn. With split, a row's first fault stays in its column _fault, and the row in the frame."""
    first = list(df.columns)
    lets: dict[str, Value] = {}
    whole = F.col("_fault").isNull() if split else F.lit(True)
    for st in program:
        if st[0] == "trace":
            continue
        faults: list | None = [] if split or more.get("faults") is not None else None
        scope = scope_of(df.schema, lets=dict(lets), **{**more, "faults": faults})
        if st[0] in ("let", "emit"):
            v = compile_tree(st[2], scope)
            # A let binds the value of its time: later emits must not change it.
            name = f"_let_{len(lets)}_{st[1]}" if st[0] == "let" else _column(st[1])
            df = df.withColumns({name: v.col} | ({"_fault": _noted(faults, st[1])} if split and faults else {}))
            if st[0] == "let":
                lets[st[1]] = Value(F.col(name), v.type, v.field)
        elif st[0] == "filter":
            kept = compile_tree(st[1], scope).col.cast("boolean")
            if split and faults:
                df = df.withColumns({"_kept": kept, "_fault": _noted(faults, "filter")}).where(F.col("_kept") | ~whole).drop("_kept")
            else:
                df = df.where(kept | ~whole if split else kept)
        elif st[0] == "distinct":
            keys = st[1] or [c for c in first if c not in (order, "_in", "_fault")]
            if split:
                # Rows that have failed stay, each on its own.
                df, keys = df.withColumn("_alone", F.when(~whole, F.monotonically_increasing_id())), [*keys, "_alone"]
            if order:
                w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(order)
                df = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
            else:
                df = df.dropDuplicates(keys)
            df = df.drop("_alone")
        elif st[0] == "each":
            _, var, _, outer, body = st
            v = compile_tree(st[2], scope)
            name = f"_each_{var}"
            if split:
                _each_faults(st, v, scope)
                df = df.withColumns({"_items": v.col, "_fault": _noted(faults, var)})
                array = F.when(whole, F.col("_items")).otherwise(F.array(F.lit(None).cast(v.type.elementType)))
            elif faults is not None:
                array = v.col
            else:
                fits = F.coalesce(F.size(v.col), F.lit(0)) <= MAX_EXPANSION
                array = F.when(fits, v.col).otherwise(F.raise_error(F.lit("an emit-each block makes too many rows")).cast(v.type))
            df = df.withColumn(name, (F.explode_outer if outer else F.explode)(array)).drop("_items")
            # The block's faults are already those of the row it stands in.
            df = _run(df, _bound(body, var, name), more | ({"faults": []} if split else {}), order)
    return df.drop(*[v for v in df.columns if v.startswith(("_let_", "_each_"))]) if not any(c.startswith("_each_") for c in first) else df


def _column(name: str) -> str:
    """Where an emit's value stands: state of the record is a column that sinks don't write."""
    return "_record_" + name.removeprefix("$record.") if name.startswith("$record.") else name


def _bound(tree, var: str, name: str):
    """The tree with a variable renamed."""
    if tree == ("name", var):
        return ("name", name)
    if isinstance(tree, tuple):
        return tuple(_bound(x, var, name) for x in tree)
    return [_bound(x, var, name) for x in tree] if isinstance(tree, list) else tree


def predicate(df: DataFrame, text: str) -> Column:
    return compile_text(text, scope_of(df.schema)).col


def route(df: DataFrame, conditions: dict[str, str], default: str = "default", mode: str = "exclusive") -> dict[str, DataFrame]:
    """Branches of rows: the first true condition's (exclusive) or every true one's (inclusive); default takes the rest."""
    if len(conditions) > 256:
        raise ValueError("more than 256 branches")
    tests = {k: F.coalesce(predicate(df, c), F.lit(False)) for k, c in conditions.items()}
    if mode == "inclusive":
        out = {k: df.where(t) for k, t in tests.items()}
        out[default] = df.where(~reduce(lambda a, b: a | b, tests.values(), F.lit(False)))
        return out
    label = reduce(lambda acc, kv: acc.when(kv[1], F.lit(kv[0])), tests.items(), F).otherwise(F.lit(default))
    marked = df.withColumn("_branch", label)
    return {k: marked.where(F.col("_branch") == k).drop("_branch") for k in [*tests, default]}


def merge(frames: list[DataFrame], mode: str = "concat", seed: int | None = None) -> DataFrame:
    """All rows of all inputs. A frame has no order, so interleave, with or without a seed, is concat: what sets an order is a sink's sort_order."""
    if mode not in ("concat", "interleave"):
        raise ValueError(f"no mode {mode!r}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def _folded(c: str, df: DataFrame) -> Column:
    """A partition key in which null, the empty string and NaN are one group."""
    kind = dict(df.dtypes)[c]
    x = F.col(f"`{c}`")
    if kind in ("double", "float"):
        return F.when(~F.isnan(x), x.cast("string"))
    return F.when(x.cast("string") != "", x.cast("string"))


def reshape(df: DataFrame, partition_by: list[str], rules: list[dict]) -> DataFrame:
    """Rules on the rows as they came: mutate sets fields of rows that match, synthesize adds rows.

    A rule: {name, when, mutate: {field: expr}, synthesize: {copy_from: trigger|none,
    overrides: {field: expr}}}. Adds _synthetic, _synthesized_by and _mutated_by.
    Two rules that set one field of one row are a fault of its whole group, which
    goes; reshape_split gives those rows too.
    """
    return reshape_split(df, partition_by, rules)[0]


def reshape_split(df: DataFrame, partition_by: list[str], rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(reshaped, rejected): rejected are the rows, as they came, of groups in which two rules set one field of one row."""
    tests = {r["name"]: F.coalesce(predicate(df, r["when"]), F.lit(False)) for r in rules}
    setters: dict[str, list[tuple[str, Column]]] = {}
    for r in rules:
        for field, e in r.get("mutate", {}).items():
            setters.setdefault(field, []).append((r["name"], compile_text(e, scope_of(df.schema)).col))
    fault = reduce(lambda a, b: a | b, [sum((tests[n].cast("int") for n, _ in s), F.lit(0)) > 1 for s in setters.values() if len(s) > 1], F.lit(False))
    rejected = df.where(F.lit(False))
    if any(len(s) > 1 for s in setters.values()):
        if partition_by:
            keys = [_folded(c, df).alias(f"_f_{c}") for c in partition_by]
            bad = df.where(fault).select(*keys).distinct()
            on = reduce(lambda a, b: a & b, [_folded(c, df).eqNullSafe(bad[f"_f_{c}"]) for c in partition_by])
            df, rejected = df.join(bad, on, "left_anti"), df.join(bad, on, "left_semi")
        else:
            df, rejected = df.where(~fault), df.where(fault)
    new = {f: reduce(lambda acc, s: F.when(tests[s[0]], s[1].cast(dict(df.dtypes).get(f, "string"))).otherwise(acc), pairs, F.col(f"`{f}`") if f in df.columns else F.lit(None)) for f, pairs in setters.items()}
    by = F.concat_ws(",", *[F.when(tests[r["name"]], F.lit(r["name"])) for r in rules if r.get("mutate")]) if any(r.get("mutate") for r in rules) else F.lit("")
    stamped = lambda synthetic, who, mutated: {"_synthetic": F.lit(synthetic), "_synthesized_by": who, "_mutated_by": mutated}
    out = df.withColumns(new | stamped(False, F.lit(None).cast("string"), F.when(by != "", by)))
    for r in rules:
        if "synthesize" not in r:
            continue
        s = r["synthesize"]
        base = df.where(tests[r["name"]])
        keep = set(partition_by) if s.get("copy_from", "trigger") == "none" else set(df.columns)
        cols = {f: compile_text(e, scope_of(df.schema)).col for f, e in s.get("overrides", {}).items()}
        row = [(cols[c].cast(df.schema[c].dataType) if c in cols else F.col(f"`{c}`") if c in keep else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns]
        made = base.select(*row).withColumns(stamped(True, F.lit(r["name"]), F.lit(None).cast("string")))
        out = out.unionByName(made)
    return out, rejected


def cull(df: DataFrame, partition_by: list[str], drop_when: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): whole groups go for which any of the aggregate predicates is true; a null predicate keeps."""
    scope = scope_of(df.schema, aggregate=True)
    bad = [F.coalesce(compile_text(p, scope).col, F.lit(False)) for p in drop_when]
    keys = [F.col(f"`{c}`") for c in partition_by]
    groups = df.groupBy(*keys).agg(reduce(lambda a, b: a | b, bad).alias("_gone")).where("_gone")
    named = groups.select(*[F.col(f"`{c}`").alias(f"_k_{c}") for c in partition_by])
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(named[f"_k_{c}"]) for c in partition_by])
    return df.join(named, on, "left_anti"), df.join(named, on, "left_semi")


def validate(df: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(passed, failed): the first rule {name, check, severity} that isn't true fails a row; warn rules only add to _warnings."""
    checks = [(r["name"], r.get("severity", "error"), F.coalesce(predicate(df, r["check"]), F.lit(False))) for r in rules]
    errors, warns = [c for c in checks if c[1] == "error"], [c for c in checks if c[1] == "warn"]
    failed = reduce(lambda acc, c: acc.when(~c[2], F.lit(c[0])), errors, F).otherwise(F.lit(None)) if errors else F.lit(None).cast("string")
    marked = df.withColumn("_failed_rule", failed).withColumn("_warnings", F.array_compact(F.array(*[F.when(~c[2], F.lit(c[0])) for c in warns])) if warns else F.array().cast("array<string>"))
    return marked.where("_failed_rule is null").drop("_failed_rule"), marked.where("_failed_rule is not null")


def dead_letter(df: DataFrame, failed: Column, group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, dead): rows that fail, or with group (a correlation key, or a document) all rows of a group that has one.

    A row with a null in its key has no peers: it goes by itself. Keys of failed
    groups are made distinct before the shuffle and joined, so no task gathers a group.
    """
    marked = df.withColumn("_fails", F.coalesce(failed, F.lit(False)))
    if group:
        keys = marked.where("_fails").select(*[F.col(f"`{g}`").alias(f"_g_{g}") for g in group]).distinct()
        on = reduce(lambda a, b: a & b, [F.col(f"`{g}`") == F.col(f"`_g_{g}`") for g in group])
        marked = marked.join(keys.withColumn("_hit", F.lit(True)), on, "left").withColumn("_fails", F.col("_fails") | F.coalesce("_hit", F.lit(False)))
    cols = [F.col(f"`{c}`") for c in df.columns]
    return marked.where("not _fails").select(*cols), marked.where("_fails").select(*cols)


def project(df: DataFrame, mapping: dict[str, str] | None = None, exclude: list[str] | None = None, include_unmapped: bool = True) -> DataFrame:
    """Output columns: mapping (field -> name, in order), then the rest unless told otherwise, less exclude."""
    mapping, exclude = mapping or {}, set(exclude or [])
    cols = [F.col(f"`{c}`").alias(n) for c, n in mapping.items() if c not in exclude]
    if include_unmapped:
        cols += [F.col(f"`{c}`") for c in df.columns if c not in mapping and c not in exclude and not c.startswith("_")]
    return df.select(*cols)


def scale_decimals(df: DataFrame, scales: dict[str, int]) -> DataFrame:
    """Decimals at a declared scale, halves to even."""
    return df.withColumns({c: F.bround(F.col(f"`{c}`"), n).cast(f"decimal(38,{n})") for c, n in scales.items()})


def split_to_rows(df: DataFrame, field: str, keep_empty: bool = True, position: str | None = None, sep: str | None = None) -> DataFrame:
    """One row for each element of a repeated (or separated) field; positions count from 1."""
    c = F.col(f"`{field}`")
    array = F.split(c, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")), -1) if sep else c
    others = [F.col(f"`{x}`") for x in df.columns if x != field]
    out = df.select(*others, (F.posexplode_outer if keep_empty else F.posexplode)(array).alias("_pos", field))
    cols = [F.col(f"`{x}`") for x in df.columns] + ([(F.col("_pos") + 1).cast("long").alias(position)] if position else [])
    return out.select(*cols)


def join_values(df: DataFrame, field: str, sep: str = ";", on_conflict: str = "error") -> DataFrame:
    """An array as one delimited cell.

    on_conflict: error (where an element holds the delimiter), escape (a backslash
    before each delimiter and backslash) or encode_json (every cell is JSON).
    """
    c = F.col(f"`{field}`")
    if on_conflict == "encode_json":
        return df.withColumn(field, F.to_json(c))
    if on_conflict == "escape":
        return df.withColumn(field, F.array_join(F.transform(c, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(sep), F.lit("\\" + sep))), sep))
    clash = F.exists(c, lambda x: F.contains(x, F.lit(sep)))
    stop = F.raise_error(F.lit(f"a value of {field} holds {sep!r}")).cast("string")
    return df.withColumn(field, F.when(clash, stop).otherwise(F.array_join(c, sep)))
