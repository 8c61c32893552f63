"""Aggregation, and event-time windows over finite input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.compiler import Scope, Value, compile_tree, scope_of
from tributary.functions.syntax import parse_program

_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def micros(duration: str) -> int:
    for unit in ("ms", "s", "m", "h", "d"):
        if duration.endswith(unit) and duration[: -len(unit)].isdigit():
            return int(duration[: -len(unit)]) * _UNITS[unit]
    raise ValueError(f"no duration: {duration!r}")


def aggregate(df: DataFrame, group_by: list[str], program: str, order: str | None = None, hidden: list[str] | None = None) -> DataFrame:
    """One row per group: the group's fields, then the emits. Filters and lets before them are row-wise; no group_by makes one row always."""
    lets: dict[str, Value] = {}
    emits: dict[str, Column] = {}
    for st in parse_program(program):
        scope = scope_of(df.schema, lets=dict(lets))
        if st[0] == "filter":
            df = df.where(compile_tree(st[1], scope).col)
        elif st[0] == "let":
            lets[st[1]] = compile_tree(st[2], scope)
        elif st[0] == "emit":
            s = Scope(scope.fields, dict(lets), aggregate=True, order=F.col(order) if order else None)
            if st[2][0] == "name" and st[2][1] in group_by:
                emits[st[1]] = F.first(F.col(f"`{st[2][1]}`"))
            else:
                emits[st[1]] = compile_tree(st[2], s).col
        else:
            raise ValueError(f"{st[0]} has no place in an aggregate")
    keys = [F.col(f"`{g}`") for g in [*group_by, *(hidden or [])]]
    out = df.groupBy(*keys).agg(*[c.alias(f"_e_{n}") for n, c in emits.items()])
    return out.select(*[F.col(f"`{c}`") for c in [*group_by, *(hidden or [])] if c not in emits], *[F.col(f"`_e_{n}`").alias(n) for n in emits])


def start_of(ts: Column, size: int, offset: int = 0) -> Column:
    """Start, in microseconds, of the window of that size that holds ts; windows align with the epoch, before it too."""
    t = F.unix_micros(ts.cast("timestamp"))
    return t - F.pmod(t - F.lit(offset), F.lit(size))


def windowed(df: DataFrame, event_time: str, window: dict, keys: list[str]) -> DataFrame:
    """df with _start (microseconds): one row per window that a row falls into. Rows without a time go.

    window: {tumbling: size} | {hopping: [size, slide]} | {session: gap}. A hop
    longer than its window leaves gaps; a session goes on while the next event is at
    most gap after the last.
    """
    df = df.where(F.col(f"`{event_time}`").isNotNull())
    t = F.unix_micros(F.col(f"`{event_time}`").cast("timestamp"))
    ((kind, spec),) = window.items()
    if kind == "tumbling":
        return df.withColumn("_start", start_of(F.col(f"`{event_time}`"), micros(spec)))
    if kind == "hopping":
        size, slide = map(micros, spec)
        last = F.floor(t / slide).cast("long")
        first = F.floor((t - size) / slide).cast("long") + 1
        starts = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * slide))
        return df.withColumn("_start", F.explode(starts))
    gap = micros(spec)
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(t)
    fresh = (t - F.lag(t).over(w) > gap) | F.lag(t).over(w).isNull()
    df = df.withColumn("_fresh", F.when(fresh, t))
    return df.withColumn("_start", F.last("_fresh", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def time_window(
    df: DataFrame, event_time: str, window: dict, group_by: list[str], program: str, bounds: bool = False, watermark: dict | None = None
) -> DataFrame:
    """An aggregate for every window and group. The window's start is not part of the output unless bounds ask for it.

    watermark: {order, source, delay, allowed_lateness} splits off rows whose window
    had closed when they arrived; see late_rows, which gives them.
    """
    rows = windowed(df, event_time, window, group_by)
    if watermark:
        rows = _closed(rows, event_time, window, watermark, group_by).where("not _late").drop("_late")
    if "session" in window and not group_by:
        rows = rows.withColumn("_all", F.lit(0))
    out = aggregate(rows, group_by, program, hidden=["_start"])
    cols = [c for c in out.columns if c != "_start"]
    return out.select(*([F.timestamp_micros("_start").cast("timestamp_ntz").alias("window_start")] if bounds else []), *[F.col(f"`{c}`") for c in cols])


def _closed(rows: DataFrame, event_time: str, window: dict, mark: dict, keys: list[str]) -> DataFrame:
    """rows with _late: their window's end, and the lateness allowed, lie at or before the watermark of all rows that came before.

    A session ends a gap after its last row.

    The watermark is the least, over sources, of the greatest time seen less
    delay. Running maxima per source need arrival order, so this sorts by it; on
    a large input give order a partition key by setting shard to a column whose
    values have watermarks of their own.
    """
    t = F.unix_micros(F.col(f"`{event_time}`").cast("timestamp"))
    ((kind, spec),) = window.items()
    size = micros(spec if kind != "hopping" else spec[0])
    by = [F.col(mark["shard"])] if mark.get("shard") else [F.lit(0)]
    w = Window.partitionBy(*by).orderBy(mark["order"]).rowsBetween(Window.unboundedPreceding, -1)
    sources = mark.get("sources")
    if sources:
        maxima = [F.max(F.when(F.col(mark["source"]) == s, t)).over(w) for s in sources]
        seen = reduce(lambda a, b: a & b, [m.isNotNull() for m in maxima])
        level = F.when(seen, F.least(*maxima) if len(maxima) > 1 else maxima[0])
    else:
        level = F.max(t).over(w)
    level = level - micros(mark.get("delay", "0s"))
    end = F.col("_start") + size if kind != "session" else F.max(t).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_start")) + size
    late = F.coalesce(end + micros(mark.get("allowed_lateness", "0s")) <= level, F.lit(False))
    return rows.withColumn("_late", late)


def late_rows(df: DataFrame, event_time: str, window: dict, watermark: dict, group_by: list[str] | None = None) -> DataFrame:
    keys = group_by or []
    return _closed(windowed(df, event_time, window, keys), event_time, window, watermark, keys).where("_late").drop("_late", "_start")


def cross_source(df: DataFrame, source: DataFrame, on: dict[str, str], program: str) -> DataFrame:
    """df with aggregates of another source's rows whose key matches, {df field: source field}; null where none does.

    The source is aggregated by its key first, so the join never multiplies.
    """
    keys = list(on.values())
    totals = aggregate(source.where(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])), keys, program)
    totals = totals.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(f"`_on_{b}`") for a, b in on.items()])
    return df.join(totals, cond, "left").drop(*[f"_on_{k}" for k in keys])


def envelope_footer(df: DataFrame, grain: list[str], totals: dict[str, str]) -> DataFrame:
    """One footer row per document: {name: aggregate expression} over its rows."""
    return aggregate(df, grain, "\n".join(f"emit {n} = {e}" for n, e in totals.items()))


def with_header(df: DataFrame, header: DataFrame, grain: list[str]) -> DataFrame:
    """Body rows with their document's header fields. Headers are one row a document, so the join never multiplies."""
    return df.join(header.dropDuplicates(grain), grain, "left")
