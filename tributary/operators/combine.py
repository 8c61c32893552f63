"""Joins: a driver input against others, by equalities, ranges and what is left of a predicate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.compiler import Scope, Value, compile_tree
from tributary.functions.syntax import parse_expression, parse_program

#: Bins of a join on a single inequality.
STEPS = 32
#: Range ends beyond this are taken as this where bins are chosen; the predicate itself decides.
FAR = 1e300
#: Spans of a bin that share an array, shares that the points of a bin are dealt to, and tasks for pairs at least, since small inputs make many.
PACK, SHARES, TASKS = 4096, 8, 96
#: Levels by which the ends of a span are cut finer where one match is enough.
DEPTH = 4


def _side(df: DataFrame, name: str) -> tuple[DataFrame, dict[str, Value]]:
    """df with columns prefixed by their input's name, and what the name's fields mean."""
    out = df.select(*[F.col(f"`{c}`").alias(f"{name}__{c}") for c in df.columns])
    return out, {c: Value(F.col(f"`{name}__{c}`"), df.schema[c].dataType, c) for c in df.columns if c != "_ord"}


def conjuncts(tree: tuple) -> list[tuple]:
    return conjuncts(tree[2]) + conjuncts(tree[3]) if tree[:2] == ("binary", "and") else [tree]


def _inputs_of(tree) -> set[str]:
    if isinstance(tree, tuple):
        if len(tree) == 3 and tree[0] == "field" and tree[1][0] == "name":
            return {tree[1][1]}
        return set().union(*[_inputs_of(x) for x in tree]) if tree else set()
    return set().union(*[_inputs_of(x) for x in tree]) if isinstance(tree, list) and tree else set()


def _words(tree) -> set[str]:
    """All names in a tree, and what else is text there."""
    if isinstance(tree, str):
        return {tree}
    return set().union(*[_words(x) for x in tree]) if isinstance(tree, (tuple, list)) else set()


def _used(df: DataFrame, name: str, words: set[str]) -> DataFrame:
    """df, prefixed by _side, without columns that no program names, so that rows stay small where they are keys or copies."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c[len(name) + 2 :] in words or c.startswith(f"{name}___")])


@dataclass
class Predicate:
    """What a join asks for. Keys compare with =: null never matches."""

    whole: Column
    #: (driver side, build side) of equalities between them.
    equal: list[tuple[Value, Value]] = field(default_factory=list)
    #: Conditions on the build side alone.
    own: list[Column] = field(default_factory=list)
    #: (below, above) of inequalities: first those with the driver's value below, then those with the build's.
    rising: list[tuple[tuple, tuple]] = field(default_factory=list)
    falling: list[tuple[tuple, tuple]] = field(default_factory=list)
    #: Whether equalities and own conditions are all.
    pure: bool = True
    #: Whether equalities, inequalities and own conditions are all.
    plain: bool = True
    #: Its names.
    words: set[str] = field(default_factory=set)


def predicate(tree: tuple, scope: Scope, build: str) -> Predicate:
    parts, out = [], Predicate(F.lit(True), words=_words(tree))
    for c in conjuncts(tree):
        sides = [_inputs_of(x) for x in c[2:4]] if c[0] == "binary" and len(c) == 4 else []
        apart = len(sides) == 2 and all(sides) and (sides[0] == {build}) != (sides[1] == {build}) and build not in (sides[0] & sides[1])
        apart = apart and (build not in sides[0] or sides[0] == {build}) and (build not in sides[1] or sides[1] == {build})
        if apart and c[1] == "==":
            a, b = (compile_tree(x, scope) for x in c[2:4])
            out.equal.append((b, a) if sides[0] == {build} else (a, b))
            parts.append(a.col == b.col)
            continue
        parts.append(compile_tree(c, scope).col)
        if _inputs_of(c) == {build}:
            out.own.append(parts[-1])
            continue
        out.pure = False
        if apart and c[1] in ("<", "<=", ">", ">="):
            low, high = (c[2], c[3]) if c[1][0] == "<" else (c[3], c[2])
            (out.falling if _inputs_of(low) == {build} else out.rising).append((low, high))
        else:
            out.plain = False
    out.whole = reduce(lambda a, b: a & b, parts)
    return out


def _number(v: Value) -> Column | None:
    """A value as a double that rises with it, for choosing bins; null for NaN, which no inequality takes."""
    if isinstance(v.type, T.NumericType):
        x = F.nullif(v.col.cast("double"), F.lit(float("nan")))
    elif isinstance(v.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(v.col.cast("timestamp")).cast("double")
    else:
        return None
    return F.greatest(F.least(x, F.lit(FAR)), F.lit(-FAR))


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def _leveled(spans: DataFrame, low: Column, high: Column) -> DataFrame:
    """spans that hold anything, with _span_level: bins 2 ** level wide, a power of four, are an eighth to half of the span, but no finer than doubles of its size can tell."""
    size = F.greatest(high - low, F.lit(2.0**-30), F.abs(low) * 2.0**-36, F.abs(high) * 2.0**-36)
    level = F.floor(F.log2(size)).cast("int") - 1
    return spans.where(low <= high).withColumn("_span_level", level - F.pmod(level, F.lit(2)))


def _share(df: DataFrame, shares: Column) -> Column:
    """A share for a row by its columns, so that another run of its task deals it out the same way."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*plain), shares.cast("long"))


def _met(points: DataFrame, x: Column, spans: DataFrame, low: Column, high: Column, cond: Column, hit: str | None = None) -> DataFrame:
    """points joined with spans where low <= x <= high, as far as bins tell, and cond.

    A span is in every bin of its level that it touches, nine at most; a point is
    looked up once for each level in use. Spans of a bin are packed into arrays,
    which the join carries and unpacks as rows go by: no pair is sorted or shuffled.
    Points of a bin are dealt to shares, each with the bin's arrays. With hit (a
    column of points), the points where it is false come out once, without a span.
    """
    theirs, mine = spans.columns, [F.col(f"`{c}`") for c in points.columns]
    spans = _leveled(spans, low, high)
    known = spans.agg(F.struct(F.collect_set("_span_level").alias("levels"), F.count(F.lit(1)).alias("n"))).scalar()
    spans = spans.withColumn("_part", _share(spans, 1 + F.floor(known["n"] / PACK)))
    spans = spans.withColumn("_span_bin", F.explode(F.sequence(_bin(low, F.col("_span_level")), _bin(high, F.col("_span_level")))))
    packed = spans.groupBy("_span_level", "_span_bin", "_part").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in theirs])).alias("_held"))
    packed = packed.withColumn("_span_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))).drop("_part")
    levels = known["levels"] if hit is None else F.when(F.col(hit), known["levels"]).otherwise(F.array(F.lit(None).cast("int")))
    points = points.withColumn("_share", _share(points, F.lit(SHARES))).withColumn("_level", F.explode(levels)).withColumn("_bin", _bin(x, F.col("_level")))
    # Counts that are set are kept, while adaptive execution would put little input, however many its pairs, into one task.
    tasks = max(TASKS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points, packed = points.repartition(tasks, "_level", "_bin", "_share"), packed.repartition(tasks, "_span_level", "_span_bin", "_span_share")
    on = (F.col("_level") == F.col("_span_level")) & (F.col("_bin") == F.col("_span_bin")) & (F.col("_share") == F.col("_span_share"))
    if hit is None:
        met = points.join(packed, on).select(*mine, F.explode("_held").alias("_span"))
    else:
        met = points.join(packed, on, "left").where(F.col("_held").isNotNull() | ~F.col(hit)).select(*mine, F.explode_outer("_held").alias("_span"))
        cond = cond | ~F.col(hit)
    return met.select(*mine, *[F.col("_span").getField(c).alias(c) for c in theirs]).where(cond)


def _least(points: DataFrame, x: Column, spans: DataFrame, ends: tuple[Value, Value], cond: Column, place: Column, outer: bool) -> DataFrame:
    """points, each with _row: the span of least place (a struct o, r) among those that hold it; with outer, null where none does. Several rows a point, of which the least counts.

    No pair is formed. A span is cut into bins that lie whole inside it, ever finer
    towards its ends, of which each keeps the least of its spans; only bins that
    still hold an end keep a row for every pair of ends, on which cond decides.
    Rows grow with points and spans, whatever the number of matches.
    """
    low, high = map(_number, ends)
    row = F.struct(place.alias("o"), F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("r"))
    spans = _leveled(spans, low, high)
    level = lambda j: F.col("_span_level") - 2 * j
    first, last = ([_bin(x, level(j)) for j in range(DEPTH + 1)] for x in (low, high))
    bins = "array<struct<l:int,b:bigint,whole:boolean>>"

    def run(j: int, start: Column, end: Column, whole: bool = True) -> Column:
        made = F.transform(F.sequence(start, end), lambda k: F.struct(level(j).alias("l"), k.alias("b"), F.lit(whole).alias("whole")).cast(bins[6:-1]))
        return F.when(start <= end, made).otherwise(F.array().cast(bins))

    cut = [run(0, first[0] + 1, last[0] - 1)]
    for j in range(1, DEPTH + 1):
        cut += [run(j, first[j] + 1, first[j - 1] * 4 + 3), run(j, last[j - 1] * 4, last[j] - 1)]
    cut += [run(DEPTH, first[DEPTH], first[DEPTH], False), run(DEPTH, last[DEPTH], last[DEPTH], False)]
    cut = F.when(first[0] == last[0], run(0, first[0], first[0], False)).otherwise(F.flatten(F.array(*cut)))
    levels = spans.agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(level(DEPTH), level(0), F.lit(2)))))).scalar()
    nodes = spans.withColumn("_cut", F.explode(cut))
    keys = [F.col("_cut.l").alias("_span_level"), F.col("_cut.b").alias("_span_bin"), F.col("_cut.whole").alias("_whole")]
    keys += [F.when(~F.col("_cut.whole"), v.col).alias(f"_end{i}") for i, v in enumerate(ends)]
    nodes = nodes.select(*keys, row.alias("_row")).groupBy("_span_level", "_span_bin", "_whole", "_end0", "_end1").agg(F.min_by("_row", "_row.o").alias("_row"))
    mine = [F.col(f"`{c}`") for c in points.columns]
    theirs = [F.col("_row")["r"][c].alias(c) for c in spans.columns if c != "_span_level"]
    nodes = nodes.select("_span_level", "_span_bin", "_whole", "_row", *theirs)
    held = points.withColumn("_level", F.explode(F.concat(F.when(x.isNotNull(), levels).otherwise(F.array().cast("array<int>")), F.array(F.lit(None).cast("int"))) if outer else levels))
    on = (F.col("_level") == F.col("_span_level")) & (_bin(x, F.col("_level")) == F.col("_span_bin")) & (F.col("_whole") | cond)
    if not outer:
        return held.join(nodes, on).select(*mine, "_row")
    return held.join(nodes, on, "left").where(F.col("_row").isNotNull() | F.col("_level").isNull()).select(*mine, "_row")


def _held_by(p: Predicate, scope: Scope) -> tuple[Value, Value, Value] | None:
    """The driver's value and the build side's ends, where a join asks for nothing but that the one lies between the others."""
    if p.equal or not p.plain or len(p.rising) != 1 or len(p.falling) != 1 or p.rising[0][0] != p.falling[0][1]:
        return None
    found = tuple(compile_tree(tree, scope) for tree in (p.rising[0][0], p.falling[0][0], p.rising[0][1]))
    return found if all(_number(v) is not None for v in found) else None


def _own(build: DataFrame, p: Predicate) -> DataFrame:
    return build.where(reduce(lambda a, b: a & b, p.own)) if p.own else build


def _pairs(out: DataFrame, build: DataFrame, p: Predicate, scope: Scope) -> DataFrame:
    """Matching pairs. Where no equality is there to join on, bins of the first inequalities make one."""
    number = lambda tree: _number(compile_tree(tree, scope))
    if not p.equal and p.rising and p.falling:
        (a, b), (c, d) = p.rising[0], p.falling[0]
        x, y, u, v = map(number, (a, b, c, d))
        if all(n is not None for n in (x, y, u, v)):
            if a == d:
                return _met(out, x, build, u, y, p.whole)
            if b == c:
                return _met(build, y, out, x, v, p.whole)
            # Driver x..v, build u..y: either starts inside the other, and never both ways at once.
            one, two = _met(build, u, out, x, v, p.whole & (u >= x)), _met(out, x, build, u, y, p.whole & (u < x))
            return one.unionByName(two)
    if not p.equal and (p.rising or p.falling):
        rising = bool(p.rising)
        low, high = (p.rising or p.falling)[0]
        mine, theirs = (number(low), number(high)) if rising else (number(high), number(low))
        if mine is not None and theirs is not None:
            # Build rows stand at every step that they may match, driver rows at one.
            edges = build.agg(F.percentile_approx(theirs, [k / STEPS for k in range(1, STEPS)], 1000).alias("_edges")).scalar()
            step = lambda n: F.size(F.filter("_edges", lambda e: e < n))
            steps = F.sequence(F.lit(0), step(theirs)) if rising else F.sequence(step(theirs), F.lit(STEPS - 1))
            left = out.where(mine.isNotNull()).withColumn("_edges", edges).withColumn("_step", step(mine)).drop("_edges")
            right = build.where(theirs.isNotNull()).withColumn("_edges", edges).withColumn("_build_step", F.explode(steps)).drop("_edges")
            return left.join(right, (F.col("_step") == F.col("_build_step")) & p.whole).drop("_step", "_build_step")
    return out.join(build, p.whole)


def _keys(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """What to group rows by that are equal in all columns, and aggregates for the columns that can't be keys: maps, which go by their entries."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    keys = [F.col(f"`{c}`") for c in df.columns if c not in maps] + [F.array_sort(F.map_entries(F.col(f"`{c}`"))).alias(f"_m_{c}") for c in maps]
    return keys, [F.first(F.col(f"`{c}`")).alias(c) for c in maps]


def _counted(df: DataFrame) -> DataFrame:
    """df with equal rows as one, and _n, their number."""
    keys, more = _keys(df)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *more).select(*[F.col(f"`{c}`") for c in df.columns], "_n")


def _repeated(df: DataFrame) -> DataFrame:
    """Each row _n times, without _n."""
    return df.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n", "_each")


def band_join(left: DataFrame, right: DataFrame, point: Column, low: Column, high: Column, width: float, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """left x right where low <= point < high, without comparing all pairs.

    Ranges are dealt to every bin of the given width that they touch, points to
    theirs; the join is an equality on bins, which AQE can split where a bin is
    hot. Choose the width near the typical range; combine() chooses widths itself.
    """
    bins = F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))
    dealt = right.where(low.isNotNull() & high.isNotNull() & (low < high)).withColumn("_bin", F.explode(bins))
    points = left.withColumn("_point_bin", F.floor(point / width).cast("long"))
    cond = (F.col("_point_bin") == F.col("_bin")) & (point >= low) & (point < high)
    return points.join(dealt, cond if extra is None else cond & extra, how).drop("_bin", "_point_bin")


def _missing(name: str, kind: T.DataType) -> Column:
    return F.raise_error(F.lit(f"no match in {name}")).cast(kind)


def _all(out: DataFrame, build: DataFrame, p: Predicate, scope: Scope, name: str, on_miss: str) -> DataFrame:
    """Every match. What finds none among ranges is told from the matched driver rows, equal ones counted as one meanwhile."""
    if on_miss == "skip":
        return _pairs(out, build, p, scope)
    if p.equal or not (p.rising or p.falling):
        joined = out.join(build.withColumn("_hit", F.lit(True)), p.whole, "left")
        if on_miss == "error":
            joined = joined.where(F.coalesce("_hit", _missing(name, T.BooleanType())))
        return joined.drop("_hit")
    held = _counted(out)
    if point := _held_by(p, scope):
        x, *ends = point
        found = _least(held, _number(x), _own(_used(build, name, p.words), p), tuple(ends), p.whole, F.lit(0), True)
        keys, more = _keys(out)
        found = found.groupBy(*keys).agg(F.first("_n").alias("_n"), F.max(F.col("_row").isNotNull()).alias("_hit"), *more)
        if on_miss == "error":
            found = found.where(F.when(F.col("_hit"), True).otherwise(_missing(name, T.BooleanType())))
        found = _repeated(found.select(*[F.col(f"`{c}`") for c in out.columns], "_hit", "_n"))
        return _met(found, _number(x), _own(build, p), _number(ends[0]), _number(ends[1]), p.whole, "_hit").drop("_hit")
    pairs = _pairs(held, build, p, scope)
    matched = pairs.select(*[F.col(f"`{c}`").alias(f"_d_{c}") for c in out.columns]).distinct()
    missed = held.join(matched, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_d_{c}`")) for c in out.columns]), "left_anti")
    if on_miss == "error":
        missed = missed.where(_missing(name, T.BooleanType()))
    return _repeated(pairs.unionByName(missed, allowMissingColumns=True))


def _picked(out: DataFrame, build: DataFrame, p: Predicate, scope: Scope, name: str, match: str, on_miss: str, hint: str | None) -> DataFrame:
    """out with _r: the first match (a struct of the build row), or all of them in order (an array of structs o, r); null where there is none.

    By equalities alone, matches depend on the build side's key only, so they are
    picked for each key before the join. Otherwise pairs are grouped by the driver
    row itself: equal driver rows have equal matches and are one row, with a
    count, meanwhile. No row goes by a generated id, which another run of its task
    could deal out differently. With equalities pairs and misses come out of one join,
    since a driver planned twice need not be the same twice: a mean of doubles follows
    the order in which its parts come in.
    """
    ord_col = f"{name}___ord"
    place = F.col(f"`{ord_col}`") if ord_col in build.columns else F.xxhash64(*[F.col(f"`{c}`") for c in build.columns])
    row = F.struct(place.alias("o"), F.struct(*[F.col(f"`{c}`") for c in build.columns]).alias("r"))
    pick = lambda x: F.min_by(x["r"], x["o"]) if match == "first" else F.array_sort(F.collect_list(x))
    if p.pure and p.equal and all(a.type == b.type for a, b in p.equal):
        held = build.where(reduce(lambda a, b: a & b, [b.col.isNotNull() for _, b in p.equal] + p.own))
        keyed = held.groupBy(*[b.col.alias(f"_k{i}") for i, (_, b) in enumerate(p.equal)]).agg(pick(row).alias("_r"))
        on = reduce(lambda a, b: a & b, [a.col == F.col(f"_k{i}") for i, (a, _) in enumerate(p.equal)])
        return out.join(keyed.hint(hint) if hint else keyed, on, "inner" if on_miss == "skip" else "left").select(*[F.col(f"`{c}`") for c in out.columns], "_r")
    held = _counted(out)
    build = build.hint(hint) if hint else build
    point = _held_by(p, scope) if match == "first" else None
    if point:
        x, *ends = point
        pairs = _least(held, _number(x), _own(build, p), tuple(ends), p.whole, place, on_miss != "skip")
    elif p.equal or not (p.rising or p.falling):
        pairs = held.join(build.withColumn("_row", row), p.whole, "inner" if on_miss == "skip" else "left").select(*[F.col(f"`{c}`") for c in held.columns], "_row")
    else:
        pairs = _pairs(held, build, p, scope).select(*[F.col(f"`{c}`") for c in held.columns], row.alias("_row"))
        if on_miss != "skip":
            pairs = pairs.unionByName(held.withColumn("_row", F.lit(None).cast(pairs.schema["_row"].dataType)))
    keys, more = _keys(out)
    found = pairs.groupBy(*keys).agg(F.first("_n").alias("_n"), pick(F.col("_row")).alias("_r"), F.max(F.col("_row").isNotNull()).alias("_some"), *more)
    return _repeated(found.select(*[F.col(f"`{c}`") for c in out.columns], F.when(F.col("_some"), F.col("_r")).alias("_r"), "_n"))


def combine(
    inputs: dict[str, DataFrame],
    where: str | dict[str, str],
    body: str,
    match: str = "first",
    on_miss: str = "null_fields",
    drive: str | None = None,
    hint: str | None = None,
    max_output_rows: int | None = None,
    max_collected: int | None = None,
) -> DataFrame:
    """Joins every other input to the driver in turn and runs the body; the output is what the body emits.

    match: first (the matching build row of least _ord, or of least hash where the
    input carries no _ord), all, or collect (an array of matches in that order, named
    after the input; over max_collected of them is an error, not a cut, and None
    sets no bound). on_miss: null_fields (null columns, or an empty array), skip
    (the driver row goes), or error. Everything in where belongs to matching; a
    filter in the body drops rows afterwards and never re-matches.

    Repeated driver rows are rows of their own. Null keys match nothing. An
    empty build side misses everywhere. A range join (inequalities and no
    equality) goes by bins that the data set; see _pairs.
    """
    names = list(inputs)
    driver = drive or names[0]
    if len(names) > 8:
        raise ValueError("at most eight inputs")
    words = _words([parse_expression(w) for w in ([where] if isinstance(where, str) else where.values())]) | _words(parse_program(body))
    out, fields = _side(inputs[driver], driver)
    out, known = _used(out, driver, words), {driver: fields}
    for name in [n for n in names if n != driver]:
        build, theirs = _side(inputs[name], name)
        known[name] = theirs
        if match == "first" and f"{name}___ord" not in build.columns:
            build = build.withColumn(f"{name}___ord", F.xxhash64(*[F.col(f"`{c}`") for c in build.columns]))
        if match != "collect":
            build = _used(build, name, words)
        tree = parse_expression(where if isinstance(where, str) else where[name])
        if len(names) > 2 and isinstance(where, str):
            parts = [c for c in conjuncts(tree) if name in _inputs_of(c) and _inputs_of(c) <= set(known)]
            tree = reduce(lambda a, b: ("binary", "and", a, b), parts)
        scope = Scope({}, inputs=known)
        p = predicate(tree, scope, name)
        if match == "all":
            out = _all(out, build.hint(hint) if hint else build, p, scope, name, on_miss)
            continue
        merged = _picked(out, build, p, scope, name, match, on_miss, hint)
        kind = merged.schema["_r"].dataType
        if on_miss == "error":
            merged = merged.where(F.when(F.col("_r").isNull(), _missing(name, T.BooleanType())).otherwise(True))
        if match == "first":
            out = merged.select(*[F.col(f"`{c}`") for c in out.columns], *[F.col("_r").getField(c).alias(c) for c in build.columns])
            continue
        whole = F.coalesce("_r", F.array().cast(kind))
        if max_collected is not None:
            whole = F.when(F.size(whole) <= max_collected, whole).otherwise(F.raise_error(F.lit(f"over {max_collected} matches")).cast(kind))
        plain = [c for c in build.columns if c != f"{name}___ord"]
        items = F.transform(whole, lambda x: F.struct(*[x["r"].getField(c).alias(c[len(name) + 2 :]) for c in plain]))  # noqa: B023
        out = merged.select(*[F.col(f"`{c}`") for c in out.columns], items.alias(f"{name}__"))
        known[name] = {}
        known.setdefault("", {})[name] = Value(F.col(f"`{name}__`"), out.schema[f"{name}__"].dataType, name)
    return _body(out, body, known, max_output_rows)


def _body(df: DataFrame, body: str, known: dict, cap: int | None) -> DataFrame:
    lets: dict[str, Value] = {}
    emitted: dict[str, Column] = {}
    arrays = known.pop("", {})
    # A driver column that every input leaves alone may be named without its input.
    plain: dict[str, Value] = {}
    for fields in known.values():
        for c, v in fields.items():
            plain.setdefault(c, v)
    tests = []
    for st in parse_program(body):
        scope = Scope(plain | arrays, lets=dict(lets), inputs=known)
        if st[0] == "let":
            lets[st[1]] = compile_tree(st[2], scope)
        elif st[0] == "emit":
            v = compile_tree(st[2], scope)
            emitted[st[1]] = v.col
            lets[st[1]] = v
        elif st[0] == "filter":
            tests.append(compile_tree(st[1], scope).col)
    for t in tests:
        df = df.where(t)
    out = df.select(*[c.alias(n) for n, c in emitted.items()])
    if cap is not None:
        # Counted apart, without columns and only until the cap is passed, before any row comes out.
        over = df.select(F.lit(1)).limit(cap + 1).agg(F.count(F.lit(1)) > cap).scalar()
        out = out.where(F.when(over, F.raise_error(F.lit(f"more than {cap} rows")).cast("boolean")).otherwise(True))
    return out


def semi(driver: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Driver rows that have a match (first with skip, where the body reads the driver only)."""
    return driver.join(other, reduce(lambda a, b: a & b, [driver[x] == other[y] for x, y in on.items()]), "left_semi")


def anti(driver: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Driver rows without one; a null key never matches, so it stays."""
    return driver.join(other, reduce(lambda a, b: a & b, [driver[x] == other[y] for x, y in on.items()]), "left_anti")
