"""Methods of values. A null receiver yields null but for is_null, type_of, is_empty and catch; a receiver of another kind too."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.compiler import BOOL, DATE, DECIMAL, FLOAT, INT, STRING, TIME, Scope, TypeFault, Value, compile_tree, each_element, fault, guarded, literal, unify

_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "I": "hh", "f": "SSSSSS"}


def date_pattern(fmt: str) -> str:
    """strftime to Spark's pattern letters; other letters are quoted."""
    out, at = "", 0
    while at < len(fmt):
        c = fmt[at]
        if c == "%" and at + 1 < len(fmt):
            at += 1
            if fmt[at] == "F":
                out += "yyyy-MM-dd"
            elif fmt[at] == "T":
                out += "HH:mm:ss"
            elif fmt[at] == "%":
                out += "%"
            elif fmt[at] in _STRFTIME:
                out += _STRFTIME[fmt[at]]
            else:
                raise TypeFault(f"no date format %{fmt[at]}")
        else:
            out += f"'{c}'" if c.isalpha() else ("''" if c == "'" else c)
        at += 1
    return out


def display(v: Value) -> Column:
    """As text: whole floats without a point, arrays as [a, b], maps as {k: v}."""
    if v.kind == "float":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, F.format_string("%.0f", v.col)).otherwise(v.col.cast("string"))
    if isinstance(v.type, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: F.coalesce(display(Value(x, v.type.elementType)), F.lit("null"))), ", "), F.lit("]"))
    if isinstance(v.type, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}: "), F.coalesce(display(Value(v.col.getField(f.name), f.dataType)), F.lit("null"))) for f in v.type]
        return F.when(v.col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    if v.kind == "datetime":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return v.col.cast("string")


def _constant(tree: tuple) -> str:
    if tree[0] != "literal" or not isinstance(tree[1], str):
        raise TypeFault("a pattern is a string literal")
    return tree[1]


def _string(v: Value, name: str, args: list, a: list[Value], s: Scope) -> Value | None:
    c = v.col
    if name in ("upper", "lower", "reverse"):
        return Value(getattr(F, name)(c), STRING)
    if name in ("trim", "trim_start", "trim_end"):
        ends = {"trim": r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "trim_start": r"^[\p{IsWhite_Space}]+", "trim_end": r"[\p{IsWhite_Space}]+$"}
        return Value(F.regexp_replace(c, ends[name], ""), STRING)
    if name in ("starts_with", "ends_with", "contains"):
        return Value(getattr(c, name.replace("_", ""))(a[0].col), BOOL)
    if name == "replace":
        return Value(F.replace(c, a[0].col, a[1].col), STRING)
    if name == "substring":
        start = F.greatest(a[0].col, F.lit(0)).cast("int")
        if len(a) < 2:
            return Value(F.substring(c, start + 1, F.char_length(c)), STRING)
        n = a[1].col.cast("int")
        return Value(F.substring(c, start + 1, F.when(n < 0, F.char_length(c)).otherwise(n)), STRING)
    if name in ("left", "right"):
        n = a[0].col.cast("int")
        return Value(F.when(n >= 0, getattr(F, name)(c, n)), STRING)
    if name in ("pad_left", "pad_right"):
        n = a[0].col.cast("int")
        fill = F.substring(a[1].col, 1, 1) if len(a) > 1 else F.lit(" ")
        return Value(F.when(F.char_length(c) < n, (F.lpad if name == "pad_left" else F.rpad)(c, n, fill)).otherwise(c), STRING)
    if name == "repeat":
        n = a[0].col.cast("int")
        return Value(F.when(n >= 0, F.repeat(c, n)), STRING)
    if name == "length":
        return Value(F.char_length(c).cast("long"), INT)
    if name == "split":
        return Value(F.split(c, F.concat(F.lit("\\Q"), a[0].col, F.lit("\\E")), -1), T.ArrayType(STRING))
    if name in ("matches", "find") and args[0][0] != "closure":
        return Value(c.rlike(_constant(args[0])), BOOL)
    if name == "capture":
        pattern = _constant(args[0])
        group = args[1][1] if len(args) > 1 else 0
        return Value(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)), STRING)
    if name == "concat":
        return Value(F.when(c.isNotNull(), F.concat(c, *[F.coalesce(display(x), F.lit("")) for x in a])), STRING)
    if name in ("file_name", "file_stem", "extension", "parent", "parent_name"):
        return Value(_path(c, name), STRING)
    return None


def _path(c: Column, name: str) -> Column:
    bare = F.regexp_replace(c, "(?<=[^/])/+$", "")
    file = F.regexp_extract(bare, "([^/]*)$", 1)
    parent = F.regexp_replace(bare, "/*[^/]*$", "")
    parent = F.when((parent == "") & bare.startswith("/") & (bare != "/"), F.lit("/")).otherwise(parent)
    dotted = r"^(.+)\.([^.]*)$"
    if name == "file_name":
        return F.when(file != "", file)
    if name == "file_stem":
        return F.when(file != "", F.when(file.rlike(dotted), F.regexp_extract(file, dotted, 1)).otherwise(file))
    if name == "extension":
        return F.when(file.rlike(dotted), F.regexp_extract(file, dotted, 2))
    if name == "parent":
        return parent
    last = F.regexp_extract(parent, "([^/]*)$", 1)
    return F.when(last != "", last)


def _half_away(x: Column, n: Column) -> Column:
    scale = F.pow(F.lit(10.0), n)
    y = x * scale
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / scale


def _numeric(v: Value, name: str, a: list[Value]) -> Value | None:
    c = v.col
    if name == "abs":
        return Value(F.abs(c), v.type)
    if name in ("ceil", "floor"):
        if v.kind == "decimal":
            return Value(getattr(F, name)(c).cast(v.type), v.type)
        return Value(getattr(F, name)(c).cast("long"), INT)
    if name in ("round", "round_to"):
        if v.kind == "int":
            return v if name == "round" else literal(None)
        n = a[0].col.cast("int") if a else F.lit(0)
        if v.kind == "decimal":
            return Value(F.bround(c, n).cast(v.type), v.type)
        return Value(_half_away(c, n), FLOAT)
    if name == "clamp":
        low, high = (x.col.cast(v.type) for x in a)
        return Value(F.when(c.isNotNull(), F.least(F.greatest(c, low), high)), v.type)
    if name in ("min", "max"):
        of = unify(v.type, a[0].type)
        x, y = c.cast(of), a[0].col.cast(of)
        return Value(F.when(c.isNotNull(), F.when(x < y if name == "min" else x > y, x).otherwise(y)), of)
    return None


def _dates(v: Value, name: str, args: list, a: list[Value]) -> Value | None:
    c = v.col
    if name in ("year", "month", "day"):
        return Value(getattr(F, name)(c).cast("long"), INT)
    if name in ("hour", "minute", "second"):
        return Value(getattr(F, name)(c).cast("long"), INT) if v.kind == "datetime" else literal(None)
    if name == "add_days":
        n = a[0].col.cast("int")
        return Value(F.date_add(c, n), DATE) if v.kind == "date" else Value(c + F.make_dt_interval(days=n), v.type)
    if name in ("add_months", "add_years"):
        if v.kind != "date":
            return literal(None)
        n = a[0].col.cast("int")
        return Value(F.add_months(c, n if name == "add_months" else n * 12), DATE)
    if name == "diff_days":
        return Value(F.datediff(c, a[0].col).cast("long"), INT) if (v.kind, a[0].kind) == ("date", "date") else literal(None)
    if name in ("diff_months", "diff_years"):
        return Value(F.lit(None).cast("long"), INT)
    if name == "format_date":
        return Value(F.date_format(c, date_pattern(_constant(args[0]))), STRING)
    return None


def _convert(v: Value, name: str, args: list, s: Scope) -> Value | None:
    if not re.fullmatch("(to|try)_(int|float|decimal|string|bool|date|datetime)", name):
        return None
    strict, to = name.startswith("to_"), name.split("_")[1]
    c, kind = v.col, v.kind
    if to == "string":
        return Value(display(v), STRING)
    none = F.lit(None)
    if to == "int":
        of, out = INT, {"int": c, "bool": c.cast("long")}.get(kind, none)
        if kind == "float":
            out = F.when(F.abs(c) < 9.2e18, F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long"))
        elif kind == "decimal" and strict:
            out = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
        elif kind == "string":
            out = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))
    elif to == "float":
        of, out = FLOAT, {"int": c.cast("double"), "float": c}.get(kind, none)
        if kind == "decimal" and strict:
            out = c.cast("double")
        elif kind == "string":
            out = F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))
    elif to == "decimal":
        of, out = DECIMAL, none
        if kind in ("int", "decimal"):
            out = c.cast(DECIMAL)
        elif kind == "string":
            out = F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c.try_cast(DECIMAL))
    elif to == "bool":
        of, out = BOOL, none
        if kind == "bool":
            out = c
        elif kind == "int":
            out = c != 0
        elif kind == "string":
            out = F.when(F.lower(c).isin("true", "1", "yes"), True).when(F.lower(c).isin("false", "0", "no"), False)
    else:
        of = DATE if to == "date" else TIME
        out = none
        if kind == "string":
            fmt = date_pattern(_constant(args[0])) if args else None
            if to == "date":
                out = F.try_to_timestamp(c, F.lit(fmt)).cast("date") if fmt else F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), c.try_cast("date"))
            else:
                out = F.try_to_timestamp(c, F.lit(fmt)).cast(TIME) if fmt else F.when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?$"), c.try_cast(TIME))
    out = out.cast(of)
    if strict:
        return fault(s, c.isNotNull() & out.isNull(), "type_coercion_failure", F.concat(F.lit(f"{name}: "), F.coalesce(display(v), F.lit("null"))), Value(out, of))
    return Value(out, of)


def _arrays(v: Value, name: str, args: list, a: list[Value], s: Scope) -> Value | None:
    of, c = v.type.elementType, v.col
    if name == "length":
        return Value(F.size(c).cast("long"), INT)
    if name == "join":
        return Value(F.array_join(F.transform(c, lambda x: F.coalesce(display(Value(x, of)), F.lit(""))), _constant(args[0])), STRING)
    if name == "remove":
        i = a[0].col.cast("int")
        return Value(F.when((i >= 0) & (i < F.size(c)), F.concat(F.slice(c, F.lit(1), i), F.slice(c, i + 2, F.size(c)))).otherwise(c), v.type)
    if name in ("filter", "map", "find", "any", "flat_map") and args and args[0][0] == "closure":
        types: list[T.DataType] = []
        held = lambda scope, x: compile_tree(args[0][2], scope.inner(**{args[0][1]: Value(x, of)}))
        quiet = each_element(s, c, held)

        def body(x: Column) -> Column:
            got = held(quiet, x)
            types.append(got.type)
            return got.col

        if name == "filter":
            return Value(F.filter(c, body), v.type)
        if name == "find":
            return Value(F.get(F.filter(c, body), F.lit(0)), of)
        if name == "any":
            return Value(F.when(c.isNotNull(), F.coalesce(F.exists(c, body), F.lit(False))), BOOL)
        made = F.transform(c, body)
        if name == "map":
            return Value(made, T.ArrayType(types[0]))
        if isinstance(types[0], T.ArrayType):
            return Value(F.flatten(F.filter(made, lambda x: x.isNotNull())), types[0])
        return Value(F.filter(made, lambda x: x.isNotNull()), T.ArrayType(types[0]))
    return None


def as_map(v: Value) -> Value:
    """A map of known fields as one with any keys: its values take one type."""
    of: T.DataType = T.NullType()
    for f in v.type:
        of = unify(of, f.dataType)
    pairs = [x for f in v.type for x in (F.lit(f.name), v.col.getField(f.name).cast(of))]
    return Value(F.when(v.col.isNotNull(), F.create_map(*pairs)), T.MapType(STRING, of))


def _maps(v: Value, name: str, args: list, a: list[Value]) -> Value | None:
    if not isinstance(v.type, T.StructType):
        c = v.col
        if name == "keys":
            return Value(F.map_keys(c), T.ArrayType(v.type.keyType))
        if name == "values":
            return Value(F.map_values(c), T.ArrayType(v.type.valueType))
        if name in ("remove_field", "unset"):
            return Value(F.map_filter(c, lambda k, _: F.coalesce(k != a[0].col, F.lit(True))), v.type)
        if name == "set":
            of = unify(v.type.valueType, a[1].type)
            rest = F.map_filter(c, lambda k, _: k != a[0].col).cast(T.MapType(v.type.keyType, of))
            return Value(F.when(a[0].col.isNotNull(), F.map_concat(rest, F.create_map(a[0].col, a[1].col.cast(of)))), T.MapType(v.type.keyType, of))
        if name == "merge" and isinstance(a[0].type, (T.MapType, T.StructType)):
            over = a[0] if isinstance(a[0].type, T.MapType) else as_map(a[0])
            kind = T.MapType(v.type.keyType, unify(v.type.valueType, over.type.valueType))
            rest = F.map_filter(c, lambda k, _: ~F.array_contains(F.map_keys(over.col), k)).cast(kind)
            return Value(F.map_concat(rest, over.col.cast(kind)), kind)
        return None
    held: dict[str, Value] = {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.type}

    def made(fields: dict[str, Value]) -> Value:
        col = F.when(v.col.isNotNull(), F.struct(*[x.col.alias(k) for k, x in fields.items()]))
        return Value(col, T.StructType([T.StructField(k, x.type) for k, x in fields.items()]))

    if name == "keys":
        return Value(F.when(v.col.isNotNull(), F.array(*[F.lit(k) for k in held])), T.ArrayType(STRING))
    if name == "values":
        of = T.NullType()
        for x in held.values():
            of = unify(of, x.type)
        return Value(F.when(v.col.isNotNull(), F.array(*[x.col.cast(of) for x in held.values()])), T.ArrayType(of))
    if name == "merge" and isinstance(a[0].type, T.StructType):
        return made(held | {f.name: Value(a[0].col.getField(f.name), f.dataType) for f in a[0].type})
    if name in ("remove_field", "unset", "set") and args[0][0] != "literal":
        return _maps(as_map(v), name, args, a)
    if name in ("remove_field", "unset", "set"):
        head, _, rest = _constant(args[0]).partition(".")
        if not rest:
            return made(held | {head: a[1]}) if name == "set" else made({k: x for k, x in held.items() if k != head})
        below = held.get(head)
        if below is None:
            if name != "set":
                return v
            below = Value(F.struct(), T.StructType([]))
            inner = _nest(rest.split("."), a[1])
        elif not isinstance(below.type, T.StructType):
            return literal(None) if name == "set" else v
        else:
            inner = _maps(below, name, [("literal", rest), *args[1:]], [literal(rest), *a[1:]])
        return made(held | {head: inner})
    return None


def _nest(path: list[str], v: Value) -> Value:
    for k in reversed(path):
        v = Value(F.struct(v.col.alias(k)), T.StructType([T.StructField(k, v.type)]))
    return v


def call(v: Value, name: str, args: list, s: Scope) -> Value:
    if name == "is_null":
        return Value(v.col.isNull(), BOOL)
    if name == "type_of":
        return Value(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(v.kind)), STRING)
    a = [guarded(x, s, v.col.isNull()) if name == "catch" else compile_tree(x, s) for x in args if x[0] != "closure"]
    if name == "is_empty":
        if v.kind in ("string", "array"):
            return Value(v.col.isNull() | ((F.char_length(v.col) if v.kind == "string" else F.size(v.col)) == 0), BOOL)
        return Value(v.col.isNull(), BOOL)
    if name == "catch":
        of = unify(v.type, a[0].type)
        return Value(F.coalesce(v.col.cast(of), a[0].col.cast(of)), of)
    if name == "debug":
        return v
    if name == "format":
        return Value(display(v), STRING)
    out = _convert(v, name, args, s)
    if out is None and v.kind == "string":
        out = _string(v, name, args, a, s)
    elif out is None and v.number:
        out = _numeric(v, name, a)
    elif out is None and v.kind in ("date", "datetime"):
        out = _dates(v, name, args, a)
    elif out is None and v.kind == "array":
        out = _arrays(v, name, args, a, s)
    elif out is None and v.kind == "map":
        out = _maps(v, name, args, a)
    if out is not None:
        return out
    if name in KNOWN:
        return literal(None)
    raise TypeFault(f"no method {name!r}")


#: Names of all methods: on a receiver of another kind they yield null.
KNOWN = set(
    """upper lower trim trim_start trim_end starts_with ends_with contains replace substring left right pad_left pad_right repeat reverse
    length split join matches find capture concat format file_name file_stem extension parent parent_name abs ceil floor round round_to clamp min
    max year month day hour minute second add_days add_months add_years diff_days diff_months diff_years format_date filter map any flat_map
    remove keys values merge set remove_field unset""".split()
)
