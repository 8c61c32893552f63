"""Trees of the expression language to Spark columns.

Every value carries its static type, as Spark names it, so that each operator
picks the expression with the language's own rules: equality never yields
null, integers divide to integers, a wrong receiver yields null. The result is
built-in expressions only; nothing runs in Python.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.syntax import parse_expression

INT, FLOAT, STRING, BOOL, DATE, TIME, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.NullType()
DECIMAL = T.DecimalType(38, 18)


class TypeFault(TypeError):
    pass


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    #: The field's name, where the value is a bare field.
    field: str | None = None

    @property
    def number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def kind(self) -> str:
        t = self.type
        for kinds, name in (
            (T.IntegralType, "int"), (T.DecimalType, "decimal"), (T.FractionalType, "float"), (T.StringType, "string"), (T.BooleanType, "bool"),
            (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "map"), (T.NullType, "null"),
        ):
            if isinstance(t, kinds):
                return name
        return "any"


def literal(x) -> Value:
    for kind, t in ((type(None), NULL), (bool, BOOL), (int, INT), (float, FLOAT), (str, STRING)):
        if isinstance(x, kind):
            return Value(F.lit(x).cast(t) if x is not None else F.lit(None), t)
    raise TypeFault(f"no literal of {type(x)}")


def unify(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return INT
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        fractional = [isinstance(x, T.FractionalType) and not isinstance(x, T.DecimalType) for x in (a, b)]
        return FLOAT if any(fractional) else DECIMAL
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return TIME
    return STRING


@dataclass
class Scope:
    """What names mean: fields of the input, lets, variables, and analytic or aggregate context.

    faults, where a list, collects what can fail in a row as (condition, category,
    detail), and the value is null there; where None, such a row stops the query.
    """

    fields: dict[str, Value]
    lets: dict[str, Value] = field(default_factory=dict)
    inputs: dict[str, dict[str, Value]] = field(default_factory=dict)
    variables: dict[str, Value] = field(default_factory=dict)
    functions: dict[str, tuple[list[str], tuple]] = field(default_factory=dict)
    group_by: list[str] | None = None
    sort_by: list[Column] | None = None
    aggregate: bool = False
    order: Column | None = None
    faults: list[tuple[Column, str, Column]] | None = None

    def inner(self, **lets: Value) -> Scope:
        return replace(self, lets=self.lets | lets)


#: Columns that hold a document's envelope section, or state of the record, and how programs name them.
_HIDDEN = {"_doc_": "$doc.", "_record_": "$record."}


def scope_of(schema: T.StructType, **more) -> Scope:
    fields = {f.name: Value(F.col(f"`{f.name}`"), f.dataType, f.name) for f in schema}
    hidden = {name + f.removeprefix(mark): v for f, v in fields.items() for mark, name in _HIDDEN.items() if f.startswith(mark)}
    more["variables"] = more.get("variables", {}) | hidden
    return Scope(fields, **more)


def fault(s: Scope, bad: Column, category: str, detail: Column, value: Value) -> Value:
    """value, which is null where bad: a fault of the row, or the end of the query."""
    if s.faults is not None:
        s.faults.append((F.coalesce(bad, F.lit(False)), category, detail))
        return value
    return Value(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(detail).cast(value.type)).otherwise(value.col), value.type)


def guarded(tree: tuple, s: Scope, when: Column) -> Value:
    """The tree's value, which can fail only where when is true."""
    if s.faults is None:
        return compile_tree(tree, s)
    held: list[tuple[Column, str, Column]] = []
    v = compile_tree(tree, replace(s, faults=held))
    s.faults.extend((F.coalesce(when, F.lit(False)) & bad, category, detail) for bad, category, detail in held)
    return v


def each_element(s: Scope, array: Column, body: Callable[[Scope, Column], object]) -> Scope:
    """The scope for body over the array's elements. A fault of any element is one of the row."""
    if s.faults is None:
        return s
    found = []

    def fails(x: Column) -> Column:
        held: list[tuple[Column, str, Column]] = []
        body(replace(s, faults=held), x)
        found.extend(held)
        return reduce(lambda a, b: a | b, [bad for bad, _, _ in held], F.lit(False))

    hit = F.exists(array, fails)
    if found:
        s.faults.append((F.coalesce(hit, F.lit(False)), found[0][1], F.lit("an element of an array is at fault")))
    return replace(s, faults=[])


def compile_text(text: str, scope: Scope) -> Value:
    return compile_tree(parse_expression(text), scope)


def compile_tree(tree: tuple, s: Scope) -> Value:
    return globals()["_" + tree[0]](tree, s)


def _literal(t, s):
    return literal(t[1])


def _date(t, s):
    return Value(F.lit(datetime.date.fromisoformat(t[1])), DATE)


def _now(t, s):
    return Value(F.localtimestamp(), TIME)


def _name(t, s):
    for held in (s.lets, s.fields, s.variables):
        if t[1] in held:
            return held[t[1]]
    raise TypeFault(f"no field {t[1]!r}; there are {sorted(s.fields)}")


def _field(t, s):
    base, name = t[1], t[2]
    if base[0] == "name":
        if base[1] in s.inputs:
            if name not in s.inputs[base[1]]:
                raise TypeFault(f"no field {name!r} of {base[1]!r}")
            return s.inputs[base[1]][name]
        if f"{base[1]}.{name}" in s.variables:
            return s.variables[f"{base[1]}.{name}"]
    if base[0] == "method" and base[1] == ("name", "$window"):
        return _window_field(base, name, s)
    v = compile_tree(base, s)
    return _member(v, name)


def _member(v: Value, name: str) -> Value:
    if isinstance(v.type, T.StructType):
        if name not in v.type.fieldNames():
            return literal(None)
        return Value(v.col.getField(name), v.type[name].dataType)
    if isinstance(v.type, T.MapType):
        return Value(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    return literal(None)


def _index(t, s):
    v, i = compile_tree(t[1], s), compile_tree(t[2], s)
    if isinstance(v.type, T.ArrayType) and i.kind == "int":
        return Value(F.get(v.col, i.col.cast("int")), v.type.elementType)
    if isinstance(v.type, T.StructType) and t[2][0] == "literal" and isinstance(t[2][1], str):
        return _member(v, t[2][1])
    if isinstance(v.type, T.MapType) and i.kind == "string":
        return Value(F.try_element_at(v.col, i.col), v.type.valueType)
    return literal(None)


def _array(t, s):
    items = [compile_tree(x, s) for x in t[1]]
    of = NULL
    for x in items:
        of = unify(of, x.type)
    return Value(F.array(*[x.col.cast(of) for x in items]), T.ArrayType(of))


def _comprehension(t, s):
    _, body, var, source, cond = t
    v = compile_tree(source, s)
    if not isinstance(v.type, T.ArrayType):
        raise TypeFault("a comprehension needs an array")
    of, col, out = v.type.elementType, v.col, []
    inner = lambda scope, x: scope.inner(**{var: Value(x, of)})
    if cond is not None:
        quiet = each_element(s, col, lambda scope, x: compile_tree(cond, inner(scope, x)))
        col = F.filter(col, lambda x: compile_tree(cond, inner(quiet, x)).col)
    quiet = each_element(s, col, lambda scope, x: compile_tree(body, inner(scope, x)))

    def made(x):
        got = compile_tree(body, inner(quiet, x))
        out.append(got.type)
        return got.col

    return Value(F.transform(col, made), T.ArrayType(out[0]))


def _map(t, s):
    keys = [k[1] for k, _ in t[1] if k[0] == "literal" and isinstance(k[1], str)]
    if len(set(keys)) != len(keys):
        raise TypeFault("a key of a map comes twice")
    values = [compile_tree(v, s) for _, v in t[1]]
    if len(keys) != len(t[1]):
        return _computed_map([compile_tree(k, s) for k, _ in t[1]], values, s)
    return Value(F.struct(*[v.col.alias(k) for k, v in zip(keys, values, strict=True)]), T.StructType([T.StructField(k, v.type) for k, v in zip(keys, values, strict=True)]))


def _computed_map(keys: list[Value], values: list[Value], s: Scope) -> Value:
    """A map whose keys the row says: strings, not null, all different."""
    if any(k.kind != "string" for k in keys):
        raise TypeFault("keys of a map are strings")
    of = reduce(unify, [v.type for v in values], NULL)
    names = F.array(*[k.col for k in keys])
    bad = F.exists(names, lambda k: k.isNull()) | (F.size(F.array_distinct(names)) < len(keys))
    held = F.when(~bad, F.map_from_arrays(names, F.array(*[v.col.cast(of) for v in values])))
    return fault(s, bad, "type_coercion_failure", F.lit("a key of a map is null or comes twice"), Value(held, T.MapType(STRING, of)))


def _if(t, s):
    cond = compile_tree(t[1], s)
    holds = F.coalesce(cond.col.cast("boolean"), F.lit(False))
    yes, no = guarded(t[2], s, holds), guarded(t[3], s, ~holds)
    of = unify(yes.type, no.type)
    return Value(F.when(cond.col.cast("boolean"), yes.col.cast(of)).otherwise(no.col.cast(of)), of)


def _match(t, s):
    subject = compile_tree(t[1], s) if t[1] is not None else None
    arms, taken = [], F.lit(False)
    for p, v in t[2]:
        if p is None:
            arms.append((None, guarded(v, s, ~taken)))
            break
        cond = guarded(p, s, ~taken)
        test = F.coalesce(equal(subject, cond).col if subject is not None else cond.col.cast("boolean"), F.lit(False))
        arms.append((test, guarded(v, s, ~taken & test)))
        taken = taken | test
    of = reduce(unify, [v.type for _, v in arms], NULL)
    out, rest = None, F.lit(None).cast(of)
    for test, v in arms:
        if test is None:
            rest = v.col.cast(of)
        else:
            out = F.when(test, v.col.cast(of)) if out is None else out.when(test, v.col.cast(of))
    return Value(out.otherwise(rest) if out is not None else rest, of)


def _not(t, s):
    return Value(~compile_tree(t[1], s).col.cast("boolean"), BOOL)


def _negative(t, s):
    v = compile_tree(t[1], s)
    return Value(-v.col, v.type) if v.number else literal(None)


def equal(a: Value, b: Value) -> Value:
    """Equality that is never null: null equals null and nothing else, NaN equals nothing, kinds that don't compare differ."""
    if "null" in (a.kind, b.kind) or a.kind == b.kind or (a.number and b.number) or {a.kind, b.kind} == {"date", "datetime"}:
        if "array" in (a.kind, b.kind) or "map" in (a.kind, b.kind):
            return Value(a.col.isNull() & b.col.isNull(), BOOL)
        of = unify(a.type, b.type)
        out = a.col.cast(of).eqNullSafe(b.col.cast(of))
        if of == FLOAT:
            out = out & ~F.coalesce(F.isnan(a.col.cast("double")), F.lit(False))
        return Value(out, BOOL)
    return Value(a.col.isNull() & b.col.isNull(), BOOL)


def _binary(t, s):
    _, op, left, right = t
    a = compile_tree(left, s)
    if op in ("??", "and", "or"):
        truth = a.col.cast("boolean") if op != "??" else a.col
        b = guarded(right, s, truth.isNull() if op == "??" else ~F.coalesce(~truth if op == "and" else truth, F.lit(False)))
    else:
        b = compile_tree(right, s)
    if op == "??":
        of = unify(a.type, b.type)
        return Value(F.coalesce(a.col.cast(of), b.col.cast(of)), of)
    if op in ("and", "or"):
        x, y = a.col.cast("boolean"), b.col.cast("boolean")
        return Value(x & y if op == "and" else x | y, BOOL)
    if op in ("==", "!="):
        same = equal(a, b)
        return same if op == "==" else Value(~same.col, BOOL)
    if op in ("<", "<=", ">", ">="):
        if "null" in (a.kind, b.kind):
            return Value(F.lit(None).cast("boolean"), BOOL)
        ordered = (a.number and b.number) or (a.kind == b.kind and a.kind in ("string", "date", "datetime")) or {a.kind, b.kind} == {"date", "datetime"}
        if not ordered:
            return Value(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), BOOL)
        of = unify(a.type, b.type)
        x, y = a.col.cast(of), b.col.cast(of)
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Value(out & ~F.isnan(x) & ~F.isnan(y) if of == FLOAT else out, BOOL)
    if op == "+" and a.kind == b.kind == "string":
        return Value(F.concat(a.col, b.col), STRING)
    if not (a.number and b.number):
        return literal(None)
    if {a.kind, b.kind} == {"decimal", "float"}:
        raise TypeFault("decimal and float don't mix")
    of = unify(a.type, b.type)
    x, y = a.col.cast(of), b.col.cast(of)
    if op == "%" and of == FLOAT:
        return Value(F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x, y)), of)
    if s.faults is not None:
        return _tried(op, x, y, of, s)
    if op == "/":
        return Value(F.call_function("div", x, y), INT) if of == INT else Value(x / y, of)
    return Value({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], of)


def _tried(op: str, x: Column, y: Column, of: T.DataType, s: Scope) -> Value:
    """Arithmetic whose division by zero or overflow is a fault of the row."""
    both = x.isNotNull() & y.isNotNull()
    if op in ("/", "%"):
        by = F.when(y != 0, y)
        out = (F.call_function("div", x, by) if of == INT else x / by) if op == "/" else x % by
        return fault(s, both & (y == 0), "type_coercion_failure", F.lit("division by zero"), Value(out.cast(of), of))
    if of == FLOAT:
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], of)
    out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y).cast(of)
    return fault(s, both & out.isNull(), "type_coercion_failure", F.lit("overflow"), Value(out, of))


#: Aggregates; each takes its arguments and the scope.
def _call(t, s):
    _, name, args = t
    if name in s.functions:
        params, body = s.functions[name]
        return compile_tree(body, s.inner(**{p: compile_tree(a, s) for p, a in zip(params, args, strict=True)}))
    if not s.aggregate:
        raise TypeFault(f"no function {name!r} here")
    plain = Scope(s.fields, s.lets, s.inputs, s.variables, s.functions)
    if name == "count" and args == [("star",)]:
        return Value(F.count(F.lit(1)), INT)
    v = [compile_tree(a, plain) for a in args]
    if name == "count":
        return Value(F.count(v[0].col), INT)
    if name == "sum":
        of = v[0].type if v[0].kind == "decimal" else (INT if v[0].kind == "int" else FLOAT)
        return Value(F.sum(v[0].col.cast(of)).cast(of), of)
    if name == "avg":
        return Value(F.avg(v[0].col.cast(DECIMAL)), DECIMAL) if v[0].kind == "decimal" else Value(F.avg(v[0].col), FLOAT)
    if name in ("min", "max"):
        return Value(getattr(F, name)(v[0].col), v[0].type)
    if name == "weighted_avg":
        x, w = (y.col.cast("double") for y in v)
        both = x.isNotNull() & w.isNotNull()
        total = F.sum(F.when(both, w))
        return Value(F.when(total != 0, F.sum(x * w) / total), FLOAT)
    if name == "collect":
        order = s.order if s.order is not None else F.lit(0)
        held = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(v[0].col.alias("x")).alias("v"))))
        return Value(F.transform(held, lambda r: r["v"]["x"]), T.ArrayType(v[0].type))
    if name == "any":
        return Value(F.first(v[0].col, ignorenulls=True), v[0].type)
    raise TypeFault(f"no aggregate {name!r}")


def _window_spec(s: Scope, frame: bool = True):
    if s.group_by is None:
        raise TypeFault("$window needs an analytic window")
    w = Window.partitionBy(*[F.col(f"`{g}`") for g in s.group_by])
    if s.sort_by:
        w = w.orderBy(*s.sort_by)
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if frame else w


def _window_field(call: tuple, name: str, s: Scope) -> Value:
    _, _, fn, args = call
    v = s.fields.get(name)
    if v is None:
        return literal(None)
    if fn in ("first", "last"):
        return Value(getattr(F, fn)(v.col).over(_window_spec(s)), v.type)
    n = args[0][1] if args and args[0][0] == "literal" else 1
    w = _window_spec(s, False)
    return Value(getattr(F, fn)(v.col, max(0, int(n))).over(w), v.type)


def _window(fn: str, args: list, s: Scope) -> Value:
    every, rows = _window_spec(s), _window_spec(s, False)
    if fn == "count":
        return Value(F.count(F.lit(1)).over(every), INT)
    if fn in ("row_number", "rank", "dense_rank"):
        if not s.sort_by:
            if fn != "row_number":
                return literal(1)
            rows = rows.orderBy(F.lit(0))
        return Value(getattr(F, fn)().over(rows).cast("long"), INT)
    plain = s.inner()
    if fn in ("any", "exists", "every", "not_exists"):
        p = compile_tree(args[0][2] if args[0][0] == "closure" else args[0], plain).col
        if fn == "not_exists":
            p = ~p
        unknown = F.sum(F.when(p.isNull(), 1).otherwise(0)).over(every) > 0
        decided = fn in ("any", "exists")
        hit = F.max(F.when(p == F.lit(decided), 1).otherwise(0)).over(every) > 0
        return Value(F.when(hit, F.lit(decided)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(not decided)), BOOL)
    v = compile_tree(args[0], plain)
    if v.field is None:
        return literal(None)
    number = v.type if v.kind == "decimal" else FLOAT
    if fn == "sum":
        return Value(F.sum(v.col.cast(number)).over(every), number)
    if fn == "cumulative_sum":
        return Value(F.sum(v.col.cast(number)).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)), number)
    if fn == "avg":
        return Value(F.avg(v.col).over(every), number)
    if fn in ("min", "max"):
        return Value(getattr(F, fn)(v.col).over(every), v.type)
    if fn in ("first_value", "last_value"):
        return Value(getattr(F, fn[:-6])(v.col).over(every), v.type)
    if fn == "collect":
        return Value(F.collect_list(v.col).over(every), T.ArrayType(v.type))
    if fn == "distinct":
        return Value(F.array_distinct(F.collect_list(v.col).over(every)), T.ArrayType(v.type))
    raise TypeFault(f"no window function {fn!r}")


def _method(t, s):
    from tributary.functions import builtins

    _, base, name, args = t
    if base == ("name", "$window"):
        return _window(name, args, s)
    if base[0] == "name" and f"{base[1]}.{name}" in s.functions:
        return _call(("call", f"{base[1]}.{name}", args), s)
    v = compile_tree(base, s)
    return builtins.call(v, name, args, s)


