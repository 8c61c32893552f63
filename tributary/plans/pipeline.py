"""Pipelines as data: a dict (or YAML) of nodes, checked, then folded into DataFrames.

Each node: {name, kind, input | inputs, ...}. A port of a node that has several
(route branches, cull's removed, rows that failed) is named node.port.
"""

from __future__ import annotations

import copy
import logging
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tributary.functions.compiler import Scope, compile_tree, literal
from tributary.functions.syntax import parse_expression, parse_program
from tributary.operators import aggregate as A
from tributary.operators import combine as C
from tributary.operators import rows as R
from tributary.sources import interchange, readers, rest, writers

KINDS = {"source", "transform", "aggregate", "route", "merge", "combine", "sink", "reshape", "cull", "envelope", "composition", "validate", "dead_letter", "lookup"}

logger = logging.getLogger("tributary")
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}

#: Ports of rows that failed.
DEAD = {"rejected", "failed", "dead"}


class PlanFault(ValueError):
    pass


def load(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise PlanFault("YAML pipelines need a YAML parser; pass a dict") from e
    return yaml.safe_load(text)


def overlay(spec: dict, patch: dict) -> dict:
    """spec with variables replaced and nodes patched, removed (null) or added; spec itself stays."""
    out = copy.deepcopy(spec)
    out.setdefault("vars", {}).update(patch.get("vars", {}))
    for name, change in patch.get("nodes", {}).items():
        at = next((i for i, n in enumerate(out["nodes"]) if n["name"] == name), None)
        if change is None:
            if at is None:
                raise PlanFault(f"no node {name!r} to remove")
            del out["nodes"][at]
        elif at is None:
            out["nodes"].append({"name": name, **change})
        else:
            out["nodes"][at] |= change
    return out


def _needs(node: dict) -> list[str]:
    inputs = node.get("inputs", [])
    return [*([node["input"]] if "input" in node else []), *(inputs.values() if isinstance(inputs, dict) else inputs), *[node[k] for k in ("header", "source") if isinstance(node.get(k), str)]]


def ordered(spec: dict) -> list[dict]:
    """Nodes so that inputs come first; refuses duplicates, unknown kinds and names, and cycles."""
    nodes = {}
    for n in spec["nodes"]:
        if n["name"] in nodes:
            raise PlanFault(f"two nodes named {n['name']!r}")
        if n["kind"] not in KINDS:
            raise PlanFault(f"{n['name']}: no kind {n['kind']!r}")
        nodes[n["name"]] = n
    out: list[dict] = []
    state: dict[str, int] = {}

    def visit(name: str, path: tuple) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise PlanFault("a cycle: " + " -> ".join([*path, name]))
        state[name] = 1
        for i in _needs(nodes[name]):
            base = i.partition(".")[0]
            if base not in nodes:
                raise PlanFault(f"{name}: no node {base!r}")
            visit(base, (*path, name))
        state[name] = 2
        out.append(nodes[name])

    for name in nodes:
        visit(name, ())
    return out


def _counts(seen: Observation, n: int, tries: int = 50) -> list[int] | None:
    """What an observation counted; zeros where the optimizer found that no rows come by, nothing where no sink read that port.

    Observation.get would wait for ever in the last case.
    """
    for _ in range(tries):
        got = seen._jo.getRowOrEmpty()  # waits for a tenth of a second
        if got.isDefined():
            return [got.get().get(k) for k in range(n)] if got.get().size() else [0] * n
    return None


def _above(spec: dict, name: str) -> set[str]:
    """A node and all that it is made of."""
    node = next(n for n in spec["nodes"] if n["name"] == name)
    return {name}.union(*[_above(spec, i.partition(".")[0]) for i in _needs(node)])


class Pipeline:
    def __init__(self, spark: SparkSession, spec: dict, tables: dict[str, DataFrame] | None = None):
        self.spark, self.spec, self.tables = spark, spec, tables or {}
        self.variables = {f"$vars.{k}": literal(v) for k, v in spec.get("vars", {}).items()}
        self.variables |= {"$pipeline.name": literal(spec.get("name", ""))}
        self.functions = {n: (f["params"], parse_expression(f["body"])) for n, f in spec.get("functions", {}).items()}
        self._modules(spec.get("modules", {}))
        self.ports: dict[str, DataFrame] = {}
        self.written: list[str] = []
        self.logs: list[tuple[str, list[dict], Observation]] = []

    def _modules(self, modules: dict) -> None:
        """{name: {lets, functions, use: {alias: module}}}: constants and functions, written name.x in programs, put in place as trees."""

        def full(name: str, tree, params: tuple, path: tuple):
            """The tree with the module's own names and aliases made full ones, and constants in place."""
            own, alias = modules[name], modules[name].get("use", {})
            go = lambda x, p=params: full(name, x, p, path)
            if isinstance(tree, list):
                return [go(x) for x in tree]
            if not isinstance(tree, tuple) or not tree:
                return tree
            if tree[0] == "name" and tree[1] not in params and tree[1] in own.get("lets", {}):
                return constant(name, tree[1], path)
            if tree[0] == "field" and tree[1][0] == "name" and tree[1][1] in alias:
                return constant(alias[tree[1][1]], tree[2], path)
            if tree[0] == "call" and tree[1] in own.get("functions", {}):
                return ("call", f"{name}.{tree[1]}", go(tree[2]))
            if tree[0] == "method" and tree[1][0] == "name" and tree[1][1] in alias:
                return ("call", f"{alias[tree[1][1]]}.{tree[2]}", go(tree[3]))
            if tree[0] == "closure":
                return ("closure", tree[1], go(tree[2], (*params, tree[1])))
            return tuple(go(x) for x in tree)

        def constant(name: str, let: str, path: tuple):
            if (name, let) in path:
                raise PlanFault(f"{name}.{let} is defined by itself")
            return full(name, parse_expression(modules[name]["lets"][let]), (), (*path, (name, let)))

        def calls(tree) -> set[str]:
            found = set().union(*[calls(x) for x in tree]) if isinstance(tree, (tuple, list)) and tree else set()
            return found | {tree[1]} if isinstance(tree, tuple) and tree and tree[0] == "call" else found

        def closed(name: str, path: tuple) -> None:
            if name in path:
                raise PlanFault("recursion: " + " -> ".join([*path, name]))
            if name in self.functions:
                for x in calls(self.functions[name][1]) & set(self.functions):
                    closed(x, (*path, name))

        for name, m in modules.items():
            for f, x in m.get("functions", {}).items():
                self.functions[f"{name}.{f}"] = (x["params"], full(name, parse_expression(x["body"]), tuple(x["params"]), ()))
            for let in m.get("lets", {}):
                self.variables[f"{name}.{let}"] = compile_tree(constant(name, let, ()), Scope({}))
        for f in self.functions:
            closed(f, ())

    def build(self) -> dict[str, DataFrame]:
        """All ports; nothing runs yet."""
        for node in ordered(self.spec):
            if node["kind"] == "sink":
                self.ports[node["name"]] = self.ports[node["input"]]
                continue
            try:
                made = getattr(self, "_" + node["kind"])(node)
            except (TypeError, ValueError, KeyError) as e:
                raise PlanFault(f"{node['name']}: {e}") from e
            for port, df in (made if isinstance(made, dict) else {"": made}).items():
                if port == "" and "log" in node:
                    df = self._logged(node, df)
                self.ports[f"{node['name']}.{port}" if port else node["name"]] = df
        return self.ports

    def run(self) -> list[str]:
        """Builds, then writes every sink, and where the spec has dlq ({path, include_reason, include_source_row}) the rows of all dead ports; returns the paths."""
        self.build()
        for node in ordered(self.spec):
            if node["kind"] == "sink":
                options = {k: v for k, v in node.items() if k not in ("name", "kind", "input", "path", "format")}
                put = interchange.write_messages if node.get("format") in interchange.LEVELS else writers.write
                self.written.append(put(self.ports[node["input"]], node["path"], node.get("format", "csv"), **options))
        dead = {k.rpartition(".")[0]: df for k, df in self.ports.items() if k.rpartition(".")[2] in DEAD and "." in k}
        if "dlq" in self.spec and dead:
            self.written.append(writers.write_dead_letters(dead, **self.spec["dlq"]))
        self._log()
        return self.written

    def _logged(self, node: dict, df: DataFrame) -> DataFrame:
        """log: [{level, message, when}]: how many of a node's rows meet each condition, counted as they pass and logged once the sinks are written."""
        entries = [{"level": "info", "when": "true", **e} for e in node["log"]]
        for e in entries:
            if e["level"] not in ("debug", "info", "warn", "error"):
                raise PlanFault(f"{node['name']}: no level {e['level']!r}")
        seen = Observation(f"{node['name']}-{uuid.uuid4().hex}")
        self.logs.append((node["name"], entries, seen))
        return df.observe(seen, *[F.count_if(F.coalesce(R.predicate(df, e["when"]), F.lit(False))).alias(f"n{k}") for k, e in enumerate(entries)])

    def _log(self) -> None:
        used = set().union(*[_above(self.spec, n["name"]) for n in self.spec["nodes"] if n["kind"] == "sink"])
        for name, entries, seen in self.logs:
            counts = _counts(seen, len(entries)) if name in used else None
            for k, e in enumerate(entries if counts else []):
                logger.log(LEVELS[e["level"]], "%s: %s (%d rows)", name, e.get("message", e["when"]), counts[k])

    def explain(self, port: str) -> str:
        df = self.ports[port]
        return df._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _source(self, n: dict) -> Any:
        if "table" in n:
            df = self.tables[n["table"]]
            return df.limit(n["limit"]) if "limit" in n else df
        kind, options = n.get("format", "csv"), n.get("options", {})
        paths = n["urls"] if kind == "rest" else readers.find_files(self.spark, n["files"])
        if kind == "rest":
            raw = rest.read_rest(self.spark, paths, n["schema"], **options)
        elif kind == "multi_record":
            return readers.read_multi_record(self.spark, paths, **options)
        elif kind in interchange.LEVELS and n.get("envelope"):
            good, bad = interchange.read_messages(self.spark, paths, kind, **options)
            return {"": good, "rejected": bad}
        elif kind == "csv":
            raw = readers.read_csv(self.spark, paths, n["schema"], **options)
        elif kind == "json":
            raw = readers.read_json(self.spark, paths, n["schema"], **({"declared_only": n.get("on_unmapped") == "drop"} | options))
        elif kind == "xml":
            raw = readers.read_xml(self.spark, paths, **options)
        elif kind == "fixed_width":
            raw = readers.read_fixed_width(self.spark, paths, n["schema"])
        elif kind in readers.SEGMENTS:
            return readers.read_segments(self.spark, paths, kind)
        else:
            return self.spark.read.format(kind).load(paths)
        good, bad = readers.coerce(raw, n["schema"], n.get("on_unmapped", "auto_widen"), n.get("type_error_threshold"))
        return {"": good.limit(n["limit"]) if "limit" in n else good, "rejected": bad}

    def _transform(self, n: dict) -> Any:
        df = self.ports[n["input"]]
        options = {"variables": self.variables, "functions": self.functions, "analytic": n.get("analytic"), "order": n.get("order")}
        if n.get("on_error", self.spec.get("on_error", "fail_fast")) == "continue":
            good, dead = R.transform_split(df, n["program"], **options)
            out = {"": good, "failed": dead}
        else:
            out = {"": R.transform(df, n["program"], **options)}
        if n.get("analytic"):
            out["unplaced"] = R.analytic_split(df, n["analytic"])[1]
        return out

    def _validate(self, n: dict) -> Any:
        good, bad = R.validate(self.ports[n["input"]], n["rules"])
        return {"": good, "failed": bad}

    def _aggregate(self, n: dict) -> DataFrame:
        df = self.ports[n["input"]]
        if "window" in n:
            return A.time_window(df, n["event_time"], n["window"], n.get("group_by", []), n["program"], n.get("bounds", False), n.get("watermark"))
        group = [*n.get("group_by", []), *([n.get("grain", "_file")] if n.get("per_document") else [])]
        return A.aggregate(df, group, n["program"], n.get("order"))

    def _route(self, n: dict) -> dict[str, DataFrame]:
        return R.route(self.ports[n["input"]], n["conditions"], n.get("default", "default"), n.get("mode", "exclusive"))

    def _merge(self, n: dict) -> DataFrame:
        return R.merge([self.ports[i] for i in n["inputs"]], n.get("mode", "concat"), n.get("seed"))

    def _combine(self, n: dict) -> DataFrame:
        options = {k: n[k] for k in ("match", "on_miss", "drive", "hint", "max_output_rows", "max_collected") if k in n}
        return C.combine({k: self.ports[v] for k, v in n["inputs"].items()}, n["where"], n["body"], **options)

    def _reshape(self, n: dict) -> dict[str, DataFrame]:
        out, rejected = R.reshape_split(self.ports[n["input"]], n["partition_by"], n["rules"])
        return {"": out, "rejected": rejected}

    def _dead_letter(self, n: dict) -> dict[str, DataFrame]:
        """Rows for which when is true, or all rows of their correlation key (group) or document (grain, _file unless named), on the port dead."""
        df = self.ports[n["input"]]
        group = n.get("group") or ([n.get("grain", "_file")] if n.get("granularity") == "document" else None)
        good, dead = R.dead_letter(df, R.predicate(df, n["when"]), group)
        return {"": good, "dead": dead}

    def _lookup(self, n: dict) -> DataFrame:
        return A.cross_source(self.ports[n["input"]], self.ports[n["source"]], n["on"], n["program"])

    def _cull(self, n: dict) -> dict[str, DataFrame]:
        kept, removed = R.cull(self.ports[n["input"]], n["partition_by"], n["drop_when"])
        return {"": kept, "removed": removed}

    def _envelope(self, n: dict) -> Any:
        body = self.ports[n["input"]]
        out = {"": R.project(body) if "header" not in n else A.with_header(body, self.ports[n["header"]], n["grain"])}
        if "footer" in n:
            out["footer"] = A.envelope_footer(body, n["grain"], n["footer"])
        return out

    def _composition(self, n: dict) -> Any:
        """A sub-pipeline whose sources name this node's inputs; its sinks are the ports."""
        inner = Pipeline(self.spark, n["pipeline"], {k: self.ports[v] for k, v in n.get("inputs", {}).items()})
        inner.variables |= self.variables
        inner.functions |= self.functions
        ports = inner.build()
        sinks = [x["name"] for x in n["pipeline"]["nodes"] if x["kind"] == "sink"]
        return {"" if len(sinks) == 1 else s: ports[s] for s in sinks}


def column_lineage(p: Pipeline) -> dict[str, dict[str, list[str]]]:
    """For each sink of a built pipeline, its columns and the source columns (node.column) that their values are made of.

    Conditions that only decide whether a row is there don't count.
    """
    made: dict[str, dict[str, set[str]]] = {}

    def names(tree, scope: dict[str, set[str]]) -> set[str]:
        if isinstance(tree, list):
            return set().union(*[names(x, scope) for x in tree])
        if not isinstance(tree, tuple) or not tree:
            return set()
        if tree[0] == "name":
            return scope.get(tree[1], set())
        if tree[0] == "field" and tree[1][0] == "name" and tree[1][1] in ("$doc", "$record"):
            return scope.get(f"_{tree[1][1][1:]}_{tree[2]}", scope.get(f"{tree[1][1]}.{tree[2]}", set()))
        if tree[0] == "field" and tree[1][0] == "name" and f"{tree[1][1]}.{tree[2]}" in scope:
            return scope[f"{tree[1][1]}.{tree[2]}"]
        if tree[0] == "field" and tree[1][0] == "method" and tree[1][1] == ("name", "$window"):
            return scope.get(tree[2], set())
        if tree[0] == "closure":
            return names(tree[2], {k: v for k, v in scope.items() if k != tree[1]})
        return set().union(*[names(x, scope) for x in tree[1:]])

    def run(program: list, scope: dict[str, set[str]], out: dict[str, set[str]]) -> None:
        for st in program:
            if st[0] in ("let", "emit"):
                got = names(st[2], scope)
                scope[st[1]] = got
                if st[0] == "emit":
                    out[st[1]] = got
            elif st[0] == "each":
                run(st[4], scope | {st[1]: names(st[2], scope)}, out)

    for n in ordered(p.spec):
        name, kind = n["name"], n["kind"]
        if kind == "source":
            made[name] = {c: {f"{name}.{c}"} for c in p.ports[name].columns}
            continue
        above = [i.partition(".")[0] for i in _needs(n)]
        before: dict[str, set[str]] = {}
        for i in above:
            for c, x in made[i].items():
                before[c] = before.get(c, set()) | x
        if kind == "combine":
            scope = {f"{k}.{c}": x for k, i in n["inputs"].items() for c, x in made[i.partition(".")[0]].items()}
            out: dict[str, set[str]] = {}
            run(parse_program(n["body"]), scope, out)
        elif kind == "aggregate":
            out = {c: before.get(c, set()) for c in n.get("group_by", [])}
            run(parse_program(n["program"]), dict(before), out)
        elif kind in ("transform", "lookup"):
            out = dict(before)
            run(parse_program(n["program"]), dict(before), out)
        elif kind == "reshape":
            out = dict(before)
            for r in n["rules"]:
                for field, e in {**r.get("mutate", {}), **r.get("synthesize", {}).get("overrides", {})}.items():
                    out[field] = out.get(field, set()) | names(parse_expression(e), before)
        else:
            out = before
        made[name] = out
    return {n["name"]: {c: sorted(made[n["name"]].get(c, set())) for c in p.ports[n["name"]].columns if not c.startswith("_")} for n in p.spec["nodes"] if n["kind"] == "sink"}


def lineage(df: DataFrame) -> list[str]:
    """Files that a frame reads."""
    return sorted(df.inputFiles())


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Any]:
    """df and an observation of aggregate metrics, which cost no pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), seen
