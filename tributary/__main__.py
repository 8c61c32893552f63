"""Command line: run or check pipelines, evaluate programs on one record.

    python -m tributary run plan.yaml [--set name=value] [--overlay patch.yaml] [--limit n] [--explain] [--check]
    python -m tributary eval 'emit x = a + 1' --record '{"a": 1}' [--schema 'a long']
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tributary.operators.rows import transform
from tributary.plans import pipeline


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def schema_of(spark: SparkSession, record: str) -> str:
    return spark.range(1).select(F.schema_of_json(F.lit(record))).first()[0]


def plan(args: argparse.Namespace) -> dict:
    """The spec with overlays, variables and the row limit applied."""
    with open(args.plan, encoding="utf-8") as f:
        spec = pipeline.load(f.read())
    for path in args.overlay:
        with open(path, encoding="utf-8") as f:
            spec = pipeline.overlay(spec, pipeline.load(f.read()))
    spec = pipeline.overlay(spec, {"vars": {k: _value(v) for k, _, v in (x.partition("=") for x in args.set)}})
    if args.limit is not None:
        for n in spec["nodes"]:
            if n["kind"] == "source":
                n["limit"] = args.limit
    return spec


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tributary")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="build a pipeline and write its sinks")
    run.add_argument("plan")
    run.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a variable")
    run.add_argument("--overlay", action="append", default=[])
    run.add_argument("--limit", type=int, help="rows a source")
    run.add_argument("--explain", action="store_true", help="print plans, write nothing")
    run.add_argument("--check", action="store_true", help="compile all nodes, write nothing")
    one = commands.add_parser("eval", help="a program on one record")
    one.add_argument("program")
    one.add_argument("--record", default="{}")
    one.add_argument("--schema", help="as Spark writes it; from the record unless given")
    args = parser.parse_args(argv)
    try:
        spec = plan(args) if args.command == "run" else None
        order = pipeline.ordered(spec) if spec else []
        spark = spark or SparkSession.builder.appName("tributary").getOrCreate()
        if args.command == "eval":
            schema = args.schema or schema_of(spark, args.record)
            row = spark.createDataFrame([(args.record,)], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
            print("\n".join(r[0] for r in transform(row, args.program).select(F.to_json(F.struct('*'), {'ignoreNullFields': 'false'})).collect()))
            return 0
        p = pipeline.Pipeline(spark, spec)
        if args.check or args.explain:
            p.build()
            for n in order if args.explain else []:
                if n["name"] in p.ports:
                    print(f"== {n['name']}\n{p.explain(n['name'])}")
            print(f"{len(order)} nodes")
            return 0
        print("\n".join(p.run()))
    except (pipeline.PlanFault, ValueError, TypeError, OSError) as e:
        print(f"tributary: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
