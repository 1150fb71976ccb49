"""Command line: prepare, run, report, query."""

from __future__ import annotations

import argparse
import json


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("prepare", help="validated samples of a table folder, with a manifest")
    x.add_argument("tables")
    x.add_argument("output")
    x = sub.add_parser("run", help="fit and evaluate a model by a JSON config")
    x.add_argument("prepared")
    x.add_argument("config")
    x.add_argument("output")
    x.add_argument("--model")
    x.add_argument("--seed", type=int)
    x = sub.add_parser("report", help="a CSV of complete, unchanged runs")
    x.add_argument("output")
    x.add_argument("runs", nargs="+")
    x = sub.add_parser("query", help="write a named query's rows as Parquet")
    x.add_argument("name")
    x.add_argument("tables")
    x.add_argument("output")
    a = p.parse_args(argv)
    if a.command == "report":
        from .provenance import report

        print(json.dumps(report(a.runs, a.output)))
    elif a.command == "prepare":
        from .operators.splits import require_valid
        from .plans.relations import samples
        from .provenance import write_frame

        print(json.dumps(write_frame(require_valid(samples(session(), a.tables)), a.output)))
    elif a.command == "run":
        from .runner import load_config, run

        config = load_config(a.config) | {k: v for k, v in (("model", a.model), ("seed", a.seed)) if v is not None}
        print(json.dumps(run(session(), a.prepared, a.output, config)))
    else:
        from .plans.queries import queries

        queries()[a.name](session(), a.tables).write.mode("errorifexists").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
