"""python -m plumbline.cli analyze FILE | info | init-config FILE | validate-config FILE"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .errors import EDAError, format_error
from .plans.config import OUTLIER_METHODS, PRESETS, EDAConfig, preset


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Exploratory data analysis on Spark")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="analyse a file and write reports")
    a.add_argument("input")
    a.add_argument("-o", "--output", default="eda_report.html")
    a.add_argument("-f", "--format", action="append", choices=["html", "json", "pdf"], help="may be given again; default by the output's suffix")
    a.add_argument("--quick", action="store_true")
    a.add_argument("--config")
    a.add_argument("--correlation-threshold", type=float)
    a.add_argument("--missing-threshold", type=float)
    a.add_argument("--significance-level", type=float)
    a.add_argument("--outlier-method", choices=OUTLIER_METHODS)
    a.add_argument("--title", default="Data report")
    a.add_argument("--no-viz", action="store_true")
    commands.add_parser("info", help="versions")
    i = commands.add_parser("init-config", help="write a preset")
    i.add_argument("output")
    i.add_argument("--profile", choices=list(PRESETS), default="default")
    v = commands.add_parser("validate-config", help="check a settings file")
    v.add_argument("file")
    return p


def analyze(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .plans.analyzer import EDA
    from .sources.loader import DataLoader

    config = EDAConfig.from_json(args.config) if args.config else EDAConfig()
    changes = {n: getattr(args, n) for n in ("correlation_threshold", "missing_threshold", "significance_level", "outlier_method") if getattr(args, n) is not None}
    eda = EDA(config, **changes)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    eda.analyze(DataLoader(spark).load(args.input), quick=args.quick)
    print(eda.summary())
    output, failed = Path(args.output), 0
    for kind in args.format or [output.suffix[1:] if output.suffix[1:] in ("html", "json", "pdf") else "html"]:
        options = {} if kind == "json" else {"include_visualizations": not args.no_viz and eda.config.include_visualizations}
        try:
            print("wrote", eda.generate_report(output.with_suffix(f".{kind}"), kind, args.title, **options))
        except EDAError as error:
            print(format_error(error, kind), file=sys.stderr)
            failed = 1
    return failed


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        if args.command == "analyze":
            return analyze(args)
        if args.command == "info":
            import numpy
            import pandas
            import pyspark

            print(json.dumps({"python": sys.version.split()[0], "pyspark": pyspark.__version__, "pandas": pandas.__version__, "numpy": numpy.__version__}))
        elif args.command == "init-config":
            preset(args.profile).to_json(args.output)
        else:
            EDAConfig.from_json(args.file, strict=True)
            print("valid")
        return 0
    except (EDAError, OSError, ValueError) as error:
        print(format_error(error, args.command), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
