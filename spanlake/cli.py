"""Command line: totables and torecords."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from spanlake.sources.sinks import FORMATS


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="spanlake", description="Tables and records from OpenTelemetry agent traces.")
    commands = parser.add_subparsers(dest="command")
    for name, formats, text in (("totables", FORMATS, "six tables: spans, messages, documents, links, traces, sessions"), ("torecords", ("json", "jsonl"), "one nested record a trace")):
        p = commands.add_parser(name, help=text)
        p.add_argument("input")
        p.add_argument("output_dir")
        p.add_argument("--format", choices=formats, default=formats[0])
        p.add_argument("--spec", default="at/v2")
        if name == "totables":
            p.add_argument("--batch-size", type=int, default=10_000)
            p.add_argument("--compression", default="zstd")
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 2
    from pyspark.sql import SparkSession

    from spanlake.plans import engine
    from spanlake.sources import otlp

    spark = SparkSession.builder.appName("spanlake").getOrCreate()
    if otlp.kind_of(spark, args.input) is None:
        print(f"error: input path does not exist: {args.input}", file=sys.stderr)
        return 1
    if args.command == "totables":
        for name, path in engine.write_tables(spark, args.input, args.output_dir, args.format, spec=args.spec, batch_size=args.batch_size, compression=args.compression).items():
            print(f"{name}: {path}")
    else:
        path, n = engine.write_records(spark, args.input, args.output_dir, args.format, spec=args.spec)
        print(f"traces: {path} ({n} records)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
