"""Command line: ``python -m tickloom.cli FILE [options]``. Exit code 0: clean, or compared; 1: findings; 2: no report."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import NoReturn

from pyspark.sql import SparkSession

from tickloom import service
from tickloom.operators.calendars import PROFILES
from tickloom.sinks import reports
from tickloom.sources.benchmark_store import BenchmarkStore
from tickloom.sources.csv_scan import CsvOptions, ScanError
from tickloom.validation import Fatal


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> NoReturn:
        raise Fatal("INVALID_ARGUMENT", message, "Use --help for usage.")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tickloom", description="Judges the quality of a delimited candle file.")
    p.add_argument("file", nargs="?")
    p.add_argument("--timeframe", help="M<n>, H<n> or D<n>; found from the data by default")
    p.add_argument("--market", choices=PROFILES, default="forex")
    p.add_argument("--calendar", help="custom calendar, or hours for equities")
    p.add_argument("--date-format")
    p.add_argument("--time-format")
    p.add_argument("--timestamp-format")
    p.add_argument("--timestamp-column", help="a header name or a number from 1")
    p.add_argument("--tz-offset", default="+02:00")
    p.add_argument("--delimiter", help="comma, semicolon, tab or a character")
    p.add_argument("--header", action="store_true", help="match columns by name")
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--report-version", type=int, choices=(1, 2), default=1)
    p.add_argument("--output", help="write the report to a file, all or nothing")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--score", action="store_true")
    p.add_argument("--score-weights")
    p.add_argument("--instrument")
    p.add_argument("--benchmark", help="establish a benchmark of this name")
    p.add_argument("--benchmark-dir", default="./benchmarks/")
    p.add_argument("--benchmark-delete", metavar="NAME")
    p.add_argument("--yes", action="store_true", help="delete without asking")
    p.add_argument("--compare", metavar="NAME")
    p.add_argument("--tolerances", help="JSON")
    return p


def check(a: argparse.Namespace) -> None:
    """Conflicts between options, found before the file is opened."""

    def no(reason: str) -> None:
        raise Fatal("INVALID_ARGUMENT", reason, "Use --help for usage.")

    if a.file is None:
        no("An input file is required.")
    if a.report_version == 2 and a.format != "json":
        no("--report-version 2 goes with --format json only.")
    if a.score_weights is not None and not a.score:
        no("--score-weights requires --score.")
    if a.score and a.format == "json" and a.report_version != 2:
        no("--score isn't available under JSON version 1.")
    if a.benchmark and a.compare:
        no("--benchmark and --compare exclude each other.")
    if (a.benchmark or a.compare) and not a.score:
        no("Benchmark operations require --score.")
    if (a.benchmark or a.compare) and not (a.instrument or "").strip():
        no("--benchmark and --compare require --instrument.")
    if a.tolerances is not None and not a.compare:
        no("--tolerances requires --compare.")


def _delete(spark: SparkSession, a: argparse.Namespace) -> int:
    store = BenchmarkStore(spark, a.benchmark_dir)
    if not store.exists(a.benchmark_delete):
        raise Fatal("INVALID_ARGUMENT", f"There is no benchmark {a.benchmark_delete}.")
    if not a.yes and input(f"Delete benchmark {a.benchmark_delete}? [y/N] ").strip().lower() not in ("y", "yes"):
        return 0
    store.delete(a.benchmark_delete)
    return 0


def _lines(a: argparse.Namespace, made: service.Result):
    if a.format == "json":
        yield from reports.json_v2(made.report, made.comparison) if a.report_version == 2 else reports.json_v1(made.report)
        return
    if a.verbose:
        yield from reports.verbose_text(made.report)
    else:
        yield from reports.text_v1(made.report)
        if made.report.score:
            yield ""
            yield from reports.scoring_section(made.report.score)
    if made.comparison:
        yield ""
        yield from reports.comparison_text(made.comparison)


def run(spark: SparkSession, arguments: Sequence[str]) -> int:
    wants_json = "2" in [b for x, b in zip(arguments, arguments[1:], strict=False) if x == "--report-version"]
    try:
        a = parser().parse_args(list(arguments))
        if a.benchmark_delete:
            return _delete(spark, a)
        check(a)
        try:
            csv = CsvOptions(a.header, a.delimiter, a.date_format, a.time_format, a.timestamp_format, a.timestamp_column, a.tz_offset)
        except ScanError as e:
            raise Fatal(e.code, e.reason) from e
        operation = service.ESTABLISH if a.benchmark else service.COMPARE if a.compare else service.VALIDATE
        options = service.RunOptions(csv, a.market, a.calendar, a.timeframe, 2 if a.score else a.report_version, a.score, a.score_weights, a.instrument, a.benchmark or a.compare, a.tolerances)
        store = BenchmarkStore(spark, a.benchmark_dir)
        made = service.run_operation(spark, a.file, operation, options, store)
        try:
            if a.output:
                with reports.staged(a.output, a.file) as out:
                    reports.write_lines(_lines(a, made), out)
            else:
                reports.write_lines(_lines(a, made), sys.stdout)
        except BaseException:
            if operation == service.ESTABLISH:  # a benchmark goes with its report
                store.delete(a.benchmark)
            raise
        finally:
            made.report.prepared.release()
        return 0 if made.comparison or made.report.clean else 1
    except Fatal as e:
        if wants_json:
            sys.stdout.write(reports.fatal_json(e) + "\n")
        else:
            sys.stderr.write(f"{e.code}: {e.reason} {e.guidance}\n")
        return 2


def main() -> int:
    spark = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
