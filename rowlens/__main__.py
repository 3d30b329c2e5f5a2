"""Command line: ``python -m rowlens LEFT RIGHT [options]``, ``schema LEFT RIGHT``, ``snapshot INPUT --output PATH``,
``INPUT --against PATH``. Exit codes: 0 equal or within budget, 1 different, 2 error."""

from __future__ import annotations

import argparse
import json
import sys
from contextlib import nullcontext

from pyspark.sql import SparkSession

import rowlens
from rowlens import api
from rowlens.errors import DiffError
from rowlens.output import reports
from rowlens.output.progress import Progress, on_terminal
from rowlens.plans.options import Options


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise DiffError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="rowlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    add = p.add_argument
    add("inputs", nargs="*")
    add("--key", default="", help="key columns, by commas; inferred if left out")
    add("--keyless", action="store_true", help="compare whole rows as a multiset")
    add("--where", action="append", default=[], help="column OP literal, joined by AND; may be repeated")
    add("--ignore-columns", default="")
    add("--rename", action="append", default=[], metavar="RIGHT=LEFT")
    add("--format", default="human", choices=("human", "json", "markdown"))
    add("--report", action="append", default=[], help="write a report; .html or markdown; may be repeated")
    add("--limit", type=int, default=10)
    add("--verbose", action="store_true")
    add("--summary", action="store_true", help="counts only")
    add("--output", help="differing rows as .csv or .parquet; the baseline's path for snapshot")
    add("--mask", default="")
    add("--float-precision", type=int, default=0)
    add("--tolerance", action="append", default=[])
    add("--ignore-case", action="store_true")
    add("--trim", action="store_true")
    add("--timestamp-precision", default="")
    add("--infer-rows", type=int, default=1000)
    add("--delimiter", default="")
    add("--on-dup", default="error")
    add("--mode", default="auto")
    add("--tmpdir", help="accepted; Spark's local folders are set by the session")
    add("--max-diff")
    add("--against", help="a baseline to compare one input with")
    add("--progress", action="store_true", help="tasks done on standard error, also where it is no terminal")
    add("--version", action="store_true")
    for name in ("--cpuprofile", "--memprofile"):
        add(name, help="accepted; see the session's event log")
    return p


def options_of(a: argparse.Namespace) -> Options:
    names = lambda s: [x.strip() for x in s.split(",") if x.strip()]
    renames: dict[str, str] = {}
    for spec in (x for r in a.rename for x in r.split(",")):
        old, eq, new = (x.strip() for x in spec.partition("="))
        if not eq or not old or not new:
            raise DiffError(f"rename: expected RIGHT=LEFT, not {spec!r}")
        if old in renames:
            raise DiffError(f"rename: {old!r} has two targets")
        renames[old] = new
    return Options(
        key=names(a.key), keyless=a.keyless, where=a.where, ignore_columns=names(a.ignore_columns), rename=renames, mask=names(a.mask), float_precision=a.float_precision,
        ignore_case=a.ignore_case, trim=a.trim, timestamp_precision=a.timestamp_precision, tolerance=a.tolerance or None, on_dup=a.on_dup, mode=a.mode, summary=a.summary,
        max_diff=a.max_diff, limit=a.limit, output=a.output, infer_rows=a.infer_rows, delimiter=a.delimiter,
    )


def session() -> SparkSession:
    spark = SparkSession.builder.appName("rowlens").config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def show(text: str) -> None:
    print(text, flush=True)


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_intermixed_args(argv)
    if a.version:
        show(rowlens.__version__)
        return 0
    command = a.inputs.pop(0) if a.inputs and a.inputs[0] in ("diff", "schema", "snapshot") else "diff"
    options = options_of(a)
    need = 1 if command == "snapshot" or a.against else 2
    if len(a.inputs) != need:
        raise DiffError(f"{command} takes {need} input{'s' * (need > 1)}, not {len(a.inputs)}")
    if command == "snapshot":
        if not a.output:
            raise DiffError("snapshot needs --output, the baseline's path")
        options.output = None
    options.check()
    spark = spark or session()
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if command == "schema":
        s = api.schema_diff(spark, *a.inputs, options)
        show(reports.schema_json(s) if a.format == "json" else reports.human_schema(s))
        return 0 if s.same else 1
    if command == "snapshot":
        header = api.create_baseline(spark, a.inputs[0], a.output, options)
        show(json.dumps(header) if a.format == "json" else f"{header['rows']} rows, key {','.join(header['keys'])}, written to {a.output}")
        return 0
    if a.against:
        if a.summary or a.output:
            raise DiffError("a baseline holds hashes: summary and output do not apply")
        result = api.diff_baseline(spark, a.against, a.inputs[0], options)
    else:
        with Progress(spark, on_terminal) if a.progress or sys.stderr.isatty() else nullcontext():
            result = api.diff(spark, *a.inputs, options)
        if sys.stderr.isatty():
            sys.stderr.write("\r\x1b[K")
    for note in result.notes:
        print(note, file=sys.stderr)
    show(result.to_json() if a.format == "json" else reports.markdown(result, a.limit) if a.format == "markdown" else reports.human(result, a.limit, a.verbose))
    for path in a.report:
        reports.write_report(result, path, a.limit)
    code = result.exit_code(a.max_diff)
    if code == 0 and not result.same:
        print("differences are within the budget", file=sys.stderr)
    return code


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except DiffError as e:
        print(f"error: {e}", file=sys.stderr)
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
    except Exception as e:  # Spark's failures while scanning
        print(f"error: {str(e).splitlines()[0][:300] if str(e) else type(e).__name__}", file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main())
