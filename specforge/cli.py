"""Commands: generate, list-generators, init, validate, profile, compare, quality, diagnose, check.

Exit codes: 0 passed, 1 a gate failed, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from .functions.generators import BUILTINS, CUSTOM
from .functions.providers import PROVIDERS
from .functions.rules import RuleError
from .operators import metrics
from .operators.conformance import validate_against_spec
from .operators.disclosure import DisclosureBudget, DisclosureReport, check_budget
from .operators.engine import Engine, generate
from .operators.profile import Profiler, merge_preserving_edits, stamped
from .plans.spec import RuleViolation, SpecError, from_file, to_file
from .sources.files import FolderSink, publish, read, read_tables, report_payload

STARTER = """spec_version: "1.0"
settings: {seed: 42}
tables:
  - name: users
    row_count: 100
    primary_key: id
    columns:
      - {name: id, dtype: int, generator: sequence}
      - {name: email, dtype: str, generator: faker.email}
      - {name: age, dtype: int, generator: int, params: {min: 18, max: 90}}
    rules: ["age >= 18"]
"""


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specforge")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("generate")
    _spec(a)
    a.add_argument("--out", required=True)
    a.add_argument("--format", choices=["csv", "json", "jsonl", "parquet", "sql"])
    a.add_argument("--seed", type=int)
    a.add_argument("--stream", action="store_true", help="write each table as soon as it is planned, csv or jsonl")
    a.add_argument("--chunk-size", type=int, help="rows of a table that are written at once with --stream")
    a.add_argument("--progress", action="store_true")
    a.add_argument("--vectorized", action=argparse.BooleanOptionalAction, default=True, help="accepted for compatibility: columns are always made whole")
    sub.add_parser("list-generators")
    a = sub.add_parser("init")
    a.add_argument("path", nargs="?", default="spec.yaml")
    a.add_argument("--out", dest="path_option")
    a = sub.add_parser("validate")
    _spec(a)
    a.add_argument("--migrate-out")
    a = sub.add_parser("profile")
    a.add_argument("data", nargs="+")
    a.add_argument("--out", required=True)
    a.add_argument("--columns", nargs="*", type=lambda x: x.split(","))
    a.add_argument("--max-rows", type=int)
    a.add_argument("--sample", type=int, help="profile shapes on this many rows; counts, keys and nulls still come from all")
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--min-cell-count", type=int, default=5)
    a.add_argument("--max-categories", type=int, default=50)
    a.add_argument("--max-categorical-ratio", type=float, default=0.5)
    a.add_argument("--fd-max-lhs", type=int, default=3)
    a.add_argument("--fd-error", type=float, default=0.0)
    a.add_argument("--pii", nargs="*", default=[], metavar="COLUMN", help="treat these columns as personal")
    a.add_argument("--no-pii", nargs="*", default=[], metavar="COLUMN", help="never treat these as personal")
    a.add_argument("--pii-strategy", choices=["faker", "mask", "redact", "hash"], default="faker")
    for flag in ("--redact", "--discover-fds", "--no-condition-on-fds", "--no-discover-keys", "--no-detect-pii"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--merge-into")
    a.add_argument("--disclosure-mode", choices=["off", "warning", "error"], default="off")
    for flag in ("--max-categorical-values", "--max-rare-values", "--max-conditional-cells"):
        a.add_argument(flag, type=int)
    for name in ("compare", "quality", "diagnose"):
        a = sub.add_parser(name)
        a.add_argument("real")
        a.add_argument("synthetic")
        a.add_argument("--spec")
        a.add_argument("--table")
        a.add_argument("--report")
        if name == "quality":
            a.add_argument("--min-score", type=float)
            a.add_argument("--seed", type=int, default=0)
        if name == "diagnose":
            a.add_argument("--tolerance", type=float, default=0.0)
    a = sub.add_parser("check")
    a.add_argument("data")
    _spec(a)
    a.add_argument("--report")
    a.add_argument("--row-order", help="the column that orders rows, for ordered children; else a sequence column of the Spec")
    a.add_argument("--bounds", action="store_true")
    return p


def _spec(a: argparse.ArgumentParser) -> None:
    a.add_argument("spec", nargs="?")
    a.add_argument("--spec", dest="spec_option")


def _stream(spark, engine: Engine, out: str, fmt: str, chunk: int | None, progress: bool) -> None:
    """Each table goes to the sink as soon as it is planned, in slices of rows if asked."""
    if chunk is not None and chunk <= 0:
        raise ValueError("chunk size must be above 0")
    sink = FolderSink(out, fmt)

    def take(name: str, df) -> None:
        rows, step = engine._rows(name), chunk or engine._rows(name) or 1
        for at in range(0, max(1, rows), step):
            sink.write_table(name, df.filter(f"_rid > {at} AND _rid <= {at + step}").drop("_rid") if chunk else df.drop("_rid"))
            if progress:
                print(f"{name}: {min(rows, at + step)} of {rows} rows", file=sys.stderr)

    engine.run(take, with_id=True)
    sink.close()


def _emit(report: dict, a: argparse.Namespace, ok: bool, spec=None) -> int:
    text = json.dumps(report_payload(report, {k: v for k, v in vars(a).items() if isinstance(v, str)}, spec), indent=2, default=str)
    Path(a.report).write_text(text) if a.report else print(text)
    return 0 if ok else 1


def run(a: argparse.Namespace) -> int:
    if a.command == "list-generators":
        print("\n".join([*sorted(BUILTINS), "fk", *[f"faker.{p}" for p in sorted(PROVIDERS)], *[f"custom:{c}" for c in sorted(CUSTOM)]]))
        return 0
    if a.command == "init":
        target = Path(a.path_option or a.path)
        if target.exists():
            raise ValueError(f"{target} exists")
        target.write_text(STARTER)
        return 0
    from pyspark.sql import SparkSession

    if hasattr(a, "spec_option"):
        a.spec = a.spec_option or a.spec
        if not a.spec:
            raise ValueError("a Spec is needed")
    if a.command == "validate":
        from .operators.engine import validate
        from .plans.spec import expand_many_to_many

        spec = from_file(a.spec)
        validate(expand_many_to_many(spec))
        if a.migrate_out:
            to_file(spec, a.migrate_out)
        return 0
    spark = SparkSession.builder.appName("specforge").getOrCreate()
    if a.command == "generate":
        spec = from_file(a.spec)
        if a.seed is not None:
            spec.settings.seed = a.seed
        suffix = os.path.splitext(a.out)[1].lstrip(".")
        fmt = a.format or suffix or spec.settings.default_format or "csv"
        if a.stream or a.chunk_size is not None:
            if fmt not in ("csv", "jsonl", "parquet") or suffix:
                raise ValueError("--stream writes csv, jsonl or parquet to a folder")
            engine = Engine(spark, spec)
            publish(spark, a.out, lambda stage: _stream(spark, engine, stage, fmt, a.chunk_size, a.progress))
            return 0
        result = generate(spark, spec)
        if suffix or fmt == "sql":
            result.write(a.out, fmt)
        else:
            publish(spark, a.out, lambda stage: result.write(stage, fmt))
        if a.progress:
            print("\n".join(f"{n}: {df.count()} rows" for n, df in result.tables.items()), file=sys.stderr)
        result.close()
        return 0
    if a.command == "profile":
        columns = [c for group in a.columns or [] for c in group] or None
        tables = {}
        for path in a.data:
            tables |= {Path(path).stem: read(spark, path, columns, a.max_rows)} if Path(path).suffix and len(a.data) + bool(columns or a.max_rows) > 1 else read_tables(spark, path)
        profiler = Profiler(a.min_cell_count, a.redact, a.discover_fds, not a.no_condition_on_fds, not a.no_discover_keys, not a.no_detect_pii, a.max_categories, max_categorical_ratio=a.max_categorical_ratio, sample=a.sample, seed=a.seed, max_lhs=a.fd_max_lhs, fd_error=a.fd_error, personal=a.pii, not_personal=a.no_pii, pii_strategy=a.pii_strategy)
        spec = stamped(profiler.profile_set(tables))
        if a.merge_into:
            spec, _ = merge_preserving_edits(from_file(a.merge_into), spec)
        report = DisclosureReport.from_spec(spec)
        over = check_budget(report, DisclosureBudget(a.max_categorical_values, a.max_rare_values, a.max_conditional_cells))
        if over and a.disclosure_mode != "off":
            print("\n".join(over), file=sys.stderr)
            if a.disclosure_mode == "error":
                return 1
        to_file(spec, a.out)
        print(report.to_text(), file=sys.stderr)
        return 0
    if a.command == "check":
        spec = from_file(a.spec)
        got = validate_against_spec(read_tables(spark, a.data), spec, row_order=a.row_order, bounds=a.bounds)
        return _emit(got.to_dict(), a, got.overall_ok, spec)
    real, synth, spec = read(spark, a.real), read(spark, a.synthetic), from_file(a.spec) if a.spec else None
    if a.command == "compare":
        got = metrics.compare(real, synth, declared=metrics.spec_kinds(spec, a.table)[0])
        return _emit(got, a, got["passed"], spec)
    if a.command == "quality":
        got = metrics.quality_report(real, synth, spec, a.table, a.seed)
        return _emit(got, a, a.min_score is None or got["overall"] >= a.min_score, spec)
    got = metrics.diagnostic_report(real, synth, spec, a.table, tolerance=a.tolerance)
    return _emit(got, a, got["passed"], spec)


def main(argv: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return run(a)
    except (RuleViolation,) as e:
        print(e, file=sys.stderr)
        return 1
    except (SpecError, RuleError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
