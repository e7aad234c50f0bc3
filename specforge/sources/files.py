"""Reading tables and writing generated ones."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generators import SQL_TYPES
from ..plans.spec import Spec, TableSpec
from .fs import Files

SUFFIXES = (".parquet", ".csv", ".txt", ".tsv", ".jsonl", ".json", ".xlsx", ".xls")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """A table by its suffix; columns are chosen before rows are cut, and unknown ones are all named in the error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix in (".csv", ".txt", ".tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == ".tsv" else ",", multiLine=True, escape='"')
    elif suffix == ".jsonl":
        df = spark.read.json(path)
    elif suffix == ".json":
        df = spark.read.json(path, multiLine=True)
    elif suffix in (".xlsx", ".xls"):
        df = spark.createDataFrame(pd.read_excel(path))
    else:
        raise ValueError(f"no reader for the suffix of {path}; known: {', '.join(SUFFIXES)}")
    if columns:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"unknown columns: {', '.join(missing)}")
        df = df.select(*[f"`{c}`" for c in columns])
    return df.limit(max_rows) if max_rows else df


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{table: frame} of a folder of files, of one JSON file {table: rows}, or of one file; any file system that Spark reads."""
    files, (stem, suffix) = Files(spark), os.path.splitext(path.rstrip("/").rsplit("/", 1)[-1])
    if suffix.lower() not in SUFFIXES:
        if not files.is_folder(path):
            raise ValueError(f"no folder {path}")
        found = {os.path.splitext(n)[0]: read(spark, f"{path}/{n}") for n in files.names(path) if os.path.splitext(n)[1].lower() in SUFFIXES}
        if not found:
            raise ValueError(f"no tables in {path}")
        return found
    if suffix.lower() == ".json" and not files.is_folder(path):
        whole = spark.read.json(path, multiLine=True)
        lists = [f.name for f in whole.schema.fields if isinstance(f.dataType, T.ArrayType)]
        if lists and len(lists) == len(whole.columns):
            rows = lambda c: whole.select(F.explode(f"`{c}`").alias("r"))
            return {c: rows(c).select("r.*") if isinstance(whole.schema[c].dataType.elementType, T.StructType) else rows(c) for c in lists}
    return {stem: read(spark, path)}


def sql_value(c: Column) -> Column:
    text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def ddl(t: TableSpec) -> str:
    """CREATE TABLE for a table of the Spec."""
    lines = []
    for c in t.columns:
        line = f'"{c.name}" {SQL_TYPES.get(c.dtype, "TEXT")}'
        line += " NOT NULL" * (c.nullable is False) + " UNIQUE" * bool(c.constraints.get("unique"))
        lines.append(line + (" PRIMARY KEY" if t.key == [c.name] else ""))
    quote = lambda cols: ", ".join(f'"{c}"' for c in cols)
    if len(t.key) > 1:
        lines.append(f"PRIMARY KEY ({quote(t.key)})")
    lines += [f"UNIQUE ({quote(k)})" for k in t.unique_constraints]
    lines += [f'FOREIGN KEY ({quote(r.columns)}) REFERENCES "{r.parent}" ({quote(r.parent_columns)})' for r in t.relationships]
    return f'CREATE TABLE IF NOT EXISTS "{t.name}" (\n  ' + ",\n  ".join(lines) + "\n);"


def inserts(t: TableSpec, df: DataFrame) -> DataFrame:
    """One INSERT statement a row, as the column `value`."""
    plain = {"int", "float", "bool"}  # other values are quoted text
    vals = [F.coalesce(F.col(f"`{c.name}`").cast("string"), F.lit("NULL")) if c.dtype in plain else sql_value(F.col(f"`{c.name}`")) for c in t.columns]
    head = f'INSERT INTO "{t.name}" ({", ".join(chr(34) + c.name + chr(34) for c in t.columns)}) VALUES ('
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *vals), F.lit(");")).alias("value"))


#: How CSV is written everywhere: quotes are doubled, blanks stay, empty text is quoted; read() takes it for null.
CSV = {"header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_one(df: DataFrame, path: str, fmt: str) -> None:
    """One table to a folder of part files, written by the executors."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.csv(path, **CSV)
    elif fmt in ("json", "jsonl"):
        w.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"no writer for format {fmt}")


def write(tables: dict[str, DataFrame], out: str, fmt: str | None = None, spec: Spec | None = None) -> None:
    """Tables to a folder (<table>.<fmt> each), or to one file where out has a suffix; fmt, the suffix, or csv decides."""
    suffix = os.path.splitext(out)[1].lstrip(".")
    fmt = fmt or suffix or "csv"
    if fmt != "sql" and not suffix:
        for name, df in tables.items():
            write_one(df, f"{out}/{name}.{fmt}", fmt)
    elif fmt in ("sql", "json", "jsonl"):
        _write_single(tables, out if suffix else f"{out}.sql", fmt, spec)
    elif len(tables) != 1:
        raise ValueError(f"{fmt} holds one table a file")
    else:
        write_one(next(iter(tables.values())), out, fmt)


def _write_single(tables: dict[str, DataFrame], out: str, fmt: str, spec: Spec | None) -> None:
    """One file of all tables: lines are made by the executors as part files, whose bytes are then copied one behind another."""
    spark = next(iter(tables.values())).sparkSession
    files, stage = Files(spark), f"{out}.parts-{uuid.uuid4().hex[:8]}"
    quoted = lambda name: json_text(name)
    try:
        pieces: list[str | tuple[str, int]] = []
        order = [t.name for t in sorted(spec.tables, key=lambda t: len(t.relationships)) if t.name in tables] if fmt == "sql" else list(tables)
        for i, name in enumerate(order):
            df, folder = tables[name], f"{stage}/{i}"
            row = F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"})
            if fmt == "sql":
                t = spec.table(name)
                pieces += [ddl(t) + "\n", (folder, 0)]
                lines = inserts(t, df)
            elif fmt == "jsonl":
                pieces.append((folder, 0))
                lines = df.select(F.concat(F.lit("{" + quoted(name) + ": "), row, F.lit("}")).alias("value"))
            else:
                pieces += [("{" if i == 0 else ",") + f"\n  {quoted(name)}: [\n", (folder, 1), "  ]"]
                lines = df.select(F.concat(F.lit(","), row).alias("value"))
            lines.write.text(folder)
        if fmt == "json":
            pieces.append("\n}\n" if order else "{}\n")
        files.write(out, pieces)
    finally:
        files.delete(stage)


def json_text(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False)


class RowSink(Protocol):
    """Where a run's tables go, one by one."""

    def write_table(self, name: str, df: DataFrame) -> None: ...

    def close(self) -> None: ...


class FolderSink:
    """Part files under out/<table>.<fmt>; the first write of a table replaces it, later ones append. A frame without rows adds none."""

    def __init__(self, out: str, fmt: str):
        if fmt not in ("csv", "jsonl", "parquet"):
            raise ValueError(f"no writer for format {fmt}")
        self.out, self.fmt, self.seen = out, fmt, set()

    def write_table(self, name: str, df: DataFrame) -> None:
        w = df.write.mode("append" if name in self.seen else "overwrite")
        self.seen.add(name)
        path = f"{self.out}/{name}.{self.fmt}"
        if self.fmt == "csv":
            w.csv(path, **CSV)
        elif self.fmt == "jsonl":
            w.option("ignoreNullFields", "false").json(path)
        else:
            w.parquet(path)

    def close(self) -> None:
        pass


def publish(spark: SparkSession, out: str, fill: Callable[[str], None]) -> None:
    """Fill a staging folder beside out, then swap it in; what was there comes back if anything fails."""
    files, tag = Files(spark), uuid.uuid4().hex[:8]
    stage, backup = f"{out}-staging-{tag}", f"{out}-backup-{tag}"
    try:
        fill(stage)
        had = files.exists(out)
        if had:
            files.rename(out, backup)
        try:
            files.rename(stage, out)
        except Exception:
            if had:
                files.rename(backup, out)
            raise
        if had:
            files.delete(backup)
    finally:
        files.delete(stage)


def report_payload(report: dict, inputs: dict, spec: Spec | None = None, thresholds: dict | None = None) -> dict:
    return {"tool_version": "0.1.0", "inputs": inputs, "spec": None if spec is None else {"version": spec.spec_version, "tables": [t.name for t in spec.tables]}, "thresholds": thresholds or {}, **report}
