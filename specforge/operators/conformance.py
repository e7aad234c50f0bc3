"""Whether data obeys its Spec: one wide aggregation a table, an anti-join a relationship, a left join a rule's parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule, frame_resolver
from ..plans.spec import Spec, TableSpec, expand_many_to_many

#: How much a declared null rate may be exceeded before it is a warning.
NULL_RATE_SLACK = 0.05
Check = tuple[str, str, str, int]


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Distinct child keys, without null parts, that the parent does not have."""
    keys = child.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]).dropna().distinct()
    known = parent.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(parent_columns)])
    return keys.join(known, reduce(lambda a, b: a & b, [F.col(f"k{i}") == F.col(f"p{i}") for i in range(len(columns))]), "left_anti")


def rule_violations(tables: dict[str, DataFrame], t: TableSpec, if_semantics: str = "filter") -> DataFrame:
    """The rows of a table that fail at least one rule; a missing parent's columns count as null."""
    df, parents = tables[t.name], {}
    rules = [Rule(r, if_semantics) for r in t.rules]
    used = {a for r in rules for a in r.parent_aliases}
    for r in t.relationships:
        if not ({r.name, r.parent} & used) or r.parent not in tables:
            continue
        p = tables[r.parent]
        side = p.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(r.parent_columns)], F.struct(*[f"`{c}`" for c in p.columns]).alias(f"__p_{r.name}")).dropDuplicates([f"__k{i}" for i in range(len(r.columns))])
        df = df.join(side, reduce(lambda a, b: a & b, [df[f"`{c}`"] == side[f"__k{i}"] for i, c in enumerate(r.columns)]), "left").drop(*[f"__k{i}" for i in range(len(r.columns))])
        parents[r.name] = p.schema
        if r.parent not in parents:
            df = df.withColumn(f"__p_{r.parent}", F.col(f"__p_{r.name}"))
            parents[r.parent] = p.schema
    resolve = frame_resolver(tables[t.name].schema, parents)
    ok = reduce(lambda a, b: a & b, [r.check(resolve) for r in rules], F.lit(True))
    return df.filter(~ok).select(*[f"`{c}`" for c in tables[t.name].columns])


def unordered_groups(df: DataFrame, columns: list[str], order_column: str, row_order: str) -> DataFrame:
    """Parents whose children's order_column does not rise strictly in row order."""
    w = Window.partitionBy(*[f"`{c}`" for c in columns]).orderBy(row_order)
    bad = F.col(f"`{order_column}`") <= F.lag(f"`{order_column}`").over(w)
    return df.select(*[f"`{c}`" for c in columns], bad.alias("bad")).filter("bad").select(*[f"`{c}`" for c in columns]).distinct()


def check_table(tables: dict[str, DataFrame], t: TableSpec, if_semantics: str = "filter", row_order: str | None = None, bounds: bool = False) -> list[Check]:
    """(table, check, status, violations) of one table. bounds: also check children per parent, which verdicts do not count otherwise."""
    out: list[Check] = []
    if t.name not in tables:
        return [(t.name, "table_present", "fail", 1)]
    df = tables[t.name]
    missing = [c.name for c in t.columns if c.name not in df.columns]
    if missing:
        return [(t.name, f"columns_present:{','.join(missing)}", "fail", len(missing))]
    row = lambda cols: F.struct(*[f"`{c}`" for c in cols])
    keys = [("primary_key", t.key)] * bool(t.key) + [(f"unique:{','.join(k)}", k) for k in t.unique_constraints]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_distinct(row(k)).alias(f"k{i}") for i, (_, k) in enumerate(keys)]
    for i, c in enumerate(t.columns):
        aggs.append(F.count_if(F.col(f"`{c.name}`").isNull()).alias(f"null{i}"))
        if c.constraints.get("unique"):
            aggs.append((F.count(f"`{c.name}`") - F.count_distinct(f"`{c.name}`")).alias(f"dup{i}"))
    r = df.agg(*aggs).first()
    out.append((t.name, "row_count", "pass" if r["n"] == t.row_count else "warn", abs(r["n"] - t.row_count)))
    out += [(t.name, name, "fail" if r["n"] - r[f"k{i}"] else "pass", r["n"] - r[f"k{i}"]) for i, (name, _) in enumerate(keys)]
    for i, c in enumerate(t.columns):
        if c.constraints.get("unique"):
            out.append((t.name, f"column_unique:{c.name}", "fail" if r[f"dup{i}"] else "pass", r[f"dup{i}"]))
        if c.nullable is False:
            out.append((t.name, f"not_null:{c.name}", "fail" if r[f"null{i}"] else "pass", r[f"null{i}"]))
        rate = c.constraints.get("null_rate", 0) or 0
        if rate > 0:
            over = r["n"] > 0 and r[f"null{i}"] / r["n"] > rate + NULL_RATE_SLACK
            out.append((t.name, f"null_rate:{c.name}", "warn" if over else "pass", r[f"null{i}"]))
    for rel in t.relationships:
        label = ",".join(rel.columns)
        if rel.parent not in tables:
            out.append((t.name, f"foreign_key:{label}", "fail", 1))
            continue
        n = orphans(df, tables[rel.parent], rel.columns, rel.parent_columns).count()
        out.append((t.name, f"foreign_key:{label}", "fail" if n else "pass", n))
        by = row_order if row_order in df.columns else next((c.name for c in t.columns if c.generator == "sequence"), None)
        if rel.ordered and rel.order_column and by:
            n = unordered_groups(df, rel.columns, rel.order_column, by).count()
            out.append((t.name, f"ordered:{label}", "fail" if n else "pass", n))
        if bounds and (rel.min_children or rel.max_children is not None):
            kids = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rel.columns)]).groupBy(*[f"k{i}" for i in range(len(rel.columns))]).count()
            p = tables[rel.parent].select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rel.parent_columns)])
            c = F.coalesce("count", F.lit(0))
            n = p.join(kids, [f"k{i}" for i in range(len(rel.columns))], "left").filter((c < (rel.min_children or 0)) | (c > (rel.max_children if rel.max_children is not None else 2**62))).count()
            out.append((t.name, f"children:{label}", "fail" if n else "pass", n))
    if t.rules:
        n = rule_violations(tables, t, if_semantics).count()
        out.append((t.name, "rules", "fail" if n else "pass", n))
    return out


class SpecConformance:
    def __init__(self, checks: list[Check]):
        self.checks = checks

    @property
    def overall_ok(self) -> bool:
        return all(s != "fail" for _, _, s, _ in self.checks)

    def to_dict(self, full: bool = True) -> dict:
        keep = [c for c in self.checks if full or c[2] != "pass"]
        return {"verdict": "CONFORMS" if self.overall_ok else "VIOLATES", "checks": [dict(zip(("table", "check", "status", "violations"), c)) for c in keep]}

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.checks, "table string, check string, status string, violations long")


def validate_against_spec(tables: dict[str, DataFrame], spec: Spec, row_order: str | None = None, bounds: bool = False) -> SpecConformance:
    spec = expand_many_to_many(spec)
    return SpecConformance([c for t in spec.tables for c in check_table(tables, t, spec.settings.if_semantics, row_order, bounds)])
