"""How closely synthetic data resembles real data.

Every metric is one aggregation over side-tagged rows. KS is summed over values in two steps (within hash-free ranges of
the value, then over range totals), so one column's values never pass through a single task.
"""

from __future__ import annotations

import itertools
import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Spec
from ..sources.storage import checkpointed, drop

NAN = float("nan")
#: Pairs of columns scored, and equal-width bins of a continuous column in a pair.
MOST_PAIRS, PAIR_BINS = 1000, 10
#: Thresholds for pass and warn by kind, on a distance.
LIMITS = {"numeric": (0.1, 0.2), "categorical": (0.1, 0.25), "boolean": (0.1, 0.2), "datetime": (0.1, 0.2), "text": (0.35, 0.6)}


def clean(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col


def number(df: DataFrame, c: str) -> Column:
    """A number that keeps the order: dates and times as microseconds."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return F.unix_micros(F.try_to_timestamp(F.col(f"`{c}`"))).cast("double")
    return clean(df, c).cast("double")


def sided(real: DataFrame, synth: DataFrame, pick) -> DataFrame:
    """v and side (0 real, 1 synthetic) without nulls."""
    both = real.select(pick(real).alias("v"), F.lit(0).alias("side")).unionAll(synth.select(pick(synth).alias("v"), F.lit(1).alias("side")))
    return both.filter(F.col("v").isNotNull())


def _first(df: DataFrame, name: str = "value") -> float:
    v = df.first()[name]
    return NAN if v is None else float(v)


def _ranged(by: DataFrame, order: list[str], sums: list[str], groups: list[str] | None = None) -> DataFrame:
    """by, dealt into ranges of `order` and written, with `p` (its range) and for each sum `c_<sum>`, cumulated over its group.

    The ranges are written before their totals are taken, so both see the same ones; a total for each range and group meets on the driver.
    """
    groups = groups or []
    parts = checkpointed(by.repartitionByRange(*groups, *order).withColumn("p", F.spark_partition_id()))
    totals = parts.groupBy(*groups, "p").agg(*[F.sum(x).alias(x) for x in sums]).orderBy(*groups, "p").collect()
    rows, acc, last = [], [0] * len(sums), None
    for r in totals:
        if (key := tuple(r[g] for g in groups)) != last:
            acc, last = [0] * len(sums), key
        rows.append((*key, r["p"], *acc))
        acc = [x + r[k] for x, k in zip(acc, sums)]
    kinds = ", ".join([*[f"g{i} {by.schema[g].dataType.simpleString()}" for i, g in enumerate(groups)], "q int", *[f"o_{x} long" for x in sums]])
    offs = by.sparkSession.createDataFrame(rows, kinds)
    run = Window.partitionBy(*groups, "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(g) == F.col(f"g{i}") for i, g in enumerate(groups)], F.col("p") == F.col("q"))
    cum = parts.withColumns({f"c_{x}": F.sum(x).over(run) for x in sums}).join(F.broadcast(offs), same)  # one row a range and group
    return cum.withColumns({f"c_{x}": F.col(f"c_{x}") + F.col(f"o_{x}") for x in sums}).drop("q", *[f"g{i}" for i in range(len(groups))], *[f"o_{x}" for x in sums])


def _gap(r: str, s: str, nr: str = "nr", ns: str = "ns") -> Column:
    return F.abs(F.col(r) / F.nullif(F.col(nr), F.lit(0)) - F.col(s) / F.nullif(F.col(ns), F.lit(0)))


def ks_frame(both: DataFrame) -> DataFrame:
    """One row `value`: 1 - the largest gap between the sides' distribution functions."""
    cum = _ranged(both.groupBy("v").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s")), ["v"], ["r", "s"])
    total = cum.agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    return cum.join(F.broadcast(total)).agg((1 - F.max(_gap("c_r", "c_s"))).alias("value"))  # one row


def tv_frame(both: DataFrame, keys: tuple[str, ...] = ("v",)) -> DataFrame:
    """One row `value`: 1 - half the summed gaps between the sides' frequencies."""
    by = both.groupBy(*keys).agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s"))
    total = by.agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    gap = F.abs(F.col("r") / F.nullif(F.col("nr"), F.lit(0)) - F.col("s") / F.nullif(F.col("ns"), F.lit(0)))
    return by.join(F.broadcast(total)).agg((1 - 0.5 * F.sum(gap)).alias("value"))


def ks_complement(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(ks_frame(sided(real, synth, lambda d: number(d, c))))


def tv_complement(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(tv_frame(sided(real, synth, lambda d: clean(d, c).cast("string"))))


def range_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    a = sided(real, synth, lambda d: number(d, c)).agg(*[f(F.when(F.col("side") == s, F.col("v"))).alias(n) for n, f, s in (("a", F.min, 0), ("b", F.max, 0), ("x", F.min, 1), ("y", F.max, 1))])
    width = F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    return a.select(F.greatest(F.lit(0.0), 1 - (F.greatest((F.col("x") - F.col("a")) / width, F.lit(0.0)) + F.greatest((F.col("b") - F.col("y")) / width, F.lit(0.0)))).alias("value"), width.alias("w")).select(F.when(F.col("w").isNotNull(), F.col("value")).alias("value"))


def range_coverage(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(range_frame(real, synth, c))


def category_coverage_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    by = sided(real, synth, lambda d: clean(d, c).cast("string")).groupBy("v").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return by.agg(F.try_divide(F.count_if((F.col("a") == 0) & (F.col("b") == 1)), F.count_if(F.col("a") == 0)).alias("value"))


def category_coverage(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(category_coverage_frame(real, synth, c))


def boundary_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    limits = real.agg(F.min(number(real, c)).alias("lo"), F.max(number(real, c)).alias("hi"))
    return synth.select(number(synth, c).alias("v")).filter("v IS NOT NULL").join(F.broadcast(limits)).agg(F.avg(F.col("v").between(F.col("lo"), F.col("hi")).cast("double")).alias("value"))


def boundary_adherence(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(boundary_frame(real, synth, c))


def category_adherence_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    both = real.select(clean(real, c).cast("string").alias("v"), F.lit(0).alias("side")).unionAll(synth.select(clean(synth, c).cast("string").alias("v"), F.lit(1).alias("side")))
    by = both.groupBy("v").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s"))
    return by.agg(F.try_divide(F.sum(F.when(F.col("r") > 0, F.col("s")).otherwise(0)), F.sum("s")).alias("value"))


def category_adherence(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(category_adherence_frame(real, synth, c))


def missing_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    rate = lambda d, n: d.agg(F.avg(clean(d, c).isNull().cast("double")).alias(n))
    return rate(real, "r").join(rate(synth, "s")).select((1 - F.abs(F.col("r") - F.col("s"))).alias("value"))


def missing_value_similarity(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(missing_frame(real, synth, c))


def key_uniqueness_frame(df: DataFrame, key: list[str]) -> DataFrame:
    """One row `value`: the share of rows that are the first of their key and have any part of it."""
    cols = [clean(df, k).alias(k) for k in key]
    empty = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNull() for k in key])
    by = df.select(*cols).groupBy(*[f"`{k}`" for k in key]).count()
    return by.agg(F.try_divide(F.count_if(~empty), F.sum("count")).alias("value"))


def key_uniqueness(df: DataFrame, key: list[str]) -> float:
    return _first(key_uniqueness_frame(df, key))


def table_structure(real: DataFrame, synth: DataFrame) -> float:
    a, b = set(real.dtypes), set(synth.dtypes)
    return len(a & b) / len(a | b) if a | b else NAN


def text_length_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    return ks_frame(sided(real, synth, lambda d: F.length(F.col(f"`{c}`").cast("string")).cast("double")))


def text_length_complement(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(text_length_frame(real, synth, c))


def text_character_frame(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    letters = lambda d, s: d.select(F.explode(F.split(F.col(f"`{c}`").cast("string"), "")).alias("v"), F.lit(s).alias("side")).filter("v <> ''")
    return tv_frame(letters(real, 0).unionAll(letters(synth, 1)))


def text_character_complement(real: DataFrame, synth: DataFrame, c: str) -> float:
    return _first(text_character_frame(real, synth, c))


def correlation_frame(real: DataFrame, synth: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    def rho(d: DataFrame, name: str) -> DataFrame:
        pair = d.select(number(d, a).alias("x"), number(d, b).alias("y")).dropna()
        if method == "spearman":
            rank = lambda k: average_rank(pair, k)
            pair = pair.join(rank("x"), "x").join(rank("y"), "y").select(F.col("rank_x").alias("x"), F.col("rank_y").alias("y"))
        return pair.agg(F.when(F.count(F.lit(1)) >= 2, F.corr("x", "y")).alias(name))

    return rho(real, "r").join(rho(synth, "s")).select((1 - F.abs(F.nanvl("r", F.lit(None)) - F.nanvl("s", F.lit(None))) / 2).alias("value"))


def average_rank(df: DataFrame, k: str) -> DataFrame:
    """k and rank_k, the mean place of rows with that value."""
    cum = _ranged(df.groupBy(k).agg(F.count(F.lit(1)).alias("n")), [k], ["n"])
    return cum.select(k, (F.col("c_n") - (F.col("n") - 1) / 2).alias(f"rank_{k}"))


def correlation_similarity(real: DataFrame, synth: DataFrame, a: str, b: str, method: str = "pearson") -> float:
    return _first(correlation_frame(real, synth, a, b, method))


def _binned(d: DataFrame, c: str, edges: list[float] | None) -> Column:
    if edges is None:
        return clean(d, c).cast("string")
    v = number(d, c)
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    return F.when(v.isNotNull(), F.size(F.filter(inner, lambda e: e <= v)).cast("string"))


def bin_edges(real: DataFrame, c: str, bins: int = PAIR_BINS) -> list[float]:
    r = real.agg(F.min(number(real, c)).alias("a"), F.max(number(real, c)).alias("b")).first()
    return _edges(r["a"], r["b"], bins)


def _edges(a: float | None, b: float | None, bins: int = PAIR_BINS) -> list[float]:
    a, b = (a, b) if a is not None else (0.0, 1.0)
    if a == b:
        a, b = a - 0.5, b + 0.5
    return [a + (b - a) * i / bins for i in range(bins + 1)]


def contingency_frame(real: DataFrame, synth: DataFrame, a: str, b: str, edges: dict[str, list[float]] | None = None) -> DataFrame:
    e = edges or {}
    pick = lambda d, s: d.select(_binned(d, a, e.get(a)).alias("v"), _binned(d, b, e.get(b)).alias("w"), F.lit(s).alias("side"))
    return tv_frame(pick(real, 0).unionAll(pick(synth, 1)), ("v", "w"))


def contingency_similarity(real: DataFrame, synth: DataFrame, a: str, b: str, edges=None) -> float:
    return _first(contingency_frame(real, synth, a, b, edges))


def infer_kinds(df: DataFrame, declared: dict[str, str] | None = None) -> dict[str, str]:
    """numeric, datetime, categorical, boolean or text for each column; strings are decided by one aggregation."""
    kinds = dict(declared or {})
    ask = []
    for f in df.schema.fields:
        if f.name in kinds:
            continue
        if isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "datetime"
        elif isinstance(f.dataType, T.StringType):
            ask.append(f.name)
    if ask:
        r = df.agg(*[x for i, c in enumerate(ask) for x in (F.count(f"`{c}`").alias(f"n{i}"), F.count_if(F.when(F.substring(f"`{c}`", 1, 1).between("0", "9") & F.length(f"`{c}`").between(8, 40), F.try_to_timestamp(F.col(f"`{c}`")).isNotNull() & ~F.col(f"`{c}`").rlike(r"^\d+$")).otherwise(False)).alias(f"d{i}"), F.count_distinct(f"`{c}`").alias(f"u{i}"))]).first()
        for i, c in enumerate(ask):
            n, d, u = r[f"n{i}"], r[f"d{i}"], r[f"u{i}"]
            kinds[c] = "datetime" if n and d / n > 0.8 else "categorical" if n and u / n < 0.5 and u <= 50 else "text"
    return {f.name: kinds[f.name] for f in df.schema.fields if f.name in kinds}


def spec_kinds(spec: Spec | None, table: str | None) -> tuple[dict[str, str], list[list[str]]]:
    """Declared kinds of a table's columns, and its keys."""
    t = spec.table(table) if spec and table else spec.tables[0] if spec and len(spec.tables) == 1 else None
    if t is None:
        return {}, []
    kinds = {"int": "numeric", "float": "numeric", "bool": "boolean", "datetime": "datetime", "date": "datetime"}
    got = {c.name: kinds[c.dtype] for c in t.columns if c.dtype in kinds} | {c.name: "categorical" for c in t.columns if c.generator in ("choice", "conditional")}
    return got, [k for k in [t.key, *t.unique_constraints, *[[c.name] for c in t.columns if c.constraints.get("unique")]] if k]


def mean(values: list[float]) -> float:
    known = [v for v in values if not math.isnan(v)]
    return sum(known) / len(known) if known else NAN


def _both(real: DataFrame, synth: DataFrame, pick) -> DataFrame:
    return real.select(F.lit(0).alias("side"), *pick(real)).unionAll(synth.select(F.lit(1).alias("side"), *pick(synth)))


def _nan(v) -> float:
    return NAN if v is None else float(v)


def marginals(real: DataFrame, synth: DataFrame, numbers: list[str], categories: list[str], texts: list[str]) -> tuple[dict, dict, dict]:
    """Shapes and coverage of all columns, and length shapes of texts, from one aggregation of (column, value, side) and one over its ranges."""
    names = [*numbers, *categories, *texts]
    if not names:
        return {}, {}, {}

    def cells(df: DataFrame) -> list[Column]:
        x = lambda c: number(df, c) if c in numbers else F.length(F.col(f"`{c}`").cast("string")).cast("double") if c in texts else F.lit(None).cast("double")
        v = lambda c: clean(df, c).cast("string") if c in categories else F.lit(None).cast("string")
        return [F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x(c).alias("x"), v(c).alias("v")) for i, c in enumerate(names)])).alias("e")]

    by = _both(real, synth, cells).filter("e.x IS NOT NULL OR e.v IS NOT NULL").groupBy("e.i", "e.x", "e.v").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s"))
    cum = _ranged(by, ["x", "v"], ["r", "s"], ["i"])
    totals = cum.groupBy("i").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns")).withColumnRenamed("i", "j")
    x = lambda side, f: f(F.when(F.col(side) > 0, F.col("x")))
    rows = cum.join(F.broadcast(totals), F.col("i") == F.col("j")).groupBy("i").agg(  # one row a column
        (1 - F.max(_gap("c_r", "c_s"))).alias("ks"), (1 - 0.5 * F.sum(_gap("r", "s"))).alias("tv"),
        F.try_divide(F.count_if((F.col("r") > 0) & (F.col("s") > 0)), F.count_if(F.col("r") > 0)).alias("cover"),
        x("r", F.min).alias("a"), x("r", F.max).alias("b"), x("s", F.min).alias("c"), x("s", F.max).alias("d"),
    )
    got = {names[r["i"]]: r for r in rows.collect()}

    def span(r) -> float:
        if r is None or r["a"] is None or r["c"] is None or r["b"] == r["a"]:
            return NAN
        return max(0.0, 1 - (max(0.0, (r["c"] - r["a"]) / (r["b"] - r["a"])) + max(0.0, (r["b"] - r["d"]) / (r["b"] - r["a"]))))

    value = lambda c, k: _nan(got[c][k]) if c in got else NAN
    return {c: value(c, "ks" if c in numbers else "tv") for c in [*numbers, *categories]}, {c: span(got.get(c)) if c in numbers else value(c, "cover") for c in [*numbers, *categories]}, {c: value(c, "ks") for c in texts}


def missing_values(real: DataFrame, synth: DataFrame, names: list[str]) -> dict[str, float]:
    """missing_value_similarity of all columns in one aggregation."""
    if not names:
        return {}
    rates = {r["side"]: r for r in _both(real, synth, lambda d: [clean(d, c).isNull().cast("double").alias(f"m{i}") for i, c in enumerate(names)]).groupBy("side").agg(*[F.avg(f"m{i}").alias(f"m{i}") for i in range(len(names))]).collect()}
    return {c: 1 - abs(rates[0][f"m{i}"] - rates[1][f"m{i}"]) if len(rates) == 2 else NAN for i, c in enumerate(names)}


#: Pairs of columns that one aggregation handles.
PAIRS_A_JOB = 64


def pair_trends(real: DataFrame, synth: DataFrame, pairs: list[tuple[str, str]], numbers: set[str]) -> dict[str, float]:
    """correlation_similarity of pairs of numbers, contingency_similarity of others, with many pairs in one aggregation."""
    out: dict[str, float] = {}
    close = [p for p in pairs if p[0] in numbers and p[1] in numbers]
    for some in [close[i : i + PAIRS_A_JOB] for i in range(0, len(close), PAIRS_A_JOB)]:
        cols = sorted({c for p in some for c in p})
        both = _both(real, synth, lambda d, cols=cols: [number(d, c).alias(f"x{i}") for i, c in enumerate(cols)])
        at = {c: f"x{i}" for i, c in enumerate(cols)}
        rho = {r["side"]: r for r in both.groupBy("side").agg(*[F.corr(at[a], at[b]).alias(f"p{i}") for i, (a, b) in enumerate(some)]).collect()}
        for i, (a, b) in enumerate(some):
            x, y = (_nan(rho[k][f"p{i}"]) if k in rho else NAN for k in (0, 1))
            out[f"{a}|{b}"] = 1 - abs(x - y) / 2
    mixed = [p for p in pairs if p not in set(close)]
    binned = sorted({c for p in mixed for c in p} & numbers)
    edges: dict[str, list[float]] = {}
    if binned:
        r = real.agg(*[f(number(real, c)).alias(f"{n}{i}") for i, c in enumerate(binned) for n, f in (("a", F.min), ("b", F.max))]).first()
        edges = {c: _edges(r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(binned)}
    for some in [mixed[i : i + PAIRS_A_JOB] for i in range(0, len(mixed), PAIRS_A_JOB)]:
        cells = lambda d, some=some: [F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _binned(d, a, edges.get(a)).alias("v"), _binned(d, b, edges.get(b)).alias("w")) for i, (a, b) in enumerate(some)])).alias("e")]
        by = checkpointed(_both(real, synth, cells).groupBy("e.i", "e.v", "e.w").agg(F.sum(1 - F.col("side")).alias("r"), F.sum("side").alias("s")))
        total = by.groupBy("i").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns")).withColumnRenamed("i", "j")
        got = {r["i"]: _nan(r["t"]) for r in by.join(F.broadcast(total), F.col("i") == F.col("j")).groupBy("i").agg((1 - 0.5 * F.sum(_gap("r", "s"))).alias("t")).collect()}  # one row a pair
        drop(by)
        out |= {f"{a}|{b}": got.get(i, NAN) for i, (a, b) in enumerate(some)}
    return {f"{a}|{b}": out[f"{a}|{b}"] for a, b in pairs}


def quality_report(real: DataFrame, synth: DataFrame, spec: Spec | None = None, table: str | None = None, seed: int = 0, most_pairs: int = MOST_PAIRS) -> dict:
    """Column shapes, pair trends, coverage, missing values and text, and their overall score; keys stay out."""
    declared, keys = spec_kinds(spec, table)
    skip = {c for k in keys for c in k}
    shared = [c for c in real.columns if c in synth.columns and c not in skip]
    real, synth = real.select(*[f"`{c}`" for c in shared]), synth.select(*[f"`{c}`" for c in shared])
    kinds = infer_kinds(real, {k: v for k, v in declared.items() if k in shared})
    numbers, categories, texts = ([c for c, k in kinds.items() if k in of] for of in (("numeric", "datetime"), ("categorical", "boolean"), ("text",)))
    pairs = list(itertools.combinations([c for c, k in kinds.items() if k != "text"], 2))
    if len(pairs) > most_pairs:
        pairs = sorted(random.Random(seed).sample(pairs, most_pairs))
    shapes, coverage, lengths = marginals(real, synth, numbers, categories, texts)
    missing = missing_values(real, synth, list(kinds))
    text = {c: min(lengths[c], text_character_complement(real, synth, c)) for c in texts}
    trends = pair_trends(real, synth, pairs, set(numbers))
    props = {"Column Shapes": mean(list(shapes.values())), "Column Pair Trends": mean(list(trends.values())), "Coverage": mean(list(coverage.values())), "Missing Values": mean(list(missing.values())), "Text": mean(list(text.values()))}
    return {"overall": mean([props["Column Shapes"], props["Column Pair Trends"]]), "properties": props, "columns": {c: {"kind": k, "shape": shapes.get(c), "coverage": coverage.get(c), "missing": missing.get(c), "text": text.get(c)} for c, k in kinds.items()}, "pairs": trends}


def diagnostic_report(real: DataFrame, synth: DataFrame, spec: Spec | None = None, table: str | None = None, tolerance: float = 0.0) -> dict:
    """Structure, value ranges and categories, key uniqueness; passes if each is 1 within the tolerance."""
    declared, keys = spec_kinds(spec, table)
    in_key = {c for k in keys for c in k}
    shared = [c for c in real.columns if c in synth.columns and c not in in_key]
    kinds = infer_kinds(real.select(*[f"`{c}`" for c in shared]), {k: v for k, v in declared.items() if k in shared})
    checks = {"TableStructure": table_structure(real, synth)}
    for c, k in kinds.items():
        if k in ("numeric", "datetime"):
            checks[f"BoundaryAdherence:{c}"] = boundary_adherence(real, synth, c)
        elif k in ("categorical", "boolean"):
            checks[f"CategoryAdherence:{c}"] = category_adherence(real, synth, c)
    for k in keys:
        if all(c in synth.columns for c in k):
            checks[f"KeyUniqueness:{','.join(k)}"] = key_uniqueness(synth, k)
    return {"passed": all(math.isnan(v) or v >= 1 - tolerance - 1e-9 for v in checks.values()), "checks": checks}


def compare(real: DataFrame, synth: DataFrame, limits: dict | None = None, declared: dict[str, str] | None = None) -> dict:
    """pass, warn or fail for each shared column by the distance of its marginals."""
    limits = {**LIMITS, **(limits or {})}
    shared = [c for c in real.columns if c in synth.columns]
    out = {}
    for c, k in infer_kinds(real.select(*[f"`{c}`" for c in shared]), declared).items():
        extra = {}
        if k in ("numeric", "datetime"):
            d = 1 - ks_complement(real, synth, c)
            if k == "numeric":
                for side, df in (("real", real), ("synthetic", synth)):
                    r = df.agg(F.avg(number(df, c)).alias("m"), F.stddev_pop(number(df, c)).alias("s")).first()
                    extra |= {f"mean_{side}": r["m"], f"std_{side}": r["s"]}
        elif k == "categorical":
            d = 1 - tv_complement(real, synth, c)
        elif k == "boolean":
            d = abs(_first(real.agg(F.avg(F.col(f"`{c}`").cast("double")).alias("value"))) - _first(synth.agg(F.avg(F.col(f"`{c}`").cast("double")).alias("value"))))
        else:
            m = [_first(x.agg(F.avg(F.length(f"`{c}`")).alias("value"))) for x in (real, synth)]
            d = max(abs(m[0] - m[1]) / max(1.0, m[0]), 1 - text_character_complement(real, synth, c))
        ok, warn = limits[k]
        out[c] = {"kind": k, "distance": d, "status": "pass" if math.isnan(d) or d <= ok else "warn" if d <= warn else "fail", **extra}
    return {"passed": all(v["status"] != "fail" for v in out.values()), "columns": out}
