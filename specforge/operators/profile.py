"""From data to a Spec: types, distributions, keys, foreign keys, dependencies, personal data."""

from __future__ import annotations

import hashlib
import json
import math
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.providers import PROVIDERS
from ..functions.personal import id_like, name_tokens, personal
from ..plans.spec import ColumnSpec, Relationship, Spec, TableSpec
from . import discovery
from .metrics import clean, number

MIN_CELL, MOST_CATEGORIES, HISTOGRAM_BINS = 5, 500, 50
OTHER = "__other__"
EMAIL, SSN, PHONE = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", r"^\d{3}-\d{2}-\d{4}$", r"^\+?[\d(][\d\s().-]{6,}\d$"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
def suppress(counts: list[tuple], least: int = MIN_CELL, other: str = OTHER) -> tuple[list[tuple], int]:
    """Cells below `least` summed into `other`; if that sum is itself small, the smallest kept cell joins it. Returns cells and how many went."""
    kept = [c for c in counts if c[1] >= least]
    gone = [c for c in counts if c[1] < least]
    if gone and sum(n for _, n in gone) < least and kept:
        smallest = min(kept, key=lambda c: (c[1], str(c[0])))
        kept.remove(smallest)
        gone.append(smallest)
    return (kept + ([(other, sum(n for _, n in gone))] if gone else [])), len(gone)


def redaction(counts: list[tuple]) -> dict:
    """Tokens value_001, value_002... by falling frequency, ties by value."""
    order = sorted(counts, key=lambda c: (-c[1], str(c[0])))
    return {v: f"value_{i + 1:03d}" for i, (v, _) in enumerate(order)}


def two_hashes(c: Column) -> Column:
    """128 bits of a value, so that long texts are not moved whole; null for null."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(c, F.lit(1)).alias("b")))


def facts(df: DataFrame, exact: bool = True) -> dict[str, dict]:
    """Everything scalar about all columns in one aggregation. exact: else numbers of distinct values are estimates."""
    aggs, cols = [F.count(F.lit(1)).alias("n")], df.schema.fields
    for i, f in enumerate(cols):
        c = clean(df, f.name)
        distinct = F.approx_count_distinct(c, 0.02) if not exact else F.count_distinct(two_hashes(c) if isinstance(f.dataType, T.StringType) else c)
        aggs += [F.count(c).alias(f"n{i}"), distinct.alias(f"d{i}")]
        if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            x = number(df, f.name)
            log = F.when(x > 0, F.log(x))
            cents = F.bool_and(F.abs(x * 100 - F.round(x * 100)) < 1e-6)
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.avg(log).alias(f"lm{i}"), F.stddev_samp(log).alias(f"ls{i}"), F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias(f"w{i}"), F.coalesce(cents, F.lit(False)).alias(f"cents{i}")]
            if not isinstance(f.dataType, T.NumericType):
                aggs += [F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
        elif isinstance(f.dataType, T.StringType):
            n = F.length(c)
            has = lambda test, pattern: F.avg(F.when(c.isNotNull(), F.when(test, c.rlike(pattern)).otherwise(False).cast("int")))
            stamp = F.when(F.substring(c, 1, 1).between("0", "9") & n.between(8, 40), F.try_to_timestamp(c).isNotNull() & ~c.rlike(r"^\d+$")).otherwise(False)
            aggs += [F.avg(F.when(c.isNotNull(), stamp.cast("int"))).alias(f"t{i}"), has(n == 36, UUID).alias(f"u{i}"), F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.max_by(F.substring(c, 1, 30), n).alias(f"long{i}")]
            aggs += [has(c.contains("@"), EMAIL).alias(f"e{i}"), has(n == 11, SSN).alias(f"ssn{i}"), has(n.between(8, 32) & ((n != 11) | ~c.rlike(SSN)), PHONE).alias(f"p{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
    r = df.agg(*aggs).first().asDict()
    return {f.name: {"rows": r["n"], "type": f.dataType, **{re.sub(r"\d+$", "", k): v for k, v in r.items() if k != "n" and re.fullmatch(rf"[a-z]+{i}", k)}} for i, f in enumerate(cols)}


def exact_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact numbers of distinct values, over hashes of 128 bits, in one aggregation."""
    if not columns:
        return {}
    r = df.agg(*[F.count_distinct(two_hashes(clean(df, c))).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return {c: r[f"d{i}"] for i, c in enumerate(columns)}


def all_frequencies(df: DataFrame, columns: list[str]) -> dict[str, list[tuple]]:
    """The values of columns with few of them, as text, and their counts, the most frequent first: one aggregation over all columns."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), clean(df, c).cast("string").alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(cells.alias("c")).filter("c.v IS NOT NULL").groupBy("c.i", "c.v").agg(F.count(F.lit(1)).alias("n")).collect()  # few values a column
    out: dict[str, list[tuple]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (-r["n"], r["v"])):
        out[columns[r["i"]]].append((r["v"], r["n"]))
    return out


def histograms(df: DataFrame, wanted: dict[str, tuple[float, float, int]]) -> dict[str, tuple[list[float], list[float]]]:
    """Equal-width edges and shares of values, the last bin closed, of columns with (low, high, bins): one aggregation."""
    out = {c: ([lo, hi], [1.0]) for c, (lo, hi, _) in wanted.items() if hi <= lo}
    todo = [c for c in wanted if c not in out]
    if not todo:
        return out
    place = lambda c, lo, hi, bins: F.least(F.floor((number(df, c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), place(c, *wanted[c]).alias("b")) for i, c in enumerate(todo)]))
    got = {(r["i"], r["b"]): r["n"] for r in df.select(cells.alias("c")).filter("c.b IS NOT NULL").groupBy("c.i", "c.b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bin
    for i, c in enumerate(todo):
        lo, hi, bins = wanted[c]
        n = sum(v for (j, _), v in got.items() if j == i) or 1
        out[c] = [lo + (hi - lo) * k / bins for k in range(bins + 1)], [got.get((i, k), 0) / n for k in range(bins)]
    return out


def histogram(df: DataFrame, c: str, lo: float, hi: float, bins: int = HISTOGRAM_BINS) -> tuple[list[float], list[float]]:
    return histograms(df, {c: (lo, hi, bins)})[c]


def distribution(f: dict) -> dict:
    """The distribution that a column's moments suggest."""
    lo, hi, m, s = f["lo"], f["hi"], f["m"], f["s"] or 0.0
    span, flat = hi - lo, (hi - lo) / math.sqrt(12)
    if span and abs(s - flat) < 0.1 * flat:
        return {"distribution": "uniform"}
    if lo > 0 and m:
        if lo < 0.05 * span and abs(m - s) < 0.1 * m:
            return {"distribution": "exponential", "scale": m}
        if s / m > 0.5:
            return {"distribution": "lognormal", "log_mu": f["lm"], "log_sigma": f["ls"]} if s / m < 2 else {"distribution": "pareto", "pareto_xmin": lo, "pareto_b": m / (m - lo) if m > lo else 1.0}
        return {"distribution": "normal", "mean": m, "std": s}
    return {"distribution": "empirical"}


def frequencies(df: DataFrame, c: str, most: int = MOST_CATEGORIES) -> list[tuple]:
    """The `most` most frequent values and their counts."""
    by = df.select(clean(df, c).alias("v")).dropna().groupBy("v").count()
    return [(r["v"], r["count"]) for r in by.orderBy(F.desc("count"), F.col("v").cast("string")).limit(most).collect()]


def pattern_of(text: str) -> str:
    return re.sub(r"[A-Za-z]", "?", re.sub(r"\d", "#", text))


class Profiler:
    """Profiles tables, each in a few aggregations over all its columns. Options say what the Spec may reveal.

    Counts, nulls, keys and the cells that are suppressed come from all rows; with `sample`, shapes (moments, histograms,
    shares of categories) come from that many rows, chosen by a hash of the row and the seed.
    """

    def __init__(self, min_cell: int = MIN_CELL, redact: bool = False, discover_fds: bool = False, condition_on_fds: bool = True, discover_keys: bool = True, detect_pii: bool = True, max_categories: int = 50, max_categorical_ratio: float = 0.05, sample: int | None = None, seed: int = 0, max_lhs: int = 3, fd_error: float = 0.0, personal: list[str] | None = None, not_personal: list[str] | None = None, pii_strategy: str = "faker"):
        if min_cell < 1:
            raise ValueError("min_cell must be at least 1")
        if sample is not None and sample < 1:
            raise ValueError("sample must be at least 1")
        if max_categories < 1 or not 0 <= max_categorical_ratio <= 1:
            raise ValueError("max_categories must be at least 1 and max_categorical_ratio between 0 and 1")
        self.min_cell, self.redact, self.discover_fds, self.condition, self.keys, self.pii, self.max_categories = min_cell, redact, discover_fds, condition_on_fds, discover_keys, detect_pii, max_categories
        self.ratio, self.sample, self.seed, self.max_lhs, self.error = max_categorical_ratio, sample, seed, max_lhs, fd_error
        self.personal, self.not_personal, self.strategy = set(personal or ()), set(not_personal or ()), pii_strategy

    def sampled(self, df: DataFrame, rows: int) -> DataFrame:
        """Exactly `sample` rows, the same for a seed whatever the partitioning."""
        if self.sample is None or rows <= self.sample:
            return df
        key = F.xxhash64(F.lit(self.seed), *[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))])
        return df.orderBy(key, *[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType,))]).limit(self.sample)

    def _categorical(self, f: dict) -> bool:
        return f["d"] <= self.max_categories and f["d"] / f["n"] < 0.5 or f["d"] <= MOST_CATEGORIES and f["d"] / f["n"] <= self.ratio

    def _facts(self, df: DataFrame) -> tuple[dict[str, dict], dict[str, list[tuple]]]:
        """facts(), exact where a decision needs it, and the frequencies of columns with few values."""
        got = facts(df, exact=False)
        most = max(self.max_categories, MOST_CATEGORIES)
        few = [c for c, f in got.items() if f["n"] and f["d"] <= 1.2 * most + 20 and not isinstance(f["type"], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        counts = all_frequencies(df, few)
        for c, cells in counts.items():
            got[c]["d"] = len(cells)
        many = [c for c, f in got.items() if f["n"] and c not in counts and f["d"] >= 0.8 * f["n"] and not isinstance(f["type"], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        for c, d in exact_distinct(df, many).items():
            got[c]["d"] = d
        return got, counts

    def column(self, c: str, f: dict, shape: dict, cells: list[tuple], shares: list[tuple], bars: tuple | None) -> ColumnSpec | None:
        """f: facts of all rows; shape: of the sample; cells and shares: frequencies in both; bars: histogram."""
        if not f["n"]:
            return None
        kind, rows = f["type"], f["rows"]
        out = ColumnSpec(name=c, generator="auto", profile={})
        rate = round(1 - f["n"] / rows, 4)
        out.constraints = {"nullable": rate > 0, **({"null_rate": rate} if rate else {})}
        unique = f["d"] == f["n"]
        if unique:
            out.constraints["unique"] = True
        if isinstance(kind, T.BooleanType):
            out.dtype = "bool"
        elif isinstance(kind, T.NumericType):
            out.dtype = "int" if f["w"] else "float"
            if out.dtype == "int" and unique and f["hi"] - f["lo"] + 1 == f["n"] == rows:
                out.generator, out.profile = "sequence", {}
                return out
            num = {k: shape[v] for k, v in (("min", "lo"), ("max", "hi"), ("mean", "m"), ("std", "s"))} | distribution(shape)
            num["decimals"] = None if out.dtype == "int" else 2 if f["cents"] else None
            if bars:
                num["hist_edges"], num["hist_counts"] = bars
            out.profile["numeric"] = num
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.dtype = "date" if isinstance(kind, T.DateType) else "datetime"
            out.profile["datetime_range"] = [f["a"], f["b"]]
        elif f["t"] is not None and f["t"] > 0.8:
            out.dtype, out.profile["datetime_range"] = "datetime", [f["a"], f["b"]]
        elif f["u"] > 0.9:
            out.dtype = "uuid"
        else:
            out.dtype = "str"
            if self._categorical(f):
                kept, gone = suppress(cells, self.min_cell)
                safe = {v for v, _ in kept}
                if shares is not cells:  # the sample says how much, all rows say what may be shown
                    kept, _ = suppress([(v, n) for v, n in shares if v in safe], 1)
                    rest = sum(n for v, n in shares if v not in safe)
                    kept += [(OTHER, rest)] if rest and gone else []
                names = redaction(kept) if self.redact else {}
                total = sum(n for _, n in kept) or 1
                out.profile["categorical"] = {"values": [names.get(v, v) for v, _ in kept], "weights": [round(n / total, 4) for _, n in kept], "rare": gone, "suppressed": gone, "redacted": self.redact}
            else:
                out.profile["length"] = {"min": f["lo"], "max": f["hi"]}
                if f["hi"] <= 30:
                    out.profile["string_pattern"] = pattern_of(f["long"])
        self._personal(out, f)
        return out

    def _personal(self, c: ColumnSpec, f: dict) -> None:
        """Marks a column as personal: by option, by its values, else by its name."""
        if c.name in self.not_personal or not (self.pii or c.name in self.personal):
            return
        value = next((p for k, p in (("e", "email"), ("ssn", "ssn"), ("p", "phone_number")) if (f.get(k) or 0) > 0.8), None)
        name = personal(c.name)
        if c.name in self.personal or value or c.dtype == "str" and name:
            c.pii, c.pii_strategy, c.pii_detected_by = True, self.strategy, "option" if c.name in self.personal else "value" if value else "name"
            c.generator, c.params, c.profile = f"faker.{_provider(value or name)}", {}, None
            c.constraints.pop("unique", None)

    def table(self, df: DataFrame, name: str) -> TableSpec:
        return self._table(df, name)[0]

    def _table(self, df: DataFrame, name: str) -> tuple[TableSpec, dict[str, dict]]:
        got, cells = self._facts(df)
        rows = next(iter(got.values()))["rows"] if got else 0
        shape, shares = got, cells
        few = self.sampled(df, rows)
        if few is not df:
            shape, shares = facts(few, exact=False), all_frequencies(few, list(cells))
        empirical = lambda c, f: f["n"] and isinstance(f["type"], T.NumericType) and not isinstance(f["type"], T.BooleanType) and not (f["d"] == f["n"] == f["rows"] and f["w"] and f["hi"] - f["lo"] + 1 == f["n"]) and distribution(shape[c])["distribution"] == "empirical"
        bars = histograms(few, {c: (shape[c]["lo"], shape[c]["hi"], min(HISTOGRAM_BINS, max(2, f["d"]))) for c, f in got.items() if empirical(c, f)})
        flat = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        cols = [x for c in flat if (x := self.column(c, got[c], shape[c], cells.get(c, []), shares.get(c, []) if shares is not cells else cells.get(c, []), bars.get(c)))]
        t = TableSpec(name=name, row_count=rows, columns=cols, metadata={"columns": signature(df)})
        if self.keys:
            self._choose_keys(df, t, got)
        if self.discover_fds:
            open_ = [c.name for c in cols if not c.pii]
            usable = [c for c in open_ if got[c]["d"] / max(1, got[c]["rows"]) <= discovery.NEAR_KEY]
            t.metadata["dependencies"] = discovery.functional_dependencies(df, self.max_lhs, self.error, columns=usable)[:50]
            if self.condition:
                self._condition(df, t, usable)
        return t, got

    def _choose_keys(self, df: DataFrame, t: TableSpec, got: dict) -> None:
        """The primary key: one column before several, then names that say key, whole numbers and text, and order; other composite keys as unique constraints."""
        whole = [c for c in t.columns if not c.pii and got[c.name]["n"] == got[c.name]["rows"] > 0]
        singles = [c for c in whole if got[c.name]["d"] == got[c.name]["n"]]
        if singles:
            t.primary_key = min(singles, key=lambda c: (not id_like(c.name), c.dtype not in ("int", "str", "uuid"), t.columns.index(c))).name
        own = {c.name for c in singles}
        rest = [c.name for c in whole if c.dtype in ("int", "str", "date", "uuid") and c.name not in own and got[c.name]["d"] > 1]
        sets = discovery.composite_keys(df, rest, {c: got[c]["d"] for c in rest}, t.row_count, most=3 if singles else 4)
        if sets and not singles:
            t.primary_key, sets = sets[0], sets[1:]
        t.unique_constraints = sets[:3]

    def _condition(self, df: DataFrame, t: TableSpec, usable: list[str]) -> None:
        names = [c.name for c in t.columns if c.name in usable and (c.profile or {}).get("categorical") and c.name not in t.key and not c.constraints.get("unique")]
        pairs = [(a, b) for a in names for b in names if a != b]
        edges = [{"lhs": [a], "rhs": b, "g1": m["g1"], "mu_prime": m["mu_prime"]} for (a, b), m in discovery.pair_measures(df, pairs).items() if m["mu_prime"] >= 0.5]
        for e in discovery.dependency_forest(edges):
            c = t.column(e["dependent"])
            c.generator, c.params, c.depends_on = "conditional", conditional_params(df, e["determinant"], e["dependent"], self.min_cell), [e["determinant"]]
            c.provenance = {**discovery.provenance(e, t.row_count), "reversed": e["reversed"]}

    def profile_set(self, tables: dict[str, DataFrame]) -> Spec:
        """Several tables with the foreign keys between them: by inclusion of values, or by names where keys are not discovered."""
        with ThreadPoolExecutor(4) as pool:  # the tables' jobs side by side
            got = dict(zip(tables, pool.map(lambda x: self._table(x[1], x[0]), tables.items())))
        spec = Spec(tables=[t for t, _ in got.values()])
        self._relationships(spec, tables, {n: f for n, (_, f) in got.items()})
        return spec

    def profile(self, df: DataFrame, name: str = "table") -> Spec:
        return Spec(tables=[self.table(df, name)])

    def _relationships(self, spec: Spec, tables: dict[str, DataFrame], got: dict[str, dict]) -> None:
        kind = lambda t, c: discovery.value_kind(tables[t].schema[c].dataType)
        parents = [(t.name, t.key[0]) for t in spec.tables if len(t.key) == 1 and t.column(t.key[0])]
        if not self.keys:
            parents = [(t.name, c) for t in spec.tables if (c := named_key(t))]
        children = [(t.name, c.name) for t in spec.tables for c in t.columns if not c.pii and t.key != [c.name]]

        def possible(ct: str, cc: str, pt: str, pc: str) -> bool:
            """Whether ranges and numbers of values, whose estimates are a few percent off, allow the child's values among the parent's."""
            c, p = got[ct][cc], got[pt][pc]
            if ct == pt or kind(ct, cc) != kind(pt, pc) or not c["n"] or c["d"] > 1.2 * p["d"]:
                return False
            lo, hi = ("a", "b") if kind(pt, pc) == "string" else ("lo", "hi")
            return c.get(lo) is None or p.get(lo) is None or c[lo] >= p[lo] and c[hi] <= p[hi]

        pairs = {(ct, cc, pt, pc) for ct, cc in children for pt, pc in parents if possible(ct, cc, pt, pc) and (self.keys or stem_of(cc) in names_of(pt))}
        needed = sorted({x[:2] for x in pairs} | {x[2:] for x in pairs})
        found = []
        for d in discovery.inclusion_dependencies(tables, columns=needed) if needed else []:
            (ct, cc), (pt, pc) = d["child"].split(".", 1), d["parent"].split(".", 1)
            if (ct, cc, pt, pc) in pairs:
                found.append((d["coverage"], bool(set(name_tokens(cc)) & set(name_tokens(pc))) or cc.split("_")[-1] == pc.split("_")[-1] or stem_of(cc) in names_of(pt), ct, cc, pt, pc))
        up: dict[str, set[str]] = {}

        def reaches(a: str, b: str) -> bool:
            return a == b or any(reaches(x, b) for x in up.get(a, ()))

        for cov, _, ct, cc, pt, pc in sorted(found, key=lambda x: (-x[0], not x[1], x[2:])):
            child = spec.table(ct)
            if any(cc in r.columns for r in child.relationships) or reaches(pt, ct):
                continue
            up.setdefault(ct, set()).add(pt)
            child.relationships.append(Relationship(source=cc, to=f"{pt}.{pc}", provenance={"algorithm": "inclusion" if self.keys else "name", "measure": "coverage", "confidence": cov, "support": child.row_count}))


def _provider(name: str) -> str:
    """The provider itself if there is one, else that of words."""
    return name if name in PROVIDERS else "word"


def stem_of(column: str) -> str:
    """`customer` for `customer_id`, `customerId` or `customer_key`; nothing for other names."""
    return "_".join(name_tokens(column)[:-1]) if id_like(column) else ""


def names_of(table: str) -> set[str]:
    """A table's name and its singular forms."""
    whole = "_".join(name_tokens(table))
    return {whole, whole.removesuffix("s"), whole.removesuffix("es"), whole.removesuffix("ies") + "y"} - {""}


def named_key(t: TableSpec) -> str | None:
    """The column that its name makes the key: `id`, or the table's name with id."""
    return next((c.name for c in t.columns if id_like(c.name) and (stem_of(c.name) == "" or stem_of(c.name) in names_of(t.name)) and c.constraints.get("unique")), None)


def conditional_params(df: DataFrame, on: str, dep: str, least: int = MIN_CELL, other: str = OTHER, decimals: int = 6) -> dict:
    """Parameters of a conditional generator: the dependent's distribution for each determinant; small cells go to `other`."""
    by = df.groupBy(F.col(f"`{on}`").alias("k"), F.col(f"`{dep}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cell = by.select("k", F.when(F.col("n") >= least, F.col("v").cast("string")).otherwise(F.lit(other)).alias("v"), "n").groupBy("k", "v").agg(F.sum("n").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("k")), decimals)
    rows = cell.select("k", "v", share.alias("w")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("c")).orderBy("k").collect()  # categories only
    whole = df.select(F.col(f"`{dep}`").cast("string").alias("v")).dropna().groupBy("v").count()
    small = F.col("count") < least
    sums = whole.agg(F.sum(F.when(small, F.col("count"))).alias("n"), F.count_if(small).alias("k")).first()
    marginal, _ = suppress([(r["v"], r["count"]) for r in whole.filter(~small).orderBy(F.desc("count"), "v").collect()], least, other)  # values of `least` rows or more
    marginal += [(other, sums["n"])] if sums["k"] else []
    total = sum(n for _, n in marginal) or 1
    return {"on": on, "keys": [r["k"] for r in rows], "values": [[x["v"] for x in r["c"]] for r in rows], "weights": [[x["w"] for x in r["c"]] for r in rows], "default": {"values": [v for v, _ in marginal], "weights": [round(n / total, decimals) for _, n in marginal]}}


def empirical_text_params(df: DataFrame, c: str, length_bins: int = 32, max_characters: int = 256) -> dict:
    """Length and character frequencies for the string generator."""
    by = df.select(F.length(f"`{c}`").alias("n")).dropna().groupBy("n").count().orderBy("n").collect()  # distinct lengths
    chars = df.select(F.explode(F.split(F.col(f"`{c}`"), "")).alias("ch")).filter("ch <> ''").groupBy("ch").count().orderBy(F.desc("count"), "ch").limit(max_characters).collect()
    if not by:
        return {}
    out = {"min_length": by[0]["n"], "max_length": by[-1]["n"], "char_values": [r["ch"] for r in chars], "char_weights": [r["count"] for r in chars]}
    if len(by) <= length_bins:
        return {**out, "length_values": [r["n"] for r in by], "length_weights": [r["count"] for r in by]}
    lo, width = by[0]["n"], (by[-1]["n"] - by[0]["n"]) / length_bins
    counts = [0] * length_bins
    for r in by:
        counts[min(length_bins - 1, int((r["n"] - lo) / width))] += r["count"]
    return {**out, "length_edges": [lo + width * i for i in range(length_bins + 1)], "length_counts": counts}


def fit_text_params(spec: Spec, frames: dict[str, DataFrame]) -> Spec:
    """A copy of the Spec in which `string` columns without parameters follow the given frames."""
    from ..plans.spec import from_dict, to_dict

    out = from_dict(json.loads(json.dumps(to_dict(spec), default=str)))
    for t in out.tables:
        for c in t.columns:
            if c.generator == "string" and t.name in frames and c.name in frames[t.name].columns:
                c.params = {**empirical_text_params(frames[t.name], c.name), **c.params}
    return out


def signature(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_fingerprint(df: DataFrame, controls: dict, order: list[str], rows: int = 1000) -> str:
    """Of schema, controls and the first rows in the given order."""
    head = df.orderBy(*order).limit(rows).select(F.xxhash64(F.struct("*")).alias("h")).collect()
    return fingerprint([df.dtypes, controls, [r["h"] for r in head]])


def schema_drift(old: dict[str, str], new: dict[str, str]) -> dict[str, list[str]]:
    """Columns added, removed and changed in type."""
    return {"added": sorted(set(new) - set(old)), "removed": sorted(set(old) - set(new)), "changed": sorted(c for c in set(old) & set(new) if old[c] != new[c])}


def merge_preserving_edits(old: Spec, new: Spec) -> tuple[Spec, dict[str, list[str]]]:
    """A fresh profile into which the edits of an older Spec are carried over.

    An old column counts as edited if its fingerprint no longer fits it, or is missing; edited columns, rules and
    hand-made relationships stay, and so do tables and columns that the data no longer has, reported as removed (orphaned where edited).
    """
    report: dict[str, list[str]] = {k: [] for k in ("added", "updated", "kept", "removed", "orphaned")}
    out = []
    for t in new.tables:
        was = old.table(t.name)
        if was is None:
            out.append(t)
            report["added"].append(t.name)
            continue
        cols = []
        for c in t.columns:
            before = was.column(c.name)
            edited = before is not None and (before.provenance or {}).get("fingerprint") != fingerprint({**before.write(), "provenance": None})
            report["added" if before is None else "kept" if edited else "updated"].append(f"{t.name}.{c.name}")
            cols.append(before if edited else c)
        for c in was.columns:
            if t.column(c.name) is None:
                edited = (c.provenance or {}).get("fingerprint") != fingerprint({**c.write(), "provenance": None})
                report["orphaned" if edited else "removed"].append(f"{t.name}.{c.name}")
                cols.append(c)
        own = [r for r in was.relationships if not r.provenance]
        rest = [r for r in t.relationships if not any(r.columns == o.columns for o in own)]
        out.append(TableSpec(name=t.name, row_count=t.row_count, primary_key=was.primary_key or t.primary_key, metadata=t.metadata, columns=cols, unique_constraints=was.unique_constraints or t.unique_constraints, relationships=own + rest, rules=was.rules or t.rules))
    for t in old.tables:
        if new.table(t.name) is None:
            out.append(t)
            report["removed"].append(t.name)
    return Spec(tables=out, metadata=old.metadata or new.metadata, settings=old.settings, many_to_many=old.many_to_many), report


def stamped(spec: Spec) -> Spec:
    """The Spec with each column's fingerprint in its provenance."""
    for t in spec.tables:
        for c in t.columns:
            c.provenance = {**(c.provenance or {}), "fingerprint": fingerprint({**c.write(), "provenance": None})}
    return spec
