"""Column generators: each turns its parameters and a row's context into a Column."""

from __future__ import annotations

import importlib
import random
import string
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import ColumnSpec, SpecError
from . import providers
from .rng import normal, pick, uniform

TYPES = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "date": T.DateType(), "uuid": T.StringType()}
SQL_TYPES = {"int": "INTEGER", "float": "REAL", "str": "TEXT", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "date": "DATE", "uuid": "TEXT"}
ALNUM = string.ascii_letters + string.digits


@dataclass
class Context:
    """What a generator may use: the row's key, its columns so far, its parents' structs, and parameters."""

    seed: int
    table: str
    column: str
    params: dict
    row_id: Column = field(default_factory=lambda: F.col("_rid"))
    attempt: Column = field(default_factory=lambda: F.col("_attempt"))
    portable: bool = False
    dtype: str = "str"
    known: dict[str, T.DataType] = field(default_factory=dict)
    aliases: dict[str, T.StructType] = field(default_factory=dict)

    def u(self, draw=0) -> Column:
        return uniform(str(self.seed), self.table, self.column, self.row_id, self.attempt, draw if isinstance(draw, Column) else str(draw), portable=self.portable)


def cdf_of(values: list, weights: list | None, where: str) -> list[float]:
    """Cumulated normalised weights."""
    if not values:
        raise SpecError(f"{where}: no values to choose from")
    weights = [1.0] * len(values) if weights is None else [float(w) for w in weights]
    if len(weights) != len(values):
        raise SpecError(f"{where}: {len(values)} values but {len(weights)} weights")
    total = sum(weights)
    if not all(w >= 0 and w < float("inf") for w in weights) or not 0 < total < float("inf"):
        raise SpecError(f"{where}: weights must be finite, not negative, and not all 0")
    out, acc = [], 0.0
    for w in weights:
        acc += w / total
        out.append(acc)
    return out


def sample(ctx: Context, lo: float | None, hi: float | None) -> Column:
    """A number from the distribution that params name, before clamping."""
    p, kind = ctx.params, ctx.params.get("distribution", "uniform")
    u = ctx.u()
    if kind == "uniform":
        low = lo if lo is not None else 0.0
        return low + u * ((hi if hi is not None else low + 1) - low)
    if kind in ("normal", "lognormal"):
        z = normal(u, ctx.u(1))
        return (p.get("mean", 0.0) + (p.get("std") or 1.0) * z) if kind == "normal" else F.exp(p.get("log_mu", 0.0) + (p.get("log_sigma") or 1.0) * z)
    if kind == "exponential":
        return -float(p.get("scale", 1.0)) * F.log(1.0 - u)
    if kind == "pareto":
        start = p.get("pareto_xmin", lo if lo is not None and lo > 0 else 1.0)
        return float(start) * F.pow(1.0 - u, F.lit(-1.0 / float(p.get("pareto_b", 1.0))))
    if kind == "empirical":
        edges, counts = p["hist_edges"], p["hist_counts"]
        if len(edges) != len(counts) + 1:
            raise SpecError(f"{ctx.table}.{ctx.column}: a histogram of {len(counts)} bins needs {len(counts) + 1} edges")
        at = pick(cdf_of(counts, counts, f"{ctx.table}.{ctx.column}"), u)
        table = F.array(*[F.lit(float(e)) for e in edges])
        low, high = F.get(table, at), F.get(table, at + 1)
        return low + ctx.u(1) * (high - low)
    raise SpecError(f"{ctx.table}.{ctx.column}: unknown distribution {kind}")


def clamp(c: Column, lo, hi) -> Column:
    c = c if lo is None else F.greatest(c, F.lit(float(lo)))
    return c if hi is None else F.least(c, F.lit(float(hi)))


def gen_int(ctx: Context) -> Column:
    lo = int(ctx.params.get("min", 0))
    hi = int(ctx.params.get("max", lo + 100))
    step = int(ctx.params.get("step", 1)) or 1
    if ctx.params.get("distribution", "uniform") == "uniform":
        return (F.lit(lo) + F.floor(ctx.u() * ((hi - lo) // step + 1)) * step).cast("long")
    v = clamp(F.bround(sample(ctx, lo, hi), 0), lo, hi)
    return F.least(F.lit(lo) + F.floor((v - lo) / step) * step, F.lit(hi)).cast("long")


def gen_float(ctx: Context) -> Column:
    lo = float(ctx.params.get("min", 0.0))
    hi = ctx.params.get("max")
    v = sample(ctx, lo if "min" in ctx.params or ctx.params.get("distribution", "uniform") == "uniform" else None, hi)
    if ctx.params.get("distribution", "uniform") != "uniform":
        v = clamp(v, ctx.params.get("min"), hi)
    return v if ctx.params.get("decimals") is None else F.bround(v, int(ctx.params["decimals"]))


def gen_bool(ctx: Context) -> Column:
    w = ctx.params.get("weights")
    return ctx.u() < (float(w[0]) / (w[0] + w[1]) if w else float(ctx.params.get("p", 0.5)))


def gen_uuid(ctx: Context) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(ctx.seed)), F.lit(ctx.table), F.lit(ctx.column), ctx.row_id.cast("string"), ctx.attempt.cast("string")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def gen_datetime(ctx: Context) -> Column:
    a, b = ctx.params.get("start"), ctx.params.get("end")
    if a is None or b is None:
        a, b = "2000-01-01", "2030-01-01"
    t0, t1 = (pd.Timestamp(str(x)).tz_localize(None) for x in (a, b))
    span = max(0, int((t1 - t0).total_seconds()))
    return F.timestamp_add("SECOND", F.floor(ctx.u() * (span + 1)).cast("int"), F.lit(t0.isoformat()).cast("timestamp_ntz"))


def gen_date(ctx: Context) -> Column:
    return gen_datetime(ctx).cast("date")


def gen_string(ctx: Context) -> Column:
    p, where = ctx.params, f"{ctx.table}.{ctx.column}"
    if "length_edges" in p and "length_counts" in p:
        edges = p["length_edges"]
        at = pick(cdf_of(p["length_counts"], p["length_counts"], where), ctx.u("n"))
        table = F.array(*[F.lit(float(e)) for e in edges])
        n = F.bround(F.get(table, at) + ctx.u("m") * (F.get(table, at + 1) - F.get(table, at)), 0)
    elif "length_values" in p:
        n = F.get(F.array(*[F.lit(int(v)) for v in p["length_values"]]), pick(cdf_of(p["length_values"], p.get("length_weights"), where), ctx.u("n")))
    elif "min_length" in p or "max_length" in p:
        lo = int(p.get("min_length", 0))
        n = F.lit(lo) + F.floor(ctx.u("n") * (int(p.get("max_length", max(lo, 8))) - lo + 1))
    else:
        n = F.lit(int(p.get("length", 8)))
    n = F.greatest(F.lit(0), clamp(n, p.get("min_length"), p.get("max_length"))).cast("int")
    chars = list(p.get("char_values") or p.get("alphabet") or ALNUM)
    cdf = cdf_of(chars, p.get("char_weights"), where)
    table = F.array(*[F.lit(c) for c in chars])
    one = lambda i: F.get(table, pick(cdf, ctx.u(i.cast("string"))))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise(F.lit(""))


def bothify(ctx: Context, pattern: str) -> Column:
    """? becomes a letter, # a digit, all else stays."""
    parts = []
    for i, c in enumerate(pattern):
        if c in "?#":
            chars = string.ascii_letters if c == "?" else string.digits
            parts.append(F.substring(F.lit(chars), (F.floor(ctx.u(f"b{i}") * len(chars)) + 1).cast("int"), F.lit(1)))
        else:
            parts.append(F.lit(c))
    return F.concat(*parts) if parts else F.lit("")


def gen_regex(ctx: Context) -> Column:
    return bothify(ctx, ctx.params.get("pattern", "????##"))


def _literal(v: Any, kind: T.DataType) -> Column:
    return F.lit(v).cast(kind)


def gen_choice(ctx: Context) -> Column:
    values = list(ctx.params.get("values") or [])
    cdf = cdf_of(values, ctx.params.get("weights"), f"{ctx.table}.{ctx.column}")
    return F.get(F.array(*[_literal(v, TYPES.get(ctx.dtype, T.StringType())) for v in values]), pick(cdf, ctx.u()))


#: Keys of a conditional table that are written into the plan.
INLINE = 200


def conditional_table(p: dict, where: str) -> tuple[list[str], list[list], list[list[float]]]:
    """The text of each key, its values and their cumulated weights."""
    keys, values = p.get("keys") or [], p.get("values") or []
    weights = p.get("weights") or [None] * len(keys)
    if not len(keys) == len(values) == len(weights):
        raise SpecError(f"{where}: keys, values and weights differ in length")
    text = lambda k: "\x1f".join("\x00" if x is None or x != x else providers.as_text(x) for x in (k if isinstance(k, (list, tuple)) else [k]))
    return [text(k) for k in keys], [list(v) for v in values], [[float(x) for x in cdf_of(v, w, where)] for v, w in zip(values, weights)]


def conditional_key(p: dict) -> Column:
    """The text of the row's key."""
    on = [p["on"]] if isinstance(p["on"], str) else list(p["on"])
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in on])


def gen_conditional(ctx: Context) -> Column:
    """A draw from the distribution of the determinant's value: exact key, then its text, then the default.

    params: on (name or list), keys, values and weights (a list for each key), default ({values, weights}). Tables up to
    INLINE keys become a literal map here; the engine joins longer ones.
    """
    p, where = ctx.params, f"{ctx.table}.{ctx.column}"
    keys, values, weights = conditional_table(p, where)
    kind = TYPES.get(ctx.dtype, T.StringType())
    key = conditional_key(p)
    entry = lambda v, c: F.struct(F.array(*[_literal(x, kind) for x in v]).alias("v"), F.array(*[F.lit(x) for x in c]).alias("c"))
    if len(keys) > INLINE:
        found = F.col(f"`_fk_{ctx.column}`")
    else:
        found = F.try_element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[entry(v, w) for v, w in zip(values, weights)])), key) if keys else None
    if p.get("default"):
        d = p["default"] if isinstance(p["default"], dict) else {"values": p["default"]}
        default = entry(d["values"], cdf_of(d["values"], d.get("weights"), where))
        found = default if found is None else F.coalesce(found, default)
    if found is None:
        raise SpecError(f"{where}: neither keys nor a default")
    at = F.least(F.size(F.filter(found["c"], lambda c: c < ctx.u())), F.size(found["c"]) - 1)
    return F.when(found.isNotNull(), F.get(found["v"], at)).otherwise(F.raise_error(F.concat(F.lit(f"{where}: no distribution for "), key)).cast(kind))


def gen_sequence(ctx: Context) -> Column:
    return ctx.row_id.cast("long")


def gen_const(ctx: Context) -> Column:
    return _literal(ctx.params.get("value"), TYPES.get(ctx.dtype, T.StringType()))


BUILTINS: dict[str, Callable[[Context], Column]] = {
    "int": gen_int, "float": gen_float, "bool": gen_bool, "uuid": gen_uuid, "datetime": gen_datetime, "date": gen_date, "string": gen_string,
    "regex": gen_regex, "choice": gen_choice, "conditional": gen_conditional, "sequence": gen_sequence, "const": gen_const,
}
CUSTOM: dict[str, Any] = {}


def register_generator(name: str, native: bool = False) -> Callable:
    """Register fn(ctx) -> Column (native) or fn(row, rng, faker, params) -> value as custom:<name>."""

    def add(fn):
        fn._native = native
        CUSTOM[name] = fn
        return fn

    return add


def _row_function(fn: Any, ctx: Context) -> Column:
    """A row-wise function as an Arrow-batched UDF; its random numbers depend on the row's key only.

    State that a generator keeps lasts for one batch: rows are not handed out in order.
    """
    fn = fn() if isinstance(fn, type) else fn
    call = fn if callable(fn) else fn.generate
    kind, params, key = TYPES.get(ctx.dtype, T.StringType()), dict(ctx.params), f"{ctx.seed}|{ctx.table}|{ctx.column}"
    cols = [F.col(f"`{c}`") for c in ctx.known] + [F.col(f"__p_{a}") for a in ctx.aliases]

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.to_dict("records"):
            rid, attempt = r.pop("_rid"), r.pop("_attempt")
            r["__parents__"] = {k[4:]: r.pop(k) for k in [k for k in r if k.startswith("__p_")]}
            out.append(call(r, random.Random(f"{key}|{rid}|{attempt}"), None, params))
        return pd.Series(out)

    return run(F.struct(ctx.row_id.alias("_rid"), ctx.attempt.alias("_attempt"), *cols))


def build(name: str, ctx: Context) -> Column:
    """The Column of a generator by its name in the Spec."""
    if name in BUILTINS:
        return BUILTINS[name](ctx)
    if name.startswith("faker."):
        return providers.provide(name[6:], ctx)
    if name.startswith("custom:"):
        if name[7:] not in CUSTOM:
            raise SpecError(f"unknown generator {name}")
        fn = CUSTOM[name[7:]]
        return fn(ctx) if getattr(fn, "_native", False) else _row_function(fn, ctx)
    if ":" in name:
        module, attr = name.split(":", 1)
        try:
            fn = getattr(importlib.import_module(module), attr)
        except (ImportError, AttributeError) as e:
            raise SpecError(f"can't load generator {name}: {e}") from e
        return fn(ctx) if getattr(fn, "_native", False) else _row_function(fn, ctx)
    raise SpecError(f"unknown generator {name}")


def resolve(c: ColumnSpec) -> tuple[str, dict]:
    """Generator and parameters of a column; `auto` follows the profile, else the declared type."""
    if c.generator and c.generator != "auto":
        return c.generator, dict(c.params)
    p, profile = dict(c.params), c.profile or {}
    if cat := profile.get("categorical"):
        return "choice", {"values": cat["values"], "weights": cat.get("weights"), **p}
    if num := profile.get("numeric"):
        name = "int" if c.dtype == "int" else "float"
        got = {k: num[k] for k in ("min", "max", "mean", "std", "distribution", "log_mu", "log_sigma", "scale", "pareto_b", "pareto_xmin", "hist_edges", "hist_counts") if num.get(k) is not None}
        if got.get("distribution") == "normal" and "mean" in got and "std" in got:
            got.setdefault("min", got["mean"] - 3 * got["std"])
            got.setdefault("max", got["mean"] + 3 * got["std"])
        return name, {**got, **({"decimals": num["decimals"]} if num.get("decimals") is not None and name == "float" else {}), **p}
    if r := profile.get("datetime_range"):
        return ("date" if c.dtype == "date" else "datetime"), {"start": r[0], "end": r[1], **p}
    if s := profile.get("string_pattern"):
        return "regex", {"pattern": s, **p}
    if n := profile.get("length"):
        return "string", {"min_length": n.get("min"), "max_length": n.get("max"), **p}
    return {"int": "int", "float": "float", "bool": "bool", "datetime": "datetime", "date": "date", "uuid": "uuid"}.get(c.dtype, "string"), p


def mask(col: Column, dtype: str) -> Column:
    """Hides a value but keeps its shape."""
    if dtype in ("str", "uuid"):
        local = F.substring_index(col, "@", 1)
        email = F.concat(F.when(F.length(local) <= 1, F.lit("*")).otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.length(local) - 1))), F.substring(col, F.length(local) + 1, F.length(col)))
        plain = F.when(F.length(col) <= 1, F.lit("*")).when(F.length(col) == 2, F.concat(F.substring(col, 1, 1), F.substring(col, -1, 1))).otherwise(F.concat(F.substring(col, 1, 1), F.repeat(F.lit("*"), F.length(col) - 2), F.substring(col, -1, 1)))
        return F.when(F.contains(col, F.lit("@")), email).otherwise(plain)
    if dtype == "float":
        return F.bround(col / 10, 0) * 10
    if dtype == "int":
        return (F.floor(col / 10) * 10).cast("long")
    if dtype == "datetime":
        return F.date_trunc("DAY", col).cast("timestamp_ntz")
    return col


def redact(col: Column, dtype: str) -> Column:
    value = {"str": "REDACTED", "uuid": "REDACTED", "bool": False, "int": 0, "float": 0.0}.get(dtype)
    return F.when(col.isNotNull(), F.lit(value).cast(TYPES[dtype])) if value is not None else F.lit(None).cast(TYPES.get(dtype, T.StringType()))


def hashed(col: Column, name: str) -> Column:
    return F.when(col.isNotNull(), F.substring(F.sha2(F.concat(F.lit(name + "|"), col.cast("string")), 256), 1, 12))


def apply_pii(col: Column, c: ColumnSpec) -> Column:
    if not c.pii or c.pii_strategy not in ("mask", "redact", "hash"):
        return col
    return {"mask": lambda: mask(col, c.dtype), "redact": lambda: redact(col, c.dtype), "hash": lambda: hashed(col, c.name)}[c.pii_strategy]()
