"""Dependencies between columns: functional, unique, inclusion, and the forest that generation conditions on.

Lattice levels are measured by grouped aggregations; only scalar measures reach the driver, where candidates are pruned.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns with more distinct values than this share of rows are near keys and left out of dependency search.
NEAR_KEY = 0.9


def value_kind(kind: T.DataType) -> str:
    return "bool" if isinstance(kind, T.BooleanType) else "numeric" if isinstance(kind, T.NumericType) else "datetime" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def _q(cols) -> list[str]:
    return [f"`{c}`" for c in cols]


def discovery_columns(df: DataFrame, near_key: float = NEAR_KEY) -> list[str]:
    """Columns with a value, whose distinct values are few enough: one aggregation."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(flat)]).first()
    return [c for i, c in enumerate(flat) if r[f"d{i}"] and r[f"d{i}"] / r["n"] <= near_key]


def measures_frame(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """One row: n, n_x (distinct x), g1, pdep, pdep_y, mu_prime of x -> y. Null is a value like others."""
    xy = df.groupBy(*_q(x), f"`{y}`").agg(F.count(F.lit(1)).alias("c"))
    by_x = xy.groupBy(*_q(x)).agg(F.sum("c").alias("cx"), F.sum(F.col("c") * F.col("c")).alias("cxy2"))
    by_y = xy.groupBy(f"`{y}`").agg(F.sum("c").alias("cy"))
    a = by_x.agg(F.sum("cx").alias("n"), F.count(F.lit(1)).alias("n_x"), F.sum(F.col("cx") * F.col("cx")).alias("x2"), F.sum("cxy2").alias("xy2"), F.sum(F.col("cxy2") / F.col("cx")).alias("pd"))
    b = by_y.agg(F.sum(F.col("cy") * F.col("cy")).alias("y2"))
    n = F.col("n")
    g1 = F.when(n < 2, 0.0).otherwise((F.col("x2") - F.col("xy2")) / (n * n))
    pdep, pdep_y = F.col("pd") / n, F.col("y2") / (n * n)
    mu = F.when((n < 2) | (F.col("n_x") >= n) | (F.col("y2") == n * n), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (n - F.col("n_x")) / (n - 1) * (1 - pdep) / (1 - pdep_y))))
    return a.join(b).select("n", "n_x", g1.alias("g1"), pdep.alias("pdep"), pdep_y.alias("pdep_y"), mu.alias("mu_prime"))


def dependency_measures(df: DataFrame, x: list[str], y: str) -> tuple[float, float | None]:
    """g1 and mu' of x -> y; mu' is None for an empty x."""
    r = measures_frame(df.withColumn("__one", F.lit(1)), x or ["__one"], y).first()
    return float(r["g1"] or 0.0), float(r["mu_prime"]) if x else None


def g1_error(df: DataFrame, x: list[str], y: str) -> float:
    return dependency_measures(df, x, y)[0]


def mu_prime(df: DataFrame, x: list[str], y: str) -> float:
    return dependency_measures(df, x, y)[1] or 0.0


def pdep(df: DataFrame, x: list[str], y: str) -> float:
    return float(measures_frame(df, x, y).first()["pdep"] or 0.0)


def pdep_marginal(df: DataFrame, y: str) -> float:
    r = df.groupBy(f"`{y}`").count().agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("s")).first()
    return r["s"] / r["n"] ** 2 if r["n"] else 0.0


def holds_frame(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """One row: whether each x has one y, null being a value."""
    by = df.groupBy(*_q(x)).agg((F.count_distinct(f"`{y}`") + F.max(F.col(f"`{y}`").isNull().cast("int"))).alias("k"))
    return by.agg((F.coalesce(F.max("k"), F.lit(1)) <= 1).alias("holds"))


def holds_exactly(df: DataFrame, x: list[str], y: str) -> bool:
    return bool(holds_frame(df, x, y).first()["holds"])


def _value(c: str) -> Column:
    """A value's text, null told from every text."""
    return F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n"))


def _hashes(columns) -> tuple[Column, Column]:
    return F.xxhash64(*[_value(c) for c in columns]).alias("h"), F.xxhash64(F.lit(1), *[_value(c) for c in columns]).alias("g")


def _group_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[int, int]]:
    """For each column set the number of its distinct values (nulls count) and the sum of squared group sizes: one job for 24 sets, over 128-bit hashes."""
    out = {}
    for some in [sets[i : i + 24] for i in range(0, len(sets), 24)]:
        hashed = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *_hashes(s)) for i, s in enumerate(some)])).alias("e"))
        by = hashed.groupBy("e.i", "e.h", "e.g").agg(F.count(F.lit(1)).alias("c")).groupBy("i").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.col("c")).alias("s"))
        for r in by.collect():  # one row a set
            out[some[r["i"]]] = (r["k"], r["s"])
    return out


def pair_measures(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], dict[str, float]]:
    """g1, pdep and mu_prime of x -> y for many (x, y): one job for 16 pairs, over hashes."""
    out = {}
    for some in [pairs[i : i + 16] for i in range(0, len(pairs), 16)]:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(_value(x)).alias("x"), F.xxhash64(_value(y)).alias("y")) for i, (x, y) in enumerate(some)]))
        xy = df.select(cells.alias("e")).groupBy("e.i", "e.x", "e.y").agg(F.count(F.lit(1)).alias("c"))
        by_x = xy.groupBy("i", "x").agg(F.sum("c").alias("cx"), F.sum(F.col("c") * F.col("c")).alias("q"))
        a = by_x.groupBy("i").agg(F.sum("cx").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("cx") * F.col("cx")).alias("x2"), F.sum("q").alias("xy2"), F.sum(F.col("q") / F.col("cx")).alias("pd"))
        b = xy.groupBy("i", "y").agg(F.sum("c").alias("cy")).groupBy("i").agg(F.sum(F.col("cy") * F.col("cy")).alias("y2"))
        for r in a.join(b, "i").collect():  # one row a pair
            n, k = r["n"], r["k"]
            pdep, pdep_y = r["pd"] / n, r["y2"] / (n * n)
            mu = 0.0 if n < 2 or k >= n or r["y2"] == n * n else max(0.0, min(1.0, 1 - (n - k) / (n - 1) * (1 - pdep) / (1 - pdep_y)))
            out[some[r["i"]]] = {"g1": (r["x2"] - r["xy2"]) / (n * n) if n > 1 else 0.0, "pdep": pdep, "mu_prime": mu}
    return out


#: Rows on which column sets are first tested: repeats there rule a set out for good.
TRIED_ROWS = 20_000


def composite_keys(df: DataFrame, columns: list[str], distinct: dict[str, int], rows: int, most: int = 3, width: int = 3) -> list[list[str]]:
    """The first `most` minimal sets of 2 to `width` columns without nulls that no two rows share, narrowest and alphabetically first.

    Numbers of distinct values, then repeats in some rows, rule sets out; the others are counted on all rows.
    """
    if rows < 2:
        return []
    found: list[list[str]] = []
    tried = df.select(*_q(columns)).limit(TRIED_ROWS)
    for size in range(2, width + 1):
        sets = [s for s in itertools.combinations(sorted(columns), size) if not any(set(f) <= set(s) for f in found) and 1.1 * reduce(lambda a, b: a * b, [distinct[c] for c in s]) >= rows]
        if not sets or len(found) >= most:
            continue
        small = _group_counts(tried, sets)
        n = min(rows, TRIED_ROWS)
        sets = [s for s in sets if small[s][0] >= n]
        for some in [sets[i : i + 8] for i in range(0, len(sets), 8)]:
            whole = _group_counts(df, some)
            found += [list(s) for s in some if whole[s][0] == rows]
            if len(found) >= most:
                break
    return found[:most]


def functional_dependencies(df: DataFrame, max_lhs: int = 2, error: float = 0.0, min_mu: float | None = None, columns: list[str] | None = None) -> list[dict]:
    """Minimal x -> y with g1 <= error (0: exact), by levels of the lattice, each level one job.

    A dependency is minimal if none of its left side's subsets is within the error. An empty left side is a constant column.
    """
    cols = columns or discovery_columns(df)
    n = df.count()
    if n == 0 or not cols:
        return []
    counts = {(): (1, n * n)} | _group_counts(df, [(c,) for c in cols])
    found: list[dict] = []
    done: dict[str, list[set[str]]] = {c: [] for c in cols}
    for size in range(max_lhs + 1):
        candidates = [(x, y) for y in cols for x in itertools.combinations([c for c in cols if c != y], size) if not any(d <= set(x) for d in done[y])]
        # a left side that is a key decides everything and says nothing
        need = {tuple(sorted(x)) for x, _ in candidates} | {tuple(sorted((*x, y))) for x, y in candidates}
        counts |= _group_counts(df, sorted(need - set(counts)))
        for x, y in candidates:
            kx, sx = counts[tuple(sorted(x))]
            kxy, sxy = counts[tuple(sorted((*x, y)))]
            g1 = (sx - sxy) / (n * n) if n > 1 else 0.0
            if (kx == kxy) if error == 0 else g1 <= error + 1e-12:
                done[y].append(set(x))
                found.append({"lhs": list(x), "rhs": y, "g1": g1})
    if min_mu is not None:
        found = [f | {"mu_prime": mu_prime(df, f["lhs"], f["rhs"])} for f in found if f["lhs"]]
        found = [f for f in found if f["mu_prime"] >= min_mu]
    return found


def unique_columns(df: DataFrame, max_columns: int = 3, columns: list[str] | None = None) -> list[list[str]]:
    """Minimal column sets whose values (rows with a null part left out) do not repeat; supersets are not tried."""
    cols = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    found: list[list[str]] = []
    for size in range(1, max_columns + 1):
        sets = [s for s in itertools.combinations(cols, size) if not any(set(f) <= set(s) for f in found)]
        for some in [sets[i : i + 16] for i in range(0, len(sets), 16)]:
            key = lambda s: F.when(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in s]), F.struct(*_q(s)))
            r = df.agg(*[x for i, s in enumerate(some) for x in (F.count(key(s)).alias(f"n{i}"), F.count_distinct(key(s)).alias(f"d{i}"))]).first()
            found += [list(s) for i, s in enumerate(some) if r[f"n{i}"] and r[f"n{i}"] == r[f"d{i}"]]
    return found


def inclusion_frame(tables: dict[str, DataFrame], columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """child, parent, overlap, distinct: for each ordered pair of columns of one kind, how many of the child's values the parent has.

    Every (value, column) once, then the columns of each value meet: a value's group holds at most one row per column.
    """
    columns = columns or [(t, f.name) for t, df in tables.items() for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]

    def normal(t: str, c: str):
        kind = value_kind(tables[t].schema[c].dataType)
        col = F.col(f"`{c}`")
        if kind == "numeric":
            d = col.cast("double")
            col = F.when((d == F.floor(d)) & (F.abs(d) < 2.0**53), col.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
        return F.concat(F.lit(kind[0] + "|"), col.cast("string"))

    values = reduce(DataFrame.unionAll, [tables[t].select(normal(t, c).alias("v"), F.lit(f"{t}.{c}").alias("a")) for t, c in columns]).filter("v IS NOT NULL").distinct()
    sizes = values.groupBy("a").agg(F.count(F.lit(1)).alias("distinct"))
    sets = values.groupBy("v").agg(F.collect_set("a").alias("s"))  # at most one entry a column
    pairs = sets.select(F.explode("s").alias("child"), "s").select("child", F.explode("s").alias("parent")).filter("child <> parent").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("overlap"))
    return pairs.join(F.broadcast(sizes), pairs["child"] == sizes["a"]).select("child", "parent", "overlap", "distinct")  # one row a column


def inclusion_dependencies(tables: dict[str, DataFrame], error: float = 0.0, columns: list[tuple[str, str]] | None = None) -> list[dict]:
    rows = inclusion_frame(tables, columns).filter(F.col("overlap") >= F.col("distinct") * (1 - error) - 1e-9).collect()  # at most columns squared
    return sorted(({"child": r["child"], "parent": r["parent"], "coverage": r["overlap"] / r["distinct"]} for r in rows), key=lambda d: (-d["coverage"], d["child"], d["parent"]))


def dependency_forest(edges: list[dict]) -> list[dict]:
    """A maximum spanning forest over lhs -> rhs edges by mu', each tree directed away from its best root.

    Edges: {lhs: [one column], rhs, mu_prime}. An edge used against its measured direction is marked reversed.
    """
    measured = {(e["lhs"][0], e["rhs"]): e["mu_prime"] for e in edges if len(e["lhs"]) == 1}
    group = {c: c for p in measured for c in p}

    def top(c: str) -> str:
        while group[c] != c:
            c = group[c]
        return c

    kept = []
    for (a, b), mu in sorted(measured.items(), key=lambda x: (-x[1], x[0])):
        if top(a) != top(b):
            group[top(a)] = top(b)
            kept.append((a, b))
    out = []
    for root in sorted({top(c) for c in group}):
        nodes = sorted(c for c in group if top(c) == root)
        links = [p for p in kept if top(p[0]) == root]

        def directed(start: str, links=links) -> list[dict]:
            seen, todo, got = {start}, [start], []
            while todo:
                at = todo.pop(0)
                for a, b in links:
                    if at in (a, b) and (other := b if at == a else a) not in seen:
                        seen.add(other)
                        todo.append(other)
                        got.append({"determinant": at, "dependent": other, "mu_prime": measured.get((at, other), measured.get((other, at))), "reversed": (at, other) not in measured})
            return got

        best = max(nodes, key=lambda c: (sum(e["mu_prime"] for e in directed(c) if not e["reversed"]), -nodes.index(c)))
        out += directed(best)
    return out


def provenance(result: dict, rows: int) -> dict:
    """How a dependency was inferred, for the Spec."""
    return {"algorithm": "lattice", "measure": "g1" if "g1" in result else "coverage", "error": result.get("g1"), "mu_prime": result.get("mu_prime"), "support": rows, "validated_on": "full"}
