"""Generation: a Spec becomes one DataFrame for each table.

Tables come in parent order. A table is a range of row ids; its foreign keys are equi-joins on parent numbers computed
from the row id, its other columns are expressions over counter-based randomness, applied level by level. Rules and
keys are met by drawing rejected rows again under the next attempt number, several attempts a round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import providers
from ..functions.generators import INLINE, TYPES, Context, apply_pii, build, conditional_key, conditional_table, resolve
from ..functions.rng import uniform
from ..functions.rules import Rule, frame_resolver
from ..plans.spec import ColumnSpec, Relationship, RuleViolation, Settings, Spec, SpecError, TableSpec, expand_many_to_many, sort_tables, topological

#: Attempts drawn together in a round; parents of up to this many rows, and of up to this many bytes by their columns' types, are joined by broadcast.
ATTEMPTS_PER_ROUND, BROADCAST_ROWS, BROADCAST_BYTES = 8, 200_000, 64 << 20
#: Where no rule bounds the attempts to make a column or key unique: rows draw up to DRAWS times the table's rows in a round, SMALL at least, each up to
#: ROW_DRAWS values; they are given up after VAIN times the table's rows (SMALL at least), or VAIN rounds, in which no row drew a free value.
DRAWS, SMALL, ROW_DRAWS, VAIN = 4, 1 << 16, 1 << 20, 32
#: Most groups of rows whose totals are summed in one task.
GROUPS = 1 << 16


class GenerationResult:
    """The tables of a run, lazily, with their columns in declared order."""

    def __init__(self, spec: Spec, tables: dict[str, DataFrame], written: list[DataFrame] | None = None):
        self.spec, self.tables, self._written = spec, tables, written or []

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def to_frames(self) -> dict[str, DataFrame]:
        return dict(self.tables)

    def close(self) -> None:
        """Delete the intermediate rows of rejected attempts; the tables cannot be read afterwards."""
        from ..sources.storage import drop

        drop(*self._written)

    def write(self, out: str, fmt: str | None = None) -> None:
        from ..sources.files import write

        write(self.tables, out, fmt, self.spec)


def validate(spec: Spec) -> None:
    """Raises SpecError for references and shapes that can't hold."""
    names = [t.name for t in spec.tables]
    if len(set(names)) != len(names):
        raise SpecError("two tables have one name")
    if spec.settings.fallback not in ("raise", "drop", "null"):
        raise SpecError(f"unknown fallback {spec.settings.fallback}")
    for t in spec.tables:
        cols = [c.name for c in t.columns]
        if len(set(cols)) != len(cols):
            raise SpecError(f"{t.name}: two columns have one name")
        for c in t.columns:
            if c.dtype not in TYPES:
                raise SpecError(f"{t.name}.{c.name}: unknown dtype {c.dtype}")
            for d in c.depends_on:
                if d not in cols:
                    raise SpecError(f"{t.name}.{c.name}: depends on unknown column {d}")
        for key in [t.key, *t.unique_constraints]:
            if missing := [k for k in key if k not in cols]:
                raise SpecError(f"{t.name}: key names unknown column {missing[0]}")
        for r in t.relationships:
            parent = spec.table(r.parent)
            if parent is None:
                raise SpecError(f"{t.name}: relationship to unknown table {r.parent}")
            if len(r.columns) != len(r.parent_columns):
                raise SpecError(f"{t.name}: relationship to {r.parent} pairs {len(r.columns)} with {len(r.parent_columns)} columns")
            for c in r.columns:
                if c not in cols:
                    raise SpecError(f"{t.name}: relationship names unknown column {c}")
            for c in r.parent_columns:
                if parent.column(c) is None:
                    raise SpecError(f"{t.name}: relationship names unknown column {r.parent}.{c}")
            if r.allocation not in ("uniform", "balanced", "weighted") or r.cardinality not in ("many_to_one", "one_to_one"):
                raise SpecError(f"{t.name}: unknown allocation {r.allocation} or cardinality {r.cardinality}")
            if r.allocation == "weighted" and (not r.weight_column or parent.column(r.weight_column) is None):
                raise SpecError(f"{t.name}: weighted allocation needs a weight_column of {r.parent}")
            if r.parent == t.name and not all(t.column(c).nullable for c in r.columns):
                raise SpecError(f"{t.name}: a self-reference must be nullable")
            if r.ordered and not r.order_column:
                raise SpecError(f"{t.name}: ordered children need an order_column")
        for text in t.rules:
            rule = Rule(text, spec.settings.if_semantics)
            aliases = {r.name for r in t.relationships} | {r.parent for r in t.relationships}
            if missing := rule.parent_aliases - aliases:
                raise SpecError(f"{t.name}: rule names unknown parent {sorted(missing)[0]}")
            if missing := rule.column_refs - set(cols):
                raise SpecError(f"{t.name}: rule names unknown column {sorted(missing)[0]}")


def column_levels(t: TableSpec, spec: Spec) -> list[list[ColumnSpec]]:
    """Columns that no relationship fills, grouped so that each group needs earlier ones only; `when` conditions count."""
    fk = {c for r in t.relationships for c in r.columns}
    free = [c for c in t.columns if c.name not in fk]
    names = {c.name for c in free}
    needs = {}
    for c in free:
        on = c.params.get("on", [])
        refs = set(c.depends_on) | set([on] if isinstance(on, str) else on)
        for w in c.when:
            refs |= Rule(w.condition).column_refs
        needs[c.name] = (refs & names) - {c.name}
    depth: dict[str, int] = {}
    for n in topological(needs, f"columns of {t.name}"):
        depth[n] = 1 + max((depth[d] for d in needs[n]), default=-1)
    return [[c for c in free if depth[c.name] == d] for d in range(max(depth.values(), default=-1) + 1)]


def redrawn(t: TableSpec) -> set[str]:
    """The columns that a new attempt draws again: those that rules or keys name, and what depends on them."""
    out = {c for k in [t.key, *t.unique_constraints, *[[c.name] for c in t.columns if c.constraints.get("unique")]] for c in k}
    for text in t.rules:
        out |= Rule(text).column_refs
    while True:
        more = set()
        for c in t.columns:
            on = c.params.get("on", [])
            refs = set(c.depends_on) | set([on] if isinstance(on, str) else on)
            for w in c.when:
                refs |= Rule(w.condition).column_refs
            if refs & out and c.name not in out:
                more.add(c.name)
        if not more:
            return out
        out |= more


class Engine:
    """Runs a Spec on Spark. portable: randomness that other SQL engines can repeat bit for bit."""

    def __init__(self, spark: SparkSession, spec: Spec, portable: bool = False, attempts_per_round: int = ATTEMPTS_PER_ROUND):
        self.spark, self.spec, self.portable, self.each = spark, expand_many_to_many(spec), portable, attempts_per_round
        validate(self.spec)
        self.settings: Settings = self.spec.settings
        self.tables: dict[str, DataFrame] = {}
        #: Rows of tables that lost some.
        self.counts: dict[str, int] = {}
        self.written: list[DataFrame] = []

    def run(self, sink: Callable[[str, DataFrame], None] | None = None, with_id: bool = False) -> GenerationResult:
        """All tables; with a sink, each is also handed to it as soon as it is planned, with_id: with its row number `_rid`."""
        for t in sort_tables(self.spec):
            self.tables[t.name] = self._table(t)
            if sink:
                sink(t.name, self.tables[t.name].select(*["_rid"] * with_id, *[f"`{c.name}`" for c in t.columns]))
        return GenerationResult(self.spec, {n: df.select(*[f"`{c.name}`" for c in self.spec.table(n).columns]) for n, df in self.tables.items()}, self.written)

    # parents

    def _u(self, t: TableSpec, what: str, *more) -> Column:
        return uniform(str(self.settings.seed), t.name, what, F.col("_rid"), *more, portable=self.portable)

    def _rows(self, name: str) -> int:
        """How many rows a finished table has."""
        return self.counts.get(name, self.spec.table(name).row_count)

    def _numbered(self, name: str) -> DataFrame:
        """The parent's rows with `_idx` 0..n-1."""
        df = self.tables[name]
        return df.withColumn("_idx", F.col("_rid") - 1)

    def _attach(self, df: DataFrame, t: TableSpec, r: Relationship, retry: bool) -> DataFrame:
        """df with the foreign key's columns and the parent's row as the struct __p_<alias>."""
        if r.parent == t.name:
            return df
        parent = self._numbered(r.parent)
        pspec = self.spec.table(r.parent)
        n = self._rows(r.parent)
        if n == 0:
            raise SpecError(f"{t.name}: parent {r.parent} has no rows")
        low, high = r.min_children or 0, r.max_children
        if low * n > t.row_count or (high is not None and high * n < t.row_count):
            raise SpecError(f"{t.name}: {t.row_count} rows can't give each of {n} parents in {r.parent} between {low} and {high} children")
        again = set(r.columns) & redrawn(t) or {r.name, r.parent} & {a for text in t.rules for a in Rule(text).parent_aliases}
        u = self._u(t, f"fk.{r.name}", *([F.col("_attempt") if again else F.lit(0)] if retry else []))
        if t.metadata.get("many_to_many"):
            m, side = t.metadata["many_to_many"], [x.columns[0] for x in t.relationships].index(r.columns[0])
            k, (na, nb) = t.row_count, [self._rows(x.parent) for x in t.relationships]
            if k > na * nb:
                raise SpecError(f"{t.name}: more pairs than combinations")
            s = F.col("_rid") - 1
            base, extra = divmod(k, na)
            # the first `extra` left rows hold base + 1 pairs in a row, the rest base; right rows take turns
            a = F.when(s < extra * (base + 1), F.floor(s / (base + 1))).otherwise(extra + F.floor((s - extra * (base + 1)) / max(1, base)))
            df = df.withColumn("_want", (a if side == 0 else s % nb).cast("long"))
            parent = self._shuffled(parent, r, n)
        elif r.cardinality == "one_to_one":
            if t.row_count > n:
                raise SpecError(f"{t.name}: one_to_one needs as many rows in {r.parent}")
            df = df.withColumn("_want", F.col("_rid") - 1)
            parent = self._shuffled(parent, r, n)
        elif r.allocation == "balanced" or ((r.min_children or r.max_children is not None) and r.allocation == "uniform"):
            df = df.withColumn("_want", (F.col("_rid") - 1) % n)
            parent = self._shuffled(parent, r, n)
        elif r.allocation == "weighted":
            return self._weighted(df, parent, t, r, u)
        else:
            df = df.withColumn("_want", F.floor(u * n).cast("long"))
        row = F.struct(*[F.col(f"`{c.name}`") for c in pspec.columns]).alias(f"__p_{r.name}")
        side = parent.select(F.col("_idx").alias("_want"), row)
        width = sum(64 if c.dtype in ("str", "uuid") else 16 for c in pspec.columns)
        joined = df.join(F.broadcast(side) if n <= min(BROADCAST_ROWS, BROADCAST_BYTES // max(1, width)) else side, "_want").drop("_want")
        return self._copy(joined, r)

    def _copy(self, df: DataFrame, r: Relationship) -> DataFrame:
        return df.withColumns({c: F.col(f"__p_{r.name}").getField(p) for c, p in zip(r.columns, r.parent_columns)})

    def _shuffled(self, parent: DataFrame, r: Relationship, n: int) -> DataFrame:
        """Parents renumbered by a fixed affine permutation of 0..n-1, without a sort."""
        step = next(s for s in range(int(n * 0.618) | 1, 2 * n + 2) if _coprime(s, n))
        at = F.col("_idx") if n < 3_000_000_000 else F.col("_idx").cast("decimal(38,0)")
        return parent.withColumn("_idx", ((at * step + self.settings.seed % n) % n).cast("long"))

    def _weighted(self, df: DataFrame, parent: DataFrame, t: TableSpec, r: Relationship, u: Column) -> DataFrame:
        """Parents in proportion to their weights: children and parents meet in slices of the cumulated weight."""
        w = F.greatest(F.lit(0.0), F.coalesce(F.col(f"`{r.weight_column}`").cast("double"), F.lit(0.0)))
        n = self._rows(r.parent)
        blocks = max(64, min(GROUPS, n // 100_000))
        parts = parent.withColumn("_w", w).withColumn("_b", (F.col("_idx") % blocks).cast("int"))
        sums = {x["_b"]: x["s"] for x in parts.groupBy("_b").agg(F.sum("_w").alias("s")).collect()}  # one row a block
        total = sum(sums.values())
        if total <= 0:
            raise SpecError(f"{t.name}: no weight in {r.parent}.{r.weight_column} is above 0")
        start, table = 0.0, []
        for b in range(blocks):
            table.append((b, start))
            start += sums.get(b, 0.0)
        parts = parts.join(F.broadcast(self.spark.createDataFrame(table, "_b int, _start double")), "_b")  # one row a block
        offset = F.col("_start")
        hi = F.sum("_w").over(Window.partitionBy("_b").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)) + offset
        row = F.struct(*[F.col(f"`{c.name}`") for c in self.spec.table(r.parent).columns]).alias(f"__p_{r.name}")
        slices = max(1, min(1 << 40, n))
        cut = lambda x: F.least(F.floor(x / total * slices), F.lit(slices - 1)).cast("long")
        spans = parts.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_w")).filter("_w > 0").select(row, "_lo", "_hi", F.explode(F.sequence(cut(F.col("_lo")), cut(F.col("_hi")))).alias("_slice"))
        child = df.withColumn("_at", u * total).withColumn("_slice", cut(F.col("_at")))
        return self._copy(child.join(spans, (child["_slice"] == spans["_slice"]) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).drop("_slice", "_at", "_lo", "_hi"), r)

    def _self_reference(self, df: DataFrame, t: TableSpec, r: Relationship) -> DataFrame:
        """Parents among earlier rows. Without max_depth a row draws any earlier one; with it, levels are drawn first."""
        root = (F.col("_rid") == 1) | (self._u(t, f"root.{r.name}") < r.root_fraction)
        u = self._u(t, f"self.{r.name}")
        if r.max_depth is None:
            want = F.when(~root, F.lit(1) + F.floor(u * (F.col("_rid") - 1)))
        else:
            # a row that is no root has a level 1..max_depth by its id and takes an earlier row of the level above, which
            # is at most that deep; one of level 1 takes an earlier root: a drawn row if that is one, else the first
            levels = r.max_depth
            at = F.col("_rid") - 2
            drawn = (F.lit(1) + F.floor(u * (F.col("_rid") - 1))).cast("long")
            is_root = uniform(str(self.settings.seed), t.name, f"root.{r.name}", drawn, portable=self.portable) < r.root_fraction
            above = (at % F.lit(max(1, levels)) + 1 + levels * F.floor(u * (F.floor(at / max(1, levels)) + 1))).cast("long")
            want = F.when(~root & F.lit(levels > 0), F.when(at % max(1, levels) > 0, above).otherwise(F.when(is_root, drawn).otherwise(F.lit(1))))
        return df.withColumn("_up", want.cast("long"))

    # columns

    def _value(self, c: ColumnSpec, t: TableSpec, known: dict[str, T.DataType], parents: dict[str, T.StructType]) -> Column:
        kind, attempt = TYPES[c.dtype], F.col("_attempt") if c.name in redrawn(t) else F.lit(0)
        if c.pii and c.pii_strategy == "faker" and not (c.generator or "").startswith("faker."):
            provider = providers.hint(c.name)
            if provider is None and c.dtype in ("int", "float"):
                value = providers.number(Context(self.settings.seed, t.name, c.name, {}, attempt=attempt, portable=self.portable), 0, 9999, "n")
                return (value / 100 if c.dtype == "float" else value).cast(kind)
            name, params = f"faker.{provider or 'word'}", {}
        else:
            name, params = resolve(c)
        ctx = lambda p: Context(self.settings.seed, t.name, c.name, p, attempt=attempt, portable=self.portable, dtype=c.dtype, known=known, aliases=parents)
        schema = T.StructType([T.StructField(k, v) for k, v in known.items()])
        value = F.col(f"`_fk_{c.name}`") if name == "fk" else build(name, ctx(params)).cast(kind)
        for w in reversed(c.when):
            value = F.when(Rule(w.condition, self.settings.if_semantics).check(frame_resolver(schema, parents)), build(w.generator, ctx(w.params)).cast(kind)).otherwise(value)
        value = apply_pii(value, c)
        rate = c.constraints.get("null_rate", 0) or 0
        if c.nullable and rate > 0 and name != "conditional":
            u = Context(self.settings.seed, t.name, c.name + ".null", {}, attempt=attempt, portable=self.portable).u()
            value = F.when(u < float(rate), F.lit(None).cast(kind)).otherwise(value)
        return value

    def _columns(self, df: DataFrame, t: TableSpec) -> DataFrame:
        parents = {r.name: df.schema[f"__p_{r.name}"].dataType for r in t.relationships if f"__p_{r.name}" in df.columns}
        parents |= {r.parent: parents[r.name] for r in t.relationships if r.name in parents and r.parent not in parents}
        df = df.withColumns({f"__p_{r.parent}": F.col(f"__p_{r.name}") for r in t.relationships if f"__p_{r.name}" in df.columns and f"__p_{r.parent}" not in df.columns})
        for level in column_levels(t, self.spec):
            for c in level:
                if c.generator == "fk":
                    table, col = c.params["ref"].split(".", 1)
                    n = self._rows(table)
                    if not n:
                        raise SpecError(f"{t.name}.{c.name}: {table} has no rows")
                    side = self._numbered(table).select(F.col("_idx").alias("_want"), F.col(f"`{col}`").alias(f"_fk_{c.name}"))
                    df = df.withColumn("_want", F.floor(self._u(t, c.name, F.col("_attempt") if c.name in redrawn(t) else F.lit(0)) * n).cast("long")).join(side, "_want").drop("_want")
                elif c.generator == "conditional" and len(c.params.get("keys") or []) > INLINE:
                    df = self._looked_up(df, c, t)
            known = {f.name: f.dataType for f in df.schema.fields if not f.name.startswith(("__p_", "_fk_")) and f.name not in ("_rid", "_attempt", "_up")}
            df = df.withColumns({c.name: self._value(c, t, known, parents) for c in level})
        return df

    def _looked_up(self, df: DataFrame, c: ColumnSpec, t: TableSpec) -> DataFrame:
        """df with the distribution that a long conditional table has for the row's key, as _fk_<column>."""
        keys, v, w = conditional_table(c.params, f"{t.name}.{c.name}")
        kind = TYPES.get(c.dtype, T.StringType())
        rows = [(k, [None if x is None else str(x) for x in vs], cs) for k, vs, cs in zip(keys, v, w)]
        side = self.spark.createDataFrame(rows, "_key string, v array<string>, c array<double>").dropDuplicates(["_key"])
        side = side.select("_key", F.struct(F.col("v").cast(T.ArrayType(kind)).alias("v"), "c").alias(f"_fk_{c.name}"))
        return df.withColumn("_key", conditional_key(c.params)).join(side, "_key", "left").drop("_key")

    def _passes(self, df: DataFrame, t: TableSpec) -> Column:
        parents = {n[4:]: df.schema[n].dataType for n in df.columns if n.startswith("__p_")}
        plain = T.StructType([f for f in df.schema.fields if not f.name.startswith("__p_")])
        checks = [Rule(text, self.settings.if_semantics).check(frame_resolver(plain, parents)) for text in t.rules]
        return reduce(lambda a, b: a & b, checks, F.lit(True))

    def _table(self, t: TableSpec) -> DataFrame:
        ids = self.spark.range(1, t.row_count + 1).select(F.col("id").alias("_rid"))
        keys = [k for k in [t.key, *t.unique_constraints, *[[c.name] for c in t.columns if c.constraints.get("unique")]] if k]
        generated = {c.name for c in t.columns if c.generator not in ("sequence", "uuid")}
        fk = {c for r in t.relationships for c in r.columns}
        # sequences and seeded uuids are unique as they are, and so are pairs dealt out as such
        keys = [k for k in keys if all(c in generated for c in k) and not (t.metadata.get("many_to_many") and set(k) <= fk) and not any(r.parent == t.name for r in t.relationships if set(r.columns) & set(k))]
        fixed = [r for r in t.relationships if r.cardinality == "one_to_one" or r.allocation == "balanced" or r.min_children or r.max_children is not None or t.metadata.get("many_to_many")]

        def draw(rows: DataFrame) -> DataFrame:
            for r in t.relationships:
                rows = self._attach(rows, t, r, r not in fixed)
            return self._columns(rows, t)

        if not t.rules and not keys:
            out = draw(ids.withColumn("_attempt", F.lit(0)))
        else:
            out = self._accepted(ids, draw, t, keys)
        if t.name in self.counts:
            out = self._renumbered(out, t)
        for r in t.relationships:
            if r.parent == t.name:
                out = self._self_reference(out, t, r)
                up = out.select(F.col("_rid").alias("_up"), *[F.col(f"`{p}`").alias(c) for c, p in zip(r.columns, r.parent_columns)])
                out = out.drop(*r.columns).join(up, "_up", "left").drop("_up")
        for r in t.relationships:
            if r.ordered:
                out = out.withColumn(r.order_column, F.row_number().over(Window.partitionBy(*r.columns).orderBy("_rid")).cast("long"))
        return out.select("_rid", *[f"`{c.name}`" for c in t.columns])

    def _renumbered(self, out: DataFrame, t: TableSpec) -> DataFrame:
        """Sequences count accepted rows: ids are dealt anew where rows were dropped."""
        width = max(4096, -(-t.row_count // GROUPS))
        group = F.floor(F.col("_rid") / width)
        counts = out.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # at most GROUPS rows
        starts = counts.withColumn("s", F.coalesce(F.sum("n").over(w), F.lit(0))).select("g", "s")
        own = F.row_number().over(Window.partitionBy("_g").orderBy("_rid"))
        out = out.withColumn("_g", group).withColumn("_own", own).join(F.broadcast(starts), F.col("_g") == F.col("g")).withColumn("_rid", F.col("s") + F.col("_own")).drop("g", "s", "_g", "_own")
        return out.withColumns({c.name: F.col("_rid").cast("long") for c in t.columns if c.generator == "sequence"})

    def _accepted(self, ids: DataFrame, draw: Callable[[DataFrame], DataFrame], t: TableSpec, keys: list[list[str]]) -> DataFrame:
        from ..sources.storage import checkpointed

        done: DataFrame | None = None
        pending, left, attempt, each, most, vain = ids, t.row_count, 0, self.each if t.rules else 1, max(1, self.settings.max_rule_attempts), 0.0
        while True:
            step = min(each, most - attempt) if t.rules else max(1, min(each, ROW_DRAWS, max(SMALL, DRAWS * t.row_count) // max(1, left)))
            tried = draw(pending.select("_rid", F.explode(F.sequence(F.lit(attempt), F.lit(attempt + step - 1))).alias("_attempt")))
            tried = tried.filter(self._passes(tried, t))
            tried = tried.drop(*[c for c in tried.columns if c.startswith(("__p_", "_fk_"))])
            for k in keys if done is not None else []:
                # a row's first attempt is one whose keys no row of an earlier round has
                cols = [F.col(f"`{c}`") for c in k]
                old = done.select(*[c.alias(f"_k{i}") for i, c in enumerate(cols)])
                tried = tried.join(old, reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cols)]), "left_anti")
            tried = tried.withColumn("_n", F.row_number().over(Window.partitionBy("_rid").orderBy("_attempt"))).filter("_n = 1").drop("_n")
            for k in keys:
                tried = tried.withColumn("_n", F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in k]).orderBy("_rid"))).filter("_n = 1").drop("_n")
            got = checkpointed(tried)
            done = got if done is None else done.unionByName(got)
            pending = checkpointed(pending.join(got.select("_rid"), "_rid", "left_anti"))
            self.written += [got, pending]
            before, left = left, pending.count()
            vain = 0.0 if left < before else vain + max(1 / VAIN, left * step / max(SMALL, VAIN * t.row_count))
            attempt, each = attempt + step, min(64, each * 2) if t.rules else each * 4
            if not left or (attempt >= most if t.rules else vain >= 1):
                break
        if not left:
            return done
        if self.settings.fallback == "raise":
            raise RuleViolation(f"{t.name}: {left} rows broke the rules or keys in each of {attempt} attempts")
        if self.settings.fallback == "drop":
            self.counts[t.name] = t.row_count - left
            return done
        null = draw(pending.withColumn("_attempt", F.lit(attempt)))
        fk = {c for r in t.relationships for c in r.columns}
        null = null.withColumns({c.name: F.lit(None).cast(TYPES[c.dtype]) for c in t.columns if c.name not in fk})
        return done.unionByName(null.select(*done.columns))


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def generate(spark: SparkSession, spec: Spec, **options) -> GenerationResult:
    return Engine(spark, spec, **options).run()
