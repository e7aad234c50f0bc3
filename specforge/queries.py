"""One query for each operator, over the TPC-H-like tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import generators as G
from .functions.rng import uniform_sql
from .functions.rules import Rule, frame_resolver
from .operators import conformance, discovery, metrics, profile
from .operators.engine import Engine
from .plans.spec import from_dict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Every pass over a table splits it by key parity into a real (even) and a synthetic (odd) half where a metric needs two.
SEED = 42


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 == 1)


# generators: rows are keyed by o_orderkey


def _gen(name: str, dtype: str, params: dict, sql: str, decimals: int | None = None) -> None:
    def query(spark, sf):
        ctx = G.Context(SEED, "gen", name, params, row_id=F.col("o_orderkey"), attempt=F.lit(0), portable=True, dtype=dtype)
        v = G.build(name.split("_")[0], ctx).cast(G.TYPES[dtype])
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (v if decimals is None else F.round(v, decimals)).alias("v"))

    add(f"gen_{name}", query, f"SELECT o_orderkey AS id, {sql if decimals is None else f'round({sql}, {decimals})'} AS v FROM orders")


def _u(column: str, draw: str = "0", row: str = "o_orderkey", space: str = "gen") -> str:
    return uniform_sql(f"'{SEED}'", f"'{space}'", f"'{column}'", row, "0", f"'{draw}'")


def _choice(values: list[str], cdf: list[float], u: str) -> str:
    return "(CASE " + " ".join(f"WHEN {u} <= {c!r} THEN '{v}'" for v, c in zip(values[:-1], cdf)) + f" ELSE '{values[-1]}' END)"


_gen("int", "int", {"min": 5, "max": 95, "step": 3}, f"CAST(5 + floor({_u('int')} * 31) * 3 AS BIGINT)")
_gen("float", "float", {"min": 1.0, "max": 50.0}, f"1.0::DOUBLE + {_u('float')} * (50.0::DOUBLE - 1.0::DOUBLE)", 6)
_gen("bool", "bool", {"p": 0.3}, f"{_u('bool')} < 0.3::DOUBLE")
_h = "md5(concat_ws('|', '42', 'gen', 'uuid', o_orderkey, 0))"
_gen("uuid", "uuid", {}, f"concat_ws('-', substr({_h}, 1, 8), substr({_h}, 9, 4), '4' || substr({_h}, 14, 3), substr('89ab', CAST(('0x' || substr({_h}, 17, 1))::INT % 4 + 1 AS INT), 1) || substr({_h}, 18, 3), substr({_h}, 21, 12))")
_gen("datetime", "datetime", {"start": "2020-01-01", "end": "2020-12-31"}, f"TIMESTAMP '2020-01-01' + to_seconds(CAST(floor({_u('datetime')} * 31536001) AS BIGINT))")
_gen("date", "date", {"start": "2020-01-01", "end": "2020-12-31"}, f"CAST(TIMESTAMP '2020-01-01' + to_seconds(CAST(floor({_u('date')} * 31536001) AS BIGINT)) AS DATE)")
_gen("choice", "str", {"values": ["a", "b", "c"], "weights": [1, 2, 1]}, _choice(["a", "b", "c"], [0.25, 0.75], _u("choice")))
_gen("sequence", "int", {}, "o_orderkey")
_gen("const", "str", {"value": "k"}, "'k'")
_letters = "'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_gen("regex", "str", {"pattern": "?-#"}, f"substr({_letters}, CAST(floor({_u('regex', 'b0')} * 52) + 1 AS INT), 1) || '-' || substr('0123456789', CAST(floor({_u('regex', 'b2')} * 10) + 1 AS INT), 1)")
_gen("string", "str", {"length": 3, "alphabet": "xyz"}, " || ".join(_choice(["x", "y", "z"], G.cdf_of(list("xyz"), None, ""), _u("string", str(i))) for i in (1, 2, 3)))
for _d, _p, _e in (
    ("uniform", {"min": 2, "max": 9}, "2 + {u} * 7"),
    ("normal", {"mean": 10, "std": 2}, "10 + 2 * (sqrt(-2.0 * ln(1.0 - {u})) * cos({v} * 6.283185307179586))"),
    ("lognormal", {"log_mu": 1, "log_sigma": 0.5}, "exp(1 + 0.5 * (sqrt(-2.0 * ln(1.0 - {u})) * cos({v} * 6.283185307179586)))"),
    ("exponential", {"scale": 3}, "-3.0 * ln(1.0 - {u})"),
    ("pareto", {"pareto_b": 2, "pareto_xmin": 1.5}, "1.5 * pow(1.0 - {u}, -0.5)"),
    ("empirical", {"hist_edges": [0, 1, 2, 3], "hist_counts": [0.25, 0.25, 0.5]}, "(CASE WHEN {u} <= 0.25 THEN 0 WHEN {u} <= 0.5 THEN 1 ELSE 2 END) + {v}"),
):
    _gen(f"float_{_d}", "float", {"distribution": _d, **_p}, "(" + _e.format(u=_u(f"float_{_d}"), v=_u(f"float_{_d}", "1")) + ")", 6)


def gen_conditional(spark, sf):
    p = {"on": "o_orderstatus", "keys": ["F", "O"], "values": [["x", "y"], ["z"]], "weights": [[1, 3], [1]], "default": {"values": ["d"]}}
    ctx = G.Context(SEED, "gen", "conditional", p, row_id=F.col("o_orderkey"), attempt=F.lit(0), portable=True)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), G.build("conditional", ctx).alias("v"))


add("gen_conditional", gen_conditional, f"SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN {_choice(['x', 'y'], [0.25], _u('conditional'))} WHEN 'O' THEN 'z' ELSE 'd' END AS v FROM orders")



for _s, _f, _q in (
    ("mask", lambda c: G.mask(c, "str"), "CASE WHEN length(c_name) <= 1 THEN '*' WHEN length(c_name) = 2 THEN c_name ELSE substr(c_name, 1, 1) || repeat('*', length(c_name) - 2) || substr(c_name, length(c_name), 1) END"),
    ("redact", lambda c: G.redact(c, "str"), "'REDACTED'"),
    ("hash", lambda c: G.hashed(c, "c_name"), "substr(sha256('c_name|' || c_name), 1, 12)"),
):
    add(f"pii_{_s}", lambda spark, sf, f=_f: table(spark, sf, "customer").select("c_custkey", f(F.col("c_name")).alias("v")), f"SELECT c_custkey, {_q} AS v FROM customer")


# relationships: synthetic children and parents with the row counts of orders and customer


def _star(spark: SparkSession, sf: str, rel: dict, rows: str = "orders", extra: list | None = None) -> Engine:
    n, m = table(spark, sf, "customer").count(), table(spark, sf, rows).count()
    return Engine(spark, from_dict({"settings": {"seed": SEED}, "tables": [
        {"name": "p", "row_count": n, "primary_key": "id", "columns": [{"name": "id", "dtype": "int", "generator": "sequence"}, {"name": "w", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 9}}]},
        {"name": "c", "row_count": m, "primary_key": "id", "columns": [{"name": "id", "dtype": "int", "generator": "sequence"}, {"name": "p_id", "dtype": "int"}, {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 99}}, *(extra or [])], "relationships": [{"from": "p_id", "to": "p.id", **rel}]},
    ]}), portable=True)


_P, _C = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"
_fk = f"floor({uniform_sql(repr('42'), repr('c'), repr('fk.p'), 'id', '0')} * {_P})::BIGINT + 1"
add("fk_uniform", lambda spark, sf: _star(spark, sf, {}).run()["c"].select("id", "p_id"), f"SELECT id, {_fk} AS p_id FROM (SELECT unnest(range(1, {_C} + 1)) AS id)")


def _degrees(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("children")).groupBy("children").agg(F.count(F.lit(1)).alias("parents"))


add("fk_balanced", lambda spark, sf: _degrees(_star(spark, sf, {"allocation": "balanced"}).run()["c"], "p_id"), f"SELECT children, parents FROM (SELECT {_C} // {_P} + 1 AS children, {_C} % {_P} AS parents UNION ALL SELECT {_C} // {_P}, {_P} - {_C} % {_P}) WHERE parents > 0")
add("fk_one_to_one", lambda spark, sf: _degrees(_star(spark, sf, {"cardinality": "one_to_one"}, "supplier").run()["c"], "p_id"), "SELECT CAST(1 AS BIGINT) AS children, count(*) AS parents FROM supplier")
add("ordered_children", lambda spark, sf: _star(spark, sf, {"ordered": True, "order_column": "s"}, extra=[{"name": "s", "dtype": "int", "generator": "const", "params": {"value": 7}}]).run()["c"].select("id", "p_id", "s"), f"SELECT id, p_id, row_number() OVER (PARTITION BY p_id ORDER BY id) AS s FROM (SELECT id, {_fk} AS p_id FROM (SELECT unnest(range(1, {_C} + 1)) AS id))")


def _employees(spark: SparkSession, sf: str, rel: dict) -> DataFrame:
    n = table(spark, sf, "customer").count()
    return Engine(spark, from_dict({"settings": {"seed": SEED}, "tables": [{"name": "e", "row_count": n, "primary_key": "id", "columns": [{"name": "id", "dtype": "int", "generator": "sequence"}, {"name": "boss", "dtype": "int"}], "relationships": [{"from": "boss", "to": "e.id", **rel}]}]}), portable=True).run()["e"]


_self = uniform_sql(repr("42"), repr("e"), repr("self.e"), "id")
_root = uniform_sql(repr("42"), repr("e"), repr("root.e"), "id")
_ids = f"(SELECT unnest(range(1, {_P} + 1)) AS id)"
add("self_reference", lambda spark, sf: _employees(spark, sf, {"root_fraction": 0.1}), f"SELECT id, CASE WHEN id = 1 OR {_root} < 0.1::DOUBLE THEN NULL ELSE 1 + floor({_self} * (id - 1))::BIGINT END AS boss FROM {_ids}")


def m2m_pairs(spark, sf):
    n, m = table(spark, sf, "customer").count(), table(spark, sf, "supplier").count()
    seq = [{"name": "id", "dtype": "int", "generator": "sequence"}]
    spec = from_dict({"settings": {"seed": SEED}, "tables": [{"name": "a", "row_count": n, "primary_key": "id", "columns": seq}, {"name": "b", "row_count": m, "primary_key": "id", "columns": seq}], "many_to_many": [{"name": "j", "left": "a", "right": "b", "left_column": "a_id", "right_column": "b_id", "row_count": 3 * n}]})
    j = Engine(spark, spec).run()["j"]
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("a_id", "b_id")).alias("pairs"), F.count_distinct("a_id").alias("a"), F.count_distinct("b_id").alias("b"))


add("m2m_pairs", m2m_pairs, f"SELECT 3 * {_P} AS n, 3 * {_P} AS pairs, {_P} AS a, (SELECT count(*) FROM supplier) AS b")




# rules over orders and their customer


def _rule(name: str, text: str, sql: str) -> None:
    def query(spark, sf):
        o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
        o = o.withColumn("note", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
        df = o.join(c.select(F.col("c_custkey").alias("k"), F.struct(*c.columns).alias("__p_customer")), o["o_custkey"] == F.col("k"))
        return df.select("o_orderkey", Rule(text).check(frame_resolver(o.schema, {"customer": c.schema})).alias("ok"))

    add(f"rule_{name}", query, f"SELECT o_orderkey, {sql} AS ok FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS note FROM orders) JOIN customer ON o_custkey = c_custkey")


_rule("compare", "o_totalprice > customer.c_acctbal and o_orderstatus != 'P'", "o_totalprice > c_acctbal AND o_orderstatus <> 'P'")
_rule("null_equal", "note == null or note > '3'", "note IS NULL OR note > '3'")
_rule("if_without_else", "if o_orderstatus == 'O' then o_totalprice >= 100000", "CASE WHEN o_orderstatus = 'O' THEN o_totalprice >= 100000 ELSE false END")
_rule("if_else", "if note then len(note) < 8 else o_custkey % 3 == 1", "CASE WHEN note IS NOT NULL THEN length(note) < 8 ELSE o_custkey % 3 = 1 END")
_rule("functions", "max(abs(0 - o_custkey), 10) > 50 and lower(coalesce(note, 'X')) != 'x' and days_between(o_orderdate, '1995-01-01') > 0", "greatest(abs(-o_custkey), 10) > 50 AND lower(coalesce(note, 'X')) <> 'x' AND CAST(o_orderdate AS DATE) > DATE '1995-01-01'")
_rule("modulo", "(0 - o_custkey) % 7 == 4", "((-o_custkey % 7) + 7) % 7 = 4")


# metrics


def _metric(name: str, t: str, key: str, frame, sql: str, decimals: int = 6) -> None:
    def query(spark, sf):
        return frame(*halves(table(spark, sf, t), key)).select(F.round("value", decimals).alias("value"))

    add(name, query, f"WITH b AS (SELECT *, {key} % 2 AS side FROM {t}) " + sql)


def _ks_sql(expr: str) -> str:
    return f", d AS (SELECT {expr} AS v, sum(1 - side) AS r, sum(side) AS s FROM b WHERE {expr} IS NOT NULL GROUP BY 1), c AS (SELECT sum(r) OVER o AS cr, sum(s) OVER o AS cs FROM d WINDOW o AS (ORDER BY v)) SELECT round(1 - max(abs(cr / (SELECT sum(r) FROM d) - cs / (SELECT sum(s) FROM d))), 6) AS value FROM c"


def _tv_sql(*exprs: str, source: str = "b") -> str:
    return f", d AS (SELECT {', '.join(f'{e} AS k{i}' for i, e in enumerate(exprs))}, sum(1 - side) AS r, sum(side) AS s FROM {source} GROUP BY {', '.join(str(i + 1) for i in range(len(exprs)))}) SELECT round(1 - 0.5 * sum(abs(r / (SELECT sum(r) FROM d) - s / (SELECT sum(s) FROM d))), 6) AS value FROM d"


_metric("ks_complement", "orders", "o_orderkey", lambda r, s: metrics.ks_frame(metrics.sided(r, s, lambda d: metrics.number(d, "o_totalprice"))), _ks_sql("o_totalprice"))
_metric("ks_complement_datetime", "orders", "o_orderkey", lambda r, s: metrics.ks_frame(metrics.sided(r, s, lambda d: metrics.number(d, "o_orderdate"))), _ks_sql("o_orderdate"))
_metric("tv_complement", "orders", "o_orderkey", lambda r, s: metrics.tv_frame(metrics.sided(r, s, lambda d: metrics.clean(d, "o_orderpriority"))), _tv_sql("o_orderpriority"))
_metric("range_coverage", "orders", "o_orderkey", lambda r, s: metrics.range_frame(r, s, "o_totalprice"), ", m AS (SELECT min(o_totalprice) FILTER (WHERE side = 0) AS a, max(o_totalprice) FILTER (WHERE side = 0) AS z, min(o_totalprice) FILTER (WHERE side = 1) AS x, max(o_totalprice) FILTER (WHERE side = 1) AS y FROM b) SELECT round(greatest(0.0, 1 - (greatest((x - a) / (z - a), 0) + greatest((z - y) / (z - a), 0))), 6) AS value FROM m")
_metric("category_coverage", "part", "p_partkey", lambda r, s: metrics.category_coverage_frame(r, s, "p_name"), ", d AS (SELECT p_name, min(side) AS lo, max(side) AS hi FROM b GROUP BY 1) SELECT round(count(*) FILTER (WHERE lo = 0 AND hi = 1) / count(*) FILTER (WHERE lo = 0), 6) AS value FROM d")
_metric("category_adherence", "part", "p_partkey", lambda r, s: metrics.category_adherence_frame(r, s, "p_name"), ", d AS (SELECT p_name, sum(1 - side) AS r, sum(side) AS s FROM b GROUP BY 1) SELECT round(sum(CASE WHEN r > 0 THEN s ELSE 0 END) / sum(s), 6) AS value FROM d")
_metric("boundary_adherence", "orders", "o_orderkey", lambda r, s: metrics.boundary_frame(r, s, "o_totalprice"), " SELECT round(avg(CASE WHEN o_totalprice BETWEEN (SELECT min(o_totalprice) FROM b WHERE side = 0) AND (SELECT max(o_totalprice) FROM b WHERE side = 0) THEN 1.0 ELSE 0.0 END), 6) AS value FROM b WHERE side = 1")
_metric("missing_similarity", "orders", "o_orderkey", lambda r, s: metrics.missing_frame(r.withColumn("x", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))), s.withColumn("x", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))), "x"), " SELECT round(1 - abs(avg(CASE WHEN o_custkey % 7 = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE side = 0) - avg(CASE WHEN o_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE side = 1)), 6) AS value FROM b")
_metric("contingency_similarity", "lineitem", "l_orderkey", lambda r, s: metrics.contingency_frame(r, s, "l_returnflag", "l_linestatus"), _tv_sql("l_returnflag", "l_linestatus"))
_metric("contingency_binned", "orders", "o_orderkey", lambda r, s: metrics.contingency_frame(r, s, "o_orderstatus", "o_totalprice", {"o_totalprice": metrics.bin_edges(r, "o_totalprice")}), ", m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM b WHERE side = 0), e AS (SELECT b.*, " + " + ".join(f"CASE WHEN o_totalprice >= a + (z - a) * {i} / 10 THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS bin FROM b, m)" + _tv_sql("o_orderstatus", "bin", source="e"))
_metric("correlation_similarity", "lineitem", "l_orderkey", lambda r, s: metrics.correlation_frame(r, s, "l_quantity", "l_extendedprice"), " SELECT round(1 - abs(corr(l_quantity, l_extendedprice) FILTER (WHERE side = 0) - corr(l_quantity, l_extendedprice) FILTER (WHERE side = 1)) / 2, 6) AS value FROM b")
_metric("spearman_similarity", "lineitem", "l_orderkey", lambda r, s: metrics.correlation_frame(r, s, "l_quantity", "l_extendedprice", "spearman"), ", x AS (SELECT side, rank() OVER (PARTITION BY side ORDER BY l_quantity) + (count(*) OVER (PARTITION BY side, l_quantity) - 1) / 2.0 AS p, rank() OVER (PARTITION BY side ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY side, l_extendedprice) - 1) / 2.0 AS q FROM b) SELECT round(1 - abs(corr(p, q) FILTER (WHERE side = 0) - corr(p, q) FILTER (WHERE side = 1)) / 2, 6) AS value FROM x")
_metric("text_length_complement", "documents", "doc_id", lambda r, s: metrics.text_length_frame(r, s, "text"), _ks_sql("length(text)"))
_metric("text_character_complement", "documents", "doc_id", lambda r, s: metrics.text_character_frame(r, s, "text"), ", x AS (SELECT unnest(string_split(text, '')) AS ch, side FROM b)" + _tv_sql("ch", source="(SELECT * FROM x WHERE ch <> '')"))
add("key_uniqueness", lambda spark, sf: metrics.key_uniqueness_frame(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.round("value", 6).alias("value")), "SELECT round(count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 6) AS value FROM lineitem")


def _report(kind: str) -> Query:
    def query(spark, sf):
        r, s = halves(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")
        r, s = r.drop("o_orderkey"), s.drop("o_orderkey")
        if kind == "diagnostic":
            rows = list(metrics.diagnostic_report(r, s)["checks"].items())
        else:
            rows = [(k, v["distance"]) for k, v in metrics.compare(r, s)["columns"].items()]
        return spark.createDataFrame([(k, round(float(v), 6)) for k, v in rows], "name string, value double")

    return query


_TV = "(SELECT 1 - 0.5 * sum(abs(r / (SELECT count(*) FROM b WHERE side = 0) - s / (SELECT count(*) FROM b WHERE side = 1))) FROM (SELECT sum(1 - side) AS r, sum(side) AS s FROM b GROUP BY {c}))"
_KS = "(SELECT 1 - max(abs(cr / (SELECT count(*) FROM b WHERE side = 0) - cs / (SELECT count(*) FROM b WHERE side = 1))) FROM (SELECT sum(1 - side) OVER o AS cr, sum(side) OVER o AS cs FROM b WINDOW o AS (ORDER BY o_totalprice)))"
add("compare_report", _report("compare"), f"WITH b AS (SELECT *, o_orderkey % 2 AS side FROM orders) SELECT 'o_orderstatus' AS name, round(1 - {_TV.format(c='o_orderstatus')}, 6) AS value UNION ALL SELECT 'o_orderpriority', round(1 - {_TV.format(c='o_orderpriority')}, 6) UNION ALL SELECT 'o_totalprice', round(1 - {_KS}, 6)")
add("diagnostic_report", _report("diagnostic"), "WITH b AS (SELECT *, o_orderkey % 2 AS side FROM orders) SELECT 'TableStructure' AS name, 1.0::DOUBLE AS value UNION ALL SELECT 'BoundaryAdherence:o_totalprice', round(avg(CASE WHEN o_totalprice BETWEEN (SELECT min(o_totalprice) FROM b WHERE side = 0) AND (SELECT max(o_totalprice) FROM b WHERE side = 0) THEN 1.0 ELSE 0.0 END), 6) FROM b WHERE side = 1 UNION ALL SELECT 'CategoryAdherence:o_orderstatus', round(avg(CASE WHEN o_orderstatus IN (SELECT o_orderstatus FROM b WHERE side = 0) THEN 1.0 ELSE 0.0 END), 6) FROM b WHERE side = 1 UNION ALL SELECT 'CategoryAdherence:o_orderpriority', round(avg(CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM b WHERE side = 0) THEN 1.0 ELSE 0.0 END), 6) FROM b WHERE side = 1")


# profiling


def profile_facts(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_note", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))).select("o_orderkey", "o_custkey", "o_orderstatus", "o_note")
    got = profile.facts(df)
    return spark.createDataFrame([(c, f["rows"], f["n"], f["d"], round(1 - f["n"] / f["rows"], 4)) for c, f in got.items()], "column_name string, n_rows long, n_values long, n_distinct long, null_rate double")


add("profile_nulls", profile_facts, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({e}) AS n_values, count(DISTINCT {e}) AS n_distinct, round(1 - count({e}) / count(*), 4) AS null_rate FROM orders" for c, e in (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus"), ("o_note", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END"))))


def profile_numeric(spark, sf):
    f = profile.facts(table(spark, sf, "lineitem").select("l_quantity", "l_discount"))
    return spark.createDataFrame([(c, float(v["lo"]), float(v["hi"]), round(v["m"], 6), round(v["s"], 6), profile.distribution(v)["distribution"]) for c, v in f.items()], "column_name string, low double, high double, mean double, std double, distribution string")


add("profile_numeric", profile_numeric, " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS low, max({c}) AS high, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CASE WHEN abs(stddev_samp({c}) - (max({c}) - min({c})) / sqrt(12)) < 0.1 * (max({c}) - min({c})) / sqrt(12) THEN 'uniform' ELSE 'other' END AS distribution FROM lineitem" for c in ("l_quantity", "l_discount")))


def profile_histogram(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity")
    _, counts = profile.histogram(df, "l_quantity", 1.0, 50.0, 20)
    return spark.createDataFrame([(i, round(c, 6)) for i, c in enumerate(counts)], "bin long, share double")


add("profile_histogram", profile_histogram, "SELECT i AS bin, round(coalesce(n, 0) / (SELECT count(*) FROM lineitem), 6) AS share FROM (SELECT unnest(range(20)) AS i) LEFT JOIN (SELECT least(floor((l_quantity - 1.0) / 49.0 * 20), 19)::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY 1) ON i = b")
add("profile_categorical", lambda spark, sf: spark.createDataFrame(profile.frequencies(table(spark, sf, "part"), "p_brand"), "v string, n long"), "SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1")
add("profile_text", lambda spark, sf: (lambda f: spark.createDataFrame([(int(f["lo"]), int(f["hi"]))], "shortest long, longest long"))(profile.facts(table(spark, sf, "documents").select("text"))["text"]), "SELECT min(length(text)) AS shortest, max(length(text)) AS longest FROM documents")
add("redact_tokens", lambda spark, sf: spark.createDataFrame(list(profile.redaction(profile.frequencies(table(spark, sf, "orders"), "o_orderpriority")).items()), "v string, token string"), "SELECT v, 'value_' || lpad(CAST(row_number() OVER (ORDER BY n DESC, v) AS VARCHAR), 3, '0') AS token FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)")


add("schema_drift", lambda spark, sf: spark.createDataFrame([(k, c) for k, cs in profile.schema_drift(profile.signature(table(spark, sf, "orders")), profile.signature(table(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string")).drop("o_totalprice").withColumn("o_new", F.lit(1)))).items() for c in cs], "change string, column_name string"), "SELECT * FROM (VALUES ('added', 'o_new'), ('removed', 'o_totalprice'), ('changed', 'o_custkey')) t(change, column_name)")


def conditional_table(spark, sf):
    p = profile.conditional_params(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(k, v, w) for k, vs, ws in zip(p["keys"], p["values"], p["weights"]) for v, w in zip(vs, ws)], "k string, v string, w double")


add("conditional_table", conditional_table, "SELECT k, v, round(n / sum(n) OVER (PARTITION BY k), 6) AS w FROM (SELECT l_returnflag AS k, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n >= 5")

# discovery

_m = "WITH xy AS (SELECT {x} AS x, {y} AS y, count(*) AS c FROM {t} GROUP BY 1, 2), gx AS (SELECT x, sum(c) AS cx, sum(c * c) AS c2 FROM xy GROUP BY 1), gy AS (SELECT y, sum(c) AS cy FROM xy GROUP BY 1), a AS (SELECT sum(cx) AS n, count(*) AS k, sum(cx * cx) AS x2, sum(c2) AS xy2, sum(c2 / cx) AS pd FROM gx), b AS (SELECT sum(cy * cy) AS y2 FROM gy) "
_names = {"x": "l_returnflag", "y": "l_linestatus", "t": "lineitem"}
for _n, _c, _e in (("g1", "g1", "round((x2 - xy2) / (n * n), 6)"), ("pdep", "pdep", "round(pd / n, 6)"), ("mu_prime", "mu_prime", "round(greatest(0, least(1, 1 - (n - k) / (n - 1) * (1 - pd / n) / (1 - y2 / (n * n)))), 6)")):
    add(f"fd_{_n}", lambda spark, sf, c=_c: discovery.measures_frame(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus").select(F.round(c, 6).alias("value")), _m.format(**_names) + f"SELECT {_e} AS value FROM a, b")
add("fd_holds", lambda spark, sf: discovery.holds_frame(table(spark, sf, "nation"), ["n_name"], "n_regionkey"), "SELECT max(k) <= 1 AS holds FROM (SELECT count(DISTINCT n_regionkey) AS k FROM nation GROUP BY n_name)")
_cols = [("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey")]
_vals = " UNION ".join(f"SELECT '{t}.{c}' AS a, {c}::BIGINT AS v FROM {t}" for t, c in _cols)
add("ind_unary", lambda spark, sf: discovery.inclusion_frame({t: table(spark, sf, t) for t, _ in _cols}, _cols), f"WITH v AS ({_vals}), s AS (SELECT a, count(*) AS n FROM v GROUP BY 1) SELECT x.a AS child, y.a AS parent, count(*) AS overlap, any_value(s.n) AS distinct FROM v x JOIN v y ON x.v = y.v AND x.a <> y.a JOIN s ON s.a = x.a GROUP BY 1, 2".replace("AS distinct", 'AS "distinct"'))
add("dependency_forest", lambda spark, sf: spark.createDataFrame([(e["determinant"], e["dependent"], round(e["mu_prime"], 6), e["reversed"]) for e in discovery.dependency_forest([{"lhs": [a], "rhs": b, "mu_prime": discovery.mu_prime(table(spark, sf, "lineitem"), [a], b)} for a, b in (("l_returnflag", "l_linestatus"), ("l_linestatus", "l_returnflag"), ("l_linenumber", "l_returnflag"))])], "determinant string, dependent string, mu_prime double, reversed boolean"))


# conformance

STAR = {"tables": [
    {"name": "region", "row_count": 5, "primary_key": "r_regionkey", "columns": [{"name": "r_regionkey", "dtype": "int"}, {"name": "r_name", "constraints": {"unique": True, "nullable": False}}]},
    {"name": "nation", "row_count": 25, "primary_key": "n_nationkey", "columns": [{"name": "n_nationkey", "dtype": "int"}, {"name": "n_name"}, {"name": "n_regionkey", "dtype": "int"}], "relationships": [{"from": "n_regionkey", "to": "region.r_regionkey"}]},
    {"name": "customer", "row_count": 1500, "primary_key": "c_custkey", "columns": [{"name": "c_custkey", "dtype": "int"}, {"name": "c_nationkey", "dtype": "int"}, {"name": "c_acctbal", "dtype": "float"}], "relationships": [{"from": "c_nationkey", "to": "nation.n_nationkey"}], "rules": ["c_acctbal > 0"]},
    {"name": "orders", "row_count": 15000, "primary_key": "o_orderkey", "columns": [{"name": "o_orderkey", "dtype": "int"}, {"name": "o_custkey", "dtype": "int"}, {"name": "o_totalprice", "dtype": "float"}], "relationships": [{"from": "o_custkey", "to": "customer.c_custkey", "alias": "buyer"}], "rules": ["o_totalprice > buyer.c_acctbal"]},
    {"name": "lineitem", "row_count": 60000, "primary_key": ["l_orderkey", "l_linenumber"], "columns": [{"name": "l_orderkey", "dtype": "int"}, {"name": "l_linenumber", "dtype": "int"}], "relationships": [{"from": "l_orderkey", "to": "orders.o_orderkey"}]},
]}


def conformance_report(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema's tables against STAR: one row for each check."""
    tables = {t["name"]: table(spark, sf, t["name"]) for t in STAR["tables"]}
    return conformance.validate_against_spec(tables, from_dict(STAR)).to_frame(spark)


def _check(t: str, name: str, n: str) -> str:
    return f"SELECT '{t}' AS \"table\", '{name}' AS \"check\", CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS violations FROM (SELECT CAST({n} AS BIGINT) AS n)"


_orphan = lambda c, k, p, q: f"(SELECT count(DISTINCT {k}) FROM {c} WHERE {k} NOT IN (SELECT {q} FROM {p}))"
add("conformance_report", conformance_report, "SELECT NULL::VARCHAR AS \"table\", NULL::VARCHAR AS \"check\", NULL::VARCHAR AS status, NULL::BIGINT AS violations WHERE false UNION ALL " + " UNION ALL ".join([
    *[f"SELECT '{t['name']}', 'row_count', CASE WHEN count(*) = {t['row_count']} THEN 'pass' ELSE 'warn' END, abs(count(*) - {t['row_count']}) FROM {t['name']}" for t in STAR["tables"]],
    *[_check(t, "primary_key", f"(SELECT count(*) - count(DISTINCT {k}) FROM {t})") for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "(l_orderkey, l_linenumber)"))],
    _check("region", "column_unique:r_name", "(SELECT count(r_name) - count(DISTINCT r_name) FROM region)"), _check("region", "not_null:r_name", "(SELECT count(*) - count(r_name) FROM region)"),
    _check("nation", "foreign_key:n_regionkey", _orphan("nation", "n_regionkey", "region", "r_regionkey")), _check("customer", "foreign_key:c_nationkey", _orphan("customer", "c_nationkey", "nation", "n_nationkey")),
    _check("orders", "foreign_key:o_custkey", _orphan("orders", "o_custkey", "customer", "c_custkey")), _check("lineitem", "foreign_key:l_orderkey", _orphan("lineitem", "l_orderkey", "orders", "o_orderkey")),
    _check("customer", "rules", "(SELECT count(*) FROM customer WHERE NOT c_acctbal > 0)"), _check("orders", "rules", "(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT o_totalprice > c_acctbal)"),
]))
add("conform_orphans", lambda spark, sf: conformance.orphans(table(spark, sf, "lineitem"), table(spark, sf, "orders").filter("o_orderkey % 10 <> 0"), ["l_orderkey"], ["o_orderkey"]), "SELECT DISTINCT l_orderkey AS k0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
add("conform_ordered", lambda spark, sf: conformance.unordered_groups(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey"), "SELECT DISTINCT o_custkey FROM (SELECT o_custkey, o_totalprice <= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bad FROM orders) WHERE bad")


def queries() -> dict[str, Query]:
    from . import queries_more  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    found = queries()
    return {k: v for k, v in SQL.items() if k in found}
