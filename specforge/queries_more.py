"""Queries over sources, sinks, commands, generation with rejected rows, and what the profiler decides."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.generators import register_generator
from .functions.personal import personal
from .functions.rng import uniform_sql
from .functions.rules import Rule
from .operators import conformance, discovery, disclosure, metrics, profile
from .operators.engine import Engine
from .plans.spec import expand_many_to_many, from_dict, sort_tables
from .queries import _KS, _TV, _ids, SEED, STAR, add, halves, table
from .sources import files
from .sources.storage import shared_dir


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"{v!r}::DOUBLE" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


# sources and sinks: what was written is read back

_NOTE = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'say \"hi\", twice' WHEN 2 THEN '' WHEN 3 THEN 'it''s' ELSE ' two\nlines ' END"
_CUSTOMERS = f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, {_NOTE} AS note FROM customer"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.expr(_NOTE.replace("''s", "\\'s").replace("\n", "\\n")).alias("note"))


def _same(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in like.dtypes])


def _round_trip(fmt: str):
    def query(spark, sf):
        df, path = _customers(spark, sf), f"{_folder(spark)}/customers.{fmt}"
        if fmt == "tsv":
            df.write.csv(path, **{**files.CSV, "sep": "\t"})
        else:
            files.write({"customers": df}, path.rsplit("/", 1)[0], fmt)
        return _same(files.read(spark, path), df)

    return query


#: Read back from CSV, empty text is null.
_FROM_CSV = f"SELECT * REPLACE (nullif(note, '') AS note) FROM ({_CUSTOMERS})"
for _f in ("parquet", "csv", "tsv", "jsonl"):
    add(f"source_{_f}", _round_trip(_f), _FROM_CSV if _f in ("csv", "tsv") else _CUSTOMERS)


def source_combined_json(spark, sf):
    df, path = _customers(spark, sf), f"{_folder(spark)}/all.json"
    files.write({"customers": df, "nations": table(spark, sf, "nation").select("n_nationkey", "n_name")}, path)
    got = files.read_tables(spark, path)
    return _same(got["customers"], df).join(got["nations"].select(F.col("n_nationkey").cast("int").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "note", "n_name")


add("source_combined_json", source_combined_json, f"SELECT c_custkey, note, n_name FROM ({_CUSTOMERS}) JOIN nation ON c_nationkey = n_nationkey")


def source_jsonl_tables(spark, sf):
    path = f"{_folder(spark)}/all.jsonl"
    files.write({"customers": _customers(spark, sf), "nations": table(spark, sf, "nation")}, path)
    lines = spark.read.text(path)
    return lines.select(F.json_object_keys("value")[0].alias("table_name"), F.get_json_object("value", "$.customers.c_custkey").cast("long").alias("id"), F.get_json_object("value", "$.customers.note").alias("note"))


add("sink_jsonl_tables", source_jsonl_tables, f"SELECT 'customers' AS table_name, c_custkey AS id, note FROM ({_CUSTOMERS}) UNION ALL SELECT 'nations', NULL, NULL FROM nation")


def source_folder(spark, sf):
    out = _folder(spark)
    files.write({"customer": _customers(spark, sf), "nation": table(spark, sf, "nation")}, out, "parquet")
    return _frame(spark, [(n, df.count(), ",".join(df.columns[:2])) for n, df in files.read_tables(spark, out).items()], "table_name string, n long, first_columns string")


add("source_folder", source_folder, "SELECT 'customer' AS table_name, count(*) AS n, 'c_custkey,c_name' AS first_columns FROM customer UNION ALL SELECT 'nation', count(*), 'n_nationkey,n_name' FROM nation")


def source_columns(spark, sf):
    out = _folder(spark)
    files.write({"customer": _customers(spark, sf)}, out, "csv")
    df = files.read(spark, f"{out}/customer.csv", ["c_name", "c_custkey"], 10)
    try:
        files.read(spark, f"{out}/customer.csv", ["c_name", "no", "nor_this"])
        said = ""
    except ValueError as e:
        said = str(e)
    return _frame(spark, [(df.count(), ",".join(df.columns), said)], "n long, names string, said string")


add("source_columns", source_columns, _values([(10, "c_name,c_custkey", "unknown columns: no, nor_this")], "n, names, said"))


def sink_sql(spark, sf):
    spec = from_dict({"tables": [{"name": "customer", "row_count": 0, "primary_key": "c_custkey", "columns": [{"name": "c_custkey", "dtype": "int"}, {"name": "note"}]}]})
    path = f"{_folder(spark)}/all.sql"
    files.write({"customer": _customers(spark, sf).filter("c_custkey % 5 <> 4").select("c_custkey", "note")}, path, "sql", spec)
    return spark.read.text(path)


add("sink_sql", sink_sql, "SELECT 'INSERT INTO \"customer\" (\"c_custkey\", \"note\") VALUES (' || c_custkey || ', ' || coalesce('''' || replace(note, '''', '''''') || '''', 'NULL') || ');' AS value FROM (" + _CUSTOMERS + ") WHERE c_custkey % 5 <> 4 UNION ALL SELECT unnest(['CREATE TABLE IF NOT EXISTS \"customer\" (', '  \"c_custkey\" INTEGER PRIMARY KEY,', '  \"note\" TEXT', ');'])")
add("sql_ddl", lambda spark, sf: _frame(spark, [(t.name, files.ddl(t)) for t in from_dict(STAR).tables], "table_name string, statement string"), _values([
    ("region", 'CREATE TABLE IF NOT EXISTS "region" (\n  "r_regionkey" INTEGER PRIMARY KEY,\n  "r_name" TEXT NOT NULL UNIQUE\n);'),
    ("nation", 'CREATE TABLE IF NOT EXISTS "nation" (\n  "n_nationkey" INTEGER PRIMARY KEY,\n  "n_name" TEXT,\n  "n_regionkey" INTEGER,\n  FOREIGN KEY ("n_regionkey") REFERENCES "region" ("r_regionkey")\n);'),
    ("customer", 'CREATE TABLE IF NOT EXISTS "customer" (\n  "c_custkey" INTEGER PRIMARY KEY,\n  "c_nationkey" INTEGER,\n  "c_acctbal" REAL,\n  FOREIGN KEY ("c_nationkey") REFERENCES "nation" ("n_nationkey")\n);'),
    ("orders", 'CREATE TABLE IF NOT EXISTS "orders" (\n  "o_orderkey" INTEGER PRIMARY KEY,\n  "o_custkey" INTEGER,\n  "o_totalprice" REAL,\n  FOREIGN KEY ("o_custkey") REFERENCES "customer" ("c_custkey")\n);'),
    ("lineitem", 'CREATE TABLE IF NOT EXISTS "lineitem" (\n  "l_orderkey" INTEGER,\n  "l_linenumber" INTEGER,\n  PRIMARY KEY ("l_orderkey", "l_linenumber"),\n  FOREIGN KEY ("l_orderkey") REFERENCES "orders" ("o_orderkey")\n);'),
], "table_name, statement"))


def _sink(fmt: str):
    def query(spark, sf):
        out, df = _folder(spark), _customers(spark, sf)
        files.write_one(df.limit(3), f"{out}/c.{fmt}", fmt)  # what was there goes with the first write
        sink = files.FolderSink(out, fmt)
        for part in (df.filter("c_custkey % 2 = 0"), df.filter("c_custkey < 0"), df.filter("c_custkey % 2 = 1")):
            sink.write_table("c", part)
        sink.close()
        return _same(files.read(spark, f"{out}/c.{fmt}"), df)

    return query


for _f in ("csv", "jsonl"):
    add(f"sink_append_{_f}", _sink(_f), _FROM_CSV if _f == "csv" else _CUSTOMERS)


def publish_swap(spark, sf):
    out, nation = _folder(spark), table(spark, sf, "nation")
    put = lambda df: lambda stage: files.write({"n": df}, stage, "parquet")
    rows = lambda: files.read_tables(spark, out)["n"].count()
    got = []
    files.publish(spark, out, put(nation))
    got.append(("first", rows()))
    files.publish(spark, out, put(nation.filter("n_nationkey % 2 = 0")))
    got.append(("second", rows()))

    def broken(stage: str) -> None:
        put(nation)(stage)
        raise OSError("full")

    try:
        files.publish(spark, out, broken)
    except OSError:
        got.append(("after a failure", rows()))
    beside = files.Files(spark).names(out.rsplit("/", 1)[0])
    got.append(("left beside", sum(n.startswith(out.rsplit("/", 1)[1] + "-") for n in beside)))
    return _frame(spark, got, "step string, n long")


add("publish_swap", publish_swap, "SELECT 'first' AS step, count(*) AS n FROM nation UNION ALL SELECT unnest(['second', 'after a failure']), count(*) FILTER (WHERE n_nationkey % 2 = 0) FROM nation UNION ALL SELECT 'left beside', 0")


def report_payload(spark, sf):
    spec = from_dict(STAR)
    got = json.loads(json.dumps(files.report_payload({"passed": True}, {"data": "d"}, spec, {"min": 0.5})))
    return _frame(spark, [(",".join(sorted(got)), ",".join(got["spec"]["tables"]), got["thresholds"]["min"])], "parts string, tables string, least double")


add("report_payload", report_payload, _values([("inputs,passed,spec,thresholds,tool_version", "region,nation,customer,orders,lineitem", 0.5)], "parts, tables, least"))


def cli_codes(spark, sf):
    """Commands over the written star schema, and their exit codes: 0 passed, 1 a gate failed, 2 bad input."""
    import contextlib
    import io
    import os
    import tempfile

    from .cli import main

    out = _folder(spark)
    files.write({t: table(spark, sf, t) for t in ("region", "nation")}, out, "parquet")
    with tempfile.TemporaryDirectory() as d, contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        spec, star, bad = f"{d}/spec.yaml", f"{d}/star.json", f"{d}/bad.json"
        got = [("init", main(["init", "--out", spec])), ("init again", main(["init", spec])), ("validate", main(["validate", "--spec", spec]))]
        n = {t["name"]: t for t in STAR["tables"]}
        for path, key in ((star, "n_nationkey"), (bad, "n_regionkey")):
            with open(path, "w") as f:
                json.dump({"tables": [n["region"], {**n["nation"], "primary_key": key}]}, f)
        got += [
            ("generate", main(["generate", spec, "--out", f"{out}-g", "--seed", "3", "--format", "jsonl", "--progress"])),
            ("generate in chunks", main(["generate", "--spec", spec, "--out", f"{out}-s", "--stream", "--chunk-size", "30", "--format", "csv"])),
            ("chunk of none", main(["generate", spec, "--out", f"{out}-s", "--stream", "--chunk-size", "0"])),
            ("check", main(["check", out, star])), ("check wrong key", main(["check", out, "--spec", bad])), ("no such spec", main(["check", out, f"{d}/none.json"])),
            ("profile", main(["profile", f"{out}/nation.parquet", "--out", f"{d}/p.json", "--sample", "10", "--seed", "1", "--max-categorical-ratio", "0.1", "--pii", "n_name"])),
            ("profile over budget", main(["profile", f"{out}/nation.parquet", "--out", f"{d}/q.json", "--no-pii", "n_name", "--max-categories", "30", "--disclosure-mode", "error", "--max-rare-values", "-1"])),
            ("quality", main(["quality", f"{out}/nation.parquet", f"{out}/nation.parquet", "--min-score", "0.99", "--report", f"{d}/r.json"])),
            ("quality too low", main(["quality", f"{out}/nation.parquet", f"{out}/nation.parquet", "--min-score", "1.01"])),
            ("diagnose", main(["diagnose", f"{out}/nation.parquet", f"{out}/nation.parquet"])), ("compare", main(["compare", f"{out}/nation.parquet", f"{out}/nation.parquet"])),
            ("list", main(["list-generators"])), ("no such command", main(["nothing"])), ("report written", 0 if os.path.exists(f"{d}/r.json") else 1),
        ]
    got += [("rows", files.read_tables(spark, f"{out}-g")["users"].count()), ("rows in chunks", files.read_tables(spark, f"{out}-s")["users"].count())]
    return _frame(spark, got, "command string, code long")


add("cli_codes", cli_codes, _values([("init", 0), ("init again", 2), ("validate", 0), ("generate", 0), ("generate in chunks", 0), ("chunk of none", 2), ("check", 0), ("check wrong key", 1), ("no such spec", 2), ("profile", 0), ("profile over budget", 1), ("quality", 0), ("quality too low", 1), ("diagnose", 0), ("compare", 0), ("list", 0), ("no such command", 2), ("report written", 0), ("rows", 100), ("rows in chunks", 100)], "command, code"))


# generation

_SEQ = {"name": "id", "dtype": "int", "generator": "sequence"}


def _u(t: str, column: str, row: str = "id", attempt: str = "0", draw: str | None = "0") -> str:
    return uniform_sql(f"'{SEED}'", f"'{t}'", f"'{column}'", row, attempt, *([f"'{draw}'"] if draw is not None else []))


def _int(t: str, column: str, low: int, high: int, row: str = "id", attempt: str = "0") -> str:
    return f"({low} + floor({_u(t, column, row, attempt)} * {high - low + 1}))::BIGINT"


_N, _M = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"
_orders = f"(SELECT unnest(range(1, {_M} + 1)) AS id)"


def _run(spark, sf, parent: dict | None, child: dict, **settings) -> dict[str, DataFrame]:
    n, m = table(spark, sf, "customer").count(), table(spark, sf, "orders").count()
    tables = ([{"name": "p", "row_count": n, "primary_key": "id", **parent}] if parent else []) + [{"name": "c", "row_count": m if parent else n, **child}]
    return Engine(spark, from_dict({"settings": {"seed": SEED, **settings}, "tables": tables}), portable=True).run().to_frames()


_X = {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 99}}
_LOSSY = {"columns": [_SEQ, _X], "rules": ["x < 50"]}
_KEPT = f"(SELECT row_number() OVER (ORDER BY id) AS id, x FROM (SELECT id, {_int('p', 'x', 1, 99)} AS x FROM {_ids}) WHERE x < 50)"
_drop = {"fallback": "drop", "max_rule_attempts": 1}


def drop_keeps_children(spark, sf):
    got = _run(spark, sf, _LOSSY, {"columns": [_SEQ, {"name": "p_id", "dtype": "int"}, {"name": "q_id", "dtype": "int", "generator": "fk", "params": {"ref": "p.id"}}], "relationships": [{"from": "p_id", "to": "p.id"}]}, **_drop)
    return got["c"].join(got["p"].select(F.col("id").alias("p_id"), "x"), "p_id", "left").select("id", "p_id", "q_id", "x")


add("drop_keeps_children", drop_keeps_children, f"WITH p AS {_KEPT}, c AS (SELECT id, floor({_u('c', 'fk.p', draw=None)} * (SELECT count(*) FROM p))::BIGINT + 1 AS p_id, floor({_u('c', 'q_id', draw=None)} * (SELECT count(*) FROM p))::BIGINT + 1 AS q_id FROM {_orders}) SELECT c.id, p_id, q_id, x FROM c LEFT JOIN p ON p.id = p_id")
add("fk_generator", lambda spark, sf: _run(spark, sf, {"columns": [_SEQ]}, {"columns": [_SEQ, {"name": "q_id", "dtype": "int", "generator": "fk", "params": {"ref": "p.id"}}]})["c"], f"SELECT id, floor({_u('c', 'q_id', draw=None)} * {_N})::BIGINT + 1 AS q_id FROM {_orders}")
add("fallback_null", lambda spark, sf: _run(spark, sf, None, {"columns": [_SEQ, _X], "rules": ["x < 50"]}, fallback="null", max_rule_attempts=1)["c"].groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids")), f"SELECT x, count(*) AS n, count(x) AS ids FROM (SELECT CASE WHEN x < 50 THEN x END AS x FROM (SELECT {_int('c', 'x', 1, 99)} AS x FROM {_ids})) GROUP BY 1")
add("key_rejection", lambda spark, sf: _run(spark, sf, None, {"columns": [_SEQ, _X], "rules": ["x != 7"], "unique_constraints": [["x"]]}, **_drop)["c"], f"SELECT row_number() OVER (ORDER BY min(id)) AS id, x FROM (SELECT id, {_int('c', 'x', 1, 99)} AS x FROM {_ids}) WHERE x <> 7 GROUP BY x")
add("unique_column", lambda spark, sf: _run(spark, sf, None, {"columns": [_SEQ, {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 10**6}, "constraints": {"unique": True}}]})["c"].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("kinds")), f"SELECT {_N} AS n, {_N} AS kinds")
add("composite_fk", lambda spark, sf: _run(spark, sf, {"primary_key": ["id", "x"], "columns": [_SEQ, _X]}, {"columns": [_SEQ, {"name": "p_id", "dtype": "int"}, {"name": "p_x", "dtype": "int"}], "relationships": [{"from": ["p_id", "p_x"], "to": "p", "to_columns": ["id", "x"]}]})["c"], f"SELECT id, p_id, {_int('p', 'x', 1, 99, 'p_id')} AS p_x FROM (SELECT id, floor({_u('c', 'fk.p', draw=None)} * {_N})::BIGINT + 1 AS p_id FROM {_orders})")
add("gen_null_rate", lambda spark, sf: _run(spark, sf, None, {"columns": [_SEQ, {**_X, "constraints": {"nullable": True, "null_rate": 0.2}}]})["c"], f"SELECT id, CASE WHEN {_u('c', 'x.null')} >= 0.2::DOUBLE THEN {_int('c', 'x', 1, 99)} END AS x FROM {_ids}")
add("gen_when", lambda spark, sf: _run(spark, sf, None, {"columns": [_SEQ, _X, {"name": "size", "generator": "const", "params": {"value": "other"}, "when": [{"if": "x < 10", "generator": "const", "params": {"value": "small"}}, {"if": "x < 50", "generator": "const", "params": {"value": "middle"}}]}]})["c"], f"SELECT id, x, CASE WHEN x < 10 THEN 'small' WHEN x < 50 THEN 'middle' ELSE 'other' END AS size FROM (SELECT id, {_int('c', 'x', 1, 99)} AS x FROM {_ids})")
add("gen_auto", lambda spark, sf: _run(spark, sf, None, {"columns": [_SEQ, {"name": "x", "dtype": "int", "generator": "auto", "profile": {"numeric": {"min": 3, "max": 12, "distribution": "uniform"}}}, {"name": "y", "generator": "auto", "profile": {"categorical": {"values": ["a", "b"], "weights": [0.25, 0.75]}}}]})["c"], f"SELECT id, {_int('c', 'x', 3, 12)} AS x, CASE WHEN {_u('c', 'y')} <= 0.25 THEN 'a' ELSE 'b' END AS y FROM {_ids}")


def doubled(row, rng, faker, params):
    """A generator by module path: twice another column."""
    return row[params["of"]] * 2


def gen_custom(spark, sf):
    register_generator("plus", native=True)(lambda ctx: F.col("x") + ctx.params["n"])
    register_generator("text")(lambda row, rng, faker, params: f"{row['id']}-{row['x']}")
    return _run(spark, sf, None, {"columns": [_SEQ, _X, {"name": "a", "dtype": "int", "generator": "custom:plus", "params": {"n": 5}, "depends_on": ["x"]}, {"name": "b", "generator": "custom:text", "depends_on": ["id", "x"]}, {"name": "d", "dtype": "int", "generator": "specforge.queries_more:doubled", "params": {"of": "x"}, "depends_on": ["x"]}]})["c"]


add("gen_custom", gen_custom, f"SELECT id, x, x + 5 AS a, id || '-' || x AS b, 2 * x AS d FROM (SELECT id, {_int('c', 'x', 1, 99)} AS x FROM {_ids})")


def gen_conditional_long(spark, sf):
    """More keys than are written into a plan: the engine joins the table."""
    p = {"on": "x", "keys": list(range(1, 1000)), "values": [[f"a{k}", f"b{k}"] for k in range(1, 1000)], "weights": [[1, 3]] * 999, "default": {"values": ["none"]}}
    return _run(spark, sf, None, {"columns": [_SEQ, {**_X, "params": {"min": 1, "max": 1200}}, {"name": "y", "generator": "conditional", "params": p, "depends_on": ["x"]}]})["c"]


add("gen_conditional_long", gen_conditional_long, f"SELECT id, x, CASE WHEN x > 999 THEN 'none' WHEN {_u('c', 'y')} <= 0.25 THEN 'a' || x ELSE 'b' || x END AS y FROM (SELECT id, {_int('c', 'x', 1, 1200)} AS x FROM {_ids})")
_LIKE = {"email": "^[^@ ]+@[^@ ]+[.][a-z]+$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "ipv4": "^([0-9]{1,3}[.]){3}[0-9]{1,3}$", "zipcode": "^[0-9]{5}$", "first_name": "^[A-Z].+$", "name": "^.+ .+$"}


def faker_shapes(spark, sf):
    df = _run(spark, sf, None, {"columns": [_SEQ, *[{"name": k, "generator": f"faker.{k}"} for k in _LIKE], {"name": "contact_email", "pii": True, "pii_strategy": "faker"}, {"name": "digits", "dtype": "int", "pii": True, "pii_strategy": "faker"}]})["c"]
    like = {**_LIKE, "contact_email": _LIKE["email"], "digits": "^[0-9]{1,4}$"}
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(k).cast("string").rlike(v)).alias(k) for k, v in like.items()])


add("faker_shapes", faker_shapes, f"SELECT {_N} AS n, " + ", ".join(f"{_N} AS {k}" for k in (*_LIKE, "contact_email", "digits")))
add("table_order", lambda spark, sf: _frame(spark, [(i, t.name) for i, t in enumerate(sort_tables(from_dict({"tables": STAR["tables"][::-1]})))], "place long, table_name string"), _values([(0, "region"), (1, "nation"), (2, "customer"), (3, "orders"), (4, "lineitem")], "place, table_name"))
add("m2m_lowering", lambda spark, sf: _frame(spark, [(t.name, ",".join(c.name for c in t.columns), ",".join(t.key), ";".join(r.to for r in t.relationships)) for t in expand_many_to_many(from_dict({"tables": [{"name": "users", "row_count": 2, "primary_key": "id", "columns": [_SEQ]}, {"name": "tags", "row_count": 3, "primary_key": "id", "columns": [_SEQ]}], "many_to_many": [{"name": "marks", "left": "users", "right": "tags", "row_count": 4}]})).tables], "table_name string, columns string, primary_key string, refers_to string"), _values([("users", "id", "id", ""), ("tags", "id", "id", ""), ("marks", "user_id,tag_id", "user_id,tag_id", "users.id;tags.id")], "table_name, columns, primary_key, refers_to"))
add("rule_references", lambda spark, sf: _frame(spark, [(text, ",".join(sorted(Rule(text).column_refs)), ",".join(sorted(Rule(text).parent_aliases))) for text in ("`a b` > p.c and len(d) < 3", "if x == null then y else not z")], "rule string, columns string, parents string"), _values([("`a b` > p.c and len(d) < 3", "a b,d", "p"), ("if x == null then y else not z", "x,y,z", "")], "rule, columns, parents"))

# the profiler's decisions

_NAMES = [("first_name", "first_name"), ("PatientName", "name"), ("patient", "name"), ("account_number", "bban"), ("sort_code", "bban"), ("client_ip_address", "ipv4"), ("medical_record_no", "bothify"), ("driverLicence", "license_plate"), ("product_name", None), ("table_name", None), ("shipment_id", None), ("streetcar_id", None), ("zippy", None), ("amount", None), ("date_of_birth", "date_of_birth"), ("mobile", "phone_number")]
add("personal_names", lambda spark, sf: _frame(spark, [(n, personal(n)) for n, _ in _NAMES], "name string, provider string"), _values(_NAMES, "name, provider"))


def profile_keys(spark, sf):
    o = table(spark, sf, "orders")
    frames = {"paid_first": o.select(F.col("o_orderkey").alias("paid"), (F.col("o_orderkey") + 7).alias("rec_no"), "o_custkey"), "id_later": o.select(F.concat(F.lit("x"), "o_orderkey").alias("code"), F.col("o_orderkey").alias("orderId")), "nulls": o.select(F.when(F.col("o_orderkey") > 9, F.col("o_orderkey")).alias("id"), "o_custkey"), "lines": o.select(F.floor(F.col("o_orderkey") / 5).alias("l_orderkey"), (F.col("o_orderkey") % 5).alias("l_linenumber"), "o_orderstatus")}
    got = {n: profile.Profiler().table(df, n) for n, df in frames.items()}
    return _frame(spark, [(n, ",".join(t.key), ";".join(",".join(k) for k in t.unique_constraints)) for n, t in got.items()], "table_name string, primary_key string, unique_constraints string")


add("profile_keys", profile_keys, _values([("paid_first", "paid", ""), ("id_later", "orderId", ""), ("nulls", "", ""), ("lines", "l_linenumber,l_orderkey", "")], "table_name, primary_key, unique_constraints"))


def profile_kinds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 3).alias("triple"), (F.col("o_custkey") * 1.0).alias("whole"), "o_totalprice", F.col("o_orderdate").cast("string").alias("day"), F.concat(F.lit("code "), F.col("o_orderkey") % 97).alias("code"), F.concat(F.lit("few "), F.col("o_orderkey") % 3).alias("few"), F.concat(F.lit("own "), "o_orderkey").alias("own"), F.expr("concat(substr(md5(cast(o_orderkey as string)), 1, 8), '-', substr(md5(cast(o_orderkey as string)), 9, 4), '-', substr(md5(cast(o_orderkey as string)), 13, 4), '-', substr(md5(cast(o_orderkey as string)), 17, 4), '-', substr(md5(cast(o_orderkey as string)), 21, 12))").alias("token"), F.concat("o_custkey", F.lit("@mail.org")).alias("reach"), (F.col("o_custkey") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("nothing"))
    t = profile.Profiler(discover_keys=False).table(o, "o")
    return _frame(spark, [(c.name, c.dtype, c.generator, ",".join(sorted(c.profile or {}))) for c in t.columns], "name string, dtype string, generator string, profile string")


add("profile_kinds", profile_kinds, "SELECT * REPLACE (CASE WHEN name = 'o_orderkey' AND (SELECT max(o_orderkey) - min(o_orderkey) + 1 = count(*) FROM orders) THEN 'sequence' ELSE generator END AS generator, CASE WHEN name = 'o_orderkey' AND (SELECT max(o_orderkey) - min(o_orderkey) + 1 = count(*) FROM orders) THEN '' WHEN name = 'code' AND (SELECT 97 > 0.05 * count(*) FROM orders) THEN 'length,string_pattern' ELSE profile END AS profile) FROM (" + _values([("o_orderkey", "int", "auto", "numeric"), ("triple", "int", "auto", "numeric"), ("whole", "int", "auto", "numeric"), ("o_totalprice", "float", "auto", "numeric"), ("day", "datetime", "auto", "datetime_range"), ("code", "str", "auto", "categorical"), ("few", "str", "auto", "categorical"), ("own", "str", "auto", "length,string_pattern"), ("token", "uuid", "auto", ""), ("reach", "str", "faker.email", ""), ("even", "bool", "auto", "")], "name, dtype, generator, profile") + ")")


def profile_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    p = profile.Profiler(sample=500, seed=7)
    a, b = (sorted(r[0] for r in p.sampled(x, 10**9).select("o_orderkey").collect()) for x in (o, o.repartition(5)))
    t = p.table(o, "o")
    return _frame(spark, [(len(a), a == b, t.row_count, len(t.column("o_orderpriority").profile["categorical"]["values"]))], "n long, same boolean, n_rows long, kinds long")


add("profile_sample", profile_sample, "SELECT CAST(500 AS BIGINT) AS n, true AS same, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS kinds FROM orders")


def profile_bins(spark, sf):
    l = table(spark, sf, "lineitem").select(F.pow(F.col("l_linenumber") - 2, 3).alias("few"), F.when(F.col("l_orderkey") % 10 == 0, F.col("l_extendedprice") * -1).otherwise(F.col("l_extendedprice")).alias("many"))
    t = profile.Profiler(discover_keys=False).table(l, "l")
    return _frame(spark, [(c.name, i, round(w, 6)) for c in t.columns for i, w in enumerate(c.profile["numeric"].get("hist_counts", []))], "name string, bin long, share double")


add("profile_bins", profile_bins, "WITH v AS (SELECT 'few' AS name, pow(l_linenumber - 2, 3) AS x FROM lineitem UNION ALL SELECT 'many', CASE WHEN l_orderkey % 10 = 0 THEN -l_extendedprice ELSE l_extendedprice END FROM lineitem), m AS (SELECT name, min(x) AS lo, max(x) AS hi, least(50, greatest(2, count(DISTINCT x))) AS bins, count(*) AS n FROM v GROUP BY 1), b AS (SELECT name, unnest(range(bins)) AS bin, n FROM m), c AS (SELECT v.name, least(floor((x - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin, count(*) AS k FROM v JOIN m ON v.name = m.name GROUP BY 1, 2) SELECT b.name, b.bin, round(coalesce(k, 0) / n, 6) AS share FROM b LEFT JOIN c ON b.name = c.name AND b.bin = c.bin")
add("suppress_min_cell", lambda spark, sf: _frame(spark, [(str(v), n) for v, n in profile.suppress(profile.frequencies(table(spark, sf, "supplier"), "s_nationkey"))[0]], "v string, n long"), "WITH c AS (SELECT CAST(s_nationkey AS VARCHAR) AS v, count(*) AS n FROM supplier GROUP BY 1), g AS (SELECT coalesce(sum(n), 0) AS rest FROM c WHERE n < 5), s AS (SELECT v FROM c, g WHERE n >= 5 AND rest BETWEEN 1 AND 4 ORDER BY n, v LIMIT 1), k AS (SELECT v, n FROM c WHERE n >= 5 AND v NOT IN (SELECT v FROM s)) SELECT * FROM k UNION ALL SELECT '__other__', CAST(sum(n) AS BIGINT) FROM c WHERE v NOT IN (SELECT v FROM k) HAVING sum(n) > 0")


def text_params(spark, sf):
    part = table(spark, sf, "part").select("p_name")
    spec = from_dict({"tables": [{"name": "part", "row_count": 1, "columns": [{"name": "p_name", "generator": "string"}]}]})
    p = profile.fit_text_params(spec, {"part": part}).tables[0].columns[0].params
    return _frame(spark, [("character", c, n) for c, n in zip(p["char_values"], p["char_weights"])] + [("length", str(c), n) for c, n in zip(p["length_values"], p["length_weights"])], "what string, value string, n long")


add("text_params", text_params, "SELECT 'character' AS what, ch AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> '' GROUP BY 2 UNION ALL SELECT 'length', CAST(length(p_name) AS VARCHAR), count(*) FROM part GROUP BY 2")


def profile_set(spark, sf):
    spec = profile.Profiler().profile_set({t: table(spark, sf, t) for t in ("region", "nation", "customer", "orders")})
    return _frame(spark, [(t.name, c.name, c.dtype, t.key == [c.name], next((r.to for r in t.relationships if c.name in r.columns), None)) for t in spec.tables for c in t.columns], "table_name string, column_name string, dtype string, is_key boolean, refers_to string")


_SETS = [("region", "r_regionkey", "int", None), ("region", "r_name", "str", None), ("nation", "n_nationkey", "int", None), ("nation", "n_name", "str", None), ("nation", "n_regionkey", "int", "region.r_regionkey")]
_SETS += [("customer", "c_custkey", "int", None), ("customer", "c_name", "str", None), ("customer", "c_nationkey", "int", "nation.n_nationkey"), ("customer", "c_acctbal", "float", None), ("customer", "c_mktsegment", "str", None)]
_SETS += [("orders", "o_orderkey", "int", None), ("orders", "o_custkey", "int", "customer.c_custkey"), ("orders", "o_orderstatus", "str", None), ("orders", "o_totalprice", "float", None), ("orders", "o_orderdate", "datetime", None), ("orders", "o_orderpriority", "str", None)]
add("profile_set", profile_set, " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS dtype, {'(SELECT count(*) = count(DISTINCT ' + c + ') FROM ' + t + ')' if c.endswith('key') and r is None else 'false'} AS is_key, " + (f"CASE WHEN NOT EXISTS (FROM {t} WHERE {c} NOT IN (SELECT {r.split('.')[1]} FROM {r.split('.')[0]})) THEN '{r}' END" if r else "NULL::VARCHAR") + " AS refers_to" for t, c, k, r in _SETS))


def names_only(spark, sf):
    """Without discovered keys, foreign keys follow names whose values are all there."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id"), (F.col("c_nationkey") + 90).alias("region_id"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"), "r_name")
    spec = profile.Profiler(discover_keys=False).profile_set({"customers": c, "nations": n, "regions": r})
    return _frame(spark, [(t.name, x.columns[0], x.to) for t in spec.tables for x in t.relationships], "table_name string, column_name string, refers_to string")


add("fk_by_name", names_only, _values([("customers", "nation_id", "nations.id")], "table_name, column_name, refers_to"))


def merge_report(spark, sf):
    n = table(spark, sf, "nation")
    old = profile.stamped(profile.Profiler().profile_set({"nation": n.withColumn("gone", F.lit("x")).withColumn("lost", F.lit(1)), "left": n.select("n_name")}))
    old.tables[0].column("n_name").params = {"edited": True}
    old.tables[0].column("lost").params = {"edited": True}
    spec, report = profile.merge_preserving_edits(old, profile.Profiler().profile_set({"nation": n.withColumn("new", F.lit("y")), "more": n.select("n_name")}))
    rows = [(k, v) for k, vs in report.items() for v in vs] + [("table", t.name) for t in spec.tables] + [("column", f"{t.name}.{c.name}") for t in spec.tables[:1] for c in t.columns]
    return _frame(spark, rows, "what string, name string")


add("merge_edits", merge_report, _values([("added", "nation.new"), ("added", "more"), ("kept", "nation.n_name"), ("updated", "nation.n_nationkey"), ("updated", "nation.n_regionkey"), ("removed", "nation.gone"), ("removed", "left"), ("orphaned", "nation.lost"), ("table", "nation"), ("table", "more"), ("table", "left"), *[("column", f"nation.{c}") for c in ("n_nationkey", "n_name", "n_regionkey", "new", "gone", "lost")]], "what, name"))


def disclosure_summary(spark, sf):
    spec = profile.Profiler().profile_set({t: table(spark, sf, t) for t in ("nation", "customer")})
    report = disclosure.DisclosureReport.from_spec(spec)
    over = disclosure.check_budget(report, disclosure.DisclosureBudget(max_categorical_values=1, max_rare_values=10**6))
    broken = disclosure.conditional_disclosure({"keys": "x", "values": [["a", "b"], 7]})
    return _frame(spark, [(k, v) for k, v in report.to_dict().items() if isinstance(v, int) and k in ("categorical_values", "redacted_columns", "conditional_keys", "conditional_cells", "personal_columns")] + [("over budget", len(over)), ("cells of a malformed table", broken[1])], "fact string, n long")


add("disclosure_summary", disclosure_summary, "SELECT 'categorical_values' AS fact, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n UNION ALL SELECT unnest(['redacted_columns', 'conditional_keys', 'conditional_cells']), 0 UNION ALL SELECT 'personal_columns', 2 UNION ALL SELECT 'over budget', 1 UNION ALL SELECT 'cells of a malformed table', 2")

# dependencies, over several columns of a large table

_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_shipdate"]


def _sets(error: float) -> str:
    """Minimal x -> y with up to two columns on the left, from grouped counts."""
    import itertools

    key = lambda s: "_".join(str(_COLS.index(c)) for c in sorted(s, key=_COLS.index))
    need = [s for k in (1, 2, 3) for s in itertools.combinations(_COLS, k)]
    ctes = ", ".join(f"k{key(s)} AS (SELECT count(*) AS k, sum(c * c) AS s FROM (SELECT count(*) AS c FROM lineitem GROUP BY {', '.join(s)}))" for s in need)
    sides = [(x, y) for y in _COLS for k in (1, 2) for x in itertools.combinations([c for c in _COLS if c != y], k)]
    g1 = lambda x, y: f"(((SELECT s FROM k{key(x)}) - (SELECT s FROM k{key((*x, y))}))::DOUBLE / (SELECT n * n FROM t))"
    holds = lambda x, y: f"((SELECT k FROM k{key(x)}) = (SELECT k FROM k{key((*x, y))}))" if not error else f"({g1(x, y)} <= {error} + 1e-12)"
    const = lambda y: f"((SELECT k FROM k{key((y,))}) = 1)" if not error else f"((SELECT n * n FROM t) - (SELECT s FROM k{key((y,))}))::DOUBLE / (SELECT n * n FROM t) <= {error} + 1e-12"
    some = " UNION ALL ".join(f"SELECT '{','.join(x)}' AS lhs, '{y}' AS rhs, round({g1(x, y)}, 6) AS g1 WHERE {holds(x, y)} AND NOT {const(y)}" + "".join(f" AND NOT {holds((a,), y)}" for a in x if len(x) > 1) for x, y in sides)
    return f"WITH t AS (SELECT count(*)::DOUBLE AS n FROM lineitem), {ctes} " + some + "".join(f" UNION ALL SELECT '', '{y}', round(((SELECT n * n FROM t) - (SELECT s FROM k{key((y,))}))::DOUBLE / (SELECT n * n FROM t), 6) WHERE {const(y)}" for y in _COLS)


for _name, _error in (("fd_exact", 0.0), ("fd_approximate", 0.1)):
    add(_name, lambda spark, sf, e=_error: _frame(spark, [(",".join(f["lhs"]), f["rhs"], round(float(f["g1"]), 6)) for f in discovery.functional_dependencies(table(spark, sf, "lineitem"), 2, e, columns=_COLS)], "lhs string, rhs string, g1 double"), _sets(_error))

_UCC = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def _ucc_sql() -> str:
    import itertools

    sets = [s for k in (1, 2) for s in itertools.combinations(_UCC, k)]
    unique = lambda s: f"(SELECT count(*) = count(DISTINCT ({', '.join(s)})) FROM lineitem)"
    return " UNION ALL ".join(f"SELECT '{','.join(s)}' AS columns WHERE {unique(s)}" + "".join(f" AND NOT {unique((c,))}" for c in s if len(s) > 1) for s in sets)


add("ucc_minimal", lambda spark, sf: _frame(spark, [(",".join(u),) for u in discovery.unique_columns(table(spark, sf, "lineitem"), 2, _UCC)], "columns string"), _ucc_sql())
add("discovery_columns", lambda spark, sf: _frame(spark, [(c,) for c in discovery.discovery_columns(table(spark, sf, "orders").withColumn("o_none", F.lit(None).cast("string")))], "name string"), " UNION ALL ".join(f"SELECT '{c}' AS name FROM orders HAVING count(DISTINCT {c}) / count(*) <= 0.9" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
add("fd_pdep_marginal", lambda spark, sf: _frame(spark, [(round(discovery.pdep_marginal(table(spark, sf, "lineitem"), "l_returnflag"), 6), round(discovery.dependency_measures(table(spark, sf, "lineitem"), [], "l_returnflag")[0], 6))], "value double, g1_of_nothing double"), "SELECT round(sum(c * c)::DOUBLE / (sum(c) * sum(c)), 6) AS value, round(1 - sum(c * c)::DOUBLE / (sum(c) * sum(c)), 6) AS g1_of_nothing FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag)")
add("ind_normalised", lambda spark, sf: discovery.inclusion_frame({"a": table(spark, sf, "customer").select((F.col("c_nationkey") * F.lit(1.0)).alias("k")), "b": table(spark, sf, "nation").select(F.col("n_nationkey").cast("decimal(9,2)").alias("k"))}), "SELECT 'a.k' AS child, 'b.k' AS parent, count(DISTINCT c_nationkey) FILTER (WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) AS overlap, count(DISTINCT c_nationkey) AS \"distinct\" FROM customer UNION ALL SELECT 'b.k', 'a.k', count(*) FILTER (WHERE n_nationkey IN (SELECT c_nationkey FROM customer)), count(*) FROM nation")

# reports

add("infer_kinds", lambda spark, sf: _frame(spark, list(metrics.infer_kinds(table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("string")).withColumn("yes", F.lit(True)).withColumn("free", F.concat(F.lit("no "), "o_orderkey"))).items()), "name string, kind string"), _values([("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"), ("day", "datetime"), ("yes", "boolean"), ("free", "text")], "name, kind"))


def compare_kinds(spark, sf):
    r, s = halves(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("dear"), "o_orderdate", F.concat(F.lit("no "), "o_orderkey").alias("free")), "o_orderkey")
    got = metrics.compare(r.drop("o_orderkey"), s.drop("o_orderkey"))
    return _frame(spark, [(c, v["kind"], round(v["distance"], 6), v["status"]) for c, v in got["columns"].items()], "name string, kind string, distance double, status string")


_CH = "(SELECT 0.5 * sum(abs(r / (SELECT count(*) FROM x WHERE side = 0) - s / (SELECT count(*) FROM x WHERE side = 1))) FROM (SELECT sum(1 - side) AS r, sum(side) AS s FROM x GROUP BY ch))"
add("compare_kinds", compare_kinds, "WITH b AS (SELECT *, o_orderkey % 2 AS side, 'no ' || o_orderkey AS free FROM orders), x AS (SELECT * FROM (SELECT unnest(string_split(free, '')) AS ch, side FROM b) WHERE ch <> ''), d AS (SELECT 'dear' AS name, 'boolean' AS kind, (SELECT abs(avg((o_totalprice > 150000)::INT) FILTER (WHERE side = 0) - avg((o_totalprice > 150000)::INT) FILTER (WHERE side = 1)) FROM b) AS distance, 0.1 AS ok, 0.2 AS warn UNION ALL SELECT 'o_orderdate', 'datetime', 1 - " + _KS.replace("o_totalprice", "o_orderdate").replace("(ORDER BY o_orderdate)", "(ORDER BY o_orderdate RANGE UNBOUNDED PRECEDING)") + ", 0.1, 0.2 UNION ALL SELECT 'free', 'text', greatest((SELECT abs(avg(length(free)) FILTER (WHERE side = 0) - avg(length(free)) FILTER (WHERE side = 1)) / greatest(1.0, avg(length(free)) FILTER (WHERE side = 0)) FROM b), " + _CH + "), 0.35, 0.6) SELECT name, kind, round(distance, 6) AS distance, CASE WHEN distance <= ok THEN 'pass' WHEN distance <= warn THEN 'warn' ELSE 'fail' END AS status FROM d")
_BIN = "least(floor((o_totalprice - a) / (z - a) * 10), 9)"
add("quality_report", lambda spark, sf: _quality(spark, sf), "WITH b AS (SELECT *, o_orderkey % 2 AS side FROM orders), m AS (SELECT min(o_totalprice) FILTER (WHERE side = 0) AS a, max(o_totalprice) FILTER (WHERE side = 0) AS z, min(o_totalprice) FILTER (WHERE side = 1) AS x, max(o_totalprice) FILTER (WHERE side = 1) AS y FROM b), e AS (SELECT b.*, " + " + ".join(f"(o_totalprice >= a + (z - a) * {i} / 10)::INT" for i in range(1, 10)) + " AS bin FROM b, m), t AS (SELECT " + ", ".join(f"(SELECT 1 - 0.5 * sum(abs(r / (SELECT count(*) FROM b WHERE side = 0) - s / (SELECT count(*) FROM b WHERE side = 1))) FROM (SELECT sum(1 - side) AS r, sum(side) AS s FROM e GROUP BY {a}, {b}))" + f" AS t{i}" for i, (a, b) in enumerate((("o_orderstatus", "bin"), ("o_orderstatus", "o_orderpriority"), ("bin", "o_orderpriority")))) + f"), s AS (SELECT {_TV.format(c='o_orderstatus')} AS s0, {_KS} AS s1, {_TV.format(c='o_orderpriority')} AS s2) SELECT 'Column Shapes' AS name, round((s0 + s1 + s2) / 3, 6) AS value FROM s UNION ALL SELECT 'Column Pair Trends', round((t0 + t1 + t2) / 3, 6) FROM t UNION ALL SELECT 'Coverage', round((" + " + ".join(f"(SELECT count(*) FILTER (WHERE lo = 0 AND hi = 1) / count(*) FILTER (WHERE lo = 0) FROM (SELECT min(side) AS lo, max(side) AS hi FROM b GROUP BY {c}))" for c in ("o_orderstatus", "o_orderpriority")) + " + (SELECT greatest(0.0, 1 - (greatest((x - a) / (z - a), 0) + greatest((z - y) / (z - a), 0))) FROM m)) / 3, 6) UNION ALL SELECT 'Missing Values', 1.0")


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    r, s = halves(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")
    got = metrics.quality_report(r.drop("o_orderkey"), s.drop("o_orderkey"))
    return _frame(spark, [(k, round(float(v), 6)) for k, v in got["properties"].items() if v == v], "name string, value double")


def conform_more(spark, sf):
    """Declared counts, missing tables and columns, unique constraints, null rates and children's order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    spec = from_dict({"tables": [
        {"name": "absent", "row_count": 1, "columns": [{"name": "a"}]}, {"name": "short", "row_count": 1, "columns": [{"name": "r_regionkey", "dtype": "int"}, {"name": "more"}, {"name": "still"}]},
        {"name": "customer", "row_count": 7, "primary_key": "c_custkey", "columns": [{"name": "c_custkey", "dtype": "int"}, {"name": "c_nationkey", "dtype": "int", "constraints": {"nullable": True, "null_rate": 0.01}}, {"name": "c_mktsegment"}], "unique_constraints": [["c_nationkey", "c_mktsegment"]]},
        {"name": "orders", "row_count": 7, "columns": [{"name": "o_orderkey", "dtype": "int", "generator": "sequence"}, {"name": "o_custkey", "dtype": "int"}, {"name": "o_totalprice", "dtype": "float"}], "relationships": [{"from": "o_custkey", "to": "customer.c_custkey", "ordered": True, "order_column": "o_totalprice", "max_children": 5}]},
    ]})
    frames = {"short": table(spark, sf, "region"), "customer": c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))), "orders": o}
    return conformance.validate_against_spec(frames, spec, bounds=True).to_frame(spark)


def _check(t: str, name: str, status: str, n: str) -> str:
    return f"SELECT '{t}' AS \"table\", '{name}' AS \"check\", '{status}' AS status, CAST({n} AS BIGINT) AS violations"


add("conform_more", conform_more, "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS k, c_mktsegment AS m FROM customer) " + " UNION ALL ".join([
    _check("absent", "table_present", "fail", "1"), _check("short", "columns_present:more,still", "fail", "2"),
    _check("customer", "row_count", "warn", "(SELECT count(*) - 7 FROM c)"), _check("customer", "primary_key", "pass", "(SELECT count(*) - count(DISTINCT c_custkey) FROM c)"),
    _check("customer", "unique:c_nationkey,c_mktsegment", "fail", "(SELECT (SELECT count(*) FROM c) - count(*) FROM (SELECT DISTINCT k, m FROM c))"), _check("customer", "null_rate:c_nationkey", "warn", "(SELECT count(*) FROM c WHERE k IS NULL)"),
    _check("orders", "row_count", "warn", "(SELECT count(*) - 7 FROM orders)"), _check("orders", "foreign_key:o_custkey", "pass", "(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"),
    _check("orders", "ordered:o_custkey", "fail", "(SELECT count(DISTINCT o_custkey) FROM (SELECT o_custkey, o_totalprice <= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bad FROM orders) WHERE bad)"),
    _check("orders", "children:o_custkey", "fail", "(SELECT count(*) FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey) WHERE n > 5)"),
]))


def rejection(spark, sf):
    y = {**_X, "params": {"min": 0, "max": 9}}
    return _run(spark, sf, None, {"columns": [_SEQ, y, {**y, "name": "y"}], "rules": ["x < y", "if x == 0 then y > 5 else true"]})["c"]


add("rule_rejection", rejection, f"SELECT id, x, y FROM (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY a) AS k FROM (SELECT id, a, {_int('c', 'x', 0, 9, attempt='a')} AS x, {_int('c', 'y', 0, 9, attempt='a')} AS y FROM (SELECT id, unnest(range(60)) AS a FROM {_ids})) WHERE x < y AND (x <> 0 OR y > 5)) WHERE k = 1")
_W = _int("p", "w", 1, 9)
add("fk_weighted", lambda spark, sf: _run(spark, sf, {"columns": [_SEQ, {"name": "w", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 9}}]}, {"columns": [_SEQ, {"name": "p_id", "dtype": "int"}], "relationships": [{"from": "p_id", "to": "p.id", "allocation": "weighted", "weight_column": "w"}]})["c"], f"WITH p AS (SELECT id, {_W} AS w FROM {_ids}), q AS (SELECT id AS p_id, w, sum(w) OVER (ORDER BY (id - 1) % 64, id) - w AS lo FROM p), c AS (SELECT id, {_u('c', 'fk.p', draw=None)} * (SELECT sum(w) FROM p) AS pos FROM {_orders}) SELECT c.id, q.p_id FROM c ASOF JOIN q ON c.pos >= q.lo")


def depth(spark, sf):
    n = table(spark, sf, "customer").count()
    return Engine(spark, from_dict({"settings": {"seed": SEED}, "tables": [{"name": "e", "row_count": n, "primary_key": "id", "columns": [_SEQ, {"name": "boss", "dtype": "int"}], "relationships": [{"from": "boss", "to": "e.id", "max_depth": 2, "root_fraction": 0.1}]}]}), portable=True).run()["e"]


_root, _self = (lambda i: uniform_sql(f"'{SEED}'", "'e'", "'root.e'", i)), uniform_sql(f"'{SEED}'", "'e'", "'self.e'", "id")
_up = f"(SELECT id, CASE WHEN id = 1 OR {_root('id')} < 0.1::DOUBLE THEN NULL WHEN (id - 2) % 2 = 1 THEN 2 + 2 * floor({_self} * ((id - 2) // 2 + 1)) WHEN {_root('drawn')} < 0.1::DOUBLE THEN drawn ELSE 1 END::BIGINT AS boss FROM (SELECT id, 1 + floor({_self} * (id - 1))::BIGINT AS drawn FROM {_ids}))"
add("self_reference_depth", depth, f"SELECT id, boss FROM {_up}")
add("self_reference_levels", lambda spark, sf: (lambda e: e.alias("a").join(e.alias("b"), F.col("a.boss") == F.col("b.id"), "left").join(e.alias("c"), F.col("b.boss") == F.col("c.id"), "left").join(e.alias("d"), F.col("c.boss") == F.col("d.id"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a.boss") >= F.col("a.id")).alias("later"), F.count("d.id").alias("too_deep"), F.count_if(F.col("a.boss").isNull()).alias("roots")))(depth(spark, sf)), f"SELECT {_N} AS n, CAST(0 AS BIGINT) AS later, CAST(0 AS BIGINT) AS too_deep, count(*) FILTER (WHERE id = 1 OR {_root('id')} < 0.1::DOUBLE) AS roots FROM {_ids}")
