"""Profiles of small tables."""

from specforge.operators.profile import Profiler


def test_many_categories_of_a_large_table(spark):
    df = spark.range(10000).selectExpr("concat('code ', id % 300) AS code", "concat('few ', id % 600) AS more", "concat('own ', id % 51) AS short")
    t = Profiler(discover_keys=False).profile(df).tables[0]
    assert len(t.column("code").profile["categorical"]["values"]) == 300
    assert len(t.column("short").profile["categorical"]["values"]) == 51
    assert "categorical" not in t.column("more").profile


def test_names_and_keys():
    from specforge.functions.personal import id_like, personal

    assert all(id_like(x) for x in ("id", "rec_id", "orderId", "ID", "row_key")) and not any(id_like(x) for x in ("paid", "valid", "monkey", "c_custkey", ""))
    assert personal("contact_email_address") == "email" and personal("MRN") == "bothify" and personal("patient_id") is None and personal("  ") is None


def test_sample_only_shapes(spark):
    df = spark.range(3000).selectExpr("id", "concat('k', id % 7) AS kind", "CASE WHEN id < 2 THEN 'rare' ELSE 'often' END AS odd", "CASE WHEN id % 10 > 0 THEN id * 1.5 END AS x")
    a, b = (Profiler(sample=200, seed=s).profile(df).tables[0] for s in (1, 1))
    assert a.write() == b.write() and a.row_count == 3000 and a.column("x").constraints["null_rate"] == 0.1
    assert "rare" not in a.column("odd").profile["categorical"]["values"]
    assert a.column("id").generator == "sequence"


def test_empty_and_null_tables(spark):
    t = Profiler(discover_fds=True).profile(spark.createDataFrame([], "a int, b string")).tables[0]
    assert t.row_count == 0 and t.columns == []
    t = Profiler().profile(spark.createDataFrame([(None, "x"), (None, "x")], "a int, b string")).tables[0]
    assert [c.name for c in t.columns] == ["b"]


def test_conditioning(spark):
    df = spark.range(2000).selectExpr("id", "concat('c', id % 12) AS city", "concat('s', id % 12 % 4) AS state", "concat('f', id % 5) AS free")
    t = Profiler(discover_fds=True).profile(df).tables[0]
    made = {c.name: c.params.get("on") for c in t.columns if c.generator == "conditional"}
    assert made in ({"state": "city"}, {"city": "state"}) and {"lhs": ["city"], "rhs": "state", "g1": 0.0} in t.metadata["dependencies"]
