import pytest

from specforge.operators.conformance import validate_against_spec
from specforge.operators.engine import generate
from specforge.plans.spec import RuleViolation, SpecError, SpecVersionError, dumps, expand_many_to_many, from_dict, to_dict

ID = {"name": "id", "dtype": "int", "generator": "sequence"}


def shop(**settings):
    return from_dict({"settings": {"seed": 42, "max_rule_attempts": 200, **settings}, "tables": [
        {"name": "users", "row_count": 50, "primary_key": "id", "columns": [ID, {"name": "email", "generator": "faker.email", "constraints": {"unique": True}}, {"name": "region", "generator": "choice", "params": {"values": ["EU", "US"]}}, {"name": "cap", "dtype": "float", "generator": "float", "params": {"min": 100, "max": 10000}}]},
        {"name": "orders", "row_count": 200, "primary_key": "id", "columns": [ID, {"name": "user_id", "dtype": "int"}, {"name": "total", "dtype": "float", "generator": "float", "params": {"min": 1, "max": 500}}, {"name": "off", "dtype": "float", "generator": "float", "params": {"min": 0, "max": 100}}], "relationships": [{"from": "user_id", "to": "users.id", "alias": "user"}], "rules": ["off <= total * 0.5", "total <= user.cap"]},
    ]})


def test_shop_conforms_and_repeats(spark):
    spec = shop()
    a, b = (generate(spark, spec).to_frames() for _ in range(2))
    assert validate_against_spec(a, spec).overall_ok
    assert sorted(a["orders"].collect()) == sorted(b["orders"].repartition(7).collect())


def test_negative_conformance(spark):
    spec = shop()
    t = generate(spark, spec).to_frames()
    t["orders"] = t["orders"].withColumn("user_id", t["orders"]["user_id"] + 1000)
    got = {c: s for _, c, s, _ in validate_against_spec(t, spec).checks}
    assert got["foreign_key:user_id"] == "fail" and got["rules"] == "fail"


def test_fallbacks(spark):
    bad = {"name": "t", "row_count": 20, "columns": [{"name": "x", "dtype": "int", "generator": "int", "params": {"min": 0, "max": 9}}], "rules": ["x > 99"]}
    make = lambda f: generate(spark, from_dict({"settings": {"fallback": f, "max_rule_attempts": 2}, "tables": [bad]}))
    with pytest.raises(RuleViolation):
        make("raise")
    assert make("drop")["t"].count() == 0
    assert [r[0] for r in make("null")["t"].collect()] == [None] * 20


@pytest.mark.parametrize(("rel", "ok"), [({"allocation": "balanced"}, True), ({"cardinality": "one_to_one"}, False), ({"min_children": 3, "max_children": 5}, True), ({"max_children": 1}, False), ({"allocation": "weighted", "weight_column": "id"}, True)])
def test_allocations(spark, rel, ok):
    spec = from_dict({"tables": [{"name": "p", "row_count": 10, "primary_key": "id", "columns": [ID]}, {"name": "c", "row_count": 40, "columns": [{"name": "p_id", "dtype": "int"}], "relationships": [{"from": "p_id", "to": "p.id", **rel}]}]})
    if not ok:
        with pytest.raises(SpecError):
            generate(spark, spec)["c"].collect()
        return
    counts = [r["count"] for r in generate(spark, spec)["c"].groupBy("p_id").count().collect()]
    assert sum(counts) == 40 and ("balanced" not in rel.values() or set(counts) == {4})


def test_many_to_many(spark):
    spec = from_dict({"tables": [{"name": "students", "row_count": 5, "primary_key": "id", "columns": [ID]}, {"name": "courses", "row_count": 4, "primary_key": "id", "columns": [ID]}], "many_to_many": [{"name": "takes", "left": "students", "right": "courses", "row_count": 12, "min_per_left": 2, "max_per_left": 3, "min_per_right": 2, "max_per_right": 4}]})
    rows = generate(spark, spec)["takes"].collect()
    assert len({tuple(r) for r in rows}) == 12 == len(rows)
    for i, n, low, high in ((0, 5, 2, 3), (1, 4, 2, 4)):
        deg = [sum(r[i] == k for r in rows) for k in range(1, n + 1)]
        assert min(deg) >= low and max(deg) <= high
    assert to_dict(expand_many_to_many(expand_many_to_many(spec))) == to_dict(expand_many_to_many(spec))


def test_hierarchy_depth(spark):
    spec = from_dict({"tables": [{"name": "e", "row_count": 50, "primary_key": "id", "columns": [ID, {"name": "boss", "dtype": "int"}], "relationships": [{"from": "boss", "to": "e.id", "max_depth": 2}]}]})
    up = {r["id"]: r["boss"] for r in generate(spark, spec)["e"].collect()}

    def depth(i):
        return 0 if up[i] is None else 1 + depth(up[i])

    assert max(map(depth, up)) <= 2 and all(b is None or b < i for i, b in up.items())


def test_spec_round_trip_and_versions():
    spec = shop()
    assert to_dict(from_dict(to_dict(spec))) == to_dict(spec) and dumps(spec) == dumps(from_dict(to_dict(spec)))
    with pytest.raises(SpecVersionError):
        from_dict({"spec_version": "9"})
    with pytest.raises(SpecError):
        generate(None, from_dict({"tables": [{"name": "t", "rules": ["nope > 1"]}]}))
