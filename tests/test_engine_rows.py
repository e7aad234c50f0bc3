"""Rows that parents lose, redraws, depths and weights."""

import pytest

from specforge.operators.engine import Engine, redrawn
from specforge.plans.spec import RuleViolation, SpecError, from_dict

SEQ = {"name": "id", "dtype": "int", "generator": "sequence"}


def run(spark, tables, **settings):
    return Engine(spark, from_dict({"settings": {"seed": 4, **settings}, "tables": tables})).run()


CHILD = {"name": "c", "row_count": 100, "primary_key": "id", "columns": [SEQ, {"name": "p_id", "dtype": "int"}], "relationships": [{"from": "p_id", "to": "p.id"}]}


def test_children_of_a_parent_that_lost_rows_to_a_unique_key(spark):
    parent = {"name": "p", "row_count": 12, "primary_key": "id", "columns": [SEQ, {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 5}, "constraints": {"unique": True}}]}
    got = run(spark, [parent, CHILD], fallback="drop")
    kept = sorted(r["id"] for r in got["p"].collect())
    assert kept == [1, 2, 3, 4, 5] and got["c"].count() == 100
    assert {r["p_id"] for r in got["c"].collect()} <= set(kept)


@pytest.mark.parametrize("fallback", ["drop", "null"])
def test_fk_generator_keeps_rows(spark, fallback):
    parent = {"name": "p", "row_count": 12, "primary_key": "id", "columns": [SEQ, {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 9}}], "rules": ["x < 4"]}
    child = {"name": "c", "row_count": 100, "columns": [SEQ, {"name": "q", "dtype": "int", "generator": "fk", "params": {"ref": "p.id"}}]}
    got = run(spark, [parent, child], fallback=fallback, max_rule_attempts=1)
    assert got["c"].count() == 100 and (fallback == "null" or got["p"].count() < 12)
    assert {r["q"] for r in got["c"].collect()} <= {r["id"] for r in got["p"].collect()}


def test_impossible_keys_raise(spark):
    t = {"name": "t", "row_count": 12, "columns": [{"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 5}, "constraints": {"unique": True}}]}
    with pytest.raises(RuleViolation):
        run(spark, [t])["t"].count()


def test_unique_column_takes_all_values_there_are(spark):
    x = {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 300}, "constraints": {"unique": True}}
    got = [r["x"] for r in run(spark, [{"name": "t", "row_count": 300, "columns": [SEQ, x]}])["t"].collect()]
    assert sorted(got) == list(range(1, 301))


def test_unique_pairs_take_all_pairs_there_are(spark):
    cols = [SEQ, *[{"name": n, "dtype": "int", "generator": "int", "params": {"min": 1, "max": 15}} for n in "ab"]]
    got = run(spark, [{"name": "t", "row_count": 225, "columns": cols, "unique_constraints": [["a", "b"]]}])["t"].collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in range(1, 16) for b in range(1, 16)} and len({r["id"] for r in got}) == 225


def test_no_parent_rows(spark):
    parent = {"name": "p", "row_count": 3, "primary_key": "id", "columns": [SEQ, {"name": "x", "dtype": "int", "generator": "const", "params": {"value": 1}}], "rules": ["x > 1"]}
    with pytest.raises(SpecError):
        run(spark, [parent, CHILD], fallback="drop", max_rule_attempts=2)


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_depth_and_roots(spark, depth):
    t = {"name": "e", "row_count": 50, "primary_key": "id", "columns": [SEQ, {"name": "boss", "dtype": "int"}], "relationships": [{"from": "boss", "to": "e.id", "max_depth": depth}]}
    boss = {r["id"]: r["boss"] for r in run(spark, [t])["e"].collect()}
    assert sum(b is None for b in boss.values()) == (50 if depth == 0 else 1)

    def deep(i):
        return 0 if boss[i] is None else 1 + deep(boss[i])

    assert all(b is None or b < i for i, b in boss.items()) and max(map(deep, boss)) == depth


def test_only_what_rules_touch_is_redrawn(spark):
    cols = [SEQ, {"name": "a", "dtype": "int", "generator": "int", "params": {"min": 0, "max": 9}}, {"name": "b", "dtype": "int", "generator": "int", "params": {"min": 0, "max": 99}}, {"name": "c", "generator": "conditional", "params": {"on": "a", "keys": [0], "values": [["z"]], "default": {"values": ["d"]}}, "depends_on": ["a"]}]
    free = {"name": "t", "row_count": 200, "columns": cols}
    ruled = {**free, "rules": ["a > 6"]}
    assert redrawn(from_dict({"tables": [ruled]}).tables[0]) == {"a", "c"}
    one, two = ({r["id"]: r for r in run(spark, [t])["t"].collect()} for t in (free, ruled))
    assert all(two[i]["b"] == one[i]["b"] and two[i]["a"] > 6 for i in one)


def test_weights(spark):
    parent = {"name": "p", "row_count": 3, "primary_key": "id", "columns": [SEQ, {"name": "w", "dtype": "int", "generator": "conditional", "params": {"on": "id", "keys": [1, 2], "values": [[0], [1]], "default": {"values": [3]}}, "depends_on": ["id"]}]}
    child = {**CHILD, "row_count": 4000, "relationships": [{"from": "p_id", "to": "p.id", "allocation": "weighted", "weight_column": "w"}]}
    n = {r["p_id"]: r["count"] for r in run(spark, [parent, child])["c"].groupBy("p_id").count().collect()}
    assert sum(n.values()) == 4000 and 1 not in n and abs(n[3] / 4000 - 0.75) < 0.03


def test_intermediate_rows_can_be_deleted(spark):
    parent = {"name": "p", "row_count": 50, "columns": [SEQ, {"name": "x", "dtype": "int", "generator": "int", "params": {"min": 1, "max": 9}}], "rules": ["x < 4"]}
    got = run(spark, [parent])
    assert got["p"].count() == 50
    got.close()
    with pytest.raises(Exception):
        got["p"].count()
