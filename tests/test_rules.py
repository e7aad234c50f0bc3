import pytest
from pyspark.sql import types as T

from specforge.functions.rules import Rule, RuleError, frame_resolver, quote_identifier

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("s", T.StringType()), T.StructField("odd name", T.LongType())])
ROWS = [(1, 2, "x", 5), (None, 2, "", None), (7, -3, None, 0)]


@pytest.mark.parametrize(("text", "want"), [
    ("a == null", [False, True, False]), ("a < b", [True, False, False]), ("a != b", [True, True, True]), ("s", [True, False, False]),
    ("if a == 1 then b == 2", [True, False, False]), ("if a == 1 then b == 2 else true", [True, True, True]), ("not s or b > 0", [True, True, True]),
    ("a % b == 0 - 2", [False, False, True]), ("`odd name` == 5", [True, False, False]), ("len(s) == 1 and upper(s) == 'X'", [True, False, False]),
    ("coalesce(a, 9) == 9", [False, True, False]), ("max(a, b) == 2", [True, False, False]), ("a / 0 == null", [True, True, True]), ("s == 1", [False, False, False]),
])
def test_truth(spark, text, want):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r[0] for r in df.select(Rule(text).check(frame_resolver(SCHEMA))).collect()] == want


def test_implication_option(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r[0] for r in df.select(Rule("if a == 1 then b == 3", "implication").check(frame_resolver(SCHEMA))).collect()] == [False, True, True]


@pytest.mark.parametrize("text", ["a ==", "a < b < 1", "(a", "a ? b", "if a"])
def test_unreadable(text):
    with pytest.raises(RuleError):
        Rule(text)


def test_refs_and_quotes():
    r = Rule("user.x > a and `if` == 1")
    assert r.column_refs == {"a", "if"} and r.parent_aliases == {"user"}
    assert quote_identifier("a") == "a" and quote_identifier("if") == "`if`" and quote_identifier("a`b") == "`a``b`"
