"""The rule language: text to syntax tree to a Spark Column, without any UDF."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d*|\.\d+|\d+)|(?P<str>'[^']*'|"[^"]*")|(?P<tick>`(?:[^`]|``)*`)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*/%<>().,]))""")
KEYWORDS = {"if", "then", "else", "and", "or", "not", "true", "false", "null", "none"}
FUNCTIONS = {"abs", "min", "max", "len", "lower", "upper", "coalesce", "days_between", "now"}


class RuleError(ValueError):
    """A rule that can't be read, or names what doesn't exist."""


def quote_identifier(name: str) -> str:
    """A column name as the rule language can read it."""
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) and name.lower() not in KEYWORDS | FUNCTIONS else "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise RuleError(f"can't read {text[at:]!r}")
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "name" and value.lower() in KEYWORDS:
            kind, value = "key", value.lower()
        elif kind == "tick":
            value = value[1:-1].replace("``", "`")
        out.append((kind, value))
        at = m.end()
    return [*out, ("end", "")]


#: Binary operators by level, loosest first; comparisons do not chain.
LEVELS = [({"or"}, True), ({"and"}, True), "not", ({"==", "!=", "<", "<=", ">", ">="}, False), ({"+", "-"}, True), ({"*", "/", "%"}, True)]


class _Reader:
    def __init__(self, text: str):
        self.at, self.all = 0, tokens(text)

    def peek(self) -> tuple[str, str]:
        return self.all[self.at]

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "key") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise RuleError(f"expected {value!r}, found {self.peek()[1]!r}")

    def rule(self) -> Node:
        if self.take("if"):
            cond = self.level(0)
            self.need("then")
            then = self.level(0)
            node = Node("if", None, (cond, then, self.level(0)) if self.take("else") else (cond, then))
        else:
            node = self.level(0)
        if self.peek()[0] != "end":
            raise RuleError(f"unexpected {self.peek()[1]!r}")
        return node

    def level(self, i: int) -> Node:
        if i == len(LEVELS):
            return self.unary()
        if LEVELS[i] == "not":
            return Node("not", None, (self.level(i),)) if self.take("not") else self.level(i + 1)
        ops, chain = LEVELS[i]
        left = self.level(i + 1)
        while op := self.take(*ops):
            left = Node("binary", op, (left, self.level(i + 1)))
            if not chain:
                break
        return left

    def unary(self) -> Node:
        if op := self.take("-", "+"):
            return Node("unary", op, (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return Node("lit", float(value) if "." in value else int(value))
        if kind == "str":
            return Node("lit", value[1:-1])
        if kind == "key" and value in ("true", "false", "null", "none"):
            return Node("lit", {"true": True, "false": False}.get(value))
        if (kind, value) == ("op", "("):
            node = self.level(0)
            self.need(")")
            return node
        if kind == "tick":
            return self.path(value)
        if kind == "name":
            if self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.level(0))
                    if not self.take(",") and self.peek() != ("op", ")"):
                        raise RuleError(f"expected ',' or ')' after an argument of {value}")
                return Node("call", value.lower(), tuple(args))
            return self.path(value)
        raise RuleError(f"unexpected {value!r}")

    def path(self, name: str) -> Node:
        if self.take("."):
            kind, value = self.peek()
            if kind not in ("name", "tick", "key"):
                raise RuleError("a column name must follow '.'")
            self.at += 1
            return Node("attr", (name, value))
        return Node("col", name)


def _kind(t: T.DataType) -> str:
    return "bool" if isinstance(t, T.BooleanType) else "num" if isinstance(t, T.NumericType) else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "null" if isinstance(t, T.NullType) else "str"


Typed = tuple[Column, str]


def truthy(x: Typed) -> Column:
    """Null, zero, false and empty text are false."""
    col, kind = x
    if kind == "null":
        return F.lit(False)
    return F.coalesce(col if kind == "bool" else col != 0 if kind == "num" else F.length(col) > 0 if kind == "str" else col.isNotNull(), F.lit(False))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null where the divisor is 0."""
    return a - b * F.floor(F.try_divide(a.cast("double"), b))


class Rule:
    """One rule. resolve(name) and resolve((alias, name)) give a Column and its type, or None where there is none."""

    def __init__(self, text: str, if_semantics: str = "filter"):
        self.text, self.tree, self.implies = text, _Reader(text).rule(), if_semantics == "implication"

    def _walk(self, node: Node, kind: str):
        if node.kind == kind:
            yield node.value
        for a in node.args:
            yield from self._walk(a, kind)

    @property
    def column_refs(self) -> set[str]:
        return set(self._walk(self.tree, "col"))

    @property
    def parent_refs(self) -> set[tuple[str, str]]:
        return set(self._walk(self.tree, "attr"))

    @property
    def parent_aliases(self) -> set[str]:
        return {a for a, _ in self.parent_refs}

    def check(self, resolve: Callable[[object], tuple[Column, T.DataType] | None]) -> Column:
        """Whether a row meets the rule: never null."""
        return truthy(self._typed(self.tree, resolve))

    def _typed(self, n: Node, resolve) -> Typed:
        if n.kind == "lit":
            v = n.value
            return F.lit(v), "null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"
        if n.kind in ("col", "attr"):
            got = resolve(n.value)
            return (F.lit(None), "null") if got is None else (got[0], _kind(got[1]))
        if n.kind == "not":
            return ~truthy(self._typed(n.args[0], resolve)), "bool"
        if n.kind == "unary":
            c, k = self._typed(n.args[0], resolve)
            return (-c if n.value == "-" else c), k
        if n.kind == "if":
            cond = truthy(self._typed(n.args[0], resolve))
            then = truthy(self._typed(n.args[1], resolve))
            other = truthy(self._typed(n.args[2], resolve)) if len(n.args) > 2 else F.lit(self.implies)
            return F.when(cond, then).otherwise(other), "bool"
        if n.kind == "call":
            return self._call(n, [self._typed(a, resolve) for a in n.args])
        a, b = (self._typed(x, resolve) for x in n.args)
        return self._binary(n.value, a, b)

    def _binary(self, op: str, a: Typed, b: Typed) -> Typed:
        (x, kx), (y, ky) = a, b
        if op in ("and", "or"):
            return (truthy(a) & truthy(b) if op == "and" else truthy(a) | truthy(b)), "bool"
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if kx == "date" and ky == "str":
                y = F.try_to_timestamp(y)
            elif kx == "str" and ky == "date":
                x = F.try_to_timestamp(x)
            elif {kx, ky} in ({"num", "str"}, {"bool", "str"}):
                return F.lit(False) if op != "!=" else F.lit(True), "bool"
            elif {kx, ky} == {"num", "bool"}:
                x, y = x.cast("double"), y.cast("double")
            if op in ("==", "!="):
                same = x.eqNullSafe(y)
                return (same if op == "==" else ~same), "bool"
            got = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return F.coalesce(got, F.lit(False)), "bool"
        if op == "+" and kx == ky == "str":
            return F.concat(x, y), "str"
        got = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x.cast("double"), y.cast("double")), "%": lambda: modulo(x, y)}[op]()
        return got, "num"

    def _call(self, n: Node, args: list[Typed]) -> Typed:
        cols = [c for c, _ in args]
        name = n.value
        if name in ("min", "max"):
            # a null argument makes the result null, as no order has it
            known = F.lit(True)
            for c in cols:
                known = known & c.isNotNull()
            return F.when(known, (F.least if name == "min" else F.greatest)(*cols) if len(cols) > 1 else cols[0]), args[0][1]
        simple = {"abs": (F.abs, "num"), "len": (F.length, "num"), "lower": (lambda c: F.lower(c.cast("string")), "str"), "upper": (lambda c: F.upper(c.cast("string")), "str")}
        if name in simple:
            return simple[name][0](cols[0]), simple[name][1]
        if name == "coalesce":
            return F.coalesce(*cols), next((k for _, k in args if k != "null"), "null")
        if name == "days_between":
            a, b = (F.try_to_timestamp(c).cast("date") if k == "str" else c.cast("date") for c, k in args)
            return F.datediff(a, b), "num"
        if name == "now":
            return F.current_timestamp(), "date"
        raise RuleError(f"unknown function {name}")


def frame_resolver(schema: T.StructType, parents: dict[str, T.StructType] | None = None, prefix: str = "__p_") -> Callable:
    """Columns of a frame by name, and of its parents' structs, `<prefix><alias>`, by (alias, name)."""
    own = {f.name: f.dataType for f in schema.fields}

    def resolve(ref):
        if isinstance(ref, tuple):
            alias, name = ref
            fields_ = {f.name: f.dataType for f in (parents or {}).get(alias, T.StructType()).fields}
            return (F.col(prefix + alias).getField(name), fields_[name]) if name in fields_ else None
        return (F.col("`" + ref.replace("`", "``") + "`"), own[ref]) if ref in own else None

    return resolve
