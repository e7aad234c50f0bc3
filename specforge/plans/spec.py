"""The Spec: a versioned, declarative description of tables, columns, keys, relationships and rules."""

from __future__ import annotations

import json
import sys
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any

VERSION = "1.0"
#: Written forms that mean VERSION.
SAME_VERSION = (None, "1", "1.0", "1.0.0")


class SpecError(ValueError):
    """The Spec contradicts itself or can't be met."""


class SpecVersionError(SpecError):
    """The Spec's version is unknown."""


class RuleViolation(SpecError):
    """Rows that satisfy the rules were not found within the allowed attempts."""


class Node:
    """A part of the Spec: read from and written to plain dictionaries; None and defaults are not written."""

    _alias: dict[str, str] = {}
    _parts: dict[str, type[Node]] = {}

    @classmethod
    def read(cls, data: Any):
        if isinstance(data, cls):
            return data
        if not isinstance(data, dict):
            raise SpecError(f"{cls.__name__} must be a mapping")
        known = {cls._alias.get(f.name, f.name): f for f in fields(cls)}
        got = {}
        for key, value in data.items():
            f = known.get(key)
            if f is None:
                continue
            part = cls._parts.get(f.name)
            got[f.name] = value if part is None or value is None else [part.read(x) for x in value] if isinstance(value, list) else part.read(value)
        missing = [k for k, f in known.items() if f.name not in got and f.default is MISSING and f.default_factory is MISSING]
        if missing:
            raise SpecError(f"{cls.__name__}: missing {', '.join(missing)}")
        return cls(**got)

    def write(self) -> dict[str, Any]:
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            default = f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else MISSING
            if value is None or value == default:
                continue
            out[self._alias.get(f.name, f.name)] = value.write() if isinstance(value, Node) else [x.write() if isinstance(x, Node) else x for x in value] if isinstance(value, list) else value
        return out


@dataclass
class When(Node):
    condition: str
    generator: str
    params: dict = field(default_factory=dict)
    _alias = {"condition": "if"}


@dataclass
class ColumnSpec(Node):
    name: str
    dtype: str = "str"
    generator: str | None = None
    params: dict = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)
    depends_on: list = field(default_factory=list)
    when: list = field(default_factory=list)
    pii: bool = False
    pii_strategy: str | None = None
    pii_detected_by: str | None = None
    description: str | None = None
    profile: dict | None = None
    provenance: dict | None = None
    _parts = {"when": When}

    @property
    def nullable(self) -> bool:
        return self.constraints.get("nullable", True)


@dataclass
class Relationship(Node):
    source: Any
    to: str
    to_columns: list | None = None
    alias: str | None = None
    on_delete: str | None = None
    allocation: str = "uniform"
    cardinality: str = "many_to_one"
    min_children: int | None = None
    max_children: int | None = None
    weight_column: str | None = None
    root_fraction: float = 0.0
    ordered: bool = False
    order_column: str | None = None
    max_depth: int | None = None
    provenance: dict | None = None
    _alias = {"source": "from"}

    @property
    def columns(self) -> list[str]:
        return [self.source] if isinstance(self.source, str) else list(self.source)

    @property
    def parent(self) -> str:
        return self.to.split(".")[0]

    @property
    def parent_columns(self) -> list[str]:
        return list(self.to_columns) if self.to_columns else [self.to.split(".", 1)[1]]

    @property
    def name(self) -> str:
        return self.alias or (self.columns[0][:-3] if len(self.columns) == 1 and self.columns[0].endswith("_id") else self.parent)


@dataclass
class TableSpec(Node):
    name: str
    row_count: int = 100
    primary_key: Any = None
    key_provenance: dict | None = None
    metadata: dict = field(default_factory=dict)
    columns: list = field(default_factory=list)
    unique_constraints: list = field(default_factory=list)
    relationships: list = field(default_factory=list)
    rules: list = field(default_factory=list)
    _parts = {"columns": ColumnSpec, "relationships": Relationship}

    @property
    def key(self) -> list[str]:
        return [] if not self.primary_key else [self.primary_key] if isinstance(self.primary_key, str) else list(self.primary_key)

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class ManyToMany(Node):
    name: str
    left: str
    right: str
    row_count: int = 100
    left_column: str | None = None
    right_column: str | None = None
    unique_pairs: bool = True
    min_per_left: int = 0
    max_per_left: int | None = None
    min_per_right: int = 0
    max_per_right: int | None = None
    allocation: str = "uniform"


@dataclass
class Settings(Node):
    seed: int = 0
    fallback: str = "raise"
    max_rule_attempts: int = 100
    default_format: str | None = None
    if_semantics: str = "filter"


@dataclass
class Spec(Node):
    tables: list = field(default_factory=list)
    spec_version: str = VERSION
    metadata: dict = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    many_to_many: list = field(default_factory=list)
    _parts = {"tables": TableSpec, "settings": Settings, "many_to_many": ManyToMany}

    def table(self, name: str) -> TableSpec | None:
        return next((t for t in self.tables if t.name == name), None)


def from_dict(data: Any) -> Spec:
    """A Spec from a plain dictionary, whose version is normalised first."""
    if not isinstance(data, dict):
        raise SpecError("a Spec must be a mapping")
    if (version := data.get("spec_version")) not in SAME_VERSION and str(version) not in SAME_VERSION:
        raise SpecVersionError(f"unknown spec_version {version!r}; known: {VERSION}")
    return Spec.read({**data, "spec_version": VERSION})


def from_file(path: str) -> Spec:
    """A Spec from YAML or JSON; its folder is put on the import path so that module:Attr generators resolve."""
    p = Path(path)
    text = p.read_text()
    if p.suffix in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if str(p.parent.resolve()) not in sys.path:
        sys.path.insert(0, str(p.parent.resolve()))
    return from_dict(data)


def to_dict(spec: Spec) -> dict[str, Any]:
    return {"spec_version": VERSION, **{k: v for k, v in spec.write().items() if k != "spec_version"}}


def dumps(spec: Spec, fmt: str = "json") -> str:
    if fmt in ("yaml", "yml"):
        import yaml

        return yaml.safe_dump(to_dict(spec), sort_keys=False, allow_unicode=True)
    return json.dumps(to_dict(spec), sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def to_file(spec: Spec, path: str) -> None:
    Path(path).write_text(dumps(spec, Path(path).suffix.lstrip(".")))


def expand_many_to_many(spec: Spec) -> Spec:
    """Junction tables for the many-to-many declarations; doing it again changes nothing."""
    tables = list(spec.tables)
    for m in spec.many_to_many:
        if spec.table(m.name):
            if spec.table(m.name).metadata.get("many_to_many"):
                continue
            raise SpecError(f"many-to-many {m.name}: a table of that name exists")
        sides = []
        for side, col in ((m.left, m.left_column), (m.right, m.right_column)):
            t = spec.table(side)
            if t is None or len(t.key) != 1:
                raise SpecError(f"many-to-many {m.name}: {side} needs a table with a one-column primary key")
            sides.append((col or f"{side.rstrip('s')}_id", t, t.column(t.key[0])))
        if sides[0][0] == sides[1][0]:
            raise SpecError(f"many-to-many {m.name}: both sides use the column {sides[0][0]}")
        columns = [ColumnSpec(name=c, dtype=k.dtype, constraints={"nullable": False}) for c, _, k in sides]
        key: Any = [c for c, *_ in sides]
        if not m.unique_pairs:
            columns.insert(0, ColumnSpec(name="id", dtype="int", generator="sequence", constraints={"nullable": False}))
            key = "id"
        rels = [Relationship(source=c, to=f"{t.name}.{k.name}", allocation=m.allocation) for c, t, k in sides]
        check_degrees(m, sides[0][1].row_count, sides[1][1].row_count)
        tables.append(TableSpec(name=m.name, row_count=m.row_count, primary_key=key, columns=columns, relationships=rels, metadata={"many_to_many": m.write()}))
    return Spec(tables=tables, metadata=spec.metadata, settings=spec.settings, many_to_many=spec.many_to_many)


def check_degrees(m: ManyToMany, n_left: int, n_right: int) -> None:
    """Whether row_count pairs can meet the degree bounds of both sides."""
    k = m.row_count
    for label, n, other, low, high in (("left", n_left, n_right, m.min_per_left, m.max_per_left), ("right", n_right, n_left, m.min_per_right, m.max_per_right)):
        if low < 0 or (high is not None and high < max(low, 1)):
            raise SpecError(f"{m.name}: bad degree bounds on the {label} side")
        if k and not n:
            raise SpecError(f"{m.name}: the {label} side has no rows")
        if low * n > k or (high is not None and high * n < k):
            raise SpecError(f"{m.name}: {k} pairs can't meet the degree bounds of the {label} side")
        if m.unique_pairs and low > other:
            raise SpecError(f"{m.name}: the {label} side needs more partners than there are")
    if k > n_left * n_right:
        raise SpecError(f"{m.name}: more pairs than combinations")


def sort_tables(spec: Spec) -> list[TableSpec]:
    """Parents before children; references of `fk` generators count, a table's own do not."""
    needs = {t.name: {r.parent for r in t.relationships} | {c.params["ref"].split(".")[0] for c in t.columns if c.generator == "fk" and "ref" in c.params} for t in spec.tables}
    return [spec.table(n) for n in topological({k: v - {k} for k, v in needs.items()}, "tables")]


def topological(needs: dict[str, set[str]], what: str) -> list[str]:
    out: list[str] = []
    while len(out) < len(needs):
        ready = [n for n in needs if n not in out and needs[n] & set(needs) <= set(out)]
        if not ready:
            raise SpecError(f"{what} depend on each other: {', '.join(n for n in needs if n not in out)}")
        out += ready
    return out
