"""What a Spec reveals about the data it was profiled from."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from ..plans.spec import Spec


@dataclass
class DisclosureReport:
    tables: list = field(default_factory=list)
    categorical_values: int = 0
    rare_values: int = 0
    redacted_columns: int = 0
    suppressed_values: int = 0
    conditional_keys: int = 0
    conditional_cells: int = 0
    personal_columns: int = 0
    numeric_columns: int = 0
    datetime_columns: int = 0
    text_columns: int = 0
    details: list = field(default_factory=list)

    @classmethod
    def from_spec(cls, spec: Spec) -> DisclosureReport:
        out = cls(tables=[t.name for t in spec.tables])
        for t in spec.tables:
            for c in t.columns:
                p = c.profile or {}
                cat = p.get("categorical") or {}
                n = 0 if cat.get("redacted") else len(cat.get("values", []))
                out.categorical_values += n
                out.rare_values += cat.get("rare", 0) or 0
                out.suppressed_values += cat.get("suppressed", 0) or 0
                out.redacted_columns += bool(cat.get("redacted"))
                out.personal_columns += bool(c.pii)
                out.numeric_columns += "numeric" in p
                out.datetime_columns += "datetime_range" in p
                out.text_columns += "length" in p
                keys, cells = conditional_disclosure(c.params if c.generator == "conditional" else None)
                out.conditional_keys += keys
                out.conditional_cells += cells
                if n or keys:
                    out.details.append({"table": t.name, "column": c.name, "values": n, "keys": keys, "cells": cells})
        return out

    def to_dict(self) -> dict:
        return asdict(self)

    def to_text(self) -> str:
        rows = [f"{k.replace('_', ' ')}: {v}" for k, v in self.to_dict().items() if k not in ("tables", "details")]
        return "\n".join([f"Tables: {', '.join(self.tables)}", *rows, *[f"  {d['table']}.{d['column']}: {d['values']} values, {d['keys']} keys, {d['cells']} cells" for d in self.details]])


def conditional_disclosure(params) -> tuple[int, int]:
    """Keys and cells of a conditional table; malformed ones count as far as they can be read."""
    if not isinstance(params, dict):
        return 0, 0
    keys, values = params.get("keys"), params.get("values")
    return len(keys) if isinstance(keys, list) else 0, sum(len(v) for v in values if isinstance(v, list)) if isinstance(values, list) else 0


@dataclass
class DisclosureBudget:
    max_categorical_values: int | None = None
    max_rare_values: int | None = None
    max_conditional_cells: int | None = None


def check_budget(report: DisclosureReport, budget: DisclosureBudget) -> list[str]:
    """What is over the budget, in words."""
    return [f"{k[4:].replace('_', ' ')}: {getattr(report, k[4:])} > {v}" for k, v in asdict(budget).items() if v is not None and getattr(report, k[4:]) > v]
