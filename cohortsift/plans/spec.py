"""What a review step asks for: tables, joins, fields, filters and order.

A spec is plain data. It is read from JSON, checked once, and turned into a
DataFrame by :mod:`cohortsift.plans.steps`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

MAIN = "main_table"

# The join keywords a spec may use, and Spark's name for each.
JOIN_KINDS = {
    "": "inner",
    "INNER": "inner",
    "LEFT": "left",
    "LEFT OUTER": "left",
    "RIGHT": "right",
    "RIGHT OUTER": "right",
    "FULL": "full",
    "FULL OUTER": "full",
    "OUTER": "full",
    "SEMI": "left_semi",
    "LEFT SEMI": "left_semi",
    "ANTI": "left_anti",
    "LEFT ANTI": "left_anti",
}


class SpecError(ValueError):
    """A spec that cannot be run, with the reason."""


def join_kind(text: str | None) -> str:
    """Spark's join type for a keyword such as ``LEFT JOIN``."""
    words = (text or "").replace("_", " ").upper().split()
    if words and words[-1] == "JOIN":
        words.pop()
    try:
        return JOIN_KINDS[" ".join(words)]
    except KeyError:
        raise SpecError(f"unsupported join type {text!r}: only joins on one equality") from None


@dataclass(frozen=True)
class JoinSpec:
    left_table: str
    left_on: str
    right_on: str
    how: str = "inner"


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str
    quoted: bool = False
    join: JoinSpec | None = None

    @property
    def hides_columns(self) -> bool:
        """Semi and anti joins only test for a match."""
        return self.join is not None and self.join.how in ("left_semi", "left_anti")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    table: str | None = None
    alias: str | None = None
    is_expression: bool = False
    value: str | None = None

    @property
    def output(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class OrderKey:
    field: str
    direction: str = "asc"

    def __post_init__(self) -> None:
        if self.direction.lower() not in ("asc", "desc"):
            raise SpecError(f"order direction must be asc or desc, not {self.direction!r}")

    @property
    def descending(self) -> bool:
        return self.direction.lower() == "desc"

    @classmethod
    def of(cls, value: OrderKey | str | tuple[str, str] | dict[str, str]) -> OrderKey:
        """Accept ``"a"``, ``"a desc"``, ``("a", "desc")`` or a JSON object."""
        if isinstance(value, OrderKey):
            return value
        if isinstance(value, dict):
            return cls(value["field"], value.get("direction", "asc"))
        if isinstance(value, tuple):
            return cls(*value)
        name, _, direction = value.strip().rpartition(" ")
        if name and direction.lower() in ("asc", "desc"):
            return cls(name.strip(), direction)
        return cls(value.strip())


@dataclass(frozen=True)
class FilterNode:
    """A leaf of SQL text, or an AND / OR over other nodes."""

    kind: str = "AND"
    text: str = ""
    children: tuple[FilterNode, ...] = ()

    def __bool__(self) -> bool:
        if self.kind == "LEAF":
            return bool(self.text)
        return any(self.children)

    def texts(self) -> list[str]:
        """Every leaf text below this node."""
        if self.kind == "LEAF":
            return [self.text] if self.text else []
        return [text for child in self.children for text in child.texts()]

    @classmethod
    def leaf(cls, text: str) -> FilterNode:
        return cls("LEAF", text)

    @classmethod
    def all_of(cls, *children: FilterNode | str) -> FilterNode:
        return cls("AND", children=tuple(cls.parse(c) for c in children))

    @classmethod
    def any_of(cls, *children: FilterNode | str) -> FilterNode:
        return cls("OR", children=tuple(cls.parse(c) for c in children))

    @classmethod
    def parse(cls, value: Any) -> FilterNode:
        if isinstance(value, FilterNode):
            return value
        if not value:
            return cls()
        if isinstance(value, str):
            return cls.leaf(value)
        if not isinstance(value, dict):
            raise SpecError(f"a filter is a text or an object, not {value!r}")
        if set(value) == {"expression"}:
            return cls.leaf(value["expression"])
        if set(value) == {"$and"}:
            return cls.all_of(*value["$and"])
        if set(value) == {"$or"}:
            return cls.any_of(*value["$or"])
        if "filter_type" in value:
            kind = str(value["filter_type"]).upper()
            if kind == "LEAF":
                return cls.leaf(value.get("expression", ""))
            if kind in ("AND", "OR"):
                return cls(kind, children=tuple(cls.parse(c) for c in value.get("children", ())))
        raise SpecError(f"unknown filter form {sorted(value)}")

    def to_json(self) -> Any:
        if self.kind == "LEAF":
            return {"expression": self.text}
        return {f"${self.kind.lower()}": [child.to_json() for child in self.children]}


@dataclass(frozen=True)
class StepSpec:
    fields: tuple[FieldSpec, ...]
    tables: tuple[TableRef, ...] = ()
    filters: FilterNode = field(default_factory=FilterNode)
    order: tuple[OrderKey, ...] = ()
    title: str = ""
    description: str = ""

    def __post_init__(self) -> None:
        if not self.fields:
            raise SpecError("a step needs at least one field")
        seen, visible = {MAIN}, {MAIN}
        for table in self.tables:
            if table.alias in seen:
                raise SpecError(f"table alias {table.alias!r} is used twice")
            if table.join is None:
                raise SpecError(f"table {table.alias!r} says nothing about how to join it")
            if table.join.left_table not in visible:
                raise SpecError(f"join of {table.alias!r}: no earlier table {table.join.left_table!r} to join to")
            seen.add(table.alias)
            if not table.hides_columns:
                visible.add(table.alias)
        for item in self.fields:
            if item.table is not None and item.table not in visible:
                raise SpecError(f"field {item.output!r}: no table {item.table!r} in this step")
            if item.table is None and item.value is None and not item.is_expression:
                raise SpecError(f"field {item.output!r} names no table")

    @classmethod
    def from_json(cls, step: dict[str, Any] | str) -> StepSpec:
        if isinstance(step, str):
            step = json.loads(step)
        return cls(
            fields=tuple(_field(f) for f in step["fields"]),
            tables=tuple(_table(t) for t in step.get("tables", ())),
            filters=FilterNode.parse(step.get("filters")),
            order=tuple(OrderKey.of(o) for o in step.get("order", ())),
            title=step.get("title", ""),
            description=step.get("description", ""),
        )

    def to_json(self) -> dict[str, Any]:
        return {
            "title": self.title,
            "description": self.description,
            "tables": [_table_json(t) for t in self.tables],
            "fields": [
                {k: v for k, v in vars(f).items() if v is not None or k == "is_expression"} for f in self.fields
            ],
            "filters": self.filters.to_json(),
            "order": [{"field": o.field, "direction": o.direction} for o in self.order],
        }


def _field(item: dict[str, Any]) -> FieldSpec:
    return FieldSpec(
        name=item["name"],
        table=item.get("table"),
        alias=item.get("alias"),
        is_expression=bool(item.get("is_expression", False)),
        value=item.get("value"),
    )


def _table(item: dict[str, Any]) -> TableRef:
    on = item.get("join")
    return TableRef(
        name=item["name"],
        alias=item.get("alias") or item["name"],
        quoted=bool(item.get("quoted", False)),
        join=None
        if on is None
        else JoinSpec(on["left_table"], on["left_on"], on["right_on"], join_kind(on.get("join_type"))),
    )


def _table_json(table: TableRef) -> dict[str, Any]:
    out: dict[str, Any] = {"name": table.name, "alias": table.alias, "quoted": table.quoted}
    if table.join:
        out["join"] = {
            "left_table": table.join.left_table,
            "left_on": table.join.left_on,
            "right_on": table.join.right_on,
            "join_type": table.join.how,
        }
    return out


def parse_method(body: str) -> list[StepSpec]:
    """The steps of a method file; a single object is a method of one step."""
    steps = json.loads(body)
    if isinstance(steps, dict):
        steps = [steps]
    return [StepSpec.from_json(step) for step in steps]
