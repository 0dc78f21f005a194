"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass
class Lit(Expr):
    value: Any  # None, bool, int, float, str, bytes


@dataclass
class Col(Expr):
    table: str | None
    name: str


@dataclass
class Star(Expr):
    table: str | None = None


@dataclass
class Unary(Expr):
    op: str
    arg: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass
class Like(Expr):
    arg: Expr
    pattern: Expr
    escape: Expr | None
    fold: bool
    negated: bool


@dataclass
class InList(Expr):
    arg: Expr
    items: list[Expr]
    negated: bool


@dataclass
class InSelect(Expr):
    arg: Expr
    select: Select
    negated: bool


@dataclass
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass
class Case(Expr):
    operand: Expr | None
    whens: list[tuple[Expr, Expr]]
    otherwise: Expr | None


@dataclass
class Cast(Expr):
    arg: Expr
    type: str


@dataclass
class Func(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass
class SubSelect(Expr):
    select: Select


@dataclass
class Exists(Expr):
    select: Select
    negated: bool = False


@dataclass
class Vector(Expr):
    items: list[Expr]


@dataclass
class Param(Expr):
    slot: int


@dataclass
class Default(Expr):
    pass


@dataclass
class Table:
    name: str
    alias: str | None


@dataclass
class Derived:
    select: Select
    alias: str


@dataclass
class Join:
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS
    left: Any
    right: Any
    on: Expr | None = None
    using: list[str] = field(default_factory=list)


@dataclass
class Core:
    items: list[tuple[Expr, str | None]]
    source: Any = None
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    distinct: bool = False


@dataclass
class SetOp:
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    left: Any
    right: Any


@dataclass
class Select:
    body: Any
    ctes: list[tuple[str, Select]] = field(default_factory=list)
    order: list[tuple[Expr, bool, bool | None]] = field(default_factory=list)  # expression, descending, nulls first
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False
    autoincrement: bool = False
    default: str | None = None
    checks: list[tuple[str | None, str]] = field(default_factory=list)
    references: tuple[str, list[str]] | None = None


@dataclass
class Statement:
    kind: str
    args: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None
