"""Who may do what with which table, which rows they see, and which columns as what."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.errors import InvalidArgument, PermissionDenied
from ledgerlake.functions.masks import Mask, quoted
from ledgerlake.table import Snapshot, Table

#: Actions that a role may hold; "all" stands for every one.
ACTIONS = (
    "create_table", "drop_table", "alter_table", "list_tables", "describe_table", "read", "write", "delete", "update_schema", "set_properties",
    "compact", "expire", "read_history", "grant", "audit", "all",
)


@dataclass(frozen=True)
class Principal:
    name: str
    roles: frozenset[str] = frozenset()
    attributes: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Permission:
    """action on the tables that resource names: *, a prefix followed by *, or a full name."""

    action: str
    resource: str = "*"

    def allows(self, action: str, resource: str) -> bool:
        return self.action in ("all", action) and matches(self.resource, resource)


def matches(pattern: str, resource: str) -> bool:
    return resource.startswith(pattern[:-1]) if pattern.endswith("*") else resource == pattern


@dataclass(frozen=True)
class Policy:
    """Of attributes: applies if every (attribute, test, value) holds; test is one of = != in < >. effect is allow or deny."""

    effect: str
    conditions: tuple[tuple[str, str, Any], ...]
    action: str = "all"
    resource: str = "*"

    def applies(self, who: Principal, action: str, resource: str) -> bool:
        return self.action in ("all", action) and matches(self.resource, resource) and all(_holds(who.attributes.get(a), test, v) for a, test, v in self.conditions)


def _holds(held: Any, test: str, value: Any) -> bool:
    if held is None:
        return False
    return {"=": lambda: held == value, "!=": lambda: held != value, "in": lambda: held in value, "<": lambda: held < value, ">": lambda: held > value}[test]()


@dataclass(frozen=True)
class RowFilter:
    """A condition on rows, in SQL; :name stands for an attribute of the principal, which is bound, never pasted in.

    Of permissive filters one must hold, of restrictive ones all.
    """

    condition: str
    restrictive: bool = False
    roles: frozenset[str] = frozenset()

    def concerns(self, who: Principal) -> bool:
        return not self.roles or bool(self.roles & who.roles)


@dataclass(frozen=True)
class ColumnRule:
    """What principals without one of the roles see of a column: its mask, or nothing if there is none."""

    column: str
    mask: Mask | None = None
    unless: frozenset[str] = frozenset()


@dataclass
class Security:
    """Roles, policies and rules, and a log of what was asked for."""

    roles: dict[str, tuple[Permission, ...]] = field(default_factory=dict)
    policies: list[Policy] = field(default_factory=list)
    filters: dict[str, list[RowFilter]] = field(default_factory=dict)
    rules: dict[str, list[ColumnRule]] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)

    def allowed(self, who: Principal, action: str, resource: str) -> bool:
        """A role must permit it; then no policy may deny it."""
        if action not in ACTIONS:
            raise InvalidArgument(f"unknown action '{action}'")
        ok = any(p.allows(action, resource) for r in who.roles for p in self.roles.get(r, ())) and not any(p.effect == "deny" and p.applies(who, action, resource) for p in self.policies)
        self.log.append((datetime.now(timezone.utc), who.name, action, resource, ok))
        return ok

    def check(self, who: Principal, action: str, resource: str) -> None:
        if not self.allowed(who, action, resource):
            raise PermissionDenied(f"{who.name} may not {action} {resource}")

    def read(self, who: Principal, table: Table, at: str | int | None = None) -> DataFrame:
        """The rows and columns of a snapshot that the principal may see."""
        self.check(who, "read", str(table.ident))
        return self.apply(who, table.snapshot(at), str(table.ident))

    def apply(self, who: Principal, snapshot: Snapshot, resource: str) -> DataFrame:
        df = snapshot.df()
        condition = self.row_condition(who, df, resource)
        if condition is not None:
            df = df.where(condition)
        out = []
        rules = {r.column: r for r in self.rules.get(resource, ()) if not r.unless & who.roles}
        for f in df.schema:
            rule = rules.get(f.name)
            if rule is None:
                out.append(F.col(quoted(f.name)))
            elif rule.mask is not None:
                out.append(rule.mask.column(f.name, f.dataType).alias(f.name))
        return df.select(*out)

    def row_condition(self, who: Principal, df: DataFrame, resource: str) -> Column | None:
        own = [f for f in self.filters.get(resource, ()) if f.concerns(who)]
        permissive = [_bound(f.condition, who) for f in own if not f.restrictive]
        restrictive = [_bound(f.condition, who) for f in own if f.restrictive]
        parts = ([reduce(lambda a, b: a | b, permissive)] if permissive else []) + restrictive
        return reduce(lambda a, b: a & b, parts) if parts else None

    def create_view(self, who: Principal, table: Table, name: str) -> None:
        """A view of spark.sql with the principal's rows and columns; hidden columns are not in it."""
        self.read(who, table).createOrReplaceTempView(name)

    def audit(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "at timestamp, principal string, action string, resource string, allowed boolean")


def _bound(condition: str, who: Principal) -> Column:
    """The condition with the principal's attributes as literals."""
    def literal(m: re.Match) -> str:
        if m[1] == "name":
            return _sql(who.name)
        if m[1] not in who.attributes:
            return "NULL"
        return _sql(who.attributes[m[1]])

    return F.expr(re.sub(r"(?<![:\w]):(\w+)", literal, condition))


def _sql(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, Iterable) and not isinstance(value, str):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    # Hex digits can't end the literal, whatever the value holds.
    return f"decode(X'{str(value).encode().hex()}', 'UTF-8')"
