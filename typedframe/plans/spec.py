"""The logical form of a query, its checks, and the resolution of deferred arguments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import ArgumentError, BuildError
from ..functions.expr import CONTAINS, NOT_SLICE, PREFIX, SLICE, SUFFIX, Condition, Expr, Node, fits, plain
from ..sources.schema import TableDef

INNER, LEFT, RIGHT, FULL, CROSS = "inner", "left", "right", "full", "cross"


@dataclass(frozen=True)
class Join:
    how: str
    table: TableDef
    on: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    select: tuple[Expr, ...] = ()
    source: TableDef | None = None
    joins: tuple[Join, ...] = ()
    where: tuple[Condition, ...] = ()
    search: tuple[Expr, ...] = ()
    group: tuple[Expr, ...] = ()
    having: tuple[Condition, ...] = ()
    setops: tuple[tuple[str, QuerySpec], ...] = ()
    lock: tuple[str, ...] = field(default=())

    def relations(self) -> list[TableDef]:
        return [self.source, *(j.table for j in self.joins)]

    def expressions(self) -> Iterator[Node]:
        yield from self.select
        for j in self.joins:
            yield from j.on
        yield from (*self.where, *self.search, *self.group, *self.having)

    def aggregated(self) -> bool:
        return bool(self.group or self.having) or any(e.has("aggregate") for e in self.select)

    def wrapped(self) -> bool:
        """Whether counting needs the whole result rather than the filtered rows."""
        return bool(self.setops) or self.aggregated() or any(e.has("distinct") for e in self.select)


def check(spec: QuerySpec) -> None:
    """Raises the first violation of the rules for a whole query."""
    if not spec.select:
        raise BuildError("a query selects at least one column")
    if spec.source is None:
        raise BuildError("a query has a FROM")
    names: set[str] = {spec.source.label}
    for j in spec.joins:
        label = j.table.label
        if label in names:
            raise BuildError(f"{label} is joined twice: aliases are required")
        if j.how != CROSS:
            if not j.on:
                raise BuildError(f"the join of {label} needs a condition")
            used = {n for c in j.on for n in c.tables()}
            if label not in used:
                raise BuildError(f"the join condition doesn't refer to {label}")
            if later := used - names - {label}:
                raise BuildError(f"the join of {label} refers to {sorted(later)[0]}, which isn't introduced yet")
            if not used - {label}:
                raise BuildError(f"the join condition of {label} refers to no earlier table")
        names.add(label)
    for e in spec.expressions():
        for n in e.walk():
            if n.kind == "error":
                raise BuildError(n.value)
        if missing := set(e.tables()) - names:
            raise BuildError(f"{sorted(missing)[0]} isn't in the query")
    for i, e in enumerate(spec.select):
        inner = e.args[0] if e.kind == "named" else e
        below = [n for x in inner.args for n in x.walk()] if inner.kind == "distinct" else list(inner.walk())
        if inner.kind == "distinct" and i:
            raise BuildError("DISTINCT belongs to the first selected column")
        _no_distinct(below)
    for e in (*spec.group, *spec.where, *spec.having, *(c for j in spec.joins for c in j.on)):
        _no_distinct(list(e.walk()))
    if any(c.has("aggregate") for c in (*spec.where, *spec.group)):
        raise BuildError("aggregates belong to SELECT and HAVING")
    for _, other in spec.setops:
        check(other)
        if len(other.select) != len(spec.select):
            raise BuildError("both sides of a set operation have as many columns")
        if spec.search or other.search:
            raise BuildError("a set operation takes no keyword search")
    ctes(spec)


def _no_distinct(nodes: list[Node]) -> None:
    allowed = {id(n.args[0]) for n in nodes if n.kind == "aggregate" and n.args}
    if any(n.kind == "distinct" and id(n) not in allowed for n in nodes):
        raise BuildError("DISTINCT belongs to the first selected column or into an aggregate")


def inner_specs(spec: QuerySpec) -> Iterator[QuerySpec]:
    """Bodies of subqueries and other sides of set operations."""
    for e in spec.expressions():
        for n in e.walk():
            if n.kind == "subquery":
                yield n.value.spec
    for _, s in spec.setops:
        yield s


def ctes(spec: QuerySpec) -> dict[str, TableDef]:
    """All common table expressions, each after those that it needs. Two of one name, or a cycle, are errors."""
    out: dict[str, TableDef] = {}

    def visit(s: QuerySpec, trail: tuple[str, ...]) -> None:
        for t in sorted((r for r in s.relations() if r is not None), key=lambda r: r.name):
            base = t.alias_of or t
            if base.body is None:
                continue
            if base.name in trail:
                raise BuildError(f"CTE {base.name} refers to itself")
            if base.name in out:
                if out[base.name].body is not base.body:
                    raise BuildError(f"two CTEs are called {base.name}")
                continue
            visit(base.body, (*trail, base.name))
            out[base.name] = base
        for x in inner_specs(s):
            visit(x, trail)

    visit(spec, ())
    return out


def map_nodes(spec: QuerySpec, fn) -> QuerySpec:
    """``fn`` applied to each expression in textual order: select, joins, where, search, group, having, then set operations."""
    return replace(
        spec,
        select=tuple(fn(e) for e in spec.select),
        joins=tuple(replace(j, on=tuple(fn(c) for c in j.on)) for j in spec.joins),
        where=tuple(fn(c) for c in spec.where),
        search=tuple(fn(c) for c in spec.search),
        group=tuple(fn(e) for e in spec.group),
        having=tuple(fn(c) for c in spec.having),
        setops=tuple((op, map_nodes(s, fn)) for op, s in spec.setops),
    )


def _argument(n: Node, value: Any) -> Any:
    """The value as Spark takes it, if it fits what it is compared with."""
    try:
        value = plain(value)
    except BuildError as e:
        raise ArgumentError(str(e)) from e
    if not fits(n.type, value):
        raise ArgumentError(f"{value!r} doesn't fit {n.name} of type {n.type.simpleString()}")
    return value


def _values(n: Node, x: Any) -> list[Any]:
    if x is None:
        return []
    if isinstance(x, (str, bytes)) or not hasattr(x, "__iter__"):
        raise ArgumentError("a list argument is expected")
    return [_argument(n, v) for v in x]


def resolve(spec: QuerySpec, args: tuple[Any, ...]) -> tuple[QuerySpec, dict[str, QuerySpec]]:
    """The query with its deferred arguments filled in, and the bodies of its CTEs with theirs, which come first."""
    left = list(args)

    def take() -> Any:
        if not left:
            raise ArgumentError("missing external query argument")
        return left.pop(0)

    def fill(n: Node) -> Node:
        if n.kind == "param":
            return _fill_one(n, take())
        if n.kind in ("in", "nin") and len(n.args) == 2 and n.args[1].kind == "param":
            inner = fill(n.args[0])
            values = _values(n.args[1], take())
            empty = not values and n.args[1].value == SLICE
            return replace(n, args=(inner,), value=["null"] if empty else values, name="null" if empty else "")
        if n.kind == "subquery":
            return replace(n, value=n.value.with_spec(map_nodes(n.value.spec, fill)))
        return n.rebuilt(fill)

    bodies = {name: map_nodes(t.body, fill) for name, t in ctes(spec).items()}
    out = map_nodes(spec, fill)
    if left:
        raise ArgumentError(f"{len(left)} more arguments than the query takes")
    return out, bodies


def _fill_one(n: Node, value: Any) -> Node:
    shape = {PREFIX: "{}%", SUFFIX: "%{}", CONTAINS: "%{}%"}.get(n.value)
    if shape:
        if not isinstance(value, str):
            raise ArgumentError("a pattern argument is text")
        return Expr("literal", value=_argument(n, shape.format(value)))
    if n.value in (SLICE, NOT_SLICE):
        raise ArgumentError("a list argument belongs to IN")
    return Expr("literal", value=_argument(n, value))


def params(spec: QuerySpec) -> int:
    """How many arguments the query takes."""
    n = 0

    def count(x: Node) -> Node:
        nonlocal n
        n += x.kind == "param"
        if x.kind == "subquery":
            map_nodes(x.value.spec, count)
        return x.rebuilt(count)

    for t in ctes(spec).values():
        map_nodes(t.body, count)
    map_nodes(spec, count)
    return n
