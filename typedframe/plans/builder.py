"""The staged builder. A stage has only the methods that may come next; each call gives a new stage and leaves the old one as it was."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from ..errors import BuildError
from ..functions.expr import Condition, Expr
from ..sources.schema import ResultDef, TableDef, column
from .query import Query, Subquery, build
from .spec import CROSS, FULL, INNER, LEFT, RIGHT, Join, QuerySpec, check


class Stage:
    def __init__(self, spec: QuerySpec):
        self.spec = spec

    def _to(self, kind: type, **changes: Any) -> Any:
        return kind(replace(self.spec, **changes))


class Buildable(Stage):
    """Verbs of the built query may be called on the stage itself."""

    def build(self) -> Query:
        return build(self.spec)

    must_build = build

    def as_operand(self, any_shape: bool = False) -> Expr:
        return self.build().as_operand(any_shape)


for _verb in ("to_df", "page_df", "list", "get", "get_or_err", "load", "count", "exists", "page", "scalar"):

    def _call(self: Buildable, *args: Any, _verb: str = _verb) -> Any:
        return getattr(self.build(), _verb)(*args)

    _call.__name__ = _verb
    setattr(Buildable, _verb, _call)


class Lockable(Buildable):
    def for_update(self) -> LockedStage:
        return self._to(LockedStage, lock=("FOR UPDATE",))

    def for_share(self) -> LockedStage:
        return self._to(LockedStage, lock=("FOR SHARE",))


class LockedStage(Buildable):
    """Builds, but Spark has no row locks: running it raises ``UnsupportedCapability``."""

    def _wait(self, how: str) -> LockedStage:
        if len(self.spec.lock) > 1:
            raise BuildError("NOWAIT and SKIP LOCKED exclude each other")
        return self._to(LockedStage, lock=(*self.spec.lock, how))

    def no_wait(self) -> LockedStage:
        return self._wait("NOWAIT")

    def skip_locked(self) -> LockedStage:
        return self._wait("SKIP LOCKED")


class Combinable(Lockable):
    def _set(self, op: str, other: Buildable | Query) -> CompoundStage:
        check(other.spec)
        return self._to(CompoundStage, setops=(*self.spec.setops, (op, other.spec)))

    def union(self, other: Buildable | Query) -> CompoundStage:
        return self._set("UNION", other)

    def union_all(self, other: Buildable | Query) -> CompoundStage:
        return self._set("UNION ALL", other)

    def intersect(self, other: Buildable | Query) -> CompoundStage:
        return self._set("INTERSECT", other)

    def intersect_all(self, other: Buildable | Query) -> CompoundStage:
        return self._set("INTERSECT ALL", other)

    def except_(self, other: Buildable | Query) -> CompoundStage:
        return self._set("EXCEPT", other)

    def except_all(self, other: Buildable | Query) -> CompoundStage:
        return self._set("EXCEPT ALL", other)


class CompoundStage(Combinable):
    """Set operations apply from left to right."""


class HavingStage(Combinable):
    pass


class GroupedStage(Combinable):
    def having(self, *conds: Condition) -> HavingStage:
        return self._to(HavingStage, having=conds)


class Groupable(Combinable):
    def group_by(self, *cols: Expr) -> GroupedStage:
        if not cols:
            raise BuildError("GROUP BY names at least one column")
        return self._to(GroupedStage, group=cols)


class FilteredStage(Groupable):
    pass


class WhereStage(Groupable):
    def search(self, *cols: Expr) -> FilteredStage:
        return self._to(FilteredStage, search=_searchable(cols))


class SearchStage(Groupable):
    def where(self, *conds: Condition) -> FilteredStage:
        return self._to(FilteredStage, where=_conditions(conds))


class QueryStage(Groupable):
    def _join(self, how: str, table: TableDef, conds: tuple[Condition, ...]) -> QueryStage:
        return self._to(QueryStage, joins=(*self.spec.joins, Join(how, table, _conditions(conds))))

    def inner_join(self, table: TableDef, *conds: Condition) -> QueryStage:
        return self._join(INNER, table, conds)

    join = inner_join

    def left_join(self, table: TableDef, *conds: Condition) -> QueryStage:
        return self._join(LEFT, table, conds)

    def right_join(self, table: TableDef, *conds: Condition) -> QueryStage:
        return self._join(RIGHT, table, conds)

    def full_join(self, table: TableDef, *conds: Condition) -> QueryStage:
        return self._join(FULL, table, conds)

    def cross_join(self, table: TableDef) -> QueryStage:
        return self._join(CROSS, table, ())

    def where(self, *conds: Condition) -> WhereStage:
        return self._to(WhereStage, where=_conditions(conds))

    def search(self, *cols: Expr) -> SearchStage:
        return self._to(SearchStage, search=_searchable(cols))


class SelectStage(Stage):
    def from_(self, table: TableDef) -> QueryStage:
        return self._to(QueryStage, source=table)


class FromStage(Stage):
    def select(self, *cols: Expr | ResultDef) -> QueryStage:
        return self._to(QueryStage, select=_columns(cols))


def _conditions(conds: tuple) -> tuple[Condition, ...]:
    if bad := [c for c in conds if not isinstance(c, Condition)]:
        raise BuildError(f"{bad[0]!r} is no condition")
    return conds


def _searchable(cols: tuple) -> tuple[Expr, ...]:
    if not cols:
        raise BuildError("Search names at least one column")
    return cols


def _columns(cols: tuple) -> tuple[Expr, ...]:
    out = tuple(e for c in cols for e in (c.cols() if isinstance(c, ResultDef) else [c]))
    if bad := [e for e in out if not isinstance(e, Expr)]:
        raise BuildError(f"{bad[0]!r} can't be selected")
    return out


def select(*cols: Expr | ResultDef) -> SelectStage:
    return SelectStage(QuerySpec(select=_columns(cols)))


def from_(table: TableDef) -> FromStage:
    return FromStage(QuerySpec(source=table))


def cte(name: str, stage: Buildable | Query) -> TableDef:
    """A named query to select from; its columns carry the output names of the body, aggregates included."""
    spec = stage.spec
    check(spec)
    if spec.search:
        raise BuildError("a CTE takes no keyword search")
    from pyspark.sql import types as T

    cols = tuple(column(e.name or f"c{i}", e.type or T.NullType(), json=e.json or None) for i, e in enumerate(spec.select))
    return TableDef(name, tuple(replace(c, type=None) if isinstance(c.type, T.NullType) else c for c in cols), body=spec)


def build_subquery(stage: Buildable | Query, col: Expr | None = None) -> Subquery:
    query = stage if isinstance(stage, Query) else stage.build()
    return query.as_subquery(col)
