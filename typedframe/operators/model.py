"""Lookups derived from a table's keys: by primary key, unique index, index prefix, with and without soft-deleted rows."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import types as T

from ..errors import BuildError, NoRowsError
from ..functions.expr import Condition
from ..plans.builder import select
from ..plans.query import Query
from ..sources.runtime import Runtime
from ..sources.schema import Index, TableDef
from . import mutation


class Model:
    """All lookups of one table, each a reusable query."""

    def __init__(self, table: TableDef):
        self.table = table

    def _query(self, conds: list[Condition], search: bool = False) -> Query:
        stage = select(*self.table.cols()).from_(self.table)
        stage = stage.where(*conds) if conds else stage
        return (stage.search(*self.table.search_columns()) if search and self.table.search else stage).build()

    def active_condition(self) -> Condition:
        """Integers: zero; times: null."""
        if not self.table.deleted_at:
            raise BuildError(f"{self.table.name} has no deleted_at")
        c = self.table.c(self.table.deleted_at)
        return c.eq_val(0) if isinstance(c.type, (T.LongType, T.DecimalType)) else c.is_null()

    def is_active(self, row: Any) -> bool:
        value = row[self.table.deleted_at] if self.table.deleted_at else None
        return value in (0, None)

    def _active(self, active: bool) -> list[Condition]:
        return [self.active_condition()] if active else []

    # Primary key
    def _pk(self):
        if not self.table.pk:
            raise BuildError(f"{self.table.name} has no primary key")
        return self.table.c(self.table.pk)

    def by_pk(self, active: bool = False) -> Query:
        return self._query([*self._active(active), self._pk().eq_var()])

    def by_pk_in(self, active: bool = False) -> Query:
        return self._query([*self._active(active), self._pk().in_var()])

    def list_by_pk_in(self, rt: Runtime, pks: Iterable[Any], active: bool = False) -> list[Any]:
        """In the order of the keys; a missing one is an error. The keys bound what is fetched."""
        pks = list(pks)
        found = {r[self.table.pk]: r for r in self.by_pk_in(active).list(rt, pks)}
        if missing := [k for k in pks if k not in found]:
            raise NoRowsError(f"records not found: {missing}")
        return [found[k] for k in pks]

    # Unique indexes
    def _index(self, fields: tuple[str, ...], among: tuple[Index, ...]) -> None:
        if fields not in [i.fields for i in among]:
            raise BuildError(f"{self.table.name} has no such index: {fields}")

    def by_unique(self, *fields: str, active: bool = False) -> Query:
        self._index(fields, self.table.unique)
        return self._query([*self._active(active), *(self.table.c(f).eq_var() for f in fields)], search=True)

    def list_by_unique_in(self, rt: Runtime, fields: tuple[str, ...], *args: Any, active: bool = False) -> list[Any]:
        """Values of all fields but the last, then the list of the last's, whose order the rows take."""
        self._index(fields, self.table.unique)
        *fixed, last = fields
        query = self._query([*self._active(active), *(self.table.c(f).eq_var() for f in fixed), self.table.c(last).in_var()])
        wanted = list(args[-1])
        found = {r[last]: r for r in query.list(rt, *args[:-1], wanted)}
        if missing := [k for k in wanted if k not in found]:
            raise NoRowsError(f"records not found: {missing}")
        return [found[k] for k in wanted]

    # Index prefixes
    def prefixes(self) -> list[tuple[str, ...]]:
        """Each prefix of each index that isn't a unique key itself, once."""
        whole = {i.fields for i in self.table.unique}
        out = [i.fields[:n] for i in (*self.table.unique, *self.table.indexes) for n in range(1, len(i.fields) + 1)]
        return list(dict.fromkeys(p for p in out if p not in whole and p != (self.table.pk,)))

    def by_index(self, *fields: str, active: bool = False) -> Query:
        if fields not in self.prefixes():
            raise BuildError(f"{fields} begins no index of {self.table.name}")
        return self._query([*self._active(active), *(self.table.c(f).eq_var() for f in fields)], search=True)

    def by_index_in(self, *fields: str, active: bool = False) -> Query:
        """The last field takes a list."""
        if fields not in self.prefixes():
            raise BuildError(f"{fields} begins no index of {self.table.name}")
        return self._query([*self._active(active), *(self.table.c(f).eq_var() for f in fields[:-1]), self.table.c(fields[-1]).in_var()], search=True)

    # All rows
    def all(self, active: bool = False) -> Query:
        """Without ``active`` soft-deleted rows are there, too."""
        return self._query(self._active(active), search=True)

    # One row at a time
    def insert(self, rt: Runtime, row: dict[str, Any]) -> int:
        return mutation.insert(rt, self.table, row)

    def update(self, rt: Runtime, row: dict[str, Any]) -> int:
        return mutation.update(rt, self.table, row)

    def delete(self, rt: Runtime, row: dict[str, Any]) -> int:
        return mutation.delete(rt, self.table, row)

    def soft_delete(self, rt: Runtime, row: dict[str, Any], when: Any = None) -> int:
        return mutation.soft_delete(rt, self.table, row, when)
