"""Tables and results, declared once and checked at declaration."""

from __future__ import annotations

import dataclasses
import difflib
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import BuildError
from ..functions.expr import Expr

#: Declared kinds of a column. Fixed values.
KINDS = {
    "bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint",
    "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "string": "string", "bytes": "binary", "time": "timestamp_ntz",
}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampNTZType, T.TimestampType)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise BuildError(f"{name!r} is no identifier")
    return name


#: Spark's names of simple types, which need no session to read.
_SIMPLE = {
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def data_type(kind: str | T.DataType) -> T.DataType:
    """A declared kind, a simple Spark type, decimal(p,s), or any other type of Spark's DDL, for which a session must run."""
    if isinstance(kind, T.DataType):
        return kind
    kind = KINDS.get(kind, kind)
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    try:
        return T.StructType.fromDDL(f"x {kind}").fields[0].dataType
    except Exception as e:
        raise BuildError(f"unknown type {kind!r}") from e


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: T.DataType
    json: str = ""
    nullable: bool = True
    unsigned: bool = False
    size: int | None = None

    def __post_init__(self) -> None:
        identifier(self.name)


def column(name: str, kind: str | T.DataType, *, json: str | None = None, nullable: bool = True, size: int | None = None) -> ColumnDef:
    return ColumnDef(name, data_type(kind), name if json is None else json, nullable, isinstance(kind, str) and kind.startswith("uint"), size)


@dataclass(frozen=True)
class Index:
    fields: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class TableDef:
    """A table, or with ``alias_of`` or ``body`` a table under another name or a common table expression.

    Indexes are kept as metadata: unique ones are checked by inserts and name lookups; where rows are soft-deleted, index columns begin with ``deleted_at``.
    Without columns, membership isn't checked.
    """

    name: str
    columns: tuple[ColumnDef, ...] = ()
    pk: str | None = None
    auto_increment: bool = True
    version: str | None = None
    created_at: str | None = None
    updated_at: str | None = None
    deleted_at: str | None = None
    unique: tuple[Index, ...] = ()
    indexes: tuple[Index, ...] = ()
    search: tuple[str, ...] = ()
    schema_name: str = ""
    alias_of: TableDef | None = None
    body: Any = field(default=None, compare=False)

    def __post_init__(self) -> None:
        identifier(self.name)
        if self.schema_name:
            identifier(self.schema_name)
        names = [c.name for c in self.columns]
        if len({n.lower() for n in names}) < len(names):
            raise BuildError(f"{self.name} has a column twice")
        if not self.columns or self.alias_of or self.body:
            return
        for n in filter(None, (self.pk, self.version, self.created_at, self.updated_at, self.deleted_at, *self.search, *(f for i in (*self.unique, *self.indexes) for f in i.fields))):
            self._known(n)
        if self.version and not isinstance(self._def(self.version).type, _INTEGERS):
            raise BuildError("a version is an integer")
        for n in filter(None, (self.created_at, self.updated_at)):
            if not isinstance(self._def(n).type, _TIMES):
                raise BuildError(f"{n} is a time")
        if self.deleted_at:
            kind = self._def(self.deleted_at).type
            if not isinstance(kind, (T.LongType, T.DecimalType)) and not (isinstance(kind, _TIMES) and self._def(self.deleted_at).nullable):
                raise BuildError("deleted_at is a 64-bit integer or a nullable time")
            if self.unique and isinstance(kind, _TIMES):
                raise BuildError("with unique indexes, deleted_at is an integer")
        for n in self.search:
            if not isinstance(self._def(n).type, T.StringType):
                raise BuildError(f"search column {n} isn't text")
        seen: set[tuple[str, ...]] = set()
        for i in (*self.unique, *self.indexes):
            if not i.fields or len(set(i.fields)) < len(i.fields):
                raise BuildError(f"index of {self.name} without fields or with one twice")
            if i.fields in seen:
                raise BuildError(f"two indexes of {self.name} on {i.fields}")
            seen.add(i.fields)
        for kind_, group in (("ux", "unique"), ("idx", "indexes")):
            object.__setattr__(self, group, tuple(replace(i, name=i.name or "_".join([kind_, self.name, *i.fields])) for i in getattr(self, group)))

    def _def(self, name: str) -> ColumnDef:
        return next(c for c in self.columns if c.name == name)

    def _known(self, name: str) -> None:
        names = [c.name for c in self.columns]
        if name not in names:
            close = difflib.get_close_matches(name, names, 1)
            raise BuildError(f"{self.label} has no column {name!r}" + (f"; did you mean {close[0]!r}?" if close else ""))

    @property
    def label(self) -> str:
        """The name that expressions use."""
        return self.name

    @property
    def physical(self) -> str:
        base = self.alias_of or self
        return f"{base.schema_name}.{base.name}" if base.schema_name else base.name

    def c(self, name: str) -> Expr:
        if self.columns:
            self._known(name)
            d = self._def(name)
            return Expr("column", (), None, self, name, d.json or name, d.type)
        return Expr("column", (), None, self, identifier(name), name)

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.c(name)

    def cols(self) -> list[Expr]:
        return [self.c(c.name) for c in self.columns]

    def alias(self, name: str) -> TableDef:
        return replace(self, name=identifier(name), alias_of=self.alias_of or self)

    def search_columns(self) -> list[Expr]:
        return [self.c(n) for n in self.search]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    def index_fields(self, index: Index) -> tuple[str, ...]:
        return (self.deleted_at, *index.fields) if self.deleted_at and self.deleted_at not in index.fields else index.fields

    def to_ddl(self) -> str:
        body = ", ".join(f"{c.name} {c.type.simpleString()}" + ("" if c.nullable else " NOT NULL") for c in self.columns)
        return f"CREATE TABLE {self.physical} ({body})"


def alias_columns(table: TableDef, columns: list[Expr]) -> list[Expr]:
    return [c.with_table(table) for c in columns]


_KEYS = ("name", "pk", "auto_increment", "version", "created_at", "updated_at", "deleted_at", "unique", "indexes", "search", "schema_name")
_DEFAULTS = {"version": "version", "created_at": "created_at", "updated_at": "updated_at", "deleted_at": "deleted_at"}


def table(**options: Any):
    """Class decorator: a dataclass whose annotations are kinds or Spark types becomes a ``TableDef``; base classes' fields come first.

    ``True`` for version, created_at, updated_at or deleted_at means the field of that name. A kind that ends in ``?`` is nullable.
    """
    for k in options:
        if k not in _KEYS:
            close = difflib.get_close_matches(k, _KEYS, 1)
            raise BuildError(f"unknown option {k!r}" + (f"; did you mean {close[0]!r}?" if close else ""))

    def declare(cls: type) -> TableDef:
        notes: dict[str, Any] = {}
        for base in reversed(cls.__mro__):
            notes |= base.__dict__.get("__annotations__", {}) if not dataclasses.is_dataclass(base) else {f.name: f.type for f in dataclasses.fields(base)}
        cols = tuple(column(n, k.rstrip("?") if isinstance(k, str) else k, nullable=isinstance(k, str) and k.endswith("?")) for n, k in notes.items())
        o = {k: _DEFAULTS[k] if v is True and k in _DEFAULTS else None if v is False and k in _DEFAULTS else v for k, v in options.items()}
        o |= {g: tuple(i if isinstance(i, Index) else Index(tuple(i)) for i in o[g]) for g in ("unique", "indexes") if g in o}
        o["search"] = tuple(o.get("search", ()))
        return TableDef(o.pop("name", snake(cls.__name__)), cols, o.pop("pk", "id" if any(c.name == "id" for c in cols) else None), **o)

    return declare


@dataclass(frozen=True)
class ResultDef:
    """A projection-only shape: output fields, each an expression."""

    fields: tuple[tuple[str, Expr], ...]

    def cols(self) -> list[Expr]:
        return [e.map_into(n) for n, e in self.fields]


def result(**fields: Expr) -> ResultDef:
    return ResultDef(tuple(fields.items()))
