"""Immutable expressions and predicates. They hold no Spark objects; ``plans.compile`` turns them into columns."""

from __future__ import annotations

import datetime
import decimal
import enum
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import types as T

from ..errors import BuildError

if TYPE_CHECKING:
    from ..sources.schema import TableDef

#: Markers of deferred arguments.
VALUE, PREFIX, SUFFIX, CONTAINS, SLICE, NOT_SLICE = "value", "prefix", "suffix", "contains", "slice", "not_slice"
_SCALARS = (bool, int, float, str, bytes, bytearray, decimal.Decimal, datetime.date, datetime.datetime, enum.Enum)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def plain(value: Any) -> Any:
    """The value as Spark takes it; nulls and containers are no predicate values."""
    if value is None:
        raise BuildError("null is no value here: use is_null or is_not_null")
    if not isinstance(value, _SCALARS):
        raise BuildError(f"{type(value).__name__} is no predicate value")
    return value.value if isinstance(value, enum.Enum) else bytes(value) if isinstance(value, bytearray) else value


def fits(kind: T.DataType | None, value: Any) -> bool:
    """Whether a value may be compared with a column of that type without a cast."""
    if kind is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float, decimal.Decimal)):
        return isinstance(kind, _NUMERIC)
    if isinstance(value, str):
        return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
    if isinstance(value, bytes):
        return isinstance(kind, T.BinaryType)
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def check_template(text: str, operands: int) -> None:
    """Only %s and %% are allowed, with as many %s as operands."""
    verbs = re.findall(r"%.?", text)
    if bad := [v for v in verbs if v not in ("%s", "%%")]:
        raise BuildError(f"unsupported verb {bad[0]!r} in {text!r}")
    if verbs.count("%s") != operands:
        raise BuildError(f"{text!r} has {verbs.count('%s')} places for {operands} operands")


@dataclass(frozen=True, eq=False)
class Node:
    """``kind`` says how ``args`` and ``value`` are read."""

    kind: str
    args: tuple[Node, ...] = ()
    value: Any = None
    table: TableDef | None = None
    name: str = ""
    json: str = ""
    type: T.DataType | None = None

    def key(self) -> tuple:
        """Equal for expressions that mean the same, whatever they are called."""
        own = self.name if self.kind == "column" else ""
        value = id(self.value) if self.kind == "subquery" else (type(self.value).__name__, self.value) if not isinstance(self.value, list) else tuple(map(repr, self.value))
        return (self.kind, self.table.label if self.table else "", own, value, tuple(a.key() for a in self.args))

    def walk(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.walk()

    def tables(self) -> dict[str, TableDef]:
        """Tables that the expression refers to; those inside subqueries aren't its own."""
        return {n.table.label: n.table for n in self.walk() if n.table is not None}

    def has(self, *kinds: str) -> bool:
        return any(n.kind in kinds for n in self.walk())

    def rebuilt(self, fn: Callable[[Node], Node]) -> Node:
        """``fn`` applied to each operand, in order."""
        return replace(self, args=tuple(fn(a) for a in self.args)) if self.args else self


class Condition(Node):
    """A predicate; conditions combine by ``and_`` and ``or_``. There is no negation but the predicates' own."""


def _operand(x: Any) -> Node:
    if x is None:
        raise BuildError("the right side can't be null")
    if isinstance(x, Node) and not isinstance(x, Condition):
        return x
    if hasattr(x, "as_operand"):
        return x.as_operand()
    raise BuildError("the right side is a column or a subquery; use the _val form for constants")


class Expr(Node):
    """A typed scalar expression."""

    def _lit(self, value: Any) -> Expr:
        value = plain(value)
        if not fits(self.type, value):
            raise BuildError(f"{value!r} doesn't fit {self.name or self.kind} of type {self.type.simpleString()}")
        return Expr("literal", value=value)

    def _same(self, other: Node) -> Node:
        a, b = self.type, other.type
        if a is not None and b is not None and a != b and not (isinstance(a, _NUMERIC) and isinstance(b, _NUMERIC)):
            raise BuildError(f"{a.simpleString()} can't be compared with {b.simpleString()}")
        return other

    # Null tests, ranges, lists, subqueries
    def is_null(self) -> Condition:
        return Condition("is_null", (self,))

    def is_not_null(self) -> Condition:
        return Condition("is_not_null", (self,))

    def between(self, low: Any, high: Any) -> Condition:
        return Condition("between", (self, self._same(_operand(low)), self._same(_operand(high))))

    def nbetween(self, low: Any, high: Any) -> Condition:
        return Condition("nbetween", (self, self._same(_operand(low)), self._same(_operand(high))))

    def between_val(self, low: Any, high: Any) -> Condition:
        return Condition("between", (self, self._lit(low), self._lit(high)))

    def nbetween_val(self, low: Any, high: Any) -> Condition:
        return Condition("nbetween", (self, self._lit(low), self._lit(high)))

    def between_var(self) -> Condition:
        return Condition("between", (self, param(of=self), param(of=self)))

    def nbetween_var(self) -> Condition:
        return Condition("nbetween", (self, param(of=self), param(of=self)))

    def in_val(self, *values: Any) -> Condition:
        """No value: never true."""
        return Condition("in", (self,), [self._lit(v).value for v in values])

    def nin_val(self, *values: Any) -> Condition:
        """No value: always true, for nulls too."""
        return Condition("nin", (self,), [self._lit(v).value for v in values])

    def in_var(self) -> Condition:
        return Condition("in", (self, param(SLICE, self)))

    def nin_var(self) -> Condition:
        return Condition("nin", (self, param(NOT_SLICE, self)))

    def in_(self, subquery: Any) -> Condition:
        return Condition("in_subquery", (self, self._same(subquery.as_operand())))

    def nin(self, subquery: Any) -> Condition:
        """No row if the subquery has a null."""
        return Condition("nin_subquery", (self, self._same(subquery.as_operand())))

    def unique(self, *_: Any) -> Condition:
        return Condition("error", value="UNIQUE predicates aren't supported")

    nunique = unique

    # Templates
    def expr(self, text: str) -> Expr:
        check_template(text, 1)
        return replace(self._from("template", (self,), text), type=None)

    def exprf(self, text: str, *operands: Node) -> Expr:
        check_template(text, 1 + len(operands))
        return replace(self._from("template", (self, *map(_operand, operands)), text), type=None)

    def pred(self, text: str, *operands: Node) -> Condition:
        """Each %s stands for the next operand, this expression first."""
        check_template(text, 1 + len(operands))
        return Condition("template", (self, *map(_operand, operands)), text)

    # Shape
    def _from(self, kind: str, args: tuple[Node, ...], value: Any = None, type: T.DataType | None = None) -> Expr:
        return Expr(kind, args, value, None, self.name, self.json, type if type is not None else self.type)

    def as_(self, alias: str) -> Expr:
        """The column of the table under another name."""
        if self.kind != "column":
            raise BuildError("only a plain column can be rebound")
        return self.table.alias(alias).c(self.name)

    def with_table(self, table: TableDef) -> Expr:
        if self.kind != "column":
            raise BuildError("only a plain column can be rebound")
        return table.c(self.name)

    def map_into(self, name: str, json: str | None = None) -> Expr:
        """The expression as a field of a result."""
        if not name:
            raise BuildError("a result field needs a name")
        return replace(self, name=name, json=name if json is None else json) if self.kind != "column" else Expr("named", (self,), None, None, name, name if json is None else json, self.type)

    def distinct(self) -> Expr:
        """As the first selected column it makes rows distinct; inside an aggregate it counts each value once."""
        return self._from("distinct", (self,))

    def asc(self) -> OrderBy:
        return OrderBy(self, "ASC")

    def desc(self) -> OrderBy:
        return OrderBy(self, "DESC")

    # Aggregates
    def count(self) -> Expr:
        return self._from("aggregate", (self,), "count", T.LongType())

    def sum(self) -> Expr:
        return replace(self._from("aggregate", (self,), "sum"), type=None)

    def avg(self) -> Expr:
        return self._from("aggregate", (self,), "avg", T.DoubleType())

    def max(self) -> Expr:
        return self._from("aggregate", (self,), "max")

    def min(self) -> Expr:
        return self._from("aggregate", (self,), "min")

    # Scalar functions
    def _fn(self, name: str, *args: Any, type: T.DataType | None = None) -> Expr:
        return self._from("function", (self, *(Expr("literal", value=a) if not isinstance(a, Node) else a for a in args)), name, type)

    def upper(self) -> Expr:
        return self._fn("upper")

    def lower(self) -> Expr:
        return self._fn("lower")

    def substring(self, start: int, length: int) -> Expr:
        if start == 0:
            raise BuildError("substring begins at 1; 0 means different things to different engines")
        return self._fn("substring", start, length, type=T.StringType())

    def length(self) -> Expr:
        return self._fn("length", type=T.IntegerType())

    def trim(self) -> Expr:
        return self._fn("trim")

    def concat(self, *_: Any) -> Expr:
        return self._from("error", (), "CONCAT isn't portable and is rejected; use exprf")

    def now(self) -> Expr:
        return Expr("function", (), "now", None, self.name, self.json, T.TimestampType())

    def date(self) -> Expr:
        return self._fn("date", type=T.DateType())

    def year(self) -> Expr:
        """Four digits, as text."""
        return self._fn("year", type=T.StringType())

    def month(self) -> Expr:
        """Two digits, as text."""
        return self._fn("month", type=T.StringType())

    def day(self) -> Expr:
        """Two digits, as text."""
        return self._fn("day", type=T.StringType())

    def round(self, places: int = 0) -> Expr:
        return self._fn("round", places) if places >= 0 else self._from("error", (), "round takes no negative precision")

    def ceil(self) -> Expr:
        return self._fn("ceil", type=T.DoubleType())

    def floor(self) -> Expr:
        return self._fn("floor", type=T.DoubleType())

    def abs(self) -> Expr:
        return self._fn("abs")

    def coalesce(self, value: Any) -> Expr:
        return self._fn("coalesce", value if isinstance(value, Node) else self._lit(value))

    def nullif(self, value: Any) -> Expr:
        return self._fn("nullif", value if isinstance(value, Node) else self._lit(value))


def _comparison(op: str) -> tuple[Callable, Callable, Callable]:
    def rhs(self: Expr, other: Any) -> Condition:
        return Condition(op, (self, self._same(_operand(other))))

    def val(self: Expr, value: Any) -> Condition:
        return Condition(op, (self, self._lit(value)))

    def var(self: Expr) -> Condition:
        return Condition(op, (self, param(of=self)))

    return rhs, val, var


for _op in ("eq", "ne", "gt", "gte", "lt", "lte", "like", "nlike"):
    for _suffix, _method in zip(("", "_val", "_var"), _comparison(_op)):
        _method.__name__ = _op + _suffix
        setattr(Expr, _op + _suffix, _method)

#: Wildcards inside the text stay live.
_SHAPES = {"starts_with": ("{}%", PREFIX), "ends_with": ("%{}", SUFFIX), "contains": ("%{}%", CONTAINS)}
for _name, (_shape, _marker) in _SHAPES.items():
    for _neg, _like in (("", "like"), ("n", "nlike")):

        def _val(self: Expr, text: str, _like: str = _like, _shape: str = _shape) -> Condition:
            if not isinstance(text, str):
                raise BuildError("a pattern is text")
            return Condition(_like, (self, self._lit(_shape.format(text))))

        def _var(self: Expr, _like: str = _like, _marker: str = _marker) -> Condition:
            return Condition(_like, (self, param(_marker, self)))

        setattr(Expr, f"{_neg}{_name}_val", _val)
        setattr(Expr, f"{_neg}{_name}_var", _var)


def param(marker: str = VALUE, of: Expr | None = None) -> Expr:
    """A deferred argument; its value has to fit the type of the expression that it is compared with."""
    return Expr("param", value=marker, name=(of.name or of.kind) if of is not None else "", type=of.type if of is not None else None)


def bind(value: Any) -> Expr:
    """A literal operand."""
    return Expr("literal", value=plain(value))


def bind_slice(values: Iterable[Any]) -> list[Expr]:
    return [bind(v) for v in values]


def now(name: str = "now") -> Expr:
    return Expr("function", (), "now", None, name, name, T.TimestampType())


def and_(*conds: Condition) -> Condition:
    """No condition: true."""
    return Condition("and", conds)


def or_(*conds: Condition) -> Condition:
    """No condition: false."""
    return Condition("or", conds)


def exists_sub(query: Any) -> Condition:
    return Condition("exists", (query.as_operand(any_shape=True),))


def nexists_sub(query: Any) -> Condition:
    return Condition("nexists", (query.as_operand(any_shape=True),))


class Case:
    """``case().when(cond, result)...else_(result).end()``; without an else, null."""

    def __init__(self, branches: tuple = (), default: Node | None = None):
        self._branches, self._default = branches, default

    def when(self, cond: Condition, result: Any) -> Case:
        if self._default is not None:
            raise BuildError("WHEN comes before ELSE")
        return Case((*self._branches, (cond, result if isinstance(result, Node) else bind(result))))

    def else_(self, result: Any) -> Case:
        if self._default is not None:
            raise BuildError("a CASE has one ELSE")
        return Case(self._branches, result if isinstance(result, Node) else bind(result))

    def end(self) -> Expr:
        if not self._branches:
            raise BuildError("a CASE needs a WHEN")
        flat = [x for pair in self._branches for x in pair] + ([self._default] if self._default is not None else [])
        out = Expr("case", tuple(flat), self._default is not None, None, "case", "case")
        if not out.tables():
            raise BuildError("a CASE refers to a table")
        return out


def case() -> Case:
    return Case()


@dataclass(frozen=True, eq=False)
class OrderBy:
    expr: Expr
    order: str

    def reverse(self) -> OrderBy:
        return replace(self, order="DESC" if self.order == "ASC" else "ASC")


def reverse_order(order: OrderBy) -> OrderBy:
    return order.reverse()
