"""From the logical form to DataFrames. Catalyst does all planning; nothing runs here."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, UnsupportedCapability
from ..functions.expr import Node
from .spec import CROSS, QuerySpec, ctes, resolve
from .text import escape_keyword, sql_text

if TYPE_CHECKING:
    from ..sources.runtime import Runtime

_SETOPS = {"UNION": lambda a, b: a.union(b).distinct(), "UNION ALL": DataFrame.union, "INTERSECT": DataFrame.intersect, "INTERSECT ALL": DataFrame.intersectAll, "EXCEPT": DataFrame.subtract, "EXCEPT ALL": DataFrame.exceptAll}
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "like": F.like, "nlike": lambda a, b: ~F.like(a, b)}
_FUNCTIONS = {
    "upper": F.upper, "lower": F.lower, "length": F.length, "trim": F.trim, "abs": F.abs, "coalesce": F.coalesce, "nullif": F.nullif, "date": F.to_date,
    "now": F.current_timestamp, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"),
    "year": lambda c: F.substring(F.to_date(c).cast("string"), 1, 4), "month": lambda c: F.substring(F.to_date(c).cast("string"), 6, 2), "day": lambda c: F.substring(F.to_date(c).cast("string"), 9, 2),
}
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": lambda c: F.avg(c).cast("double"), "max": F.max, "min": F.min}
_DISTINCT = {"count": F.count_distinct, "sum": F.sum_distinct, "max": F.max, "min": F.min}


class Compiler:
    """Compiles one query; ``bodies`` are the CTEs with their arguments, each compiled once."""

    def __init__(self, runtime: Runtime, bodies: Mapping[str, QuerySpec]):
        self.runtime, self.bodies, self.frames = runtime, bodies, {}

    def relation(self, table) -> DataFrame:
        base = table.alias_of or table
        if base.body is None:
            frame = self.runtime.frame(base)
        else:
            if base.name not in self.frames:
                self.frames[base.name] = self.frame(self.bodies.get(base.name, base.body))
            frame = self.frames[base.name]
        return frame.alias(table.label)

    def column(self, n: Node, hidden: Mapping[tuple, str] | None = None) -> Column:
        """``hidden`` maps aggregates and group keys to columns that hold them already."""
        if hidden and (name := hidden.get(n.key())):
            return F.col(name)
        go = lambda x: self.column(x, hidden)
        k, a = n.kind, n.args
        if k == "column":
            return F.col(f"`{n.table.label}`.`{n.name}`")
        if k == "literal":
            return F.lit(n.value)
        if k in ("named", "distinct"):
            return go(a[0])
        if k == "function":
            if n.value in ("substring", "round"):
                return {"substring": F.substring, "round": F.round}[n.value](go(a[0]), *(x.value for x in a[1:]))
            return _FUNCTIONS[n.value](*map(go, a))
        if k == "aggregate":
            if a[0].kind != "distinct":
                return _AGGREGATES[n.value](go(a[0]))
            if n.value == "avg":
                return F.expr(f"avg({sql_text(a[0])})").cast("double")
            return _DISTINCT[n.value](go(a[0]))
        if k == "case":
            pairs = a[:-1] if n.value else a
            out = reduce(lambda c, p: c.when(go(p[0]), go(p[1])), zip(pairs[2::2], pairs[3::2]), F.when(go(pairs[0]), go(pairs[1])))
            return out.otherwise(go(a[-1])) if n.value else out
        if k == "template":
            return F.expr(sql_text(n, hidden))
        if k in _COMPARE:
            return _COMPARE[k](go(a[0]), go(a[1]))
        if k in ("between", "nbetween"):
            inside = go(a[0]).between(go(a[1]), go(a[2]))
            return inside if k == "between" else ~inside
        if k in ("in", "nin"):
            if n.name == "null":  # an empty list argument: unknown, so no row
                return F.lit(None).cast("boolean")
            if not n.value:
                return F.lit(k == "nin")
            inside = go(a[0]).isin(n.value)
            return inside if k == "in" else ~inside
        if k in ("is_null", "is_not_null"):
            return go(a[0]).isNull() if k == "is_null" else go(a[0]).isNotNull()
        if k in ("and", "or"):
            parts = [go(x) for x in a]
            return reduce((lambda x, y: x & y) if k == "and" else (lambda x, y: x | y), parts) if parts else F.lit(k == "and")
        if k == "subquery":
            return self.frame(n.value.spec).scalar()
        if k in ("in_subquery", "nin_subquery"):
            inside = go(a[0]).isin(self.frame(a[1].value.spec))
            return inside if k == "in_subquery" else ~inside
        if k in ("exists", "nexists"):
            there = self.frame(a[0].value.spec).exists()
            return there if k == "exists" else ~there
        if k == "param":
            raise BuildError("a deferred argument has no value here")
        raise BuildError(f"unknown expression {k}")

    def filtered(self, spec: QuerySpec, keyword: str | None = None) -> DataFrame:
        """FROM, joins, WHERE and, with a keyword, search."""
        df = self.relation(spec.source)
        for j in spec.joins:
            right = self.relation(j.table)
            df = df.crossJoin(right) if j.how == CROSS else df.join(right, reduce(lambda x, y: x & y, [self.column(c) for c in j.on]), j.how)
        for c in spec.where:
            df = df.where(self.column(c))
        if keyword and spec.search:
            pattern = F.lit(f"%{escape_keyword(keyword)}%")
            df = df.where(reduce(lambda x, y: x | y, [F.like(self.column(c), pattern) for c in spec.search]))
        return df

    def frame(self, spec: QuerySpec, keyword: str | None = None) -> DataFrame:
        """The result, with the output names of the first select."""
        if spec.lock:
            raise UnsupportedCapability("Spark has no row locks: FOR UPDATE and FOR SHARE can't be executed")
        df = self.filtered(spec, keyword)
        hidden: dict[tuple, str] = {}
        if spec.aggregated():
            keys = []
            for i, g in enumerate(spec.group):
                g = g.args[0] if g.kind == "named" else g
                keys.append(self.column(g).alias(f"_g{i}"))
                hidden.setdefault(g.key(), f"_g{i}")
            found: dict[tuple, Node] = {}
            for e in (*spec.select, *spec.having):
                _outer_aggregates(e, found)
            aggs = []
            for i, (key, n) in enumerate(found.items()):
                aggs.append(self.column(n).alias(f"_a{i}"))
                hidden[key] = f"_a{i}"
            aggs = aggs or [F.count(F.lit(1)).alias("_n")]
            df = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
            for c in spec.having:
                df = df.where(self.column(c, hidden))
        names = [e.name or f"c{i}" for i, e in enumerate(spec.select)]
        df = df.select(*[self.column(e, hidden).alias(n) for e, n in zip(spec.select, names)])
        if (spec.select[0].args[0] if spec.select[0].kind == "named" else spec.select[0]).kind == "distinct":
            df = df.distinct()
        for op, other in spec.setops:
            right = self.frame(other)
            for x, y in zip(df.schema, right.schema):
                if x.dataType != y.dataType:
                    raise BuildError(f"{op}: {x.name} is {x.dataType.simpleString()} on the left and {y.dataType.simpleString()} on the right")
            df = _SETOPS[op](df, right)
        return df


def _outer_aggregates(n: Node, found: dict[tuple, Node]) -> None:
    if n.kind == "aggregate":
        found.setdefault(n.key(), n)
        return
    for a in n.args:
        _outer_aggregates(a, found)


def compile_query(spec: QuerySpec, runtime: Runtime, args: tuple, keyword: str | None = None) -> DataFrame:
    spec, bodies = resolve(spec, args)
    return Compiler(runtime, bodies).frame(spec, keyword)


def compile_count(spec: QuerySpec, runtime: Runtime, args: tuple, keyword: str | None = None) -> DataFrame:
    """Rows to count: without the select list unless it changes how many there are."""
    spec, bodies = resolve(spec, args)
    c = Compiler(runtime, bodies)
    return c.frame(spec, keyword) if spec.wrapped() or spec.lock else c.filtered(spec, keyword)


__all__ = ["Compiler", "compile_count", "compile_query", "ctes"]
