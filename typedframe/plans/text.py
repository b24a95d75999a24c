"""Spark SQL text of expressions and queries, for templates and for display."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Mapping

from ..errors import BuildError
from ..functions.expr import Node
from .spec import CROSS, QuerySpec, ctes

_OPS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "like": "LIKE", "nlike": "NOT LIKE"}


def escape_keyword(keyword: str) -> str:
    return keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def literal(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, decimal.Decimal):
        return f"{v}BD"
    if isinstance(v, bytes):
        return f"X'{v.hex()}'"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP{'_NTZ' if v.tzinfo is None else ''}'{v.isoformat(' ')}'"
    if isinstance(v, datetime.date):
        return f"DATE'{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise BuildError(f"no literal for {type(v).__name__}")


def sql_text(n: Node, hidden: Mapping[tuple, str] | None = None, subqueries: bool = False) -> str:
    if hidden and (name := hidden.get(n.key())):
        return f"`{name}`"
    go = lambda x: sql_text(x, hidden, subqueries)
    k, a = n.kind, n.args
    if k == "column":
        return f"`{n.table.label}`.`{n.name}`"
    if k == "literal":
        return literal(n.value)
    if k == "param":
        return "?"
    if k == "named":
        return go(a[0])
    if k == "distinct":
        return f"DISTINCT {go(a[0])}"
    if k == "aggregate":
        return f"{n.value.upper()}({go(a[0])})"
    if k == "function":
        if n.value == "now":
            return "CURRENT_TIMESTAMP()"
        if n.value in ("year", "month", "day"):
            return f"SUBSTRING(CAST(DATE({go(a[0])}) AS STRING), {dict(year='1, 4', month='6, 2', day='9, 2')[n.value]})"
        return f"{n.value.upper()}({', '.join(map(go, a))})"
    if k == "case":
        pairs = a[:-1] if n.value else a
        whens = " ".join(f"WHEN {go(c)} THEN {go(r)}" for c, r in zip(pairs[::2], pairs[1::2]))
        return f"CASE {whens}{f' ELSE {go(a[-1])}' if n.value else ''} END"
    if k == "template":
        return f"({n.value % tuple(map(go, a))})"
    if k in _OPS:
        return f"{go(a[0])} {_OPS[k]} {go(a[1])}"
    if k in ("between", "nbetween"):
        return f"{go(a[0])} {'NOT ' * (k == 'nbetween')}BETWEEN {go(a[1])} AND {go(a[2])}"
    if k in ("in", "nin"):
        if len(a) == 2:
            return f"{go(a[0])} {'NOT ' * (k == 'nin')}IN (?)"
        if not n.value:
            return "1 = 1" if k == "nin" else "1 = 0"
        return f"{go(a[0])} {'NOT ' * (k == 'nin')}IN ({', '.join(map(literal, n.value))})"
    if k in ("is_null", "is_not_null"):
        return f"{go(a[0])} IS {'NOT ' * (k == 'is_not_null')}NULL"
    if k in ("and", "or"):
        return f"({f' {k.upper()} '.join(map(go, a))})" if a else ("1 = 1" if k == "and" else "1 = 0")
    if k in ("subquery", "in_subquery", "nin_subquery", "exists", "nexists"):
        if not subqueries:
            raise BuildError("a template takes no subquery")
        if k == "subquery":
            return f"({query_text(n.value.spec, with_ctes=False)})"
        return f"{'NOT ' * (k[0] == 'n')}EXISTS {go(a[0])}" if "exists" in k else f"{go(a[0])} {'NOT ' * (k[0] == 'n')}IN {go(a[1])}"
    raise BuildError(f"no text for {k}")


def query_text(spec: QuerySpec, *, count: bool = False, keyword: bool = False, with_ctes: bool = True) -> str:
    """The query as Spark SQL; deferred arguments are ``?``."""
    if count and spec.wrapped():
        body = f"SELECT COUNT(1) FROM ({query_text(spec, keyword=keyword, with_ctes=False)}) AS _cnt"
    else:
        go = lambda x: sql_text(x, None, True)

        def rel(t):
            base = t.alias_of or t
            name = f"`{base.name}`" if base.body is not None else ".".join(f"`{p}`" for p in t.physical.split("."))
            return name if t.label == base.name else f"{name} AS `{t.label}`"

        cols = "COUNT(1)" if count else ", ".join(f"{go(e)} AS `{e.name or f'c{i}'}`" for i, e in enumerate(spec.select))
        body = f"SELECT {cols} FROM {rel(spec.source)}"
        for j in spec.joins:
            body += f" {j.how.upper()} JOIN {rel(j.table)}" + ("" if j.how == CROSS else f" ON {' AND '.join(map(go, j.on))}")
        conds = [*map(go, spec.where)]
        if keyword and spec.search:
            conds.append("(" + " OR ".join(f"{go(c)} LIKE ?" for c in spec.search) + ")")
        body += f" WHERE {' AND '.join(conds)}" * bool(conds)
        body += f" GROUP BY {', '.join(map(go, spec.group))}" * bool(spec.group)
        body += f" HAVING {' AND '.join(map(go, spec.having))}" * bool(spec.having)
        for op, other in spec.setops:
            body = f"({body}) {op} ({query_text(other, with_ctes=False)})"
        body += "".join(f" {x}" for x in spec.lock)
    if with_ctes and (named := ctes(spec)):
        body = "WITH " + ", ".join(f"`{n}` AS ({query_text(t.body, with_ctes=False)})" for n, t in named.items()) + " " + body
    return body
