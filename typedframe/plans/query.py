"""Built queries: DataFrames on demand, and the verbs that run them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildError, NoRowsError
from ..functions.expr import Expr
from .compile import compile_count, compile_query
from .paging import PageRequest, PageResponse
from .spec import QuerySpec, check, params
from .text import query_text

if TYPE_CHECKING:
    from ..sources.runtime import Runtime

_ZERO = ((T.BooleanType, False), ((T.StringType, T.CharType, T.VarcharType), ""), (T.BinaryType, b""), ((T.FloatType, T.DoubleType), 0.0), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType), 0))


@dataclass(frozen=True)
class Query:
    """Immutable and reusable; every verb takes the runtime and then the deferred arguments in textual order."""

    spec: QuerySpec
    into: type | None = None

    def with_spec(self, spec: QuerySpec) -> Query:
        return Query(spec, self.into)

    def mapped(self, into: type) -> Query:
        """Rows are given as ``into(**fields)``."""
        return Query(self.spec, into)

    # DataFrames
    def to_df(self, runtime: Runtime, *args: Any) -> DataFrame:
        return compile_query(self.spec, runtime, args)

    def page_df(self, runtime: Runtime, request: PageRequest, *args: Any) -> DataFrame:
        """The rows of one page: sort, offset and limit become one top-k."""
        r = request.normalized()
        keyword = r.keyword if self.spec.search else None
        df = compile_query(self.spec, runtime, args, keyword)
        keys = r.sort_keys([(e.name, e.json, e.name if self.spec.setops else e.key()) for e in self.spec.select])
        if keys:
            names = df.columns
            df = df.toDF(*[f"_o{i}" for i in range(len(names))])
            df = df.orderBy(*[F.col(f"_o{i}").asc_nulls_first() if o == "ASC" else F.col(f"_o{i}").desc_nulls_last() for i, o in keys])
            df = df.offset(r.offset()).limit(r.size).toDF(*names)
        else:
            df = df.offset(r.offset()).limit(r.size)
        return df

    # Verbs
    def _row(self, row: Row) -> Any:
        return self.into(**row.asDict()) if self.into else row

    def list(self, runtime: Runtime, *args: Any) -> list[Any]:
        return runtime.run("list", self, lambda: [self._row(r) for r in self.to_df(runtime, *args).collect()])

    def get(self, runtime: Runtime, *args: Any) -> Any | None:
        def first() -> Any | None:
            row = next(iter(self.to_df(runtime, *args).limit(1).collect()), None)
            return None if row is None else self._row(row)

        return runtime.run("get", self, first)

    def get_or_err(self, runtime: Runtime, *args: Any) -> Any:
        row = self.get(runtime, *args)
        if row is None:
            raise NoRowsError("no rows in the result")
        return row

    def load(self, runtime: Runtime, holder: Any, *args: Any) -> None:
        """Sets the first row's fields on ``holder``, a dict or an object."""
        row = Query(self.spec).get_or_err(runtime, *args).asDict()
        if isinstance(holder, dict):
            holder.update(row)
        else:
            for k, v in row.items():
                setattr(holder, k, v)

    def count(self, runtime: Runtime, *args: Any) -> int:
        return runtime.run("count", self, lambda: compile_count(self.spec, runtime, args).count())

    count64 = count

    def exists(self, runtime: Runtime, *args: Any) -> bool:
        return runtime.run("exists", self, lambda: not compile_count(self.spec, runtime, args).isEmpty())

    def scalar(self, runtime: Runtime, *args: Any) -> Any:
        """The only column of the first row; a null is its type's zero value."""
        if len(self.spec.select) != 1:
            raise BuildError("a scalar query selects one column")

        def one() -> Any:
            df = self.to_df(runtime, *args)
            row = next(iter(df.limit(1).collect()), None)
            if row is None:
                raise NoRowsError("no rows in the result")
            return row[0] if row[0] is not None else next((z for kinds, z in _ZERO if isinstance(df.schema[0].dataType, kinds)), None)

        return runtime.run("scalar", self, one)

    def query_int(self, runtime: Runtime, *args: Any) -> int:
        return int(self.scalar(runtime, *args))

    def query_float(self, runtime: Runtime, *args: Any) -> float:
        return float(self.scalar(runtime, *args))

    def query_string(self, runtime: Runtime, *args: Any) -> str:
        return str(self.scalar(runtime, *args))

    def page(self, runtime: Runtime, request: PageRequest | None = None, *args: Any) -> PageResponse:
        """Two actions: the count and the page's rows."""
        r = (request or PageRequest()).normalized()

        def both() -> PageResponse:
            rows = self.page_df(runtime, r, *args)
            total = compile_count(self.spec, runtime, args, r.keyword if self.spec.search else None).count()
            return r.response(total, [self._row(x) for x in rows.collect()])

        return runtime.run("page", self, both)

    # Text and shape
    def list_sql(self) -> str:
        return query_text(self.spec)

    def count_sql(self) -> str:
        return query_text(self.spec, count=True)

    def keyword_list_sql(self) -> str:
        return query_text(self.spec, keyword=True)

    def keyword_count_sql(self) -> str:
        return query_text(self.spec, count=True, keyword=True)

    def param_count(self) -> int:
        return params(self.spec)

    def as_subquery(self, column: Expr | None = None) -> Subquery:
        if len(self.spec.select) != 1:
            raise BuildError("a subquery for comparisons selects one column")
        own = self.spec.select[0]
        if column is not None and (own.key() != column.key() or own.name != column.name):
            raise BuildError("the subquery doesn't select that column")
        return Subquery(self)

    def as_operand(self, any_shape: bool = False) -> Expr:
        return Subquery(self).as_operand(any_shape)


@dataclass(frozen=True)
class Subquery:
    """A query inside another. It can't refer to the outer query's tables."""

    query: Query

    def as_operand(self, any_shape: bool = False) -> Expr:
        spec = self.query.spec
        if not any_shape and len(spec.select) != 1:
            raise BuildError("a subquery for comparisons selects one column")
        if spec.search:
            raise BuildError("a subquery takes no keyword search")
        return Expr("subquery", (), self.query, None, spec.select[0].name, "", spec.select[0].type)


def build(spec: QuerySpec) -> Query:
    check(spec)
    return Query(spec)


def as_subquery(query: Query, column: Expr) -> Subquery:
    return query.as_subquery(column)
