"""A typed query layer over Spark DataFrames."""

from .errors import (
    AmbiguousSortField, ArgumentError, BuildError, DuplicateKeyError, NoRowsError, NullViolation, OptimisticLockConflict, OrderCountMismatch, SchemaMismatch, TableMissing, UnknownSortField,
    UnsupportedCapability,
)
from .functions.expr import and_, bind, bind_slice, case, exists_sub, nexists_sub, now, or_, reverse_order
from .operators.model import Model
from .operators.mutation import chunked_delete, chunked_delete_by_pks, chunked_insert, chunked_update, delete, insert, insert_frame, soft_delete, update, update_frame
from .plans.builder import build_subquery, cte, from_, select
from .plans.paging import PageRequest, PageResponse
from .plans.query import Query, as_subquery
from .sources.policies import apply_index_policy, apply_policy
from .sources.runtime import Runtime, wrap_session
from .sources.schema import Index, ResultDef, TableDef, alias_columns, column, result, table

__all__ = [n for n in dir() if n[0] != "_"]
