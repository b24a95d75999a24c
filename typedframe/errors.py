"""Errors of the library."""


class BuildError(ValueError):
    """A query or table that can't be built."""


class ArgumentError(ValueError):
    """Deferred arguments that don't fit the query."""


class UnknownSortField(ValueError):
    pass


class AmbiguousSortField(ValueError):
    pass


class OrderCountMismatch(ValueError):
    pass


class NoRowsError(LookupError):
    """A row was asked for and there is none."""


class UnsupportedCapability(NotImplementedError):
    """Spark has no such feature, for instance row locks."""


class OptimisticLockConflict(RuntimeError):
    """A row's version isn't the expected one."""


class DuplicateKeyError(RuntimeError):
    pass


class NullViolation(RuntimeError):
    """A null in a column that is declared without."""


class SchemaMismatch(RuntimeError):
    pass


class TableMissing(SchemaMismatch):
    pass
