"""Where tables live: names bound to DataFrames, tracers around every action, and transactions over table versions."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import BuildError, OptimisticLockConflict
from .schema import TableDef, identifier
from .store import checkpointed, staged

#: Fixed limits.
MAX_TRACERS, ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 100, 3, 0.005, 0.025
#: After so many versions a table's lineage is cut by a checkpoint in the shared folder.
CHECKPOINT_EVERY = 10

Tracer = Callable[[str, Any, Callable[[], Any]], Any]


def cost_tracer(report: Callable[[str, float], None]) -> Tracer:
    def trace(verb: str, query: Any, call: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        try:
            return call()
        finally:
            report(verb, time.perf_counter() - began)

    return trace


def error_tracer(report: Callable[[str, Exception], None]) -> Tracer:
    def trace(verb: str, query: Any, call: Callable[[], Any]) -> Any:
        try:
            return call()
        except Exception as e:
            report(verb, e)
            raise

    return trace


def sql_tracer(report: Callable[[str], None]) -> Tracer:
    def trace(verb: str, query: Any, call: Callable[[], Any]) -> Any:
        if hasattr(query, "list_sql"):
            report(query.count_sql() if verb == "count" else query.list_sql())
        return call()

    return trace


def is_optimistic_conflict(e: BaseException) -> bool:
    return isinstance(e, OptimisticLockConflict)


def is_network_error(e: BaseException) -> bool:
    return isinstance(e, (ConnectionError, TimeoutError)) or type(e).__name__ in ("Py4JNetworkError", "SparkConnectGrpcException")


def is_conflict(e: BaseException) -> bool:
    return type(e).__name__ == "ConcurrentModificationException" or "CONCURRENT" in str(e).upper()


def is_retryable(e: BaseException) -> bool:
    return is_optimistic_conflict(e) or is_network_error(e) or is_conflict(e)


class _Transaction:
    """What one thread reads and has written, until it commits."""

    def __init__(self) -> None:
        self.frames: dict[str, DataFrame] = {}
        self.seen: dict[str, int] = {}
        self.written: dict[str, tuple[TableDef, int]] = {}

    def saved(self) -> tuple[dict, dict]:
        return dict(self.frames), dict(self.written)


class Runtime:
    """Binds declared tables to data.

    ``source`` is a folder with ``<table>.parquet``, a mapping from names to DataFrames, or None for the session's catalog. ``jdbc`` holds options of ``spark.read.jdbc``
    (url, properties) for a database instead, ``jdbc_tables`` those of single tables, over the common ones: their own database, their name there (table), and how the read is split
    (column, lowerBound, upperBound, numPartitions, or predicates). A mutated table is a new DataFrame under its name; readers of the old one keep theirs.
    With ``durable``, commits are written to the folder, the database or the catalog, and read from there.
    """

    def __init__(
        self, spark: SparkSession, tables: Iterable[TableDef] = (), source: str | Mapping[str, DataFrame] | None = None, *, jdbc: Mapping[str, Any] | None = None,
        jdbc_tables: Mapping[str, Mapping[str, Any]] | None = None, tracers: Iterable[Tracer] = (), durable: bool = False,
    ):
        self.spark, self.source, self.jdbc, self.durable = spark, source, dict(jdbc or {}), durable
        self.jdbc_tables = {k: dict(v) for k, v in (jdbc_tables or {}).items()}
        if durable and isinstance(source, Mapping):
            raise BuildError("tables that are DataFrames can't be durable")
        self.tracers: list[Tracer] = []
        for t in tracers:
            self.add_tracer(t)
        self.tables: dict[str, TableDef] = {}
        for t in tables:
            self.register(t)
        self._frames: dict[str, DataFrame] = dict(source) if isinstance(source, Mapping) else {}
        self._versions: dict[str, int] = {}
        self._lock, self._local = threading.RLock(), threading.local()

    def register(self, table: TableDef) -> None:
        if table is None:
            raise BuildError("a null table")
        if table.alias_of or table.body:
            raise BuildError(f"{table.name} is no base table")
        identifier(table.name)
        if table.physical in self.tables:
            raise BuildError(f"{table.physical} is registered twice")
        names = [i.name for t in (*self.tables.values(), table) for i in (*t.unique, *t.indexes)]
        if len(set(names)) < len(names):
            raise BuildError(f"two indexes of one name in {table.name}")
        self.tables[table.physical] = table

    def add_tracer(self, tracer: Tracer) -> None:
        if len(self.tracers) >= MAX_TRACERS:
            raise BuildError(f"more than {MAX_TRACERS} tracers")
        self.tracers.append(tracer)

    def run(self, verb: str, query: Any, call: Callable[[], Any]) -> Any:
        """Through the tracers, the first outermost."""
        for tracer in reversed(self.tracers):
            call = (lambda t, c: lambda: t(verb, query, c))(tracer, call)
        return call()

    # Where tables come from
    def is_jdbc(self, table: TableDef) -> bool:
        return bool(self.jdbc) or table.physical in self.jdbc_tables

    def jdbc_options(self, table: TableDef) -> dict[str, Any]:
        return self.jdbc | self.jdbc_tables.get(table.physical, {})

    def read_jdbc(self, table: TableDef) -> DataFrame:
        return self.spark.read.jdbc(**({"table": table.physical} | self.jdbc_options(table)))

    def _load(self, table: TableDef) -> DataFrame:
        if table.physical in self.jdbc_tables:
            return self.read_jdbc(table)
        if isinstance(self.source, str):
            return self.spark.read.parquet(f"{self.source.rstrip('/')}/{table.name}.parquet")
        return self.read_jdbc(table) if self.jdbc else self.spark.table(table.physical)

    def frame(self, table: TableDef) -> DataFrame:
        """The table's version that this thread sees: inside a transaction what it has written, or else what it read first."""
        name, tx = table.physical, self._open()
        if tx and name in tx.frames:
            return tx.frames[name]
        with self._lock:
            if name not in self._frames:
                self._frames[name] = self._load(table)
            frame, version = self._frames[name], self._versions.get(name, 0)
        if tx:
            tx.frames[name] = frame
            tx.seen.setdefault(name, version)
        return frame

    # Versions
    def _open(self) -> _Transaction | None:
        return getattr(self._local, "tx", None)

    def publish(self, table: TableDef, df: DataFrame) -> None:
        """``df`` becomes the table's next version, for others when the transaction commits."""
        tx = self._open()
        if tx is None:
            with self.transaction():
                self.publish(table, df)
            return
        name = table.physical
        tx.seen.setdefault(name, self._versions.get(name, 0))
        n = tx.written.get(name, (table, 0))[1] + 1
        if (tx.seen[name] + n) % CHECKPOINT_EVERY == 0:
            df = checkpointed(df)
        tx.frames[name], tx.written[name] = df, (table, n)

    def _commit(self, tx: _Transaction) -> None:
        swaps = {name: staged(self, table, tx.frames[name]) for name, (table, _) in tx.written.items()} if self.durable else {}
        with self._lock:
            for name in tx.written:
                if self._versions.get(name, 0) != tx.seen[name]:
                    raise OptimisticLockConflict(f"{name} was changed by another transaction")
            for name, (_, n) in tx.written.items():
                self._frames[name] = swaps[name]() if name in swaps else tx.frames[name]
                self._versions[name] = self._versions.get(name, 0) + n

    @contextmanager
    def transaction(self):
        """Versions published inside are seen by this thread alone until the block ends, and discarded if it raises. A table that another transaction changed meanwhile is a conflict: ``OptimisticLockConflict``,
        nothing is committed. An inner block's failure undoes that block only, if the outer one catches it."""
        tx = self._open()
        if tx is not None:
            before = tx.saved()
            try:
                yield self
            except BaseException:
                tx.frames, tx.written = before
                raise
            return
        self._local.tx = tx = _Transaction()
        try:
            yield self
        finally:
            self._local.tx = None
        if tx.written:
            self._commit(tx)

    def atomic(self, fn: Callable[[], Any]) -> Any:
        """``fn`` in the open transaction, or in one of its own."""
        with self.transaction():
            return fn()

    def with_tx(self, fn: Callable[[Runtime], Any], retry: Callable[[BaseException], bool] | None = None, attempts: int = ATTEMPTS) -> Any:
        """``fn``'s result; what it raises rolls back, and is tried again while ``retry`` says so."""
        if attempts < 1:
            raise ValueError("at least one attempt")
        wait = FIRST_WAIT
        for k in range(attempts):
            try:
                with self.transaction():
                    return fn(self)
            except Exception as e:
                if retry is None or not retry(e) or k == attempts - 1:
                    raise
                time.sleep(wait * random.uniform(0.5, 1))
                wait = min(2 * wait, LONGEST_WAIT)
        raise AssertionError

    with_tx_result = with_tx


def wrap_session(spark: SparkSession, tables: Iterable[TableDef] = ()) -> Runtime:
    """A runtime over the session's own catalog."""
    return Runtime(spark, tables)
