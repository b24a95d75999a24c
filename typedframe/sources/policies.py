"""Schema policies: how declared tables and the session's catalog are brought together."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildError, SchemaMismatch, TableMissing
from .runtime import Runtime
from .schema import TableDef

MANUAL, VALIDATE, CREATE_MISSING, RECONCILE, MANAGED = "manual", "validate", "create_missing", "reconcile", "managed"
REGISTRY = "typedframe_managed_tables"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Change:
    """``kind`` is add, drop or alter; types are simple strings."""

    kind: str
    column: str
    before: str = ""
    after: str = ""


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Text types of any length are one, as are the two timestamps without a zone's difference in storage."""
    text = (T.StringType, T.VarcharType, T.CharType)
    return a == b or isinstance(a, text) and isinstance(b, text)


def diff(current: T.StructType, wanted: T.StructType) -> list[Change]:
    now, then = {f.name: f for f in current}, {f.name: f for f in wanted}
    out = [Change("add", n, "", f.dataType.simpleString()) for n, f in then.items() if n not in now]
    out += [Change("drop", n, f.dataType.simpleString()) for n, f in now.items() if n not in then]
    return out + [Change("alter", n, now[n].dataType.simpleString(), f.dataType.simpleString()) for n, f in then.items() if n in now and not same_type(now[n].dataType, f.dataType)]


def create(spark: SparkSession, table: TableDef, name: str | None = None) -> None:
    spark.createDataFrame([], table.struct()).write.format("parquet").saveAsTable(name or table.physical)


def rebuild(spark: SparkSession, table: TableDef) -> None:
    """A new table of the wanted shape takes the shared columns, then the old one's place."""
    old = spark.table(table.physical)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in old.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in table.struct()]
    temp = f"{table.physical}_{uuid.uuid4().hex[:8]}"
    old.select(*cols).write.format("parquet").saveAsTable(temp)
    spark.sql(f"DROP TABLE {table.physical}")
    spark.sql(f"ALTER TABLE {temp} RENAME TO {table.physical}")


def managed_names(spark: SparkSession) -> list[str]:
    return sorted(r[0] for r in spark.table(REGISTRY).collect()) if spark.catalog.tableExists(REGISTRY) else []


def apply_policy(runtime: Runtime, policy: str) -> None:
    """manual: nothing. validate: a missing or different table is an error. create_missing: creates, but a difference is an error.
    reconcile: creates and rebuilds. managed: also drops tables that an earlier call managed and that are declared no more."""
    if policy not in (MANUAL, VALIDATE, CREATE_MISSING, RECONCILE, MANAGED):
        raise BuildError(f"unknown policy {policy!r}")
    if policy == MANUAL:
        return
    spark = runtime.spark
    for name, table in runtime.tables.items():
        if not table.columns:
            raise BuildError(f"{name} declares no columns")
        if not spark.catalog.tableExists(name):
            if policy == VALIDATE:
                raise TableMissing(name)
            create(spark, table)
            continue
        changes = diff(spark.table(name).schema, table.struct())
        if changes and policy in (VALIDATE, CREATE_MISSING):
            raise SchemaMismatch(f"{name}: " + ", ".join(f"{c.kind} {c.column}" for c in changes))
        if changes:
            for c in changes:
                if c.kind == "drop":
                    log.warning("column %s of %s and its data are dropped", c.column, name)
            rebuild(spark, table)
            runtime._frames.pop(name, None)
    before = managed_names(spark)
    if policy == MANAGED:
        for name in before:
            if name not in runtime.tables and spark.catalog.tableExists(name):
                spark.sql(f"DROP TABLE {name}")
    names = sorted(runtime.tables)
    if names != before:
        if before or spark.catalog.tableExists(REGISTRY):
            spark.sql(f"DROP TABLE {REGISTRY}")
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.format("parquet").saveAsTable(REGISTRY)


def check_unique(runtime: Runtime, table: TableDef) -> list[str]:
    """Names of unique indexes that the data breaks; Spark has no indexes, so they are checked on demand."""
    df = runtime.frame(table)
    return [i.name for i in table.unique if not df.dropna(subset=list(table.index_fields(i))).groupBy(*table.index_fields(i)).count().where("count > 1").isEmpty()]


INDEXES = "typedframe_indexes"


def registered_indexes(spark: SparkSession) -> set[tuple[str, str, str, bool]]:
    """(table, name, fields, unique) of all indexes that earlier calls registered."""
    return {tuple(r) for r in spark.table(INDEXES).collect()} if spark.catalog.tableExists(INDEXES) else set()


def apply_index_policy(runtime: Runtime, policy: str) -> list[str]:
    """The same policies for declared indexes, which Spark hasn't but the catalog can register: validate compares them with the register, create_missing adds to it, but a difference
    is an error, reconcile and managed replace what differs, managed drops those of tables declared no more. A unique index enters only if the data keeps it. Returns the names that were added."""
    if policy not in (MANUAL, VALIDATE, CREATE_MISSING, RECONCILE, MANAGED):
        raise BuildError(f"unknown policy {policy!r}")
    if policy == MANUAL:
        return []
    spark, now = runtime.spark, registered_indexes(runtime.spark)
    wanted = {(t.physical, i.name, ",".join(t.index_fields(i) if u else i.fields), u) for t in runtime.tables.values() for group, u in ((t.unique, True), (t.indexes, False)) for i in group}
    own = {r for r in now if r[0] in runtime.tables}
    missing, extra = wanted - own, own - wanted
    if missing and policy == VALIDATE or extra and policy in (VALIDATE, CREATE_MISSING):
        raise SchemaMismatch(", ".join(sorted([f"add {r[1]}" for r in missing] + [f"drop {r[1]}" for r in extra])))
    if broken := [n for name in sorted({r[0] for r in missing if r[3]}) for n in check_unique(runtime, runtime.tables[name])]:
        raise SchemaMismatch(f"not unique: {', '.join(broken)}")
    after = wanted | (set() if policy == MANAGED else now - own)
    if after != now:
        if spark.catalog.tableExists(INDEXES):
            spark.sql(f"DROP TABLE {INDEXES}")
        spark.createDataFrame(sorted(after), "table string, name string, fields string, uniq boolean").coalesce(1).write.format("parquet").saveAsTable(INDEXES)
    return sorted(r[1] for r in missing)
