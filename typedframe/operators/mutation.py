"""Copy-on-write inserts, updates and deletes with optimistic locking.

Rows are dicts (ids and versions are written back into them) or whole DataFrames. Each mutation is one join against the table, never a loop over rows.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildError, DuplicateKeyError, NullViolation, OptimisticLockConflict
from ..functions.expr import Expr
from ..sources.runtime import Runtime
from ..sources.schema import TableDef
from ..sources.store import checkpointed

CHUNK = 1000
#: Row lists up to this long are broadcast; DataFrames are joined as Catalyst sees fit.
MOST_BROADCAST = 10_000
Row = dict[str, Any]


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC).replace(tzinfo=None)


def _key(table: TableDef) -> str:
    if not table.pk:
        raise BuildError(f"{table.name} has no single primary key")
    return table.pk


def _frame(rt: Runtime, table: TableDef, rows: Sequence[Row], columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([f for f in (T.StructField(f.name, f.dataType, True) for f in table.struct()) if f.name in columns])
    df = rt.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df


def _layout(rows: Sequence[Row], table: TableDef) -> list[str]:
    first = set(rows[0])
    for r in rows:
        if set(r) != first:
            raise BuildError("all rows of a batch have the same fields")
    names = [c.name for c in table.columns]
    if unknown := first - set(names):
        raise BuildError(f"{table.name} has no column {sorted(unknown)[0]!r}")
    return [n for n in names if n in first]


def _need_keys(rows: Sequence[Row], pk: str) -> None:
    if any(not r.get(pk) for r in rows):
        raise BuildError(f"each row needs a non-zero {pk}")
    if len({r[pk] for r in rows}) < len(rows):
        raise BuildError(f"a {pk} twice in one batch")


def _keys_of(table: TableDef) -> list[tuple[str, ...]]:
    return ([(table.pk,)] if table.pk else []) + [table.index_fields(i) for i in table.unique]


def _duplicates(rt: Runtime, table: TableDef, new: DataFrame) -> DataFrame | None:
    """Rows of ``new`` that repeat a key of the table; null keys never do."""
    old, out = rt.frame(table), None
    for fields in _keys_of(table):
        if not set(fields) <= set(new.columns):
            continue  # a missing field is null
        hit = new.join(old.select(*fields).distinct(), list(fields), "left_semi").select(*new.columns)
        out = hit if out is None else out.union(hit)
    return out


def _mark_active(table: TableDef, rows: Sequence[Row]) -> None:
    if table.deleted_at and isinstance(table.struct()[table.deleted_at].dataType, (T.LongType, T.DecimalType)):
        for r in rows:
            r.setdefault(table.deleted_at, 0)


def _known(table: TableDef, columns: Iterable[str]) -> None:
    if unknown := set(columns) - {c.name for c in table.columns}:
        raise BuildError(f"{table.name} has no column {sorted(unknown)[0]!r}")


def _no_repeats(table: TableDef, new: DataFrame, keys: Iterable[tuple[str, ...]]) -> None:
    """Keys are distinct within ``new``; null ones never repeat."""
    for fields in keys:
        if set(fields) <= set(new.columns) and not new.dropna(subset=list(fields)).groupBy(*fields).count().where("count > 1").isEmpty():
            raise DuplicateKeyError(f"{table.name}: {fields} twice in one batch")


def _no_nulls(table: TableDef, new: DataFrame, whole: bool) -> None:
    """No null in a column declared without; with ``whole``, none of these is missing."""
    need = [c.name for c in table.columns if not c.nullable]
    if whole and (missing := [n for n in need if n not in new.columns]):
        raise NullViolation(f"{table.name}.{missing[0]} has no value")
    if need := [n for n in need if n in new.columns]:
        found = new.agg(*[F.max(F.col(n).isNull()).alias(n) for n in need]).first()
        if bad := [n for n in need if found[n]]:
            raise NullViolation(f"{table.name}.{bad[0]} is null")


def _numbered(rt: Runtime, table: TableDef, new: DataFrame) -> DataFrame:
    """Rows with ids from the table's largest on, without gaps: places in partitions, and how many rows the partitions before have."""
    kind = table.struct()[table.pk].dataType
    top = int(rt.frame(table).agg(F.max(table.pk)).first()[0] or 0)
    rows = checkpointed(new.withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | place
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    total, before = 0, []
    for p, n in counts:
        before.append((p, total))
        total += n
    most = {T.ByteType: 127, T.ShortType: 32767, T.IntegerType: 2**31 - 1}.get(type(kind), 2**63 - 1)
    if top + total > most:
        raise BuildError(f"{table.name}.{table.pk} has no room for {total} more ids")
    before = F.broadcast(rt.spark.createDataFrame(before, "_p long, _before long"))
    return rows.join(before, part == F.col("_p")).withColumn(table.pk, (place + F.col("_before") + F.lit(top + 1)).cast(kind)).drop("_at", "_p", "_before")


def insert_frame(rt: Runtime, table: TableDef, new: DataFrame, check_keys: bool = True) -> None:
    """Appends a DataFrame by column names; missing columns are null, missing automatic ids follow the largest without gaps.

    Unknown columns, nulls in columns declared without, and keys that repeat in the frame or in the table are errors; ``check_keys`` says whether keys are looked at.
    """

    def act() -> None:
        _known(table, new.columns)
        rows = _numbered(rt, table, new) if table.pk and table.auto_increment and table.pk not in new.columns else new
        _no_nulls(table, rows, True)
        if check_keys:
            _no_repeats(table, rows, _keys_of(table))
            if (hits := _duplicates(rt, table, rows)) is not None and not hits.isEmpty():
                raise DuplicateKeyError(table.name)
        old = rt.frame(table)
        rt.publish(table, old.unionByName(rows, allowMissingColumns=True).select(*old.columns))

    rt.atomic(act)


def insert(rt: Runtime, table: TableDef, rows: Row | Sequence[Row]) -> int:
    """Missing or zero automatic ids follow the largest in the order given and are written back, as are the managed times and versions."""
    rows = [rows] if isinstance(rows, dict) else list(rows)
    if not rows:
        return 0

    def act() -> int:
        now = _now()
        for r in rows:
            for n in filter(None, (table.created_at, table.updated_at)):
                r[n] = now
            if table.version:
                r[table.version] = r.get(table.version) or 0
        _mark_active(table, rows)
        if table.pk and table.auto_increment and (bare := [r for r in rows if not r.get(table.pk)]):
            top = max([rt.frame(table).agg(F.max(table.pk)).first()[0] or 0, *(r[table.pk] for r in rows if r.get(table.pk))])
            for k, r in enumerate(bare, 1):
                r[table.pk] = top + k
        cols = _layout(rows, table)
        for fields in _keys_of(table):
            keys = [k for r in rows if None not in (k := tuple(r.get(f) for f in fields))]
            if len(set(keys)) < len(keys):
                raise DuplicateKeyError(f"{table.name}: {fields} twice in one batch")
        if bad := [c.name for c in table.columns if not c.nullable and any(r.get(c.name) is None for r in rows)]:
            raise NullViolation(f"{table.name}.{bad[0]} has no value")
        new = _frame(rt, table, rows, cols)
        if (hits := _duplicates(rt, table, new)) is not None and not hits.isEmpty():
            raise DuplicateKeyError(table.name)
        old = rt.frame(table)
        rt.publish(table, old.unionByName(new, allowMissingColumns=True).select(*old.columns))
        return len(rows)

    return rt.run("insert", table, lambda: rt.atomic(act))


def _matching(rt: Runtime, table: TableDef, rows: Sequence[Row]) -> int:
    """How many rows of the table have one of the keys, and the version that goes with it."""
    on = [_key(table)] + ([table.version] if table.version else [])
    return rt.frame(table).join(_frame(rt, table, rows, on), on, "left_semi").count()


def update_frame(rt: Runtime, table: TableDef, new: DataFrame) -> None:
    """Sets the columns of ``new`` in rows with its keys; neither key nor version changes by its values.

    A key twice in the frame, an unknown column, a null in a column declared without and a unique index that the result breaks are errors.
    """

    def act() -> None:
        pk = _key(table)
        _known(table, new.columns)
        _no_repeats(table, new, [(pk,)])
        _no_nulls(table, new, False)
        cols = [c for c in new.columns if c not in (pk, table.version)]
        old = rt.frame(table).alias("_old")
        right = new.select(F.col(pk).alias("_pk"), *[F.col(c).alias(f"_new_{c}") for c in cols])
        joined = old.join(right, F.col(f"_old.{pk}") == F.col("_pk"), "left")
        hit = F.col("_pk").isNotNull()

        def value(c: str):
            was = F.col(f"_old.{c}")
            return F.when(hit, F.col(f"_new_{c}")).otherwise(was) if c in cols else F.when(hit, (was + 1).cast(table.struct()[c].dataType)).otherwise(was) if c == table.version else was

        after = joined.select(*[value(c.name).alias(c.name) for c in table.columns])
        for fields in _keys_of(table):
            if set(fields) & set(cols):
                touched = after.join(new.select(pk), pk, "left_semi").select(*fields).dropna().distinct()
                if not after.join(touched, list(fields), "left_semi").groupBy(*fields).count().where("count > 1").isEmpty():
                    raise DuplicateKeyError(f"{table.name}: {fields}")
        rt.publish(table, after)

    rt.atomic(act)


def update(rt: Runtime, table: TableDef, rows: Row | Sequence[Row]) -> int:
    """By primary key, and with the version expected where there is one; the new version is written back."""
    rows = [rows] if isinstance(rows, dict) else list(rows)
    if not rows:
        return 0

    def act() -> int:
        pk = _key(table)
        _need_keys(rows, pk)
        if table.updated_at:
            for r in rows:
                r[table.updated_at] = _now()
        cols = _layout(rows, table)
        if table.version and table.version not in cols:
            raise BuildError(f"an update needs {table.version}")
        n = _matching(rt, table, rows)
        if table.version and n != len(rows):
            raise OptimisticLockConflict(f"{table.name}: {n} of {len(rows)} rows have the expected version")
        update_frame(rt, table, _frame(rt, table, rows, cols))
        for r in rows if table.version else ():
            r[table.version] += 1
        return n

    return rt.run("update", table, lambda: rt.atomic(act))


def delete_frame(rt: Runtime, table: TableDef, keys: DataFrame) -> None:
    pk = _key(table)
    rt.atomic(lambda: rt.publish(table, rt.frame(table).join(keys.select(pk), pk, "left_anti").select(*[c.name for c in table.columns])))


def delete(rt: Runtime, table: TableDef, rows: Row | Sequence[Row]) -> int:
    rows = [rows] if isinstance(rows, dict) else list(rows)
    if not rows:
        return 0

    def act() -> int:
        pk = _key(table)
        _need_keys(rows, pk)
        n = _matching(rt, table, rows)
        if table.version and n != len(rows):
            raise OptimisticLockConflict(f"{table.name}: {n} of {len(rows)} rows have the expected version")
        delete_frame(rt, table, _frame(rt, table, rows, [pk]))
        return n

    return rt.run("delete", table, lambda: rt.atomic(act))


def soft_delete(rt: Runtime, table: TableDef, rows: Row | Sequence[Row], when: int | datetime.datetime | None = None) -> int:
    """Sets deleted_at, by default to now: nanoseconds for integers."""
    rows = [rows] if isinstance(rows, dict) else list(rows)
    if not table.deleted_at:
        raise BuildError(f"{table.name} has no deleted_at")
    whole = isinstance(table.struct()[table.deleted_at].dataType, (T.LongType, T.DecimalType))
    value = when if when is not None else time.time_ns() if whole else _now()
    for r in rows:
        r[table.deleted_at] = value
    return update(rt, table, rows)


def _chunks(items: Sequence[Any], size: int) -> Iterator[Sequence[Any]]:
    if size < 1:
        raise BuildError("a chunk has at least one row")
    for i in range(0, len(items), size):
        yield items[i : i + size]


def chunked_insert(rt: Runtime, table: TableDef, rows: Iterable[Row], size: int = CHUNK, ignore_errors: bool = False) -> int:
    """With ``ignore_errors``, rows whose key is taken, by the table or an earlier row, are left out."""
    done = 0
    for chunk in _chunks(list(rows), size):
        if ignore_errors:
            _mark_active(table, chunk)
            chunk = _fresh(rt, table, chunk)
        done += insert(rt, table, chunk)
    return done


def _fresh(rt: Runtime, table: TableDef, rows: Sequence[Row]) -> list[Row]:
    taken: set[tuple] = set()
    for fields in _keys_of(table):
        if all(f in rows[0] for f in fields):
            new = _frame(rt, table, rows, list(fields))
            taken |= {(fields, *r) for r in rt.frame(table).join(new, list(fields), "left_semi").select(*fields).collect()}
    out = []
    for r in rows:
        own = {(fields, *k) for fields in _keys_of(table) if None not in (k := tuple(r.get(f) for f in fields))}
        if not own & taken:
            taken |= own
            out.append(r)
    return out


def _chunked(act: Callable) -> Callable:
    def run(rt: Runtime, table: TableDef, rows: Iterable[Row], size: int = CHUNK) -> int:
        return sum(act(rt, table, chunk) for chunk in _chunks(list(rows), size))

    return run


chunked_update, chunked_delete = _chunked(update), _chunked(delete)


def chunked_delete_by_pks(rt: Runtime, column: Expr, pks: Iterable[Any], size: int = CHUNK) -> int:
    """``column`` is the table's plain primary key."""
    table = column.table
    if column.kind != "column" or table is None or table.pk != column.name:
        raise BuildError("the column is the table's sole primary key, untransformed")
    done = 0
    for chunk in _chunks(list(pks), size):
        keys = _frame(rt, table, [{table.pk: k} for k in chunk], [table.pk])
        done += rt.frame(table).join(keys, table.pk, "left_semi").count()
        delete_frame(rt, table, keys)
    return done
