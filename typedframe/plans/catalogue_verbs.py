"""Registered queries for what ends in rows, numbers, errors or tables afterwards: verbs, paging, lookups, mutations, transactions, policies, tracers."""

from __future__ import annotations

import contextlib
import dataclasses
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from ..functions.expr import bind_slice, now, reverse_order
from ..operators import mutation
from ..operators.model import Model
from ..sources import policies
from ..sources import runtime as tracing
from ..sources.runtime import Runtime, wrap_session
from ..sources.schema import Index, TableDef, column, identifier, result
from .builder import select
from .catalogue import TABLES, _add, _do, _table, customer, nation, orders, region
from .paging import PageRequest, parse_order


def _rows(name: str, schema: str, sql: str):
    """A query whose rows a verb returned to the caller."""

    def keep(fn: Callable[[Runtime], list[tuple]]):
        _do(name, sql)(lambda rt: rt.spark.createDataFrame([tuple(r) for r in fn(rt)], schema).coalesce(1))
        return fn

    return keep


def _raised(fn: Callable[[], Any]) -> str:
    """The name of the error that ``fn`` ends with, or 'none'."""
    try:
        fn()
    except Exception as e:
        return type(e).__name__
    return "none"


def _values(*rows: tuple, names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


# Sources
@_do("schema_qualified", "SELECT n_nationkey, n_name FROM nation")
def _(rt):
    t = TableDef("nation", nation.columns, pk="n_nationkey", schema_name="main")
    return select(t.n_nationkey, t.n_name).from_(t).to_df(Runtime(rt.spark, [t], {"main.nation": rt.frame(nation)}))


@_do("wrap_session", "SELECT r_regionkey, r_name FROM region")
def _(rt):
    rt.frame(region).createOrReplaceTempView("typedframe_region_view")
    t = TableDef("typedframe_region_view", region.columns, pk="r_regionkey")
    return select(*t.cols()).from_(t).to_df(wrap_session(rt.spark, [t]))


_by_key = lambda: select(nation.n_nationkey, nation.n_name).from_(nation).where(nation.n_nationkey.eq_var()).build()


@_rows("load", "n_nationkey long, n_name string", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def _(rt):
    holder: dict = {}
    _by_key().load(rt, holder, 7)
    return [(holder["n_nationkey"], holder["n_name"])]


_rows("ddl_text", "ddl string", _values(("CREATE TABLE nation (n_nationkey int, n_name string, n_regionkey int)",), names="ddl"))(lambda rt: [(nation.to_ddl(),)])
_add("bind_slice", lambda: select(nation.n_nationkey).from_(nation).where(nation.n_nationkey.pred("%s IN (%s, %s, %s)", *bind_slice([1, 4, 9]))), "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 4, 9)")
_add("now", lambda: select(orders.o_orderkey).from_(orders).where(orders.o_orderdate.pred("%s < %s", now())), "SELECT o_orderkey FROM orders WHERE o_orderdate < now()::TIMESTAMP")
_add("result_columns", lambda: select(*result(key=nation.n_nationkey, shout=nation.n_name.upper()).cols()).from_(nation), "SELECT n_nationkey AS key, upper(n_name) AS shout FROM nation")

# What is rejected
_s = lambda *c: select(*(c or (nation.n_nationkey,))).from_(nation)
_rows("unique_rejected", "error string", _values(("BuildError",), names="error"))(lambda rt: [(_raised(lambda: _s().where(nation.n_name.unique()).build()),)])
_rows("concat_rejected", "error string", _values(("BuildError",), names="error"))(lambda rt: [(_raised(lambda: _s(nation.n_name.concat("x")).build()),)])
_rows("row_locks_rejected", "lock string, error string", _values(("update", "UnsupportedCapability"), ("share", "UnsupportedCapability"), ("both waits", "AttributeError"), names="lock, error"))(
    lambda rt: [("update", _raised(lambda: _s().for_update().list(rt))), ("share", _raised(lambda: _s().for_share().no_wait().list(rt))), ("both waits", _raised(lambda: _s().for_update().no_wait().union(_s())))]
)
_rows("identifiers", "name string, error string", _values(("ok_1", "none"), ("a-b", "BuildError"), ("1a", "BuildError"), ("", "BuildError"), names="name, error"))(lambda rt: [(n, _raised(lambda: identifier(n))) for n in ("ok_1", "a-b", "1a", "")])
_rows("registration", "what string, error string", _values(("twice", "BuildError"), ("alias", "BuildError"), ("null", "BuildError"), ("fresh", "none"), names="what, error"))(
    lambda rt: [("twice", _raised(lambda: rt.register(nation))), ("alias", _raised(lambda: rt.register(nation.alias("n")))), ("null", _raised(lambda: rt.register(None))), ("fresh", _raised(lambda: rt.register(_table("fresh", "id:bigint"))))]
)
_rows("argument_types", "what string, error string", _values(("text for a number", "ArgumentError"), ("number for text", "ArgumentError"), ("list with text", "ArgumentError"), ("fits", "none"), ("missing", "ArgumentError"), names="what, error"))(
    lambda rt: [
        ("text for a number", _raised(lambda: _s().where(nation.n_nationkey.eq_var()).to_df(rt, "abc"))), ("number for text", _raised(lambda: _s().where(nation.n_name.starts_with_var()).to_df(rt, 3))),
        ("list with text", _raised(lambda: _s().where(nation.n_nationkey.in_var()).to_df(rt, [1, "x"]))), ("fits", _raised(lambda: _s().where(nation.n_nationkey.eq_var()).to_df(rt, 3))), ("missing", _raised(lambda: _s().where(nation.n_nationkey.eq_var()).to_df(rt))),
    ]
)

# Orders and pages
_rows("reverse_order", "a string, b string", _values(("DESC", "ASC"), names="a, b"))(lambda rt: [(reverse_order(nation.n_name.asc()).order, nation.n_name.desc().reverse().order)])
_rows("parse_order", "given string, parsed string", _values((" asc", "ASC"), ("DESC ", "DESC"), ("up", "ValueError"), names="given, parsed"))(lambda rt: [(x, parse_order(x) if _raised(lambda: parse_order(x)) == "none" else _raised(lambda: parse_order(x))) for x in (" asc", "DESC ", "up")])
_GIVEN = ({}, {"page": "3", "size": "50", "sort": "a", "order": "desc"}, {"page": "-1", "size": "5000"}, {"page": "x", "order_by": "b", "keyword": "k"})
_rows("page_request_parse", "n long, page long, size long, order_by string, direction string, keyword string", _values((0, 1, 20, "", "", ""), (1, 3, 50, "a", "desc", ""), (2, 1, 1000, "", "", ""), (3, 1, 20, "b", "", "k"), names="n, page, size, order_by, direction, keyword"))(
    lambda rt: [(i, r.page, r.size, r.order_by, r.order, r.keyword) for i, r in enumerate(map(PageRequest.parse, _GIVEN))]
)
_rows("page_request_serialise", "k string, v string", _values(("page", "2"), ("size", "7"), ("order_by", "id"), ("order", "desc"), names="k, v"))(lambda rt: list(PageRequest(2, 7, "id", "desc").to_query().items()))
_rows("page_request_normalise", "n long, page long, size long, skipped long, error string", _values((0, 1, 20, 0, "ValueError"), (1, 1, 1000, 0, "ValueError"), (2, 3, 10, 20, "none"), (3, 2, 5, 5, "ValueError"), names="n, page, size, skipped, error"))(
    lambda rt: [(i, r.normalized().page, r.normalized().size, r.offset(), _raised(r.validate)) for i, r in enumerate((PageRequest(0, 0), PageRequest(1, 5000), PageRequest(3, 10), PageRequest(2, 5, "a", "up")))]
)


@_rows("page_response", "o_orderkey long, total long, total_page long", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT CAST(ceil(count(*) / 15.0) AS BIGINT) FROM orders) AS total_page FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 15")
def _(rt):
    page = select(orders.o_orderkey).from_(orders).page(rt, PageRequest(2, 15, "o_orderkey"))
    return [(r.o_orderkey, page.total, page.total_page) for r in page.data]


@_rows("page_navigation", "p long, more boolean, before boolean, none boolean", "SELECT CAST(p AS BIGINT) AS p, p < ceil(n / 10.0) AS more, p > 1 AS before, (p - 1) * 10 >= n AS none FROM (VALUES (1), (2), (3), (4)) v(p), (SELECT count(*) AS n FROM nation)")
def _(rt):
    pages = [_s().page(rt, PageRequest(p, 10, "n_nationkey")) for p in (1, 2, 3, 4)]
    return [(x.request.page, x.has_next(), x.has_prev(), x.is_empty()) for x in pages]


# Verbs
_asia = lambda: select(nation.n_nationkey, nation.n_name).from_(nation).where(nation.n_regionkey.eq_var()).build()
_rows("list", "n_nationkey long, n_name string", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2")(lambda rt: _asia().list(rt, 2))
_point = dataclasses.make_dataclass("Point", ["n_nationkey", "n_name"])
_rows("list_mapped", "n_nationkey long, n_name string", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 3")(lambda rt: [dataclasses.astuple(p) for p in _asia().mapped(_point).list(rt, 3)])
_rows("get", "found boolean, n_name string", "SELECT TRUE AS found, n_name FROM nation WHERE n_nationkey = 4 UNION ALL SELECT FALSE, NULL")(lambda rt: [(True, _by_key().get(rt, 4).n_name), (_by_key().get(rt, -4) is not None, None)])
_rows("get_or_err", "n_name string, error string", "SELECT n_name, 'none' AS error FROM nation WHERE n_nationkey = 4 UNION ALL SELECT NULL, 'NoRowsError'")(lambda rt: [(_by_key().get_or_err(rt, 4).n_name, "none"), (None, _raised(lambda: _by_key().get_or_err(rt, -4)))])
_rows("count", "n long", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000")(lambda rt: [(select(orders.o_orderkey).from_(orders).where(orders.o_totalprice.gt_val(150000.0)).count(rt),)])
_rows("exists", "some boolean, none boolean", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 4) AS some, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = -4) AS none")(lambda rt: [(_by_key().exists(rt, 4), _by_key().exists(rt, -4))])
_rows("scalar", "top double, unset long", "SELECT max(o_totalprice) AS top, CAST(0 AS BIGINT) AS unset FROM orders")(
    lambda rt: [(select(orders.o_totalprice.max().map_into("m")).from_(orders).scalar(rt), select(nation.n_nationkey.max()).from_(nation).where(nation.n_nationkey.lt_val(-9)).scalar(rt))]
)
_n_orders = lambda: select(orders.o_orderkey.count()).from_(orders).build()
_rows("query_scalars", "i long, f double, s string", "SELECT count(*) AS i, CAST(count(*) AS DOUBLE) AS f, CAST(count(*) AS VARCHAR) AS s FROM orders")(lambda rt: [(_n_orders().query_int(rt), _n_orders().query_float(rt), _n_orders().query_string(rt))])
_texts = (
    ("list", "SELECT `nation`.`n_name` AS `n_name` FROM `nation` WHERE `nation`.`n_nationkey` > ?"), ("count", "SELECT COUNT(1) FROM `nation` WHERE `nation`.`n_nationkey` > ?"),
    ("keyword", "SELECT `nation`.`n_name` AS `n_name` FROM `nation` WHERE `nation`.`n_nationkey` > ? AND (`nation`.`n_name` LIKE ?)"), ("params", "1"),
)


@_rows("sql_accessors", "what string, text string", _values(*_texts, names="what, text"))
def _(rt):
    q = select(nation.n_name).from_(nation).where(nation.n_nationkey.gt_var()).search(nation.n_name).build()
    return [("list", q.list_sql()), ("count", q.count_sql()), ("keyword", q.keyword_list_sql()), ("params", str(q.param_count()))]


# Lookups
@_rows("list_by_pk_in", "at long, n_name string", "SELECT CAST(CASE n_nationkey WHEN 9 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS at, n_name FROM nation WHERE n_nationkey IN (9, 2, 5)")
def _(rt):
    return [(i, r.n_name) for i, r in enumerate(Model(nation).list_by_pk_in(rt, [9, 2, 5]))]


def _some(rt: Runtime, n: int = 3) -> list[str]:
    return [r.n_name for r in rt.frame(nation).orderBy(F.desc("n_nationkey")).limit(n).collect()]


@_rows("list_by_unique_in", "at long, n_nationkey long", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS at, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 3")
def _(rt):
    return [(i, r.n_nationkey) for i, r in enumerate(Model(nation).list_by_unique_in(rt, ("n_name",), _some(rt)))]


_soft = _table("nation_soft", "n_nationkey:int n_name:string n_regionkey:int deleted_at:bigint", pk="n_nationkey", deleted_at="deleted_at", unique=(Index(("n_name",)),), indexes=(Index(("n_regionkey",)),))
_SOFT = "(SELECT *, CAST(n_nationkey % 5 AS BIGINT) AS deleted_at FROM nation)"


def _softened(rt: Runtime) -> Runtime:
    rt.publish(_soft, rt.frame(nation).withColumn("deleted_at", (F.col("n_nationkey") % 5).cast("bigint")))
    return rt


_do("active_by_pk", f"SELECT * FROM {_SOFT} WHERE deleted_at = 0 AND n_nationkey IN (10, 11)")(lambda rt: Model(_soft).by_pk_in(active=True).to_df(_softened(rt), [10, 11]))
_do("active_by_unique", f"SELECT * FROM {_SOFT} WHERE deleted_at = 0 AND n_name = (SELECT n_name FROM nation WHERE n_nationkey = 5)")(lambda rt: Model(_soft).by_unique("n_name", active=True).to_df(_softened(rt), rt.frame(nation).where("n_nationkey = 5").first().n_name))
_do("active_by_index", f"SELECT * FROM {_SOFT} WHERE deleted_at = 0 AND n_regionkey = 1")(lambda rt: Model(_soft).by_index("n_regionkey", active=True).to_df(_softened(rt), 1))
_rows("is_active", "n_nationkey long, active boolean", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_nationkey % 5 = 0 AS active FROM nation")(lambda rt: [(r.n_nationkey, Model(_soft).is_active(r)) for r in Model(_soft).all().list(_softened(rt))])

# Managed columns
_notes = _table("notes", "id:bigint text:string version:bigint created_at:timestamp_ntz updated_at:timestamp_ntz", pk="id", version="version", created_at="created_at", updated_at="updated_at")


def _noted(rt: Runtime) -> Runtime:
    out = Runtime(rt.spark, [_notes], {"notes": rt.spark.createDataFrame([], _notes.struct())})
    mutation.insert(out, _notes, [{"text": t} for t in ("a", "b", "c")])
    return out


_FACTS = ("id", "text", "version", "created_at IS NOT NULL AS made", "updated_at >= created_at AS later")
_NAMES = "id, text, version, made, later"
_do("insert_times", _values((1, "a", 0, True, True), (2, "b", 0, True, True), (3, "c", 0, True, True), names=_NAMES))(lambda rt: _noted(rt).frame(_notes).selectExpr(*_FACTS))


@_do("update_time", _values((1, "a", 0, True, True), (2, "x", 1, True, True), (3, "c", 0, True, True), names=_NAMES))
def _(rt):
    rt = _noted(rt)
    mutation.update(rt, _notes, {"id": 2, "text": "x", "version": 0})
    return rt.frame(_notes).selectExpr(*_FACTS)


@_do("optimistic_update", _values((1, "a", 0, "none"), (2, "second", 2, "OptimisticLockConflict"), (3, "c", 0, "none"), names="id, text, version, error"))
def _(rt):
    rt = _noted(rt)
    row = {"id": 2, "text": "first", "version": 0}
    mutation.update(rt, _notes, row)
    mutation.update(rt, _notes, dict(row, text="second"))
    error = _raised(lambda: mutation.update(rt, _notes, {"id": 2, "text": "late", "version": 0}))
    return rt.frame(_notes).select("id", "text", "version", F.when(F.col("id") == 2, error).otherwise("none").alias("error"))


@_do("optimistic_delete", _values((1, "a"), (3, "c"), names="id, text"))
def _(rt):
    rt = _noted(rt)
    assert _raised(lambda: mutation.delete(rt, _notes, {"id": 1, "version": 5})) == "OptimisticLockConflict"
    mutation.delete(rt, _notes, {"id": 2, "version": 0})
    return rt.frame(_notes).select("id", "text")


# Mutations
@_do("hard_delete", "SELECT * FROM nation WHERE n_nationkey <> 6")
def _(rt):
    Model(nation).delete(rt, {"n_nationkey": 6})
    return rt.frame(nation)


@_do("soft_delete", f"SELECT n_nationkey, CAST(CASE n_nationkey WHEN 10 THEN 77 ELSE deleted_at END AS BIGINT) AS deleted_at FROM {_SOFT}")
def _(rt):
    Model(_soft).soft_delete(_softened(rt), {"n_nationkey": 10}, 77)
    return rt.frame(_soft).select("n_nationkey", "deleted_at")


@_do("insert_frame", "SELECT * FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER), 'NEW ' || r_name, r_regionkey FROM region")
def _(rt):
    new = rt.frame(region).orderBy("r_regionkey").coalesce(1).selectExpr("concat('NEW ', r_name) AS n_name", "r_regionkey AS n_regionkey")
    mutation.insert_frame(rt, nation, new)
    return rt.frame(nation)


@_do("insert_frame_ids", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids, max(c_custkey) AS top FROM (SELECT c_custkey FROM customer UNION ALL SELECT row_number() OVER () + (SELECT max(c_custkey) FROM customer) FROM customer)")
def _(rt):
    mutation.insert_frame(rt, customer, rt.frame(customer).drop("c_custkey").repartition(5))
    return rt.frame(customer).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("ids"), F.max("c_custkey").alias("top"))


@_do("chunked_update", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 1 AND 6 THEN 'N' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation")
def _(rt):
    mutation.chunked_update(rt, nation, [{"n_nationkey": k, "n_name": f"N{k}"} for k in range(1, 7)], size=2)
    return rt.frame(nation)


@_do("chunked_delete", "SELECT * FROM nation WHERE n_nationkey NOT BETWEEN 1 AND 6")
def _(rt):
    mutation.chunked_delete(rt, nation, [{"n_nationkey": k} for k in range(1, 7)], size=4)
    return rt.frame(nation)


_account = TableDef("account", (column("id", "int64"), column("mail", "string", nullable=False), column("age", "int32")), pk="id", unique=(Index(("mail",)),))


def _accounts(rt: Runtime) -> Runtime:
    return Runtime(rt.spark, [_account], {"account": rt.spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, mail string, age int")})


def _mutation_errors(rt: Runtime) -> list[tuple[str, str]]:
    rt = _accounts(rt)
    frame = lambda rows, schema="id long, mail string": rt.spark.createDataFrame(rows, schema)
    cases = {
        "insert a taken key": lambda: mutation.insert(rt, _account, {"id": 1, "mail": "c"}), "insert a taken unique value": lambda: mutation.insert(rt, _account, {"mail": "b"}), "insert one twice": lambda: mutation.insert(rt, _account, [{"mail": "c"}, {"mail": "c"}]),
        "insert a null": lambda: mutation.insert(rt, _account, {"mail": None}), "insert an unknown field": lambda: mutation.insert(rt, _account, {"mail": "c", "x": 1}), "rows of other fields": lambda: mutation.insert(rt, _account, [{"mail": "c"}, {"mail": "d", "age": 1}]),
        "frame with a key twice": lambda: mutation.insert_frame(rt, _account, frame([(8, "x"), (8, "y")])), "frame with a taken value": lambda: mutation.insert_frame(rt, _account, frame([(8, "a")])), "frame with a null": lambda: mutation.insert_frame(rt, _account, frame([(8, None)])),
        "frame without a needed column": lambda: mutation.insert_frame(rt, _account, frame([(8,)], "id long")), "frame with an unknown column": lambda: mutation.insert_frame(rt, _account, frame([(8, "x", 1)], "id long, mail string, x int")),
        "update without a key": lambda: mutation.update(rt, _account, {"mail": "c"}), "update one key twice": lambda: mutation.update(rt, _account, [{"id": 1, "mail": "c"}, {"id": 1, "mail": "d"}]), "update to a taken value": lambda: mutation.update(rt, _account, {"id": 1, "mail": "b"}),
        "update to a null": lambda: mutation.update(rt, _account, {"id": 1, "mail": None}), "update frame with a key twice": lambda: mutation.update_frame(rt, _account, frame([(1, "x"), (1, "y")])), "update frame with an unknown column": lambda: mutation.update_frame(rt, _account, frame([(1, 2)], "id long, x int")),
        "swap two values": lambda: mutation.update(rt, _account, [{"id": 1, "mail": "b"}, {"id": 2, "mail": "a"}]), "delete by another column": lambda: mutation.chunked_delete_by_pks(rt, _account.mail, ["a"]),
    }
    return [(k, _raised(f)) for k, f in cases.items()]


_EXPECTED = {
    "insert a taken key": "DuplicateKeyError", "insert a taken unique value": "DuplicateKeyError", "insert one twice": "DuplicateKeyError", "insert a null": "NullViolation", "insert an unknown field": "BuildError", "rows of other fields": "BuildError",
    "frame with a key twice": "DuplicateKeyError", "frame with a taken value": "DuplicateKeyError", "frame with a null": "NullViolation", "frame without a needed column": "NullViolation", "frame with an unknown column": "BuildError",
    "update without a key": "BuildError", "update one key twice": "BuildError", "update to a taken value": "DuplicateKeyError", "update to a null": "NullViolation", "update frame with a key twice": "DuplicateKeyError", "update frame with an unknown column": "BuildError",
    "swap two values": "none", "delete by another column": "BuildError",
}
_rows("mutation_errors", "what string, error string", _values(*_EXPECTED.items(), names="what, error"))(_mutation_errors)


# Transactions
@_do("tx_rollback", "SELECT * FROM nation")
def _(rt):
    def half(r: Runtime) -> None:
        mutation.insert(r, nation, {"n_name": "MU", "n_regionkey": 1})
        raise KeyError("no")

    assert _raised(lambda: rt.with_tx(half)) == "KeyError"
    return rt.frame(nation)


@_do("tx_commit", "SELECT * FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT max(n_nationkey) + 1, 'MU', 1 FROM nation")
def _(rt):
    rt.with_tx(lambda r: (mutation.insert(r, nation, {"n_name": "MU", "n_regionkey": 1}), mutation.delete(r, nation, {"n_nationkey": 3})))
    return rt.frame(nation)


@_rows("tx_retry", "attempts long, error string", _values((3, "OptimisticLockConflict"), (1, "KeyError"), (2, "none"), names="attempts, error"))
def _(rt):
    from ..errors import OptimisticLockConflict

    out = []
    for error, good in ((OptimisticLockConflict, 9), (KeyError, 9), (OptimisticLockConflict, 2)):
        calls: list[int] = []

        def act(r: Runtime, error=error, good=good, calls=calls) -> None:
            calls.append(1)
            if len(calls) < good:
                raise error("again")

        out.append((error, calls, _raised(lambda act=act: rt.with_tx(act, retry=tracing.is_retryable))))
    return [(len(calls), e) for _, calls, e in out]


@_rows("tx_isolation", "what string, n long", "SELECT 'other thread, before' AS what, count(*) AS n FROM nation UNION ALL SELECT 'own, before', count(*) + 1 FROM nation UNION ALL SELECT 'other thread, after', count(*) + 1 FROM nation UNION ALL SELECT 'conflicts', 1")
def _(rt):
    from concurrent.futures import ThreadPoolExecutor

    size = lambda: select(nation.n_nationkey).from_(nation).count(rt)
    with ThreadPoolExecutor(1) as other:
        with rt.transaction():
            mutation.insert(rt, nation, {"n_name": "MU", "n_regionkey": 1})
            before, own = other.submit(size).result(), size()
        after = other.submit(size).result()

        def late() -> None:
            with rt.transaction():
                mutation.insert(rt, nation, {"n_name": "LEMURIA", "n_regionkey": 1})
                other.submit(lambda: mutation.delete(rt, nation, {"n_nationkey": 2})).result()

        conflicts = int(_raised(late) == "OptimisticLockConflict")
    return [("other thread, before", before), ("own, before", own), ("other thread, after", after), ("conflicts", conflicts)]


@_rows("retry_predicates", "error string, conflict boolean, network boolean, retry boolean", _values(("OptimisticLockConflict", True, False, True), ("ConnectionError", False, True, True), ("TimeoutError", False, True, True), ("KeyError", False, False, False), names="error, conflict, network, retry"))
def _(rt):
    from ..errors import OptimisticLockConflict

    return [(type(e).__name__, tracing.is_optimistic_conflict(e), tracing.is_network_error(e), tracing.is_retryable(e)) for e in (OptimisticLockConflict("x"), ConnectionError(), TimeoutError(), KeyError("x"))]


@contextlib.contextmanager
def _database(spark):
    """A database of its own for tables and registers, gone afterwards."""
    before, name = spark.catalog.currentDatabase(), _named(spark)
    spark.sql(f"CREATE DATABASE {name}")
    spark.catalog.setCurrentDatabase(name)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _named(spark) -> str:
    return f"typedframe_{uuid.uuid4().hex[:8]}"


@_rows("durable_tables", "n_nationkey long, n_name string", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey WHEN 5 THEN 'FIVE' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 3")
def _(rt):
    name = _named(rt.spark)
    kept = TableDef(name, nation.columns, pk="n_nationkey")
    with _database(rt.spark):
        rt.frame(nation).write.format("parquet").saveAsTable(name)
        one = Runtime(rt.spark, [kept], durable=True)
        one.with_tx(lambda r: (mutation.update(r, kept, {"n_nationkey": 5, "n_name": "FIVE"}), mutation.delete(r, kept, {"n_nationkey": 3})))
        return select(kept.n_nationkey, kept.n_name).from_(kept).list(Runtime(rt.spark, [kept]))


# Schema policies
def _policy_steps(rt: Runtime) -> list[tuple[str, str]]:
    spark, name = rt.spark, _named(rt.spark)
    old = TableDef(name, (column("id", "int64"), column("name", "string")), pk="id")
    new = TableDef(name, (column("id", "int32"), column("note", "string")), pk="id", unique=(Index(("note",)),))
    a, b = Runtime(spark, [old]), Runtime(spark, [new])
    with _database(spark):
        out = [("validate a missing table", _raised(lambda: policies.apply_policy(a, policies.VALIDATE))), ("manual", _raised(lambda: policies.apply_policy(a, policies.MANUAL)))]
        out += [("create", _raised(lambda: policies.apply_policy(a, policies.CREATE_MISSING))), ("validate", _raised(lambda: policies.apply_policy(a, policies.VALIDATE)))]
        spark.sql(f"INSERT INTO {name} VALUES (1, 'a'), (2, 'b')")
        out += [(f"{c.kind} {c.column}", f"{c.before}>{c.after}") for c in policies.diff(spark.table(name).schema, new.struct())]
        out += [("validate a difference", _raised(lambda: policies.apply_policy(b, policies.VALIDATE))), ("create_missing with a difference", _raised(lambda: policies.apply_policy(b, policies.CREATE_MISSING)))]
        policies.apply_policy(b, policies.RECONCILE)
        out += [(f"row {r.id}", str(r.note)) for r in spark.table(name).orderBy("id").collect()]
        out += [("registered", str(name in policies.managed_names(spark))), ("index missing", _raised(lambda: policies.apply_index_policy(b, policies.VALIDATE)))]
        out += [("index added", str(len(policies.apply_index_policy(b, policies.CREATE_MISSING)))), ("index kept", _raised(lambda: policies.apply_index_policy(b, policies.VALIDATE)))]
        spark.sql(f"INSERT INTO {name} VALUES (3, 'x'), (4, 'x')")
        b._frames.clear()
        spark.sql(f"DROP TABLE {policies.INDEXES}")
        out += [("index broken", _raised(lambda: policies.apply_index_policy(b, policies.CREATE_MISSING)))]
        policies.apply_policy(Runtime(spark, []), policies.MANAGED)
        return [*out, ("managed drops", str(not spark.catalog.tableExists(name)))]


_STEPS = (
    ("validate a missing table", "TableMissing"), ("manual", "none"), ("create", "none"), ("validate", "none"), ("add note", ">string"), ("drop name", "string>"), ("alter id", "bigint>int"), ("validate a difference", "SchemaMismatch"),
    ("create_missing with a difference", "SchemaMismatch"), ("row 1", "None"), ("row 2", "None"), ("registered", "True"), ("index missing", "SchemaMismatch"), ("index added", "1"), ("index kept", "none"), ("index broken", "SchemaMismatch"), ("managed drops", "True"),
)
for _name, _some_steps in {
    "table_policies": ("validate a missing table", "manual", "create", "validate", "validate a difference", "create_missing with a difference"), "policy_rebuild": ("row 1", "row 2"), "index_policy": ("index missing", "index added", "index kept", "index broken"),
    "column_diff": ("add note", "drop name", "alter id"), "policy_registry": ("registered", "managed drops"),
}.items():
    _rows(_name, "what string, outcome string", _values(*[s for s in _STEPS if s[0] in _some_steps], names="what, outcome"))(lambda rt, own=_some_steps: [s for s in _policy_steps(rt) if s[0] in own])


@_rows("registration_checks", "what string, error string", _values(("index names", "BuildError"), ("no columns", "BuildError"), ("two alike", "BuildError"), names="what, error"))
def _(rt):
    one, two = (TableDef(n, nation.columns, indexes=(Index(("n_name",), "same"),)) for n in ("one", "two"))
    return [("index names", _raised(lambda: Runtime(rt.spark, [one, two]))), ("no columns", _raised(lambda: policies.apply_policy(Runtime(rt.spark, [TableDef("bare")]), policies.VALIDATE))), ("two alike", _raised(lambda: Runtime(rt.spark, [nation, nation])))]


# Tracers
@_rows("tracers", "place long, seen string", _values((0, "outer"), (1, "inner"), (2, "count"), (3, "SELECT COUNT(1) FROM `nation`"), (4, "BuildError"), names="place, seen"))
def _(rt):
    seen: list[str] = []
    traced = Runtime(rt.spark, TABLES, rt.source, tracers=[lambda v, q, call: (seen.append("outer"), call())[1], lambda v, q, call: (seen.append("inner"), seen.append(v), call())[2], tracing.sql_tracer(seen.append)])
    _s().count(traced)
    return [(i, s) for i, s in enumerate([*seen, _raised(lambda: [traced.add_tracer(lambda v, q, c: c()) for _ in range(100)])])]


@_rows("builtin_tracers", "what string, seen string", _values(("cost", "list"), ("cost is positive", "True"), ("error", "list UnsupportedCapability"), names="what, seen"))
def _(rt):
    costs, errors = [], []
    traced = Runtime(rt.spark, TABLES, rt.source, tracers=[tracing.cost_tracer(lambda v, s: costs.append((v, s))), tracing.error_tracer(lambda v, e: errors.append(f"{v} {type(e).__name__}"))])
    _s().list(traced)
    _raised(lambda: _s().for_update().list(traced))
    return [("cost", costs[0][0]), ("cost is positive", str(costs[0][1] > 0)), ("error", errors[0])]
