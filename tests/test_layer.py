"""Rules of the builder, arguments, paging, mutations, transactions and schema policies."""

import dataclasses
import itertools

import pytest
import typedframe as tf
from typedframe.errors import UnsupportedCapability
from typedframe.sources import policies, runtime as rt_mod


@tf.table(unique=[("email",)], search=["name"], version=True, deleted_at=True, updated_at=True)
class Users:
    id: "int64"
    name: "string"
    email: "string"
    version: "int64"
    deleted_at: "int64"
    updated_at: "time?"


Users: tf.TableDef
NAME = Users.c("name")  # the attribute is the table's own name
Orders = tf.TableDef("orders", (tf.column("id", "int64"), tf.column("user_id", "int64"), tf.column("total", "float64")), pk="id")
Extra = tf.TableDef("extra", (tf.column("id", "int64"), tf.column("name", "string")), pk="id")


@pytest.fixture
def rt(spark):
    users = spark.createDataFrame([], Users.struct())
    orders = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 2, 9.0), (4, None, None)], "id long, user_id long, total double")
    out = tf.Runtime(spark, [Users, Orders], {"users": users, "orders": orders})
    tf.insert(out, Users, [{"name": n, "email": f"{n}@x"} for n in ("ann", "bob", "c_d")])
    return out


def bad(stage, text):
    with pytest.raises(tf.BuildError, match=text):
        (stage() if callable(stage) else stage).build()


def test_declaration_rules():
    assert Users.label == "users" and Users.pk == "id" and Users.unique[0].name == "ux_users_email" and Users.index_fields(Users.unique[0]) == ("deleted_at", "email")
    with pytest.raises(tf.BuildError, match="did you mean 'search'"):
        tf.table(serach=[])
    with pytest.raises(tf.BuildError, match="did you mean 'name'"):
        Users.c("nam")
    for options, text in (({"pk": "nope"}, "no column"), ({"version": "name"}, "integer"), ({"search": ("id",)}, "isn't text"), ({"unique": (tf.Index(("id", "id")),)}, "twice"), ({"created_at": "id"}, "time"), ({"deleted_at": "name"}, "64-bit"), ({"indexes": (tf.Index(("id",)), tf.Index(("id",)))}, "two indexes")):
        with pytest.raises(tf.BuildError, match=text):
            tf.TableDef("t", Extra.columns, **options)
    with pytest.raises(tf.BuildError, match="identifier"):
        tf.TableDef("a-b")
    assert Extra.to_ddl() == "CREATE TABLE extra (id bigint, name string)"


def test_join_graph_rules():
    s = lambda: tf.select(Users.id).from_(Users)
    on = Users.id.eq(Orders.user_id)
    o2 = Orders.alias("o2")
    bad(lambda: tf.select().from_(Users), "at least one column")
    bad(lambda: s().inner_join(Users, on), "aliases are required")
    bad(lambda: s().cross_join(Users), "aliases are required")
    bad(lambda: s().inner_join(Orders), "needs a condition")
    bad(lambda: s().inner_join(Orders, Users.id.gt_val(1)), "doesn't refer")
    bad(lambda: s().inner_join(Orders, Orders.id.eq(o2.id)), "isn't introduced")
    bad(lambda: s().inner_join(Orders, Orders.id.gt_val(1)), "no earlier table")
    bad(lambda: s().where(Orders.id.gt_val(1)), "isn't in the query")
    bad(lambda: tf.select(Users.id, Orders.id.distinct()).from_(Users).inner_join(Orders, on), "DISTINCT")
    bad(lambda: s().where(Users.id.unique()), "UNIQUE")
    bad(lambda: tf.select(NAME.concat("x")).from_(Users), "CONCAT")
    bad(lambda: tf.select(Users.id.round(-1)).from_(Users), "precision")
    bad(lambda: s().where(Users.id.count().gt_val(1)), "aggregates")
    assert s().inner_join(Orders, on).left_join(o2, o2.user_id.eq(Users.id)).build()


def test_stages_offer_only_what_may_follow():
    s = tf.select(Users.id).from_(Users)
    assert not hasattr(tf.select(Users.id), "where") and not hasattr(tf.from_(Users), "build")
    assert not hasattr(s.where(), "where") and not hasattr(s.where(), "inner_join") and not hasattr(s.group_by(Users.id), "where") and not hasattr(s.for_update(), "union")
    assert hasattr(s.search(NAME), "where") and not hasattr(s.search(NAME).where(), "search")
    a = s.where(Users.id.gt_val(1))
    b = a.group_by(Users.id)
    assert a.spec.group == () and b.spec.group and s.spec.where == ()


def test_values_are_checked():
    for call in (lambda: NAME.eq_val(1), lambda: Users.id.eq_val("1"), lambda: Users.id.eq_val(None), lambda: Users.id.in_val([1]), lambda: Users.id.eq(None), lambda: Users.id.eq(NAME), lambda: tf.bind(None), lambda: Users.id.expr("%d"), lambda: Users.id.exprf("%s + %s"), lambda: tf.case().end(), lambda: NAME.substring(0, 1), lambda: NAME.upper().as_("u2")):
        with pytest.raises(tf.BuildError):
            call()


def test_setop_and_cte_rules(rt):
    s = lambda *c: tf.select(*c).from_(Users)
    bad(lambda: s(Users.id).union(s(Users.id, NAME)), "as many columns")
    bad(lambda: s(Users.id).search(NAME).union(s(Users.id)), "keyword search")
    with pytest.raises(tf.BuildError, match="on the left"):
        s(Users.id).union(s(NAME)).to_df(rt)
    with pytest.raises(tf.BuildError, match="keyword"):
        tf.cte("x", s(Users.id).search(NAME))
    one, two = tf.cte("x", s(Users.id)), tf.cte("x", s(Users.id).where(Users.id.gt_val(1)))
    y = tf.cte("y", tf.select(two.id).from_(two))
    bad(lambda: tf.select(one.id).from_(one).inner_join(y, one.id.eq(y.id)), "two CTEs")
    with pytest.raises(tf.BuildError, match="one column"):
        tf.build_subquery(s(Users.id, NAME))
    with pytest.raises(tf.BuildError, match="doesn't select"):
        tf.build_subquery(s(Users.id), NAME)


def test_argument_order_and_errors(rt):
    big = tf.cte("big", tf.select(Orders.user_id, Orders.total).from_(Orders).where(Orders.total.gt_var()))
    q = tf.select(NAME, big.total).from_(Users).inner_join(big, big.user_id.eq(Users.id)).where(NAME.starts_with_var(), Users.id.in_var()).build()
    assert q.param_count() == 3
    assert [tuple(r) for r in q.list(rt, 6.0, "a", [1, 2])] == [("ann", 7.0)]
    for args in ((6.0,), (6.0, 1, [1]), (6.0, "a", 5), (6.0, "a", [None]), (6.0, "a", [1], 9), (None, "a", [1])):
        with pytest.raises(tf.ArgumentError):
            q.list(rt, *args)
    sub = tf.build_subquery(tf.select(Orders.user_id).from_(Orders).where(Orders.total.lt_var()))
    assert {r.name for r in tf.select(NAME).from_(Users).where(Users.id.in_(sub)).list(rt, 8.0)} == {"ann"}
    assert tf.select(NAME).from_(Users).where(Users.id.nin(tf.build_subquery(tf.select(Orders.user_id).from_(Orders)))).list(rt) == []


def test_verbs(rt):
    s = tf.select(Users.id, NAME).from_(Users)
    assert s.count(rt) == 3 and s.exists(rt) and s.where(Users.id.gt_val(9)).get(rt) is None
    with pytest.raises(tf.NoRowsError):
        s.where(Users.id.gt_val(9)).get_or_err(rt)
    holder: dict = {}
    s.where(Users.id.eq_var()).load(rt, holder, 2)
    assert holder == {"id": 2, "name": "bob"}
    point = dataclasses.make_dataclass("Point", ["id", "name"])
    assert s.where(Users.id.eq_val(1)).build().mapped(point).get(rt) == point(1, "ann")
    assert tf.select(Orders.total.max().map_into("m")).from_(Orders).scalar(rt) == 9.0
    assert tf.select(Orders.total).from_(Orders).where(Orders.id.eq_val(4)).scalar(rt) == 0.0
    assert tf.select(Orders.id.count()).from_(Orders).build().query_string(rt) == "4"
    assert tf.select(Orders.user_id).from_(Orders).group_by(Orders.user_id).count(rt) == 3
    with pytest.raises(tf.BuildError):
        s.scalar(rt)
    with pytest.raises(UnsupportedCapability):
        s.for_update().no_wait().list(rt)
    with pytest.raises(tf.BuildError):
        s.for_share().no_wait().skip_locked()


def test_sql_text():
    q = tf.select(Users.id, NAME.upper().map_into("n")).from_(Users).where(Users.id.gt_var(), NAME.eq_val("o'x")).search(NAME).build()
    assert q.list_sql() == r"SELECT `users`.`id` AS `id`, UPPER(`users`.`name`) AS `n` FROM `users` WHERE `users`.`id` > ? AND `users`.`name` = 'o\'x'"
    assert q.count_sql().startswith("SELECT COUNT(1) FROM `users`") and q.keyword_list_sql().endswith("(`users`.`name` LIKE ?)")
    assert "AS _cnt" in tf.select(Users.id.count()).from_(Users).build().count_sql()


def test_paging(rt):
    s = tf.select(Users.id, NAME).from_(Users).search(NAME)
    page = s.page(rt, tf.PageRequest(1, 2, "name", "desc"))
    assert [r.name for r in page.data] == ["c_d", "bob"] and (page.total, page.total_page) == (3, 2) and page.has_next() and not page.has_prev() and not page.is_empty()
    assert [r.name for r in s.page(rt, tf.PageRequest(keyword="_")).data] == ["c_d"]
    for request, error in ((tf.PageRequest(order_by="nope"), "UnknownSortField"), (tf.PageRequest(order_by="id,name", order="asc"), "OrderCountMismatch")):
        with pytest.raises(getattr(tf, error)):
            s.page(rt, request)
    o = tf.select(Users.id.map_into("k"), Orders.id.map_into("k")).from_(Users).inner_join(Orders, Orders.user_id.eq(Users.id))
    with pytest.raises(tf.AmbiguousSortField):
        o.page(rt, tf.PageRequest(order_by="k"))
    parse = tf.PageRequest.parse
    assert parse({"page": "0", "size": "5000", "sort": "id", "order": "DESC"}) == tf.PageRequest(1, 1000, "id", "DESC") and parse(None) == tf.PageRequest() == parse({"page": "x"})
    assert tf.PageRequest(3, 10).offset() == 20 and tf.PageRequest(2_000_000, 10).offset() == 0
    assert parse(tf.PageRequest(2, 7, "id", "desc", "q").to_query()) == tf.PageRequest(2, 7, "id", "desc", "q")
    for r in (tf.PageRequest(0), tf.PageRequest(1, 0), tf.PageRequest(1, 1001), tf.PageRequest(order="asc"), tf.PageRequest(order_by="a", order="up")):
        with pytest.raises(ValueError):
            r.validate()


def test_mutations_and_versions(rt):
    rows = tf.select(*Users.cols()).from_(Users)
    first = rows.where(Users.id.eq_val(1)).get(rt).asDict()
    assert first["version"] == 0 and first["deleted_at"] == 0 and first["updated_at"]
    first["name"] = "anna"
    assert tf.update(rt, Users, first) == 1 and first["version"] == 1
    assert rows.where(Users.id.eq_val(1)).get(rt).name == "anna"
    stale = dict(first, version=0)
    for act in (tf.update, tf.delete):
        with pytest.raises(tf.OptimisticLockConflict):
            act(rt, Users, dict(stale))
    with pytest.raises(tf.DuplicateKeyError):
        tf.insert(rt, Users, {"name": "x", "email": "bob@x"})
    with pytest.raises(tf.BuildError):
        tf.update(rt, Users, {"id": 0, "version": 0, "name": "x"})
    with pytest.raises(tf.BuildError, match="same fields"):
        tf.insert(rt, Users, [{"name": "a", "email": "1"}, {"email": "2"}])
    new = [{"name": f"n{k}", "email": f"n{k}@x"} for k in range(5)]
    assert tf.chunked_insert(rt, Users, new, size=2) == 5 and [r["id"] for r in new] == [4, 5, 6, 7, 8]
    assert tf.chunked_insert(rt, Users, [{"name": "z", "email": "n1@x", "deleted_at": 0}, {"name": "w", "email": "w@x", "deleted_at": 0}], ignore_errors=True) == 1
    assert tf.chunked_update(rt, Users, [dict(r, name="m") for r in new], size=3) == 5 and rows.where(NAME.eq_val("m")).count(rt) == 5
    users = tf.Model(Users)
    row = rows.where(Users.id.eq_val(4)).get(rt).asDict()
    assert users.soft_delete(rt, row, 77) == 1 and users.by_pk(active=True).get(rt, 4) is None and users.by_pk().get(rt, 4).deleted_at == 77
    assert tf.chunked_delete_by_pks(rt, Users.id, [5, 6, 99], size=1) == 2 and rows.count(rt) == 7
    with pytest.raises(tf.BuildError):
        tf.chunked_delete_by_pks(rt, NAME, ["a"])
    assert tf.delete(rt, Users, row) == 1
    for k in range(12):  # lineage is cut on the way
        tf.insert(rt, Users, {"name": f"l{k}", "email": f"l{k}@x"})
    assert rows.count(rt) == 18


def test_lookups(rt):
    users = tf.Model(Users)
    assert [r.id for r in users.list_by_pk_in(rt, [3, 1])] == [3, 1] and [r.id for r in users.list_by_unique_in(rt, ("email",), ["c_d@x", "ann@x"])] == [3, 1]
    with pytest.raises(tf.NoRowsError, match="9"):
        users.list_by_pk_in(rt, [1, 9])
    with pytest.raises(tf.BuildError):
        users.by_index("name")
    assert users.by_unique("email").get(rt, "bob@x").id == 2 and users.is_active(users.all().get(rt))
    many = tf.Model(tf.TableDef("t", tuple(tf.column(c, "int64") for c in "abcd"), pk="a", unique=(tf.Index(("b", "c")),), indexes=(tf.Index(("c", "d")),)))
    assert many.prefixes() == [("b",), ("c",), ("c", "d")]


def test_transactions_and_tracers(rt):
    count = lambda: tf.select(Users.id).from_(Users).count(rt)

    def half(r):
        tf.insert(r, Users, {"name": "q", "email": "q@x"})
        raise tf.OptimisticLockConflict("no")

    calls = itertools.count()
    with pytest.raises(tf.OptimisticLockConflict):
        rt.with_tx(lambda r: (next(calls), half(r)), retry=rt_mod.is_retryable)
    assert next(calls) == 3 and count() == 3
    assert rt.with_tx(lambda r: tf.insert(r, Users, {"name": "q", "email": "q@x"})) == 1 and count() == 4
    seen: list = []
    rt.add_tracer(lambda verb, q, call: (seen.append("a"), call())[1])
    rt.add_tracer(rt_mod.cost_tracer(lambda verb, s: seen.append(verb)))
    rt.add_tracer(rt_mod.sql_tracer(seen.append))
    count()
    assert seen[0] == "a" and seen[1].startswith("SELECT COUNT(1)") and seen[2] == "count"
    with pytest.raises(tf.BuildError):
        for _ in range(100):
            rt.add_tracer(lambda v, q, c: c())
    with pytest.raises(tf.BuildError, match="twice"):
        rt.register(Users)


def test_durable_folder(spark, tmp_path):
    where = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0)], "id long, user_id long, total double").write.parquet(f"{where}/orders.parquet")
    rows = lambda rt: sorted((r.id, r.total) for r in tf.select(Orders.id, Orders.total).from_(Orders).list(rt))
    one = tf.Runtime(spark, [Orders], where, durable=True)
    tf.insert(one, Orders, {"user_id": 2, "total": 9.0})
    one.with_tx(lambda r: (tf.update(r, Orders, {"id": 1, "total": 6.0}), tf.delete(r, Orders, {"id": 2})))
    with pytest.raises(KeyError):
        one.with_tx(lambda r: (tf.delete(r, Orders, {"id": 1}), {}["no"]))
    assert rows(one) == rows(tf.Runtime(spark, [Orders], where)) == [(1, 6.0), (3, 9.0)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["orders.parquet"]
    with pytest.raises(tf.BuildError):
        tf.Runtime(spark, [Orders], {"orders": one.frame(Orders)}, durable=True)


def test_jdbc_tables_have_their_own_options(spark):
    common = {"url": "jdbc:derby:memory:one;create=true", "properties": {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}}
    other = "jdbc:derby:memory:two;create=true"
    spark.createDataFrame([(k, k % 3, float(k)) for k in range(1, 41)], "id long, user_id long, total double").write.jdbc(common["url"], "orders", properties=common["properties"])
    spark.createDataFrame([(1, "x")], "id long, name string").write.jdbc(other, "more", properties=common["properties"])
    rt = tf.Runtime(spark, [Orders, Extra], jdbc=common, jdbc_tables={"orders": {"column": "id", "lowerBound": 1, "upperBound": 40, "numPartitions": 4}, "extra": {"url": other, "table": "more"}}, durable=True)
    assert rt.frame(Orders).rdd.getNumPartitions() == 4 and tf.select(Orders.id).from_(Orders).where(Orders.total.gt_val(30.0)).count(rt) == 10
    assert tf.select(Extra.c("name")).from_(Extra).scalar(rt) == "x"
    tf.insert(rt, Extra, {"id": 2, "name": "y"})
    assert sorted(r.name for r in tf.select(Extra.c("name")).from_(Extra).list(tf.Runtime(spark, [Extra], jdbc=common, jdbc_tables={"extra": {"url": other, "table": "more"}}))) == ["x", "y"]


def test_inner_transactions(rt):
    count = lambda: tf.select(Users.id).from_(Users).count(rt)
    with rt.transaction():
        tf.insert(rt, Users, {"name": "q", "email": "q@x"})
        with pytest.raises(KeyError):
            with rt.transaction():
                tf.insert(rt, Users, {"name": "r", "email": "r@x"})
                assert count() == 5
                raise KeyError
        assert count() == 4
    assert count() == 4


def test_schema_policies(spark):
    spark.sql("DROP TABLE IF EXISTS extra")
    r = tf.Runtime(spark, [Extra])
    with pytest.raises(tf.TableMissing):
        tf.apply_policy(r, policies.VALIDATE)
    tf.apply_policy(r, policies.CREATE_MISSING)
    tf.apply_policy(r, policies.VALIDATE)
    spark.sql("INSERT INTO extra VALUES (1, 'a')")
    wider = tf.TableDef("extra", (tf.column("id", "int32"), tf.column("note", "string")), pk="id")
    r2 = tf.Runtime(spark, [wider])
    with pytest.raises(tf.SchemaMismatch, match="add note, drop name, alter id"):
        tf.apply_policy(r2, policies.CREATE_MISSING)
    tf.apply_policy(r2, policies.RECONCILE)
    assert [tuple(x) for x in tf.select(*wider.cols()).from_(wider).list(r2)] == [(1, None)]
    assert policies.check_unique(r2, wider) == []
    other = tf.TableDef("extra2", Extra.columns, pk="id")
    tf.apply_policy(tf.Runtime(spark, [other]), policies.MANAGED)
    assert not spark.catalog.tableExists("extra") and spark.catalog.tableExists("extra2")
    with pytest.raises(tf.BuildError):
        tf.apply_policy(r, "sometimes")


def test_pushdown_and_plan(spark):
    from typedframe.plans import catalogue as c

    rt = c.runtime(spark, "/root/testdata/sf0.001")
    plan = tf.select(c.orders.o_orderkey).from_(c.orders).where(c.orders.o_orderstatus.eq_val("F")).to_df(rt)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
    page = c.order_journey(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(__file__))
    shutil.copytree(f"{root}/typedframe", tmp_path / "typedframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
