"""The registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import and_, bind, case, exists_sub, nexists_sub, or_
from ..operators import mutation
from ..operators.model import Model
from ..sources.runtime import Runtime
from ..sources.schema import Index, TableDef, column, result
from .builder import Buildable, build_subquery, cte, from_, select
from .paging import PageRequest


def _table(name: str, kinds: str, **options) -> TableDef:
    return TableDef(name, tuple(column(*c.split(":")) for c in kinds.split()), **options)


region = _table("region", "r_regionkey:int r_name:string", pk="r_regionkey", auto_increment=False)
nation = _table("nation", "n_nationkey:int n_name:string n_regionkey:int", pk="n_nationkey", unique=(Index(("n_name",)),), indexes=(Index(("n_regionkey",)),), search=("n_name",))
customer = _table("customer", "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string", pk="c_custkey", indexes=(Index(("c_nationkey", "c_mktsegment")),), search=("c_name", "c_mktsegment"))
supplier = _table("supplier", "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double", pk="s_suppkey")
part = _table("part", "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double", pk="p_partkey", search=("p_name", "p_type"))
orders = _table("orders", "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string", pk="o_orderkey")
lineitem = _table("lineitem", "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz")
events = _table("events", "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string", pk="event_id")
labels = _table("labels", "doc_id:bigint quality:int toxic:int", pk="doc_id")
documents = _table("documents", "doc_id:bigint text:string lang:string source:string n_chars:bigint", pk="doc_id")
TABLES = (region, nation, customer, supplier, part, orders, lineitem, events, labels, documents)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def runtime(spark: SparkSession, sf_dir: str) -> Runtime:
    return Runtime(spark, TABLES, sf_dir)


def _add(name: str, stage: Callable[[], Buildable], sql: str, *args, page: PageRequest | None = None) -> None:
    """A query of the builder; with ``page``, that page of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built, rt = stage(), runtime(spark, sf_dir)
        query = built.build() if isinstance(built, Buildable) else built
        return query.page_df(rt, page, *args) if page else query.to_df(rt, *args)

    _QUERIES[f"q_{name}"], _SQL[f"q_{name}"] = run, sql


def _do(name: str, sql: str):
    """A query that works on a runtime, such as a mutation and the table after it."""

    def keep(fn: Callable[[Runtime], DataFrame]):
        _QUERIES[f"q_{name}"], _SQL[f"q_{name}"] = (lambda spark, sf_dir: fn(runtime(spark, sf_dir))), sql
        return fn

    return keep


# Sources and projection
_add("scan_select", lambda: select(orders.o_orderkey, orders.o_totalprice).from_(orders), "SELECT o_orderkey, o_totalprice FROM orders")
_add("from_first", lambda: from_(customer).select(customer.c_custkey, customer.c_name), "SELECT c_custkey, c_name FROM customer")
_o2 = orders.alias("o2")
_add("alias_select", lambda: select(_o2.o_orderkey, orders.o_custkey.as_("o2")).from_(_o2), "SELECT o_orderkey, o_custkey FROM orders o2")
_add("map_into", lambda: select(*result(id=customer.c_custkey, label=customer.c_name.upper()).cols()).from_(customer), "SELECT c_custkey AS id, upper(c_name) AS label FROM customer")
_add("select_distinct", lambda: select(customer.c_mktsegment.distinct(), customer.c_nationkey).from_(customer), "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_add("case_when", lambda: select(orders.o_orderkey, case().when(orders.o_totalprice.gt_val(200000.0), "high").when(orders.o_totalprice.gt_val(100000.0), "mid").else_("low").end().map_into("band")).from_(orders), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_add("case_no_else", lambda: select(orders.o_orderkey, case().when(orders.o_orderstatus.eq_val("F"), orders.o_totalprice).end().map_into("closed")).from_(orders), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS closed FROM orders")
_add("expr_template", lambda: select(customer.c_custkey, customer.c_name.expr("REVERSE(%s)").map_into("backwards")).from_(customer), "SELECT c_custkey, reverse(c_name) AS backwards FROM customer")
_add("exprf_template", lambda: select(lineitem.l_orderkey, lineitem.l_linenumber, lineitem.l_extendedprice.exprf("%s * (1 - %s)", lineitem.l_discount).map_into("net")).from_(lineitem), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_add("bind_literal", lambda: select(orders.o_orderkey, orders.o_orderstatus.exprf("CONCAT(%s, %s)", bind("-x'y")).map_into("tag")).from_(orders), "SELECT o_orderkey, concat(o_orderstatus, '-x''y') AS tag FROM orders")

# Predicates
_OK = "SELECT o_orderkey FROM orders WHERE "
for _n, _cond, _where in (
    ("eq_val", lambda: orders.o_orderstatus.eq_val("F"), "o_orderstatus = 'F'"),
    ("ne_val", lambda: orders.o_orderstatus.ne_val("F"), "o_orderstatus <> 'F'"),
    ("gt_val", lambda: orders.o_totalprice.gt_val(150000.0), "o_totalprice > 150000"),
    ("gte_val", lambda: orders.o_orderkey.gte_val(500), "o_orderkey >= 500"),
    ("lt_val", lambda: orders.o_totalprice.lt_val(50000.0), "o_totalprice < 50000"),
    ("lte_val", lambda: orders.o_orderkey.lte_val(500), "o_orderkey <= 500"),
    ("between_val", lambda: orders.o_totalprice.between_val(50000.0, 90000.0), "o_totalprice BETWEEN 50000 AND 90000"),
    ("nbetween_val", lambda: orders.o_totalprice.nbetween_val(50000.0, 90000.0), "o_totalprice NOT BETWEEN 50000 AND 90000"),
    ("in_val", lambda: orders.o_orderkey.in_val(1, 2, 3, 77), "o_orderkey IN (1, 2, 3, 77)"),
    ("nin_val", lambda: orders.o_orderkey.nin_val(1, 2, 3, 77), "o_orderkey NOT IN (1, 2, 3, 77)"),
    ("in_val_empty", lambda: orders.o_orderkey.in_val(), "FALSE"),
    ("nin_val_empty", lambda: orders.o_orderkey.nin_val(), "TRUE"),
    ("and_or_nested", lambda: or_(and_(orders.o_orderstatus.eq_val("F"), orders.o_totalprice.gt_val(100000.0)), orders.o_orderkey.lt_val(100)), "(o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderkey < 100"),
    ("and_empty", lambda: and_(), "TRUE"),
    ("or_empty", lambda: or_(), "FALSE"),
    ("pred_template", lambda: orders.o_orderkey.pred("%s %% (%s + 1) = %s", orders.o_custkey, bind(1)), "o_orderkey % (o_custkey + 1) = 1"),
    ("col_vs_col", lambda: orders.o_orderkey.gt(orders.o_custkey), "o_orderkey > o_custkey"),
):
    _add(_n, lambda c=_cond: select(orders.o_orderkey).from_(orders).where(c()), _OK + _where)
for _n, _cond, _where in (
    ("like_val", lambda: part.p_type.like_val("%BRASS%"), "p_type LIKE '%BRASS%'"),
    ("nlike_val", lambda: part.p_type.nlike_val("%BRASS%"), "p_type NOT LIKE '%BRASS%'"),
    ("starts_with", lambda: part.p_name.starts_with_val("a"), "p_name LIKE 'a%'"),
    ("nstarts_with", lambda: part.p_name.nstarts_with_val("a"), "p_name NOT LIKE 'a%'"),
    ("ends_with", lambda: part.p_brand.ends_with_val("3"), "p_brand LIKE '%3'"),
    ("nends_with", lambda: part.p_brand.nends_with_val("3"), "p_brand NOT LIKE '%3'"),
    ("contains", lambda: part.p_name.contains_val("re"), "p_name LIKE '%re%'"),
    ("contains_wildcard", lambda: part.p_name.contains_val("a_e"), "p_name LIKE '%a_e%'"),
    ("ncontains", lambda: part.p_name.ncontains_val("re"), "p_name NOT LIKE '%re%'"),
    ("like_col", lambda: part.p_name.like(part.p_name), "p_name LIKE p_name"),
    ("nlike_col", lambda: part.p_name.nlike(part.p_type), "p_name NOT LIKE p_type"),
):
    _add(_n, lambda c=_cond: select(part.p_partkey).from_(part).where(c()), "SELECT p_partkey FROM part WHERE " + _where)
_add("between_cols", lambda: select(lineitem.l_orderkey, lineitem.l_linenumber).from_(lineitem).where(lineitem.l_tax.between(lineitem.l_discount, lineitem.l_quantity)), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax BETWEEN l_discount AND l_quantity")
_add("nbetween_cols", lambda: select(lineitem.l_orderkey, lineitem.l_linenumber).from_(lineitem).where(lineitem.l_tax.nbetween(lineitem.l_discount, lineitem.l_quantity)), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax NOT BETWEEN l_discount AND l_quantity")
_docs_labels = lambda: select(documents.doc_id).from_(documents).left_join(labels, labels.doc_id.eq(documents.doc_id))
_add("is_null", lambda: _docs_labels().where(labels.quality.is_null()), "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL")
_add("is_not_null", lambda: _docs_labels().where(labels.quality.is_not_null()), "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL")

# Deferred arguments
for _n, _cond, _where, _args in (
    ("eq_var", lambda: nation.n_name.eq_var(), "n_name = 'FRANCE'", ("FRANCE",)),
    ("ne_var", lambda: nation.n_regionkey.ne_var(), "n_regionkey <> 2", (2,)),
    ("gt_lt_var", lambda: and_(nation.n_nationkey.gt_var(), nation.n_nationkey.lt_var()), "n_nationkey > 3 AND n_nationkey < 12", (3, 12)),
    ("gte_lte_var", lambda: and_(nation.n_nationkey.gte_var(), nation.n_nationkey.lte_var()), "n_nationkey >= 3 AND n_nationkey <= 12", (3, 12)),
    ("between_var", lambda: nation.n_nationkey.between_var(), "n_nationkey BETWEEN 4 AND 9", (4, 9)),
    ("nbetween_var", lambda: nation.n_nationkey.nbetween_var(), "n_nationkey NOT BETWEEN 4 AND 9", (4, 9)),
    ("in_var", lambda: nation.n_nationkey.in_var(), "n_nationkey IN (1, 5, 9)", ([1, 5, 9],)),
    ("in_var_empty", lambda: nation.n_nationkey.in_var(), "n_nationkey IN (NULL)", ([],)),
    ("nin_var", lambda: nation.n_nationkey.nin_var(), "n_nationkey NOT IN (1, 5, 9)", ([1, 5, 9],)),
    ("nin_var_empty", lambda: nation.n_nationkey.nin_var(), "TRUE", (None,)),
    ("like_var", lambda: nation.n_name.like_var(), "n_name LIKE '%AN%'", ("%AN%",)),
    ("nlike_var", lambda: nation.n_name.nlike_var(), "n_name NOT LIKE '%AN%'", ("%AN%",)),
    ("starts_with_var", lambda: nation.n_name.starts_with_var(), "n_name LIKE 'A%'", ("A",)),
    ("nstarts_with_var", lambda: nation.n_name.nstarts_with_var(), "n_name NOT LIKE 'A%'", ("A",)),
    ("ends_with_var", lambda: nation.n_name.ends_with_var(), "n_name LIKE '%A'", ("A",)),
    ("nends_with_var", lambda: nation.n_name.nends_with_var(), "n_name NOT LIKE '%A'", ("A",)),
    ("contains_var", lambda: nation.n_name.contains_var(), "n_name LIKE '%AN%'", ("AN",)),
    ("ncontains_var", lambda: nation.n_name.ncontains_var(), "n_name NOT LIKE '%AN%'", ("AN",)),
):
    _add(_n, lambda c=_cond: select(nation.n_nationkey, nation.n_name).from_(nation).where(c()), "SELECT n_nationkey, n_name FROM nation WHERE " + _where, *_args)

# Joins
_nr = lambda: select(nation.n_name, region.r_name).from_(nation)
_add("inner_join", lambda: _nr().inner_join(region, nation.n_regionkey.eq(region.r_regionkey)), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("left_join", lambda: select(documents.doc_id, labels.toxic).from_(documents).left_join(labels, documents.doc_id.eq(labels.doc_id)), "SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_add("right_join", lambda: select(orders.o_orderkey, customer.c_custkey).from_(orders).right_join(customer, orders.o_custkey.eq(customer.c_custkey)), "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
_add("full_join", lambda: select(supplier.s_suppkey, nation.n_nationkey).from_(supplier).full_join(nation, supplier.s_nationkey.eq(nation.n_nationkey)), "SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey")
_r2 = region.alias("r2")
_add("cross_join", lambda: select(region.r_name, _r2.r_name.map_into("other")).from_(region).cross_join(_r2), "SELECT a.r_name, b.r_name AS other FROM region a CROSS JOIN region b")
_add("theta_join", lambda: select(nation.n_name, region.r_name).from_(nation).inner_join(region, nation.n_nationkey.lt(region.r_regionkey)), "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey < r_regionkey")
_add("multi_cond_join", lambda: select(customer.c_custkey, supplier.s_suppkey).from_(customer).inner_join(supplier, customer.c_nationkey.eq(supplier.s_nationkey), customer.c_acctbal.gt(supplier.s_acctbal)), "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
_n2 = nation.alias("n2")
_add("self_join_alias", lambda: select(nation.n_name, _n2.n_name.map_into("neighbour")).from_(nation).inner_join(_n2, nation.n_regionkey.eq(_n2.n_regionkey), nation.n_nationkey.lt(_n2.n_nationkey)), "SELECT a.n_name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_oc = lambda *cols: select(*cols).from_(orders).inner_join(customer, orders.o_custkey.eq(customer.c_custkey)).inner_join(nation, customer.c_nationkey.eq(nation.n_nationkey))
_OC = " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_add("three_way_join", lambda: _oc(orders.o_orderkey, customer.c_name, nation.n_name), "SELECT o_orderkey, c_name, n_name" + _OC)

# Aggregates
_add("group_count", lambda: select(orders.o_orderstatus, orders.o_orderkey.count().map_into("n")).from_(orders).group_by(orders.o_orderstatus), "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders GROUP BY 1")
_q = lineitem.l_quantity
_add("group_sum_avg_min_max", lambda: select(lineitem.l_returnflag, lineitem.l_linestatus, _q.sum().map_into("total"), _q.avg().map_into("mean"), _q.min().map_into("low"), _q.max().map_into("high")).from_(lineitem).group_by(lineitem.l_returnflag, lineitem.l_linestatus), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2")
_add("global_agg", lambda: select(lineitem.l_orderkey.count().map_into("n"), lineitem.l_linenumber.sum().map_into("total")).from_(lineitem), "SELECT count(l_orderkey) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
_add("count_distinct", lambda: select(orders.o_orderpriority, orders.o_custkey.distinct().count().map_into("n")).from_(orders).group_by(orders.o_orderpriority), "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
_add("sum_distinct", lambda: select(lineitem.l_linenumber.distinct().sum().map_into("total"), lineitem.l_linenumber.distinct().avg().map_into("mean")).from_(lineitem), "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS total, avg(DISTINCT l_linenumber) AS mean FROM lineitem")
_add("having", lambda: select(orders.o_custkey, orders.o_orderkey.count().map_into("n")).from_(orders).group_by(orders.o_custkey).having(orders.o_orderkey.count().gt_val(5), orders.o_orderkey.max().gt_val(100)), "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(o_orderkey) > 5 AND max(o_orderkey) > 100")
_add("group_by_expr", lambda: select(orders.o_orderdate.year().map_into("y"), orders.o_orderkey.count().map_into("n")).from_(orders).group_by(orders.o_orderdate.year()), "SELECT substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS y, count(o_orderkey) AS n FROM orders GROUP BY 1")


@_do("plain_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(rt):
    from .compile import compile_count

    return compile_count(select(orders.o_orderkey).from_(orders).where(orders.o_orderstatus.eq_val("F")).spec, rt, ()).agg(F.count(F.lit(1)).alias("n"))


@_do("wrapped_count", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 5)")
def _(rt):
    from .compile import compile_count

    return compile_count(select(orders.o_custkey).from_(orders).group_by(orders.o_custkey).having(orders.o_orderkey.count().gt_val(5)).spec, rt, ()).agg(F.count(F.lit(1)).alias("n"))


# Set operations
_cn, _sn = lambda: select(customer.c_nationkey.map_into("k")).from_(customer), lambda: select(supplier.s_nationkey.map_into("k")).from_(supplier)
_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
_add("union", lambda: _cn().union(_sn()), f"{_C} UNION {_S}")
_add("union_all", lambda: _cn().union_all(_sn()), f"{_C} UNION ALL {_S}")
_add("intersect", lambda: _cn().intersect(_sn()), f"{_C} INTERSECT {_S}")
_add("intersect_all", lambda: _cn().intersect_all(_sn()), f"{_C} INTERSECT ALL {_S}")
_add("except", lambda: _cn().except_(_sn()), f"{_C} EXCEPT {_S}")
_add("except_all", lambda: _cn().except_all(_sn()), f"{_C} EXCEPT ALL {_S}")
_nk = lambda: select(nation.n_nationkey.map_into("k")).from_(nation).where(nation.n_nationkey.lt_val(10))
_N = "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 10"
_add("setop_chain", lambda: _cn().union(_sn()).intersect(_nk()).except_(select(region.r_regionkey.map_into("k")).from_(region)), f"(({_C} UNION {_S}) INTERSECT {_N}) EXCEPT SELECT r_regionkey AS k FROM region")
_add("setop_nested_right", lambda: _cn().except_(_sn().intersect(_nk())), f"{_C} EXCEPT ({_S} INTERSECT {_N})")


# Common table expressions and subqueries
def _rich() -> TableDef:
    return cte("rich", select(customer.c_custkey, customer.c_nationkey, customer.c_acctbal).from_(customer).where(customer.c_acctbal.gt_val(5000.0)))


def _cte():
    rich = _rich()
    return select(nation.n_name, rich.c_custkey).from_(rich).inner_join(nation, rich.c_nationkey.eq(nation.n_nationkey))


_RICH = "rich AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000)"
_add("cte", _cte, f"WITH {_RICH} SELECT n_name, c_custkey FROM rich JOIN nation ON c_nationkey = n_nationkey")


def _cte_nested():
    rich = _rich()
    by = cte("by_nation", select(rich.c_nationkey, rich.c_custkey.count().map_into("n"), rich.c_acctbal.max().map_into("top")).from_(rich).group_by(rich.c_nationkey))
    return select(nation.n_name, by.n, by.top).from_(by).inner_join(nation, by.c_nationkey.eq(nation.n_nationkey)).where(by.n.gt_val(2))


_add("cte_nested", _cte_nested, f"WITH {_RICH}, by_nation AS (SELECT c_nationkey, count(c_custkey) AS n, max(c_acctbal) AS top FROM rich GROUP BY 1) SELECT n_name, n, top FROM by_nation JOIN nation ON c_nationkey = n_nationkey WHERE n > 2")
_big = lambda: select(orders.o_custkey).from_(orders).where(orders.o_totalprice.gt_var())
_add("in_subquery", lambda: select(customer.c_custkey).from_(customer).where(customer.c_custkey.in_(build_subquery(_big(), orders.o_custkey))), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", 200000.0)
_add("not_in_subquery", lambda: select(customer.c_custkey).from_(customer).where(customer.c_custkey.nin(build_subquery(_big(), orders.o_custkey))), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", 200000.0)
_mean = lambda: build_subquery(select(orders.o_totalprice.avg()).from_(orders))
_add("scalar_subquery", lambda: select(orders.o_orderkey).from_(orders).where(orders.o_totalprice.gt(_mean())), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_low, _high = lambda: build_subquery(select(customer.c_nationkey.min()).from_(customer)), lambda: build_subquery(select(supplier.s_nationkey.max()).from_(supplier))
_add("between_subqueries", lambda: select(nation.n_name).from_(nation).where(nation.n_nationkey.between(_low(), _high())), "SELECT n_name FROM nation WHERE n_nationkey BETWEEN (SELECT min(c_nationkey) FROM customer) AND (SELECT max(s_nationkey) FROM supplier)")
_add("exists_uncorrelated", lambda: select(region.r_name).from_(region).where(exists_sub(select(nation.n_name, nation.n_nationkey).from_(nation).where(nation.n_nationkey.eq_val(3)).build())), "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)")
_add("not_exists_uncorrelated", lambda: select(region.r_name).from_(region).where(nexists_sub(select(nation.n_name).from_(nation).where(nation.n_nationkey.eq_val(-3)).build())), "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = -3)")

# Functions
for _n, _e, _t, _k, _sql in (
    ("upper", lambda: customer.c_mktsegment.upper(), customer, customer.c_custkey, "upper(c_mktsegment)"),
    ("lower", lambda: customer.c_mktsegment.lower(), customer, customer.c_custkey, "lower(c_mktsegment)"),
    ("substring", lambda: customer.c_name.substring(2, 4), customer, customer.c_custkey, "substr(c_name, 2, 4)"),
    ("length", lambda: part.p_name.length(), part, part.p_partkey, "CAST(length(p_name) AS INTEGER)"),
    ("trim", lambda: part.p_name.exprf("CONCAT(%s, %s, %s)", part.p_name, bind("  ")).trim(), part, part.p_partkey, "trim(concat(p_name, p_name, '  '))"),
    ("date", lambda: orders.o_orderdate.date(), orders, orders.o_orderkey, "CAST(o_orderdate AS DATE)"),
    ("year", lambda: orders.o_orderdate.year(), orders, orders.o_orderkey, "strftime(o_orderdate, '%Y')"),
    ("month", lambda: orders.o_orderdate.month(), orders, orders.o_orderkey, "strftime(o_orderdate, '%m')"),
    ("day", lambda: orders.o_orderdate.day(), orders, orders.o_orderkey, "strftime(o_orderdate, '%d')"),
    ("event_day", lambda: events.ts.day(), events, events.event_id, "strftime(ts, '%d')"),
    ("round", lambda: orders.o_orderkey.exprf("%s / %s", bind(8.0)).round(1), orders, orders.o_orderkey, "round(o_orderkey / 8.0::DOUBLE, 1)"),
    ("ceil", lambda: orders.o_totalprice.ceil(), orders, orders.o_orderkey, "ceil(o_totalprice)::DOUBLE"),
    ("floor", lambda: orders.o_totalprice.floor(), orders, orders.o_orderkey, "floor(o_totalprice)::DOUBLE"),
    ("abs", lambda: customer.c_acctbal.abs(), customer, customer.c_custkey, "abs(c_acctbal)"),
    ("nullif", lambda: orders.o_orderstatus.nullif("F"), orders, orders.o_orderkey, "nullif(o_orderstatus, 'F')"),
    ("chained_fn", lambda: customer.c_name.trim().upper().substring(1, 3), customer, customer.c_custkey, "substr(upper(trim(c_name)), 1, 3)"),
):
    _add(_n, lambda e=_e, t=_t, k=_k: select(k, e().map_into("x")).from_(t), f"SELECT {_k.name}, {_sql} AS x FROM {_t.name}")
_add("coalesce", lambda: select(documents.doc_id, labels.quality.coalesce(-1).map_into("x")).from_(documents).left_join(labels, documents.doc_id.eq(labels.doc_id)), "SELECT d.doc_id, coalesce(quality, -1) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

# Paging and keyword search
_po = lambda: select(orders.o_orderkey, orders.o_orderstatus, orders.o_totalprice).from_(orders)
_PO = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY "
_add("page_sorted", _po, _PO + "o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 15", page=PageRequest(1, 15, "o_totalprice,o_orderkey", "desc,asc"))
_add("page_offset", _po, _PO + "o_orderkey ASC NULLS FIRST LIMIT 7 OFFSET 14", page=PageRequest(3, 7, "o_orderkey"))
_add("page_multi_sort", _po, _PO + "o_orderstatus DESC NULLS LAST, o_orderkey DESC NULLS LAST LIMIT 20 OFFSET 20", page=PageRequest(2, 20, "o_orderstatus,o_orderkey", "DESC,DESC"))
_kw = lambda: select(part.p_partkey, part.p_name).from_(part).search(part.p_name, part.p_type)
_add("keyword_search", _kw, "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%re%' OR p_type LIKE '%re%' ORDER BY p_partkey LIMIT 1000", page=PageRequest(1, 1000, "p_partkey", "", "re"))
_add("keyword_escaped", _kw, r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%\_%' ESCAPE '\' OR p_type LIKE '%\_%' ESCAPE '\' ORDER BY p_partkey LIMIT 1000", page=PageRequest(1, 1000, "p_partkey", "", "_"))
_add("keyword_ignored_when_empty", lambda: select(part.p_partkey, part.p_name).from_(part).where(part.p_size.gt_val(10)).search(part.p_name), "SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 20", page=PageRequest(1, 20, "p_partkey"))
_add("page_compound", lambda: _cn().union(_sn()), f"SELECT k FROM ({_C} UNION {_S}) ORDER BY k DESC LIMIT 5", page=PageRequest(1, 5, "k", "desc"))


# Mutations: the table afterwards
@_do("insert_rows", "SELECT * FROM nation UNION ALL SELECT max(n_nationkey) + 1, 'ATLANTIS', 1 FROM nation UNION ALL SELECT max(n_nationkey) + 2, 'LEMURIA', 2 FROM nation")
def _(rt):
    mutation.insert(rt, nation, [{"n_name": "ATLANTIS", "n_regionkey": 1}, {"n_name": "LEMURIA", "n_regionkey": 2}])
    return rt.frame(nation)


@_do("update_rows", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THREE' WHEN 5 THEN 'FIVE' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _(rt):
    mutation.update(rt, nation, [{"n_nationkey": 3, "n_name": "THREE"}, {"n_nationkey": 5, "n_name": "FIVE"}])
    return rt.frame(nation)


@_do("update_frame", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def _(rt):
    mutation.update_frame(rt, customer, rt.frame(customer).where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey", "0.0D AS c_acctbal"))
    return rt.frame(customer)


@_do("delete_rows", "SELECT * FROM nation WHERE n_nationkey NOT IN (2, 4)")
def _(rt):
    mutation.delete(rt, nation, [{"n_nationkey": 2}, {"n_nationkey": 4}])
    return rt.frame(nation)


@_do("delete_by_pks", "SELECT * FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
def _(rt):
    mutation.chunked_delete_by_pks(rt, customer.c_custkey, [1, 2, 3, 10**9], size=2)
    return rt.frame(customer)


@_do("upsert_ignore_dups", "SELECT * FROM nation UNION ALL SELECT 900, 'MU', 0")
def _(rt):
    mutation.chunked_insert(rt, nation, [{"n_nationkey": 1, "n_name": "X", "n_regionkey": 0}, {"n_nationkey": 900, "n_name": "MU", "n_regionkey": 0}, {"n_nationkey": 901, "n_name": "MU", "n_regionkey": 0}], ignore_errors=True)
    return rt.frame(nation)


@_do("soft_delete_active", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def _(rt):
    soft = _table("labels", "doc_id:bigint quality:int toxic:bigint", pk="doc_id", deleted_at="toxic")
    rt.publish(soft, rt.frame(labels).withColumn("toxic", F.col("toxic").cast("bigint")))
    return Model(soft).all(active=True).to_df(rt).select("doc_id", "quality")


# Derived lookups
_add("by_pk", lambda: Model(customer).by_pk(), "SELECT * FROM customer WHERE c_custkey = 42", 42)
_add("by_pk_in", lambda: Model(customer).by_pk_in(), "SELECT * FROM customer WHERE c_custkey IN (5, 3)", [5, 3])
_add("by_unique", lambda: Model(nation).by_unique("n_name"), "SELECT * FROM nation WHERE n_name = 'CHINA'", "CHINA")
_add("by_index_prefix", lambda: Model(customer).by_index("c_nationkey"), "SELECT * FROM customer WHERE c_nationkey = 7", 7)
_add("by_index_in", lambda: Model(customer).by_index_in("c_nationkey", "c_mktsegment"), "SELECT * FROM customer WHERE c_nationkey = 7 AND c_mktsegment IN ('BUILDING', 'MACHINERY')", 7, ["BUILDING", "MACHINERY"])
_add("list_all", lambda: Model(region).all(), "SELECT * FROM region")


def _journey():
    busy = build_subquery(select(orders.o_custkey).from_(orders).group_by(orders.o_custkey).having(orders.o_orderkey.count().gte_var()))
    return (
        select(orders.o_orderkey, orders.o_totalprice, orders.o_orderdate, customer.c_name, nation.n_name, region.r_name)
        .from_(orders)
        .left_join(customer, orders.o_custkey.eq(customer.c_custkey))
        .left_join(nation, customer.c_nationkey.eq(nation.n_nationkey))
        .left_join(region, nation.n_regionkey.eq(region.r_regionkey))
        .where(region.r_name.in_var(), orders.o_custkey.in_(busy))
        .search(customer.c_name, nation.n_name)
    )


_add("order_journey", _journey, """
SELECT o_orderkey, o_totalprice, o_orderdate, c_name, n_name, r_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(o_orderkey) >= 12)
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100""", ["ASIA", "EUROPE"], 12, page=PageRequest(1, 100, "o_totalprice,o_orderkey", "desc,asc"))  # fmt: skip


def order_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["q_order_journey"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_verbs  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {n: _SQL[n] for n in queries()}
