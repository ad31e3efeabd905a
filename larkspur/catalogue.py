"""The dialect's queries that the driver runs, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

import atexit
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Engine
from .sources.sqlite_file import ROWID

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NCUST = (
    "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"
)

#: name: (statement of the dialect, SQL for DuckDB or None where the same text serves)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "flagship_top_customers": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None),
    # scan and projection
    "scan_star": ("SELECT * FROM nation", None),
    "project_columns": ("SELECT c_custkey, c_name FROM customer", None),
    "project_alias": ("SELECT c_custkey AS k, c_name n FROM customer", "SELECT c_custkey AS k, c_name AS n FROM customer"),
    "project_rowid": ("SELECT rowid AS rid, c_name FROM customer", "SELECT c_custkey + 1 AS rid, c_name FROM customer"),
    "project_expr_alias": ("SELECT o_orderkey, o_totalprice * 2 AS dbl FROM orders", None),
    "project_literals": ("SELECT r_regionkey, 7 AS i, 'x' AS s, 1.5 AS f, NULL AS n FROM region", "SELECT r_regionkey, 7::BIGINT AS i, 'x' AS s, 1.5::DOUBLE AS f, NULL::INTEGER AS n FROM region"),
    "project_auto_name": ("SELECT p_size+1, typeof(p_brand) FROM part", "SELECT CAST(p_size + 1 AS BIGINT) AS \"p_size+1\", 'text' AS \"typeof(p_brand)\" FROM part"),
    # predicates
    "filter_eq_text": ("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "filter_eq_double_equals": ("SELECT c_custkey FROM customer WHERE c_nationkey == 7", "SELECT c_custkey FROM customer WHERE c_nationkey = 7"),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'O'", None),
    "filter_ne_angle": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_lt_le": ("SELECT p_partkey FROM part WHERE p_size < 10 AND p_retailprice <= 1000.5", None),
    "filter_gt_ge": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey >= 700", None),
    "filter_is_null": ("SELECT c_custkey FROM ncust WHERE c_acctbal IS NULL", f"SELECT c_custkey FROM {NCUST} WHERE c_acctbal IS NULL"),
    "filter_is_not_null": ("SELECT c_custkey FROM ncust WHERE c_mktsegment IS NOT NULL", f"SELECT c_custkey FROM {NCUST} WHERE c_mktsegment IS NOT NULL"),
    "filter_is_value": ("SELECT c_custkey FROM ncust WHERE c_mktsegment IS 'MACHINERY'", f"SELECT c_custkey FROM {NCUST} WHERE c_mktsegment IS NOT DISTINCT FROM 'MACHINERY'"),
    "filter_is_not_value": ("SELECT c_custkey FROM ncust WHERE c_mktsegment IS NOT 'MACHINERY'", f"SELECT c_custkey FROM {NCUST} WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY'"),
    "filter_in_two": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)", None),
    "filter_in_many": ("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1','Brand#4','Brand#9')", None),
    "filter_or": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 20000", None),
    "filter_or_null_operand": ("SELECT c_custkey FROM ncust WHERE c_acctbal > 9000 OR c_mktsegment = 'MACHINERY'", f"SELECT c_custkey FROM {NCUST} WHERE c_acctbal > 9000 OR c_mktsegment = 'MACHINERY'"),
    "filter_or_then_and": ("SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size = 2) AND p_retailprice > 950", None),
    "filter_and_inside_or": ("SELECT p_partkey FROM part WHERE p_size = 1 AND p_retailprice > 950 OR p_size = 50", None),
    "filter_in_and": ("SELECT p_partkey FROM part WHERE p_size IN (1, 2) AND p_retailprice > 950", None),
    "filter_alias": ("SELECT c_name n, c_acctbal b FROM customer WHERE b > 9000", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 9000"),
    "filter_col_col": ("SELECT o_orderkey FROM orders WHERE o_custkey < o_orderkey", None),
    "filter_negative_literal": ("SELECT c_custkey FROM customer WHERE c_acctbal < -500", None),
    "filter_float_literal": ("SELECT c_custkey FROM customer WHERE c_acctbal > 9000.75", None),
    "filter_literal_first": ("SELECT c_custkey FROM customer WHERE 7 = c_nationkey", None),
    "filter_affinity_text_literal": ("SELECT c_custkey FROM customer WHERE c_nationkey = '7'", "SELECT c_custkey FROM customer WHERE c_nationkey = 7"),
    "filter_rowid": ("SELECT c_custkey FROM customer WHERE rowid <= 10", "SELECT c_custkey FROM customer WHERE c_custkey + 1 <= 10"),
    "filter_expression": ("SELECT p_partkey FROM part WHERE p_size * 2 - 1 > 90", None),
    "filter_value_as_condition": ("SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    # order and limits
    # a cut in the middle makes the order count, not only the content
    "sort_asc_desc": ("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 120 OFFSET 40", None),
    "sort_hidden_key": ("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 90 OFFSET 30", None),
    "sort_whole": ("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal) AS at FROM customer ORDER BY c_mktsegment DESC, c_acctbal", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal) AS at FROM customer"),
    "sort_rowid_desc": ("SELECT c_custkey FROM customer ORDER BY rowid DESC LIMIT 5", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5"),
    "sort_nulls_topn": ("SELECT c_custkey, c_acctbal FROM ncust ORDER BY c_acctbal, c_custkey LIMIT 200", f"SELECT c_custkey, c_acctbal FROM {NCUST} ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 200"),
    "topn_desc": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10"),
    "topn_alias": ("SELECT o_orderkey k, o_totalprice p FROM orders ORDER BY p DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "topn_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "topn_ties_by_rowid": ("SELECT c_custkey FROM customer ORDER BY c_nationkey LIMIT 30", "SELECT c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 30"),
    "topn_expression": ("SELECT p_partkey, p_size * p_retailprice AS v FROM part ORDER BY v DESC, p_partkey LIMIT 15", "SELECT p_partkey, p_size * p_retailprice AS v FROM part ORDER BY p_size * p_retailprice DESC, p_partkey LIMIT 15"),
    "topn_lineitem": ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25", None),
    "limit_natural": ("SELECT c_custkey FROM customer LIMIT 25", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25"),
    "limit_zero": ("SELECT c_custkey FROM customer LIMIT 0", None),
    "limit_offset_after_filter": ("SELECT c_custkey FROM customer WHERE c_nationkey = 7 LIMIT 10 OFFSET 3", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 10 OFFSET 3"),
    "filter_sort_topn": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None),
    "or_with_limit": ("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 7 ORDER BY c_custkey LIMIT 15", None),
    # expressions
    "arith_add_sub_mul": ("SELECT p_partkey, p_size + 1 AS a, p_size - 100 AS s, p_size * 3 AS m FROM part", "SELECT p_partkey, CAST(p_size+1 AS BIGINT) AS a, CAST(p_size-100 AS BIGINT) AS s, CAST(p_size*3 AS BIGINT) AS m FROM part"),
    "arith_int_div_mod": ("SELECT p_partkey, (p_size - 25) / 7 AS d, (p_size - 25) % 7 AS m FROM part", "SELECT p_partkey, CAST((p_size-25)//7 AS BIGINT) AS d, CAST((p_size-25)%7 AS BIGINT) AS m FROM part"),
    "arith_div_zero_null": ("SELECT n_nationkey, 10 / n_regionkey AS d, 10 % n_regionkey AS m FROM nation", "SELECT n_nationkey, CAST(10//NULLIF(n_regionkey,0) AS BIGINT) AS d, CAST(10%NULLIF(n_regionkey,0) AS BIGINT) AS m FROM nation"),
    "arith_real_div": ("SELECT o_orderkey, o_totalprice / 4 AS q FROM orders", None),
    "arith_text_operand": ("SELECT n_nationkey, '12abc' + n_nationkey AS s FROM nation", "SELECT n_nationkey, CAST(12 + n_nationkey AS BIGINT) AS s FROM nation"),
    "concat": ("SELECT n_nationkey, n_name || '-' || n_regionkey AS s FROM nation", None),
    "concat_null": ("SELECT c_custkey, c_mktsegment || '!' AS s FROM ncust", f"SELECT c_custkey, c_mktsegment || '!' AS s FROM {NCUST}"),
    "concat_precedence": ("SELECT n_nationkey, CAST(1 + 2 || n_regionkey AS INTEGER) AS s FROM nation", "SELECT n_nationkey, 1 + CAST('2' || n_regionkey AS BIGINT) AS s FROM nation"),
    "unary_minus": ("SELECT c_custkey, -c_acctbal AS neg FROM customer", None),
    "compare_as_value": ("SELECT p_partkey, p_size > 25 AS big, p_brand = 'Brand#1' AS b1 FROM part", "SELECT p_partkey, CAST(p_size > 25 AS BIGINT) AS big, CAST(p_brand = 'Brand#1' AS BIGINT) AS b1 FROM part"),
    "compare_null_as_value": ("SELECT c_custkey, c_acctbal > 0 AS pos FROM ncust", f"SELECT c_custkey, CAST(c_acctbal > 0 AS BIGINT) AS pos FROM {NCUST}"),
    "logic_as_value": ("SELECT c_custkey, c_acctbal > 0 AND c_mktsegment = 'MACHINERY' AS v, NOT c_acctbal > 0 AS w FROM ncust", f"SELECT c_custkey, CAST(c_acctbal > 0 AND c_mktsegment = 'MACHINERY' AS BIGINT) AS v, CAST(NOT c_acctbal > 0 AS BIGINT) AS w FROM {NCUST}"),
    "unary_plus_strips_affinity": ("SELECT c_custkey, c_nationkey = '7' AS e, +c_nationkey = '7' AS u FROM customer", "SELECT c_custkey, CAST(c_nationkey = 7 AS BIGINT) AS e, CAST(typeof(c_nationkey) = typeof('7') AND CAST(c_nationkey AS VARCHAR) = '7' AS BIGINT) AS u FROM customer"),
    "cross_class_compare": (
        "SELECT c_custkey, c_acctbal < c_mktsegment AS lt, c_mktsegment <= 5 AS le, c_acctbal > 'x' AS gt FROM ncust",
        f"SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL THEN 1::BIGINT END AS lt, CASE WHEN c_mktsegment IS NOT NULL THEN 0::BIGINT END AS le, CASE WHEN c_acctbal IS NOT NULL THEN 0::BIGINT END AS gt FROM {NCUST}",
    ),
    "typeof_columns": ("SELECT c_custkey, typeof(c_nationkey) AS tk, typeof(c_acctbal) AS ta, typeof(c_mktsegment) AS tm FROM ncust", f"SELECT c_custkey, 'integer' AS tk, CASE WHEN c_acctbal IS NULL THEN 'null' ELSE 'real' END AS ta, CASE WHEN c_mktsegment IS NULL THEN 'null' ELSE 'text' END AS tm FROM {NCUST}"),
    "typeof_expressions": ("SELECT n_nationkey, typeof(n_nationkey + 1) AS a, typeof(1.5) AS b, typeof(NULL) AS c, typeof(rowid) AS d FROM nation", "SELECT n_nationkey, 'integer' AS a, 'real' AS b, 'null' AS c, 'integer' AS d FROM nation"),
    # extensions beyond the dialect's own statements, after SQLite's documentation
    "ext_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "ext_group_having": ("SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS s, min(c_name) AS a FROM customer GROUP BY c_nationkey HAVING count(*) > 50", "SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS s, min(c_name) AS a FROM customer GROUP BY c_nationkey HAVING count(*) > 50"),
    "ext_count_null": ("SELECT count(*) AS n, count(c_acctbal) AS c, count(DISTINCT c_mktsegment) AS d FROM ncust", f"SELECT count(*) AS n, count(c_acctbal) AS c, count(DISTINCT c_mktsegment) AS d FROM {NCUST}"),
    "ext_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part", None),
    "ext_between_like_not": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND NOT p_brand LIKE 'brand#1%'", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND NOT p_brand ILIKE 'brand#1%'"),
    "ext_not_in": ("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 2)", None),
    "ext_cast": ("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(o_orderkey AS TEXT) AS t FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS t FROM orders"),
    "ext_join": ("SELECT n.n_name, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey > 1", None),
    "ext_join_group": ("SELECT n_name, count(*) AS n, avg(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "ext_left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", None),
    "ext_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "ext_except": ("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier", None),
    "ext_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "ext_derived_table": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE n > 15"),
    "ext_cte": ("WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000), n(k, c) AS (SELECT k, count(*) FROM big GROUP BY k) SELECT k, c FROM n WHERE c > 1", None),
    "ext_window_rank": ("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (ORDER BY c_nationkey) AS rk FROM customer", None),
    "ext_window_frame": ("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part"),
    "ext_in_query": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None),
    "ext_not_in_query": ("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", None),
    "ext_exists": ("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 99)", None),
    "ext_not_exists_correlated": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "ext_in_query_correlated": ("SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > c.c_acctbal)", None),
    "ext_scalar_query": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "ext_scalar_query_correlated": ("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS most FROM nation ORDER BY n_name LIMIT 20", None),
    "ext_scalar_query_same_table": ("SELECT c_custkey FROM customer x WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer y WHERE y.c_nationkey = x.c_nationkey)", None),
    "ext_right_join": ("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 350000", None),
    "ext_full_join": ("SELECT x.k AS a, y.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15) x FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 8) y ON x.k = y.k", None),
    "ext_cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_regionkey", None),
    "ext_natural_join": ("SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier)", None),
    "ext_using": ("SELECT k, n_name, s_suppkey FROM (SELECT n_nationkey AS k, n_name FROM nation) a LEFT JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b USING (k)", None),
    "ext_union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "ext_glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*' AND NOT p_name GLOB '*[xyz]'", None),
    "ext_like_escape": ("SELECT p_partkey, p_brand || '_%' LIKE '%3!_!%' ESCAPE '!' AS e FROM part", "SELECT p_partkey, CAST(p_brand || '_%' ILIKE '%3!_!%' ESCAPE '!' AS BIGINT) AS e FROM part"),
    "ext_bits": ("SELECT p_partkey, p_partkey & 12 AS a, p_size | 3 AS o, p_size << 3 AS l, p_partkey >> 2 AS r, ~p_size AS n FROM part", "SELECT p_partkey, p_partkey & 12 AS a, (p_size | 3)::BIGINT AS o, (p_size::BIGINT << 3) AS l, p_partkey >> 2 AS r, (~p_size)::BIGINT AS n FROM part"),
    "ext_isnull_notnull": ("SELECT c_custkey, c_acctbal ISNULL AS i, c_mktsegment NOTNULL AS n FROM ncust", f"SELECT c_custkey, CAST(c_acctbal IS NULL AS BIGINT) AS i, CAST(c_mktsegment IS NOT NULL AS BIGINT) AS n FROM {NCUST}"),
    "ext_is_distinct_from": ("SELECT c_custkey FROM ncust WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY' AND c_acctbal IS NOT DISTINCT FROM NULL", f"SELECT c_custkey FROM {NCUST} WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY' AND c_acctbal IS NOT DISTINCT FROM NULL"),
    "ext_nulls_last": ("SELECT c_custkey FROM ncust ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 40, 200", f"SELECT c_custkey FROM {NCUST} ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 200 OFFSET 40"),
    "ext_group_concat": ("SELECT n_regionkey AS k, group_concat(n_name, '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "ext_aggregate_filter": ("SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%') AS s FROM orders GROUP BY o_custkey", None),
    "ext_window_order": ("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER () AS n FROM customer ORDER BY rn DESC LIMIT 50 OFFSET 10", None),
    "ext_window_limit": ("SELECT n_nationkey, count(*) OVER () AS n, sum(n_nationkey) OVER (ORDER BY n_name) AS s FROM nation ORDER BY n_nationkey LIMIT 7", "SELECT n_nationkey, count(*) OVER () AS n, CAST(sum(n_nationkey) OVER (ORDER BY n_name) AS BIGINT) AS s FROM nation ORDER BY n_nationkey LIMIT 7"),
    "ext_window_range": ("SELECT p_partkey, count(*) OVER (ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, sum(p_partkey) OVER (ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g FROM part", "SELECT p_partkey, count(*) OVER (ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, CAST(sum(p_partkey) OVER (ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS g FROM part"),
    "ext_window_named": ("SELECT p_partkey, lag(p_size) OVER w AS b, sum(p_size) FILTER (WHERE p_size > 20) OVER (w ROWS 3 PRECEDING) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)", "SELECT p_partkey, lag(p_size) OVER w AS b, CAST(sum(p_size) FILTER (WHERE p_size > 20) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS 3 PRECEDING) AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"),
    "ext_collate": ("SELECT p_partkey FROM part WHERE p_brand = 'BRAND#3' COLLATE NOCASE ORDER BY p_name COLLATE NOCASE, p_partkey LIMIT 30", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#3' ORDER BY lower(p_name), p_partkey LIMIT 30"),
    "ext_no_from": ("SELECT 7 / 2 AS q, 'a' || 1 AS s, NULL IS NULL AS n", "SELECT 3::BIGINT AS q, 'a1' AS s, 1::BIGINT AS n"),
    "ext_values": ("SELECT column1 AS k, column2 AS s, r_name FROM (VALUES (1, 'one'), (3, 'three'), (9, NULL)) LEFT JOIN region ON r_regionkey = column1", "SELECT k::BIGINT AS k, s, r_name FROM (VALUES (1, 'one'), (3, 'three'), (9, NULL)) v(k, s) LEFT JOIN region ON r_regionkey = k"),
}


#: As STATEMENTS, over a SQLite file that holds region and nation.
FILE_STATEMENTS: dict[str, tuple[str, str]] = {
    "sqlite_scan": ("SELECT * FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey::BIGINT END AS n_odd FROM nation"),
    "sqlite_rowid_filter": ("SELECT rowid AS r, n_name FROM nation WHERE r > 7 AND n_odd IS NOT NULL", "SELECT n_nationkey::BIGINT AS r, n_name FROM nation WHERE n_nationkey > 7 AND n_nationkey % 3 > 0"),
    "sqlite_limit": ("SELECT n_name FROM nation LIMIT 6 OFFSET 3", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 6 OFFSET 3"),
    "sqlite_real_affinity": ("SELECT n_nationkey AS k, n_regionkey = '2' AS e, typeof(n_regionkey) AS t, n_regionkey / 2 AS h FROM nation", "SELECT n_nationkey::BIGINT AS k, CAST(n_regionkey = 2 AS BIGINT) AS e, 'real' AS t, n_regionkey / 2.0::DOUBLE AS h FROM nation"),
    "sqlite_join": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name > 'B'", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name > 'B'"),
}


def library_file(spark: SparkSession, sf_dir: str) -> str:
    """A SQLite file with region and nation (30 rows at every scale), in a folder that all machines have."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp() if folder is None else folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"tables-{uuid.uuid4().hex}.db")
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE region(r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
    db.execute("CREATE TABLE nation(n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey REAL, n_odd)")
    db.execute("CREATE INDEX by_region ON nation(n_regionkey)")
    rows = {name: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()] for name in ("region", "nation")}
    db.executemany("INSERT INTO region VALUES(?,?)", rows["region"])
    db.executemany("INSERT INTO nation VALUES(?,?,?,?)", [(*r, r[0] if r[0] % 3 else None) for r in rows["nation"]])
    db.commit()
    db.close()
    return path


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark)
    tables = out.catalogue

    def ncust():
        return tables.add_frame("ncust", spark.read.parquet(f"{sf_dir}/customer.parquet").select(
            "c_custkey", "c_name", "c_nationkey", F.when(~(F.col("c_acctbal") < 0), F.col("c_acctbal")).alias("c_acctbal"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("_metadata.row_index") + 1).alias(ROWID),
        ), ROWID)

    for name in TABLES:
        tables.later[name] = lambda name=name: tables.add_parquet(name, f"{sf_dir}/{name}.parquet")
    tables.later["ncust"] = ncust
    return out


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).plan(sql)


def _file_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sqlite=library_file(spark, sf_dir)).plan(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(sql) for name, (sql, _) in STATEMENTS.items()} | {name: _file_query(sql) for name, (sql, _) in FILE_STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: other or sql for name, (sql, other) in {**STATEMENTS, **FILE_STATEMENTS}.items()}
