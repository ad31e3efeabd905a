"""What Spark makes of statements over Parquet."""

import sqlite3

import duckdb
import pandas as pd
import pytest

from larkspur import catalogue
from larkspur.plans.parser import ParseError, parse
from larkspur.session import Engine

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return catalogue.engine(spark, DIR)


def test_filter_and_columns_reach_the_scan(engine):
    plan = engine.explain("SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = '7'")
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "EqualTo(c_nationkey,7)" in plan
    assert "c_acctbal" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_top_n_is_one_operator(engine):
    plan = engine.explain("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 10 OFFSET 5")
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_no_python_in_plans(engine):
    for sql, _ in catalogue.STATEMENTS.values():
        assert "Python" not in engine.explain(sql) and "ArrowEval" not in engine.explain(sql), sql


def test_several_files_have_one_numbering(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id AS v").coalesce(1).write.parquet(str(tmp_path / "t.parquet" / f"p={i}"))
    e = Engine(spark, parquet=str(tmp_path))
    assert [r[0] for r in e.plan("SELECT v FROM t LIMIT 4 OFFSET 8").collect()] == [8, 9, 10, 11]
    assert [tuple(r) for r in e.plan("SELECT rowid AS r, v FROM t WHERE rowid > 28 ORDER BY v").collect()] == [(29, 28), (30, 29)]


def test_limit_reads_no_more_files_than_it_needs(spark, tmp_path):
    for i in range(40):
        spark.range(i * 100, i * 100 + 100).selectExpr("id AS v", "id % 7 AS m").coalesce(1).write.parquet(str(tmp_path / "t.parquet" / f"p={i:02d}"))
    e = Engine(spark, parquet=str(tmp_path))
    scanned = lambda sql: _files_read(e.plan(sql))
    assert [r[0] for r in e.plan("SELECT v FROM t LIMIT 5 OFFSET 130").collect()] == list(range(130, 135))
    assert scanned("SELECT v FROM t LIMIT 5") == 1
    assert scanned("SELECT v FROM t LIMIT 5 OFFSET 130") == 4
    assert [r[0] for r in e.plan("SELECT v FROM t WHERE m = 3 LIMIT 3 OFFSET 40").collect()] == [v for v in range(4000) if v % 7 == 3][40:43]
    assert scanned("SELECT v FROM t WHERE m = 3 LIMIT 3 OFFSET 40") == 4
    assert [r[0] for r in e.plan("SELECT v FROM t WHERE v > 3990 LIMIT 30").collect()] == list(range(3991, 4000))
    assert e.plan("SELECT v FROM t LIMIT 0").collect() == [] and scanned("SELECT v FROM t ORDER BY v LIMIT 5") == 40


def _files_read(df):
    """Files that the scans of an executed plan read, from the scans' metrics."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif hasattr(plan, "plan") and "QueryStage" in plan.getClass().getSimpleName():
            todo.append(plan.plan())
        elif plan.getClass().getSimpleName() == "FileSourceScanExec":
            found += plan.metrics().apply("numFiles").value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("sql", ["", "SELECT", "SELECT a b c", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT a, FROM t", "SELECT a FROM t ORDER a", "SELECT 'x FROM t", "SELECT a FROM t; SELECT b FROM t", "SELECT a IN 3 FROM t"])
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)


@pytest.mark.parametrize("sql", ["SELECT nope FROM nation", "SELECT n_name FROM nope", "SELECT n_name FROM nation ORDER BY nope", "SELECT x.n_name FROM nation", "SELECT n_name FROM nation a JOIN nation b ON 1", "SELECT a", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE nope = 1)"])
def test_names_fail_when_planned(engine, sql):
    with pytest.raises(LookupError):
        engine.plan(sql)


def test_unknown_function_fails_when_planned(engine):
    with pytest.raises(ValueError, match="no such function"):
        engine.plan("SELECT nope(n_name) FROM nation")


def test_order_is_kept(engine):
    rows = [tuple(r) for r in engine.plan("SELECT c_acctbal, c_custkey FROM ncust ORDER BY c_acctbal DESC, c_custkey").collect()]
    assert rows == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    first = [r[0] for r in engine.plan("SELECT c_mktsegment FROM ncust ORDER BY c_mktsegment").collect()]
    assert first == sorted(first, key=lambda x: (x is not None, x or ""))


def test_peers_of_a_window_stand_in_storage_order(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t(v INTEGER, k INTEGER, p INTEGER)")
    start = 0
    for i, n in enumerate((40, 400, 90)):  # Spark reads the largest file first
        rows = [((7919 * v) % 1009, v % 5, v % 3) for v in range(start, start + n)]
        spark.createDataFrame(rows, "v long, k long, p long").coalesce(1).write.parquet(str(tmp_path / f"made-{i}"))
        next((tmp_path / f"made-{i}").glob("part-*")).rename(tmp_path / "t.parquet" / f"{i}.parquet")
        db.executemany("INSERT INTO t VALUES(?,?,?)", rows)
        start += n
    e = Engine(spark, parquet=str(tmp_path))
    for sql in (  # one window each: SQLite sorts for a second one what the first has sorted
        "SELECT v, row_number() OVER (ORDER BY k DESC) AS r, rank() OVER (ORDER BY k DESC) AS a FROM t",
        "SELECT v, row_number() OVER (PARTITION BY p ORDER BY k) AS r FROM t",
        "SELECT v, ntile(7) OVER (ORDER BY k) AS n, lag(v) OVER (ORDER BY k) AS b FROM t",
        "SELECT v, lead(v, 2) OVER (PARTITION BY p ORDER BY k DESC) AS l FROM t",
        "SELECT v, sum(v) OVER (ORDER BY k ROWS 3 PRECEDING) AS s, sum(v) OVER (ORDER BY k) AS peers, count(*) OVER (ORDER BY k RANGE 1 PRECEDING) AS c FROM t",
        "SELECT v, first_value(v) OVER (ORDER BY k) AS f, last_value(v) OVER (ORDER BY k) AS l FROM t",
        "SELECT v, last_value(v) OVER (PARTITION BY p ORDER BY k DESC) AS l FROM t",
        "SELECT v, last_value(v) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g FROM t",
        "SELECT v, first_value(v) OVER (ORDER BY k RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM t",
        "SELECT v, last_value(v) OVER (PARTITION BY p) AS l FROM t",
        "SELECT v, row_number() OVER () AS r FROM t WHERE p > 0",
        "SELECT DISTINCT row_number() OVER (ORDER BY k) - v AS d FROM t",
        "SELECT rowid AS i, row_number() OVER (ORDER BY k) AS r FROM t ORDER BY k, r LIMIT 70",
        "SELECT p, count(*) AS n, row_number() OVER (ORDER BY p) AS r FROM t GROUP BY p",
        "SELECT p FROM t WHERE v IN (SELECT row_number() OVER (ORDER BY k) FROM t)",
    ):
        assert sorted(map(repr, map(tuple, e.plan(sql).collect()))) == sorted(map(repr, db.execute(sql).fetchall())), sql


def test_sort_whole_over_copies(spark, tmp_path):
    """Rows, numbers and order as SQLite gives them; DuckDB's SQL leaves the numbers of peers open, but not those of their group."""
    rows = spark.read.parquet(f"{DIR}/customer.parquet").toPandas()[["c_custkey", "c_mktsegment", "c_acctbal"]]
    (tmp_path / "customer.parquet").mkdir()
    files = []
    for i, copies in enumerate((range(1), range(1, 6), range(6, 8))):
        files.append(pd.concat([rows.assign(c_custkey=rows.c_custkey + 1000 * c) for c in copies]).sample(frac=1, random_state=i))
        files[-1].to_parquet(tmp_path / "customer.parquet" / f"{i}.parquet", index=False)
    lite = sqlite3.connect(":memory:")
    pd.concat(files).to_sql("customer", lite, index=False)
    got = [tuple(r) for r in catalogue.queries()["sort_whole"](spark, str(tmp_path)).collect()]
    assert got == lite.execute(catalogue.STATEMENTS["sort_whole"][0].replace(" at ", ' "at" ')).fetchall()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    key = {k: (s, a) for f in files for k, s, a in f.itertuples(index=False)}
    want = db.execute(catalogue.oracle_sql()["sort_whole"]).fetchall()
    assert sorted((n, key[k]) for k, n in got) == sorted((n, key[k]) for k, n in want) and {k for k, _ in got} == {k for k, _ in want}
