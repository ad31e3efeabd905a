import pytest

from larkspur.streaming import StatefulStatement, plan_stream

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path):
    spark.read.parquet(f"{DIR}/events.parquet").write.parquet(str(tmp_path / "events"))
    path = str(tmp_path / "events")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_projection_and_filter(spark, events):
    sql = "SELECT event_id, value * 2 AS v, typeof(event_type) AS k FROM events WHERE user_id % 2 = 1 AND event_type IS NOT 'view'"
    q = plan_stream(sql, {"events": events}).writeStream.format("memory").queryName("got").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{DIR}/events.parquet").filter("user_id % 2 = 1 AND NOT event_type <=> 'view'")
    assert sorted(r[0] for r in spark.table("got").collect()) == sorted(r[0] for r in want.select("event_id").collect())


@pytest.mark.parametrize("sql", ["SELECT event_id FROM events ORDER BY event_id", "SELECT event_id FROM events LIMIT 3", "SELECT DISTINCT user_id FROM events", "SELECT user_id FROM events GROUP BY user_id",
    "SELECT count(*) FROM events", "SELECT row_number() OVER (ORDER BY event_id) AS r FROM events", "WITH e AS (SELECT * FROM events) SELECT event_id FROM e",
    "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events)", "SELECT (SELECT max(user_id) FROM events) AS m FROM events",
    "SELECT e FROM (SELECT max(event_id) AS e FROM events)", "SELECT event_id FROM events UNION ALL SELECT event_id FROM events", "SELECT 1",
])
def test_stateful_statements_are_refused(events, sql):
    with pytest.raises(StatefulStatement):
        plan_stream(sql, {"events": events})
