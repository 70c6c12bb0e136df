import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrystat.functions import guard, text
from quarrystat.operators import graph, recursions
from quarrystat.sources import readers
from quarrystat.streaming import events as streams


def _whole(spark):
    spark.range(1).createOrReplaceGlobalTempView("whole")
    return True


def test_guard(spark):
    assert guard.guarded_sql(spark, "SELECT 1 AS a;").collect()[0]["a"] == 1
    assert guard.guarded_sql(spark, "WITH t AS (SELECT 2 AS a) SELECT a FROM t WHERE a > :x", args={"x": 1}).count() == 1
    for bad in ("DROP TABLE x", "CREATE TABLE t (a INT)", "SET a = b", "INSERT INTO t VALUES (1)", "CACHE TABLE t", "SHOW TABLES", "SELECT 1; SELECT 2"):
        with pytest.raises(Exception):
            guard.guarded_sql(spark, bad)
    with pytest.raises(guard.NotAllowed):
        guard.guarded_sql(spark, "SELECT * FROM range(10)", max_rows=9)
    spark.sql("CREATE TABLE IF NOT EXISTS guarded (a INT) USING parquet")
    spark.range(1).createOrReplaceTempView("one_row")
    try:
        for bad in (
            "WITH t AS (SELECT 1 AS a) INSERT INTO guarded SELECT * FROM t",
            "FROM one_row INSERT INTO guarded SELECT CAST(id AS INT) INSERT INTO guarded SELECT 2",
            "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
            "SELECT a FROM (SELECT java_method('java.lang.System', 'nanoTime') AS a)",
            "SELECT * FROM one_row WHERE id IN (SELECT reflect('java.lang.System', 'nanoTime'))",
            "FROM one_row SELECT TRANSFORM(id) USING 'cat' AS (x STRING)",
            "SELECT * FROM text.`/etc/hostname`",
            "SELECT * FROM one_row WHERE id IN (SELECT CAST(value AS INT) FROM text.`/etc/hostname`)",
            "WITH t AS (SELECT * FROM csv.`/etc/hostname`) SELECT * FROM t",
            "SELECT * FROM parquet.`x` p JOIN one_row o ON true",
            "SELECT * FROM read_everything('/etc/hostname')",
        ):
            with pytest.raises(guard.NotAllowed):
                guard.guarded_sql(spark, bad)
        assert spark.table("guarded").count() == 0
    finally:
        spark.sql("DROP TABLE guarded")
    assert guard.guarded_sql(spark, "SELECT count(*) AS n FROM global_temp.whole w JOIN range(3) r ON true").first()["n"] == 3 if _whole(spark) else False
    assert guard.guarded_sql(spark, "SELECT max(a) AS m FROM (SELECT id AS a FROM one_row UNION ALL SELECT 5) WHERE a IN (SELECT 5)").first()["m"] == 5
    assert guard.statement_id("SELECT  1") == guard.statement_id("SELECT\n1")


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, text.mask, "job 12 at 0xFF id 123e4567-e89b-12d3-a456-426614174000") == "job <num> at <hex> id <uuid>"
    assert one(spark, text.redact, "a.b@c.org from 10.0.0.1") == "<email> from <ip>"
    assert one(spark, text.redact, "4111 1111 1111 1111, 4111 1111 1111 1112, 3782-822463-10005") == "<card>, 4111 1111 1111 1112, <card>"
    assert one(spark, text.redact, "call +1 (555) 123-4567 or 555-123-4567; 256.1.1.1 1.2.3.4.") == "call <phone> or <phone>; 256.1.1.1 <ip>."
    assert one(spark, text.redact, "id 123e4567-e89b-12d3-a456-426614174000") == "id <uuid>" and one(spark, text.redact, None) is None
    assert one(spark, text.mask, "mail a@b.c 5") == "mail <email> <num>"
    assert one(spark, text.normal_organisation, " Smith & Sons, Inc. ") == "SMITH AND SONS"
    pairs = lambda v: [tuple(p) for p in one(spark, text.parse_params, v)]
    assert pairs("b=2; a:1=x; junk") == [("a:1", "x"), ("b", "2")] and pairs("plain") == [("raw", "plain")]
    assert one(spark, text.parse_params, None) is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1, Two \n3,\n")
    df = readers.read_any(spark, f"{tmp_path}/a.csv")
    assert df.count() == 2 and readers.unique_headers(["a", "", "a", "a"]) == ["a", "column", "a_2", "a_3"]
    assert [r["y"] for r in readers.normalise(df).collect()] == ["two", None]
    (tmp_path / "r.csv").write_text("a,b,a,,1\n1,2,3,4,5\n")
    assert readers.read_any(spark, f"{tmp_path}/r.csv").columns == ["a", "b", "a_2", "column", "1"]
    assert {r["name"]: r["missing"] for r in readers.profile(df).collect()} == {"x": 0.0, "y": 0.5}
    (tmp_path / "d.sql").write_text("CREATE TABLE t (id INT, name TEXT, PRIMARY KEY (id));\nINSERT INTO t VALUES (1,'a, (b)'),(2,NULL);\nINSERT INTO t VALUES (3,'it''s');\n")
    rows = readers.read_any(spark, f"{tmp_path}/d.sql").collect()
    assert [tuple(r) for r in rows] == [("1", "a, (b)"), ("2", None), ("3", "it's")]
    spark.createDataFrame([("1,000",), ("2",)], "v string").write.json(f"{tmp_path}/j.jsonl")
    assert [r["v"] for r in readers.normalise(readers.read_any(spark, f"{tmp_path}/j.jsonl", "jsonl")).orderBy("v").collect()] == [2.0, 1000.0]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3)], "src long, dst long")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(e, 30).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == 3
    assert {r["node"] for r in graph.k_core(e, 2).collect()} == {1, 2, 3}
    assert {r["node"]: r["depth"] for r in graph.reachable(e, spark.createDataFrame([(1,)], "node long"), 5).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_recursions():
    x = np.concatenate([np.zeros(50), np.ones(50)]) + np.tile([0.01, -0.01], 50)
    assert recursions.cusum(x)[0].max() > 5 and abs(recursions.ewma(x)[-1] - 1) < 0.05
    assert 50 <= recursions.ddm((x > 0.5).astype(int)) < 80 and recursions.page_hinkley(x) > 5
    assert abs(recursions.kalman(x)[-1] - 1) < 0.5
    pdf = pd.DataFrame({"event_type": "a", "ts": range(100), "event_id": range(100), "value": x}).sample(frac=1, random_state=1)
    assert recursions.summarise(pdf)["n"][0] == 100


def run_stream(spark, sf, tmp_path, f, mode="append"):
    kinds = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = f(stream).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out")


def test_stream_counts(spark, sf, tmp_path):
    out = run_stream(spark, sf, tmp_path, streams.tumbling_counts, "complete")
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").count()
    assert out.agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0] and out.count() == batch.count()


def test_stream_sessions_and_distinct(spark, sf, tmp_path):
    assert run_stream(spark, sf, tmp_path, streams.distinct_events).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert run_stream(spark, sf, tmp_path / "b", lambda s: streams.sessions(s, "1 hour")).count() > 0
