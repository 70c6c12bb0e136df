"""Vector search by blocks equals all distances sorted; no step makes a row for each pair."""

import random

from pyspark.sql import functions as F

from quarrystat.functions import vectors


def test_knn(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    r = random.Random(3)
    rows = [(i, [round(r.random(), 1) for _ in range(4)]) for i in range(300)] + [(i, [0.5] * 4) for i in range(300, 400)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows + [(400, None), (401, [1e9, 0.0, 0.0, 0.0])], "id long, v array<float>").repartition(3)
    asked = df.where("id % 20 = 0 AND v IS NOT NULL")
    got = {(x.query_id, x["rank"]): (x.item_id, x.distance) for x in vectors.knn(df, asked, 7, "id", "id", "v").collect()}
    pairs = asked.select(F.col("id").alias("q"), F.col("v").alias("qv")).crossJoin(df.where("v IS NOT NULL")).select("q", "id", F.sqrt(vectors.l2(F.col("v"), F.col("qv"))).alias("d")).collect()
    want = {}
    for q, i, d in sorted(pairs, key=lambda p: (p[0], p[2], p[1])):
        n = sum(k[0] == q for k in want) + 1
        if n <= 7:
            want[q, n] = (i, d)
    assert got == want
    few = vectors.knn(df.where("id IN (399, 400)"), asked, 3, "id", "id", "v").where("query_id = 0").orderBy("rank").collect()
    assert [x.item_id for x in few] == [399, 400] and few[1].distance is None


def test_no_row_for_each_pair(spark):
    df = spark.range(10).selectExpr("id", "array(1.0f * id) AS v")
    plan = vectors.knn(df, df, 2, "id", "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan.split("Join")[0]
