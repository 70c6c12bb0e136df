"""Sequential patterns read whole sequences."""

from pyspark.sql import functions as F

from quarrystat.operators import learning


def test_patterns_of_whole_sequences(spark, tmp_path):
    """Events after the twelfth and patterns of six are seen."""
    kinds = ["a"] * 12 + ["b", "c", "d", "e", "f", "g"]
    rows = [(u * 100 + i, u, f"2026-01-01 00:00:{i:02}", k) for u in range(3) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.pattern: r.freq for r in learning._prefixspan(spark, str(tmp_path)).collect()}
    assert got["b>c>d>e>f>g"] == 3 and got["a>b>g"] == 3
