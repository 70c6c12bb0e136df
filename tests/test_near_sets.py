"""Near-duplicate sets are all found."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarrystat.operators import models


def test_near_sets_are_all_pairs(spark, sf):
    rows = models._minhash(spark, sf).collect()
    log = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set(F.concat_ws("=", "event_type", F.floor(F.col("value") / 50))).alias("items")).collect()
    classes = {}
    for r in log:
        classes.setdefault(frozenset(r["items"]), []).append((r.user_id, str(r.day)))
    key = lambda s: ",".join(sorted(s))
    want = {tuple(sorted((key(s), key(t)))) for s, t in combinations(classes, 2) if 10 * len(s & t) >= 7 * len(s | t)}
    want |= {(key(s), key(s)) for s, members in classes.items() if len(members) > 1}
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
    first = {key(s): (f"{min(m)[0]}/{min(m)[1]}", len(m)) for s, m in classes.items()}
    assert all((r.a_id, r.a_copies) == first[r.a] and (r.b_id, r.b_copies) == first[r.b] for r in rows)
    assert any("," not in r.a for r in rows)  # sets of one item stay


def random_sets(spark, n, sizes, items, seed=5):
    draw = random.Random(seed)
    rows = {tuple(sorted(draw.sample([f"i{j}" for j in range(items)], draw.choice(sizes)))) for _ in range(n)}
    return rows, spark.createDataFrame([(",".join(r), list(r), str(i), 1 + i % 2) for i, r in enumerate(sorted(rows))], "key string, items array<string>, id string, copies long")


@pytest.mark.parametrize("sizes, items", [(range(1, 8), 9), (range(9, 21), 22), ([10, 13, 14, 15, 20], 20)])
def test_pairs_of_short_and_long_sets(spark, sizes, items):
    rows, sets = random_sets(spark, 300, list(sizes), items)
    got = [(r.a, r.b, r.distance) for r in models.near_sets(sets).collect() if r.a != r.b]
    near = lambda s, t: 10 * len(s & t) >= 7 * len(s | t)
    want = {(*sorted((",".join(s), ",".join(t))), round(1 - len({*s} & {*t}) / len({*s} | {*t}), 6)) for s, t in combinations(rows, 2) if near({*s}, {*t})}
    assert set(got) == want and len(got) == len(want) > 0


def test_sets_that_meet_are_near(spark, monkeypatch):
    """Sets of few common items once met by one item, nearly all with all, in one task."""
    kept, write = {}, models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, tag: kept.setdefault(tag, write(df, tag)))
    monkeypatch.setattr(models, "MEETING", 1000)
    rows, sets = random_sets(spark, 2000, range(3, 8), 14)
    out = models.near_sets(sets)
    pairs = out.where("a <> b").count()
    met = [r for r in kept["prefix"].groupBy([c for c in kept["prefix"].columns if c not in ("key", "items", "n")]).agg(F.count("*").alias("m")).collect()]
    assert sum(r.m * (r.m - 1) // 2 for r in met) < len(rows) * len(rows) / 50
    assert 0 < pairs < sum(r.m * r.m for r in met)
