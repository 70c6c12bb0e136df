"""The edit-distance join and local alignment against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrystat.functions.matching import alignment_score, edit_pairs
from quarrystat.operators.sequences import local_alignment


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(seed, n, alphabet, longest):
    r = random.Random(seed)
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]
    for w in list(out[: n // 2]):  # near copies
        for _ in range(r.randint(1, 3)):
            i = r.randint(0, len(w))
            w = w[:i] + r.choice(["", r.choice(alphabet)]) + w[i + r.randint(0, 1) :]
        out.append(w)
    return out


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
@pytest.mark.parametrize("alphabet, longest", [("ab", 7), ("abcdé", 14)])
def test_edit_pairs(spark, edits, alphabet, longest):
    found = words(edits, 90, alphabet, longest)
    df = spark.createDataFrame([(w,) for w in [*found, *found[:5], None]], "w string")
    got = sorted(tuple(r) for r in edit_pairs(df, "w", edits).collect())
    every = sorted(set(found), key=lambda w: (len(w), w))
    assert got == sorted((a, b, distance(a, b)) for a, b in itertools.combinations(every, 2) if distance(a, b) <= edits)


def test_no_pairs(spark):
    assert edit_pairs(spark.createDataFrame([], "w string"), "w", 2).count() == 0


def test_alignment(spark):
    found = words(7, 40, "abc", 9)
    pairs = list(zip(found, reversed(found)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("s", alignment_score(F.col("a"), F.col("b")))
    assert sorted(tuple(r) for r in df.collect()) == sorted((a, b, local_alignment(a, b)) for a, b in pairs)
