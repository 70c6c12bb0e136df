"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quarrystat.llm import collocations
from quarrystat.llm.collocations import Mine

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least, inside=100, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, _, left, right = min((1000 * a * n[lang] // (c[p[:j]] * c[p[j:]]), j, c[p[:j]], c[p[j:]]) for j in range(1, len(p)))
            holds = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023
            if not any(holds(q) and 100 * b >= inside * a for q, b in found.items()):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mined(df, cfg):
    rows = collocations.digest(df, cfg).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


@pytest.fixture(scope="module")
def phrases(spark):
    """Planted phrases of 2 to 6 words, ties, words at piece ends, other languages' words, repeated rows, clashing names."""
    r = random.Random(8)
    planted = ["new york city", "Ad hoc", "a b c d e f", "to be or not", "x x x x", "ÄPFEL essen"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(0, 30)):
            words.append(r.choice(planted) if r.random() < 0.4 else f"w{int(r.random() ** 3 * 40)}")
            if r.random() < 0.3:
                words[-1] += r.choice([".", ",", " ;", "!", "?", "\n", "\r", "\x0b", "\t", "  ", ":"])
        rows.append((" ".join(words), r.choice(["en", "de", None, "en", "en"])))
    rows += [(None, "en"), ("", None), (". , !", "de"), ("x " * 5000, "en"), rows[0], rows[0], ("ad hoc", "lonely")]
    df = spark.createDataFrame([(i, t, lang, "k", 1, "f") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long, f string")
    return df.repartition(3), rows


@pytest.mark.parametrize("cfg", [
    Mine(least=10), Mine(least=3, batch_bytes=2000, held_rows=20), Mine(least=5, buckets=1 << 10, chunk=1 << 8), Mine(least=4, inside=60, top=7), Mine(least=10**6),
])
def test_phrases(phrases, cfg):
    """Few buckets, small batches, small tops and shares below one: the same rows as plain counting."""
    df, rows = phrases
    assert mined(df, cfg) == plain(rows, cfg.least, cfg.inside, top=cfg.top)


def test_phrases_of_documents(docs):
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert mined(docs, Mine(least=20)) == plain(rows, 20)


def test_phrases_of_odd_rows(odd, none, nulls):
    rows = [(r["text"], r["lang"]) for r in odd.select("text", "lang").collect()]
    assert mined(odd, Mine(least=3)) == plain(rows, 3)
    assert mined(none, Mine()) == [] and collocations.digest(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert mined(nulls, Mine(least=2)) == plain([(None, None), ("a b c d", None), ("k l m n o p", "en"), ("k l m n o p", "en")], 2)


def test_large_scores(spark):
    """Products past 64 bits keep every digit."""
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(9 * 10**11, 10**13 + 7, 9 * 10**11 + 1, 3 * 10**9 + 1)], "a long, n long, l long, r long")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    got = row.select((whole("a") * whole("n") * 1000).alias("over"), (whole("l") * whole("r")).alias("under")).selectExpr("over div under AS s").first()["s"]
    assert got == 1000 * 9 * 10**11 * (10**13 + 7) // ((9 * 10**11 + 1) * (3 * 10**9 + 1))
