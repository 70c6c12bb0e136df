import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, tiny, long, repeated and near-equal texts, and working names as extra columns."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 4000)}" for _ in range(120)]
    near = lambda k: " ".join(x if i % k else x + "z" for i, x in enumerate(base, 1))
    long = " ".join(f"w{r.randint(0, 300)}" for _ in range(30_000))
    texts = [None, "", " \n\t ", "one", "One TWO three", "one two three", long, long + " tail", near(1000), near(100), near(60), near(40)]
    texts += [near(1000)] * 5 + ["spam spam spam spam spam spam spam spam spam spam spam spam"] * 3
    texts += ["日本 語 Ä É é", "a\x1cb c", "! ! !", "#*$%&|<> " * 12, "<|endoftext|> x  y\n\n\nz", "x\n y \n"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src1", 0, i, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KINDS + ", _q_m long, comp string, f1 long").repartition(3)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows of nulls only, and one document twice."""
    return spark.createDataFrame([(None, None, None, None, None), (None, "a b c d", None, None, None), (4, "k l m n o p", "en", "s", 1), (4, "k l m n o p", "en", "s", 1)], KINDS)
