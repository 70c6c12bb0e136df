"""Topics read every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarrystat.operators import models, topics


def test_topics_see_every_document(spark, tmp_path):
    """A word that only one rare kind of document has leads a topic, and no common-word bound hides it."""
    common = [(i, " ".join(f"c{(i * 7 + j) % 2500}" for j in range(60))) for i in range(300)]
    rare = [(1000 + i, "zebra quagga okapi " * 400) for i in range(2)]
    spark.createDataFrame(common + rare, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {t for r in models._topics(spark, str(tmp_path)).collect() for t in r.terms.split()}
    assert {"zebra", "quagga", "okapi"} <= seen
    assert models.VOCABULARY > 2000


def _plainly(beta, counts, alpha):
    """The fixed point of one document by plain steps alone, and how many steps it took."""
    now, moved, n = alpha + counts.sum() / len(alpha), 1.0, 0
    while moved > 1e-9:
        shares = np.exp(topics.expected_log(now))
        new = alpha + shares * (beta @ (counts / (shares @ beta)))
        moved, now, n = np.abs(new - now).sum(), new, n + 1
    return now, n


def _bound(gamma, beta, counts, alpha):
    logs = topics.expected_log(gamma)
    gammas = sum(math.lgamma(g) for g in gamma) - math.lgamma(gamma.sum())
    return counts @ np.log(np.exp(logs) @ beta) + (alpha - gamma) @ logs + gammas


def test_inference_of_like_topics_takes_few_steps(monkeypatch):
    """Plain steps took thousands while topics were alike; the fixed points are the same or have a higher bound."""
    rng = np.random.default_rng(5)
    beta, alpha = rng.gamma(100, 0.01, (5, 3000)) / 3000, np.full(5, 0.2)
    counts = rng.poisson(1.5, (12, 3000)).astype(float)
    seen, told = [], topics._told
    monkeypatch.setattr(topics, "_told", lambda *a: seen.append(1) or told(*a))
    got = topics.settle(np.repeat(beta[None], 12, 0), counts, alpha)
    assert len(seen) < 60
    steps = []
    for gamma, n in zip(got, counts):
        want, took = _plainly(beta, n, alpha)
        steps.append(took)
        shares = np.exp(topics.expected_log(gamma))
        assert np.abs(alpha + shares * (beta @ (n / (shares @ beta))) - gamma).sum() < 0.01
        assert _bound(gamma, beta, n, alpha) > _bound(want, beta, n, alpha) - 0.5
    assert np.median(steps) > 500


def test_sums_of_documents_of_all_sizes(monkeypatch):
    """Sums of words and topics hold every word once, whatever the blocks."""
    rng, found = np.random.default_rng(2), []
    size = np.array([0, 7, 1, 30, 0, 12, 30])
    words, counts = rng.integers(0, 40, size.sum()), rng.integers(1, 5, size.sum())
    beta = rng.gamma(1, 1, (40, 5)) + 0.01
    for cells, added in ((1, 1), (60, 20), (30_000, 500_000)):
        monkeypatch.setattr(topics, "CELLS", cells)
        monkeypatch.setattr(topics, "ADDED", added)
        sums = np.zeros((5, 40))
        n = sum(len(g) for g in topics.infer(words, counts, size, beta, np.full(5, 0.2), sums))
        assert n == 5 and sums.sum(0) == pytest.approx(np.bincount(words, counts, minlength=40))
        found.append(sums)
    assert np.allclose(found[0], found[1], atol=0.05) and np.allclose(found[0], found[2], atol=0.05)


@pytest.mark.parametrize("most", [1, 3, 9, 60, 1000])
def test_vocabulary_is_the_commonest_words(spark, monkeypatch, most):
    """Equals are told apart without ordering all words; no empty word stands for what surrounds a text's words."""
    monkeypatch.setattr(topics, "TEXTS", 50)
    monkeypatch.setattr(topics, "RANGES", 7)
    texts = [f"({' '.join(f'W{j % (i + 1)}' for j in range(2 * i))}) été_{i}!" for i in range(40)] + ["", " ...", "İx"]
    counts = Counter(w for t in texts for w in re.findall(r"[a-z0-9_]+", t.lower()))
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = topics.vocabulary(rows, most)
    got = [counts[w] for w in terms.to_pylist()]
    assert len(set(terms.to_pylist())) == len(got) and got == sorted(counts.values(), reverse=True)[:most]
    index = topics.indexed(rows, terms).collect()
    total = Counter()
    for r in index:
        total.update(dict(zip((terms[w].as_py() for w in r.words), r.counts)))
    assert len(index) == len(texts) and total == {w: counts[w] for w in terms.to_pylist()}


def test_planted_topics_are_found(spark):
    """Texts of two word sets give topics of one set each."""
    rows = spark.createDataFrame([(" ".join(f"{'ab'[i % 2]}{(i * 7 + j) % 30}" for j in range(50)),) for i in range(200)], "text string")
    terms = topics.vocabulary(rows, 100)
    weights = topics.lda(topics.indexed(rows, terms), len(terms), k=2, rounds=10, seed=3)
    lead = [{terms[int(i)].as_py()[0] for i in np.argsort(-weights[:, k])[:10]} for k in range(2)]
    assert sorted(map(sorted, lead)) == [["a"], ["b"]]


def test_no_words_no_topics(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, " ... ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.terms for r in models._topics(spark, str(tmp_path)).collect()] == [""] * 5
