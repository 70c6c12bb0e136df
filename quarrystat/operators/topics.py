"""Online variational topics (Hoffman, Blei and Bach 2010) over whole texts, every document in every round.

Words are counted by text in tasks and added up by Spark, documents become word numbers with counts once, and a round's sums of words
and topics are added up by Spark; the driver holds the vocabulary and its weights. A document's shares are the fixed point that plain
iteration goes to, found by Newton steps: plain iteration takes hundreds of rounds while topics are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.plans.scratch import materialize

#: Bytes of texts that are split together; cells (words times documents) that are inferred, and added up, together.
TEXTS, CELLS, ADDED = 4_000_000, 30_000, 500_000
#: Bytes of words.
WORD = np.isin(np.arange(256), np.frombuffer(b"0123456789_abcdefghijklmnopqrstuvwxyz", np.uint8))
#: Newton steps of a document, before it goes on plainly; least part of a share that a step leaves.
STEPS, LEAST = 40, 0.1
#: Hash ranges among which equally common words are told apart.
RANGES = 4096


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Document and text of each word, a run of ``_``, digits and letters of ASCII in lower case."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    word = WORD[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    starts, size = edge[0::2], edge[1::2] - edge[0::2]  # the buffer ends in a space, so edges pair up
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in raw]), starts, "right")
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return doc, pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a[word])))


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, pa.Array]]:
    """Document, word and number of each distinct word of a document, the number of documents and the words, for some MB of texts."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, "right")))
        doc, said = _words(texts.slice(at, upto - at))
        coded = said.dictionary_encode()
        terms, most = coded.dictionary, max(len(coded.dictionary), 1)
        cells, n = np.unique(doc * most + coded.indices.to_numpy(), return_counts=True)
        yield cells // most, cells % most, n, upto - at, terms
        at = upto


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, word, n, _, terms in _pieces(batch.column(0)):
            total = np.bincount(word, n, minlength=len(terms)).astype(np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(total[some])], ["word", "n"])


def vocabulary(texts: DataFrame, most: int) -> pa.Array:
    """The ``most`` commonest words ``\\w+`` of ``texts`` (column text, lower case), commonest first; the least common ones that
    are in are told from equals by hash. No task orders all words."""
    words = materialize(texts.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    taken, spare = None, most
    for n, size in sorted(((r.n, r.size) for r in words.groupBy("n").agg(F.count("*").alias("size")).collect()), reverse=True):
        if size > spare:
            equal = words.where(F.col("n") == n).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(RANGES)))
            taken = words.where(F.col("n") > n)
            for r in equal.groupBy("part").agg(F.count("*").alias("size")).orderBy("part").collect():
                if r.size > spare:
                    last = equal.where(F.col("part") == r.part).orderBy(F.xxhash64("word"), "word").limit(spare)
                    taken = taken.unionByName(equal.where(F.col("part") < r.part).drop("part")).unionByName(last.drop("part"))
                    break
                spare -= r.size
            break
        spare -= size
    found = (words if taken is None else taken).select("word", "n").toArrow().combine_chunks()
    return pa.chunked_array(found.sort_by([("n", "descending"), ("word", "ascending")])["word"].chunks, pa.string()).combine_chunks()


def indexed(texts: DataFrame, terms: pa.Array) -> DataFrame:
    """A row for each of ``texts`` with the places of its words in ``terms`` and their numbers."""
    told = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, word, n, docs, own in _pieces(batch.column(0)):
                place = pc.fill_null(pc.index_in(own, value_set=told.value), -1).to_numpy(zero_copy_only=False)[word] if len(word) else word
                known = place >= 0
                upto = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[known], minlength=docs)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(upto, pa.array(x[known].astype(np.int32))) for x in (place, n)]
                yield pa.RecordBatch.from_arrays(lists, ["words", "counts"])

    return texts.select("text").mapInArrow(run, "words array<int>, counts array<int>")


def digamma(x: np.ndarray) -> np.ndarray:
    low = sum(1 / (x + i) for i in range(6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - low


def trigamma(x: np.ndarray) -> np.ndarray:
    low = sum(1 / (x + i) ** 2 for i in range(6))
    x = x + 6
    y = 1 / (x * x)
    return 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66)))) + low


def expected_log(a: np.ndarray) -> np.ndarray:
    """Mean logarithm of shares that are Dirichlet distributed by ``a``."""
    return digamma(a) - digamma(a.sum(-1, keepdims=True))


def _told(shares: np.ndarray, beta: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each word under the document's shares, and its count over that."""
    phi = np.matmul(shares[:, None, :], beta)[:, 0, :] + 1e-100
    return phi, counts / phi


def settle(beta: np.ndarray, counts: np.ndarray, alpha: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """Gamma (documents, topics) where a plain step moves by less than ``tolerance`` in the mean, from words' chances ``beta``
    (documents, topics, places) and ``counts`` (documents, places).

    The bound's gradient is the plain step's move, and its curvature in coordinates scaled by ``d`` is 1 - A. A step divides by the
    absolute curvature, so it goes up; a plain step that moves little ends it."""
    k, live = len(alpha), np.arange(len(counts))
    out = np.empty((len(counts), k))
    now = alpha + counts.sum(1, keepdims=True) / k
    step = 0
    while len(live):
        shares = np.exp(expected_log(now))
        phi, over = _told(shares, beta, counts)
        plain = alpha + shares * np.matmul(beta, over[:, :, None])[:, :, 0]
        left = np.abs(plain - now).sum(1) > tolerance * k
        out[live] = plain
        if 4 * np.count_nonzero(left) <= 3 * len(live):  # copies cost more than some documents that go on in vain
            live, beta, counts, shares, phi, over, plain, now = (x[left] for x in (live, beta, counts, shares, phi, over, plain, now))
        step += 1
        if step <= 2 or step > STEPS or not len(live):
            now = plain
            continue
        d = np.sqrt(trigamma(now))
        both = np.matmul(beta * (over / phi)[:, None, :], beta.transpose(0, 2, 1))
        a = -(shares * d)[:, :, None] * both * (shares * d)[:, None, :]
        a[:, range(k), range(k)] += (plain - alpha) * d * d
        e, u = np.linalg.eigh(a)
        move = np.matmul((d * (plain - now))[:, None, :], u) / np.maximum(np.abs(1 - e), 1e-4)[:, None, :]
        move = np.matmul(move, u.transpose(0, 2, 1))[:, 0, :] / d
        upto = np.where(move < 0, (1 - LEAST) * now / np.maximum(-move, 1e-300), np.inf).min(1)
        now = np.maximum(now + np.minimum(1, upto)[:, None] * move, alpha)
    return out


def _blocks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Documents with words, in blocks of like sizes."""
    order = np.argsort(size, kind="stable")
    order, at = order[np.count_nonzero(size == 0) :], 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * size[order[upto]] <= CELLS:
            upto += 1
        yield order[at:upto]
        at = upto


def infer(words: np.ndarray, counts: np.ndarray, size: np.ndarray, beta: np.ndarray, alpha: np.ndarray, sums: np.ndarray) -> Iterator[np.ndarray]:
    """Gamma of blocks of documents, given one after the other with ``size`` words each; adds to ``sums`` (topics, words)."""
    ends, held = np.cumsum(size), []

    def add() -> None:
        word = np.concatenate([w for w, _ in held])
        for k in range(len(alpha)):
            sums[k] += np.bincount(word, np.concatenate([given[k] for _, given in held]), minlength=sums.shape[1])
        held.clear()

    for block in _blocks(size):
        place = np.arange(size[block].max())
        real = place < size[block][:, None]
        at = np.where(real, (ends - size)[block][:, None] + place, 0)
        word, n = words[at], np.where(real, counts[at], 0).astype(float)
        own = np.ascontiguousarray(beta[word].transpose(0, 2, 1))
        gamma = settle(own, n, alpha)
        shares = np.exp(expected_log(gamma))
        over = _told(shares, own, n)[1]
        held.append((word[real], [(over * shares[:, k : k + 1] * own[:, k])[real] for k in range(len(alpha))]))
        if sum(len(w) for w, _ in held) > ADDED:
            add()
        yield gamma
    if held:
        add()


def lda(rows: DataFrame, terms: int, k: int, rounds: int, seed: int, tau: float = 1024.0, kappa: float = 0.51) -> np.ndarray:
    """Weights (words, topics) after ``rounds`` over all ``rows`` of ``indexed``, with the updates of pyspark.ml's online optimizer:
    weights and alpha move to the round's own by (tau + round) ** -kappa, priors start at 1 / k."""
    sc = rows.sparkSession.sparkContext
    weights = np.random.default_rng(seed).gamma(100, 1 / 100, (terms, k))
    if not terms:
        return weights
    alpha = np.full(k, 1 / k)
    names = [f"s{i}" for i in range(k)]
    for i in range(1, rounds + 1):
        told = sc.broadcast((np.exp(digamma(weights) - digamma(weights.sum(0))), alpha))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            (beta, prior), docs, logs = told.value, 0, np.zeros(k)
            sums = np.zeros((k, terms))
            for batch in batches:
                words, counts = (batch.column(c).flatten().to_numpy() for c in (0, 1))
                size = batch.column(0).value_lengths().to_numpy()
                for gamma in infer(words, counts, size.astype(np.int64), beta, prior, sums):
                    docs, logs = docs + len(gamma), logs + expected_log(gamma).sum(0)
            some = np.flatnonzero(sums.any(0))
            # word -1 has the sums of log shares, and n the documents with words
            table = np.column_stack((sums[:, some], logs))
            n = np.append(np.zeros(len(some), np.int64), docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(n), *map(pa.array, table)], ["word", "n", *names])

        parts = rows.mapInArrow(run, ", ".join(["word long", "n long", *(f"{c} double" for c in names)]))
        total = parts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
        told.unpersist()
        word, n = total["word"].to_numpy(), total["n"].to_numpy().sum()
        if not n:
            break
        sums = np.zeros((terms + 1, k))  # word -1 is the last
        sums[word] = np.column_stack([total[c].to_numpy() for c in names])
        pace = (tau + i) ** -kappa
        weights = (1 - pace) * weights + pace * (sums[:terms] + 1 / k)
        alpha = _prior(alpha, sums[terms] / n, pace)
    return weights


def _prior(alpha: np.ndarray, logs: np.ndarray, pace: float) -> np.ndarray:
    """A Newton step of the documents' prior to mean log shares ``logs``, weighed by ``pace``; none that leaves the positive."""
    grad, c, q = logs - expected_log(alpha), trigamma(alpha.sum()), -trigamma(alpha)
    moved = alpha - pace * (grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
    return moved if (moved > 0).all() else alpha
