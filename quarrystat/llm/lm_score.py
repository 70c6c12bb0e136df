"""Stupid-backoff scores of documents under the corpus's own n-gram counts, leaving each document's own counts out.

With c(x) the count of an n-gram over all other documents, a word w after context h scores
    c(hw) / c(h)            if c(hw) > 0,
    backoff * score(w | shorter context)   otherwise, and at last  max(c(w), 1) / (words of all other documents, 1 at least).
A document's score is the mean natural logarithm over its words; words are space-separated, A-Z lower-cased.

The count tables and the exploded n-grams meet in one relational step, partitioned by n-gram hash. Documents are first
written in units of about ``unit_chars`` characters. A unit sends its distinct n-grams with counts to buckets, which are
ranges of the hash; a bucket adds up what all units sent (its part of the count table) and answers each unit with the
totals of just the n-grams it sent (the join); a unit and its answers are co-grouped and summed by document. An answer
needs no keys, as a unit's distinct n-grams in hash order are the same again. Sorted 64-bit keys travel as their low five
bytes and the gaps between their high parts, entropy-coded.

Single words and pairs go in one round, every longer order in a round of its own: an n-gram can stand in another document only
if both (n-1)-grams inside it do, so n-grams without that are not sent; their count elsewhere is known to be zero. No score
changes by this.

Units are one table bucketed by unit, so no round shuffles texts. Units and buckets have fixed sizes, so no task grows with the
corpus, and a frequent n-gram is one key for each unit.

Defined results: null text, or text without words, has n_words 0 and a null score; repeated rows each count and each get a
score; rows with null doc_id are scored like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import bucketed, materialize
from quarrystat.llm.texthash import chunks, count_words, hashed_words, mix, trim


@dataclass(frozen=True)
class Model:
    order: int = 3
    backoff: float = 0.4
    #: Characters of text in a unit, and in what one hash bucket counts.
    unit_chars: int = 8_000_000
    bucket_chars: int = 4_000_000


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one word array: n-gram i starts at word i."""
    out = h.copy()
    for j in range(1, n):
        out = mix(out[:-1] * np.uint64(0xA0761D6478BD642F) + h[j:] + np.uint64(j))
    return out


def _squeeze(x: np.ndarray) -> bytes:
    import zstandard

    width = x.dtype.itemsize
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, width).T.tobytes())


def _stretch(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    return _squeeze(np.ascontiguousarray(counts, dtype="<u8"))


def unpack_counts(blob: bytes) -> np.ndarray:
    return _stretch(blob, "<u8").astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: number of bytes of the gaps, gaps of the high 24 bits, low 40 bits."""
    high = (keys >> np.uint64(40)).astype("<u4")
    gaps = _squeeze(np.diff(high, prepend=np.uint32(0)).astype("<u4"))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
    return len(gaps).to_bytes(4, "little") + gaps + low


def unpack(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    high = np.cumsum(_stretch(blob[4 : 4 + size], "<u4"), dtype=np.uint64)
    out = np.zeros((len(high), 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8, offset=4 + size).reshape(5, -1).T
    return out.view("<u8").ravel() + (high << np.uint64(40))


UNIT = "unit long, chars long, words long, docs binary"
SENT = "unit long, bucket int, keys binary, counts binary"
ANSWER = "unit long, round int, bucket int, totals binary"


def _units(cfg: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            words = sum(count_words(t) for b in held for t in b.column(1).to_pylist())
            number += 1
            row = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([size]), pa.array([words]), pa.array([zstandard.ZstdCompressor(6).compress(sink.getvalue())], pa.binary())],
                ["unit", "chars", "words", "docs"],
            )
            held, size = [], 0
            return row

        for batch in batches:
            n = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()])
            at = 0
            while at < len(n):
                start = n[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(n, start + cfg.unit_chars - size, "right")))
                held.append(batch.slice(at, end - at))
                size += int(n[end - 1] - start)
                at = end
                if size >= cfg.unit_chars or at < len(n):
                    yield close()
        if held:
            yield close()

    return run


def _texts(blob: bytes) -> tuple[pa.ChunkedArray, list[str | None]]:
    import zstandard

    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return table.column(0), table.column(1).to_pylist()


class Unit:
    """The words of a unit's documents: hashes, the document of each word, and n-grams by their first word."""

    def __init__(self, texts: list[str | None]):
        hashes, sizes = [], []
        for lo, hi in chunks(texts):
            h, off = hashed_words(texts[lo:hi])
            hashes.append(h)
            sizes.append(np.diff(off))
        self.h = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        self.sizes = np.concatenate([np.zeros(0, dtype=np.int64), *sizes])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: For each order the counts in other documents, by first word.
        self.rest: list[np.ndarray] = []

    def starts(self, n: int) -> np.ndarray:
        """First words of all n-grams; of those longer than two only the ones that may stand in another document."""
        if len(self.h) < n:
            return np.zeros(0, dtype=np.int64)
        inside = self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]
        if n > 2:
            shorter = self.rest[n - 2] > 0
            inside &= shorter[: len(inside)] & shorter[1 : len(inside) + 1]
        return np.flatnonzero(inside)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.starts(n)
        return at, ngrams(self.h, n)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def of_round(self, r: int, order: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Orders of round r with their first words, and all their n-grams."""
        orders = range(1, min(order, 2) + 1) if r == 1 else (r + 1,)
        found = [(n, *self.grams(n)) for n in orders]
        return [(n, at) for n, at, _ in found], np.concatenate([g for _, _, g in found])

    def learn(self, r: int, order: int, totals: np.ndarray) -> None:
        """Take in the totals of round r's distinct n-grams, less each document's own counts."""
        parts, flat = self.of_round(r, order)
        keys, where = np.unique(flat, return_inverse=True)
        if len(totals) != len(keys):
            raise ValueError("a unit's answers don't fit its n-grams")
        doc = np.concatenate([self.doc[at] for _, at in parts])
        _, own, times = np.unique(where * np.int64(len(self.sizes)) + doc, return_inverse=True, return_counts=True)
        rest, lo = totals[where] - times[own] if len(flat) else totals, 0
        for _, at in parts:
            self.rest.append(np.zeros(len(self.h) + 1, dtype=np.int64))
            self.rest[-1][at] = rest[lo : lo + len(at)]
            lo += len(at)

    def scores(self, words: int, backoff: float) -> np.ndarray:
        """Sums of log scores by document."""
        score = np.log(np.maximum(self.rest[0][:-1], 1)) - np.log(np.maximum(words - self.sizes, 1))[self.doc]
        for n in range(2, len(self.rest) + 1):
            # the n-gram that starts at i predicts word i + n - 1 from the (n-1)-gram that starts at i
            inside = np.flatnonzero(self.doc[: max(len(self.doc) - n + 1, 0)] == self.doc[n - 1 :])
            full, context = self.rest[n - 1][inside], self.rest[n - 2][inside]
            told = np.log(np.maximum(full, 1)) - np.log(np.maximum(context, 1))
            score[inside + n - 1] = np.where(full > 0, told, np.log(backoff) + score[inside + n - 1])
        return np.bincount(self.doc, weights=score, minlength=len(self.sizes))


def _message(unit: int, flat: np.ndarray, buckets: int) -> pa.Table:
    """A unit's distinct n-grams with counts, a row for each bucket that gets some."""
    keys, counts = np.unique(flat, return_counts=True)
    place = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    ends = np.concatenate((cut[1:], [len(keys)])) if len(keys) else cut
    return pa.table(
        {
            "unit": pa.array([unit] * len(cut), pa.int64()),
            "bucket": pa.array(place[cut].astype(np.int32)),
            "keys": pa.array([pack(keys[a:b]) for a, b in zip(cut, ends)], pa.binary()),
            "counts": pa.array([pack_counts(counts[a:b]) for a, b in zip(cut, ends)], pa.binary()),
        }
    )


def _send(cfg: Model, buckets: int):
    """Round 1: single words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _message(unit, Unit(_texts(blob.as_py())[1]).of_round(1, cfg.order)[1], buckets).to_batches()
                trim()

    return run


def _told(answers: pa.Table, r: int) -> np.ndarray:
    own = answers.filter(pc.equal(answers.column("round"), r)).sort_by("bucket").column("totals").to_pylist()
    return np.concatenate([np.zeros(0, dtype=np.int64), *map(unpack_counts, own)])


def _resend(cfg: Model, buckets: int, r: int):
    """Round r: the n-grams of order r + 1 that what earlier rounds told leaves."""

    def run(key: tuple, units: pa.Table, answers: pa.Table) -> pa.Table:
        own = Unit(_texts(units.column("docs")[0].as_py())[1])
        for q in range(1, r):
            own.learn(q, cfg.order, _told(answers, q))
        out = _message(key[0].as_py(), own.of_round(r, cfg.order)[1], buckets)
        del own
        trim()
        return out

    return run


def _summed(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the messages, the distinct keys, the place of each message's keys among them, and their totals."""
    keys = [unpack(b) for b in table.column("keys").to_pylist()]
    counts = [unpack_counts(b) for b in table.column("counts").to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return list(map(len, keys)), every, where, np.bincount(where, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def _answer(r: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A hash bucket: adds up what all units count, and answers each with the totals of its keys, in their order."""
        sizes, _, where, totals = _summed(table)
        told, at = totals[where], np.cumsum([0, *sizes])
        out = pa.array([pack_counts(told[a:b]) for a, b in zip(at, at[1:])], pa.binary())
        del where, totals, told
        trim()
        return pa.table({"unit": table.column("unit"), "round": pa.array([r] * len(sizes), pa.int32()), "bucket": table.column("bucket"), "totals": out})

    return run


def _score(cfg: Model, words: int, rounds: int):
    def run(key: tuple, units: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _texts(units.column("docs")[0].as_py())
        own = Unit(texts)
        for r in range(1, rounds + 1):
            own.learn(r, cfg.order, _told(answers, r))
        sums, n = own.scores(words, cfg.backoff), own.sizes
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        del own, texts
        trim()
        return pa.table({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "lm_score": mean})

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _buckets(cfg: Model, chars: int | None) -> int:
    return max(1, -(-(chars or 0) // cfg.bucket_chars))


def score(docs: DataFrame, cfg: Model = Model()) -> DataFrame:
    """One row for each document: doc_id, n_words, lm_score (mean log score of a word; null without words)."""
    units = bucketed(_plain(docs).mapInArrow(_units(cfg), UNIT), "unit", "units")
    total = units.agg(F.sum("chars").alias("chars"), F.sum("words").alias("words")).first()
    buckets, texts, answers = _buckets(cfg, total["chars"]), units.select("unit", "docs"), None
    rounds = max(1, cfg.order - 1)
    for r in range(1, rounds + 1):
        if answers is None:
            sent = texts.mapInArrow(_send(cfg, buckets), SENT)
        else:
            sent = texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_resend(cfg, buckets, r), SENT)
        told = sent.groupBy("bucket").applyInArrow(_answer(r), ANSWER)
        if r < rounds:
            told = materialize(told, "answers")  # two later rounds read it
        answers = told if answers is None else answers.unionByName(told)
    return texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_score(cfg, total["words"] or 0, rounds), "doc_id long, n_words long, lm_score double")


def count_table(docs: DataFrame, order: int, cfg: Model = Model()) -> DataFrame:
    """The counts of all n-grams of one order: rows (bucket, hash, n), partitioned by bucket, ranges of the hash."""
    units = materialize(_plain(docs).mapInArrow(_units(cfg), UNIT), "units")
    buckets = _buckets(cfg, units.agg(F.sum("chars").alias("chars")).first()["chars"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Unit(_texts(blob.as_py())[1])
                own.rest = [np.ones(len(own.h) + 1, dtype=np.int64)] * order  # nothing is left out
                yield from _message(unit, own.grams(order)[1], buckets).to_batches()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        _, every, _, totals = _summed(table)
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(every), pa.int32()), "hash": every.view(np.int64), "n": totals})

    return units.select("unit", "docs").mapInArrow(send, SENT).groupBy("bucket").applyInArrow(add, "bucket int, hash long, n long")


def digest(docs: DataFrame, cfg: Model = Model()) -> DataFrame:
    """The operator's query: the scores, rounded."""
    return score(docs, cfg).select("doc_id", "n_words", F.round("lm_score", 6).alias("lm_score"))
