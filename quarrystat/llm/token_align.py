"""Alignment of two tokenizers over the same texts.

Both tokenizers cover the bytes of space + text. The sorted byte ends of A's and B's tokens are merged, a whole batch of texts at
once: a merged end is an end of A, of B or of both. Between two merged ends lies one pair of tokens, and each pair of tokens
that overlap has one such stretch, so the merged ends are the links. Ends of both cut the texts into groups.

Links are written once as a table, each document's distinct id pairs with their number. Spark counts the documents that hold a
pair, takes the maxima of both sides and joins them back to the links. Pairs that occur in most documents are joined first, from
a broadcast table of ``hot_pairs`` rows at most: every pair from some count upwards. The other pairs are rarer than that count,
so no key of their shuffled join is hot. The maxima have as many rows as a vocabulary and are broadcast.

Defined results: a null or empty text, or one whose tokens' bytes are not space + text in either tokenizer (a text that holds
U+2581), has no tokens: zeros and ''. Rows of equal or null doc_id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.byte_bpe import ByteBpe
from quarrystat.llm.common import materialize
from quarrystat.llm.piece_bpe import PieceBpe
from quarrystat.llm.texthash import trim, worker_cache


@dataclass(frozen=True)
class Align:
    #: A: a byte-level BPE of the tokenizers library. B: a sentencepiece BPE.
    a: str
    b: str
    #: Pieces in each of the two generations of each cache.
    cached: int = 150_000
    batch_bytes: int = 2_000_000
    hot_pairs: int = 500_000


class Pair:
    """Both tokenizers, the bytes of their tokens and how their ids are written."""

    def __init__(self, cfg: Align):
        self.a, self.b = ByteBpe(cfg.a, cfg.cached, special_as_text=True), PieceBpe(cfg.b, cfg.cached)
        vocab = self.a.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        back = {c: b for b, c in self.a.shown.items()}
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(back.get(ord(c), ord(c)) for c in token) if all(ord(c) in back or ord(c) < 256 for c in token) else b""
        self.a_bytes, self.b_bytes, self.n_a, self.n_b = pa.array(raw, pa.binary()), self.b.bytes, size, len(self.b.bytes)
        shown = [str(i) for i in [*range(self.n_a), *range(self.n_b)]]
        self.shown = pa.array([s + mark for s in shown for mark in ",|;"])


def pair(cfg: Align) -> Pair:
    cache = worker_cache()
    if cache.get("pair", (None,))[0] != cfg:
        cache["pair"] = (cfg, Pair(cfg))
    return cache["pair"][1]


def _raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and their offsets, from 0."""
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    base, size = int(off[0]), int(off[-1] - off[0])
    return np.frombuffer(data, dtype=np.uint8)[base : base + size] if size else np.zeros(0, dtype=np.uint8), off - base


def _same(spelled: np.ndarray, at: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text's tokens spell it; tokens' bytes of the texts lie between consecutive ``at``."""
    if len(spelled) == len(raw) and (spelled == raw).all():
        return np.ones(len(off) - 1, dtype=bool)
    return np.array([spelled[at[d] : at[d + 1]].tobytes() == raw[off[d] : off[d + 1]].tobytes() for d in range(len(off) - 1)], dtype=bool)


def merge(texts: pa.Array, both: Pair) -> dict:
    """Arrays for a batch: of texts n_a, n_b, n_groups, n_links, first (a text's first link); of links a, b (token numbers in the
    batch) and cut (a group ends here); ids a_ids, b_ids."""
    spaced = pc.fill_null(pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(" ", texts, ""), ""), "")
    while True:
        raw, off = _raw(spaced)
        a, n_a = both.a.encode(spaced, 0)
        ends = np.cumsum(n_a)
        inner = np.ones(len(a), dtype=bool)
        inner[ends - 1] = False  # the end ids
        a, n_a = a[inner], n_a - 1
        b, n_b = both.b.encode(raw, off)
        spelled_a, end_a = _raw(both.a_bytes.take(pa.array(a)))
        spelled_b, end_b = _raw(both.b_bytes.take(pa.array(b)))
        to_a, to_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        good = _same(spelled_a, end_a[to_a], raw, off) & _same(spelled_b, end_b[to_b], raw, off)
        if good.all():
            break
        spaced = pc.if_else(pa.array(good), spaced, "")
    mark = np.zeros(len(raw), dtype=np.uint8)
    mark[end_a[1:] - 1] = 1
    mark[end_b[1:] - 1] |= 2
    at = np.flatnonzero(mark)
    kind = mark[at]
    of_a, of_b, cut = kind & 1, kind >> 1, kind == 3
    first = np.searchsorted(at, off)
    groups = np.append(0, np.cumsum(cut))[first]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": np.diff(first), "first": first, "cut": cut,
        "a": np.cumsum(of_a, dtype=np.int64) - of_a, "b": np.cumsum(of_b, dtype=np.int64) - of_b, "a_ids": a.astype(np.int64), "b_ids": b.astype(np.int64),
    }


def written(m: dict, both: Pair) -> Iterator[memoryview]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    last_a, last_b = m["a"][m["cut"]], m["b"][m["cut"]]
    n, mark_a, mark_b = len(last_a), np.zeros(len(m["a_ids"]), dtype=np.int64), np.zeros(len(m["b_ids"]), dtype=np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    group_a = np.repeat(np.arange(n), np.diff(last_a, prepend=-1))
    group_b = np.repeat(np.arange(n), np.diff(last_b, prepend=-1))
    order = np.empty(len(mark_a) + len(mark_b), dtype=np.int64)
    order[np.arange(len(mark_a)) + np.append(0, last_b + 1)[group_a]] = 3 * m["a_ids"] + mark_a
    order[np.arange(len(mark_b)) + (last_a + 1)[group_b]] = 3 * (m["b_ids"] + both.n_a) + mark_b
    raw, off = _raw(both.shown.take(pa.array(order)))
    ends = off[np.append(0, np.cumsum(m["n_a"] + m["n_b"]))].tolist()
    view = memoryview(raw)
    for lo, hi in zip(ends, ends[1:]):
        yield view[lo : max(lo, hi - 1)]


def distinct_pairs(m: dict, both: Pair) -> pa.Array:
    """Each text's distinct id pairs (a, b) with the number n of its links of that pair."""
    docs = len(m["n_links"])
    code = m["a_ids"][m["a"]] * both.n_b + m["b_ids"][m["b"]]
    code += np.repeat(np.arange(docs), m["n_links"]) * (both.n_a * both.n_b)
    code, n = np.unique(code, return_counts=True)
    starts = np.searchsorted(code, np.arange(docs + 1) * (both.n_a * both.n_b))
    code %= both.n_a * both.n_b
    ints = lambda x: pa.array(x.astype(np.int32))
    return pa.ListArray.from_arrays(ints(starts), pa.StructArray.from_arrays([ints(code // both.n_b), ints(code % both.n_b), ints(n)], ["a", "b", "n"]))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
#: ``row`` is a document's number: partition, then place in it.
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"


def _run(cfg: Align, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = pair(cfg), TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(sizes):
                # about batch_bytes of text; a longer text stands alone
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + cfg.batch_bytes, "right")))
                m = merge(batch.column(1).slice(lo, hi - lo), both)
                shas = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in written(m, both)]
                cols = [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), *[pa.array(m[k].astype(np.int64)) for k in NUMBERS]]
                cols += [pa.array(shas, pa.string()), distinct_pairs(m, both)]
                names = ["row", "doc_id", *NUMBERS, "groups_sha256", "pairs"]
                if groups:
                    cols.append(pa.array([bytes(g).decode() for g in written(m, both)], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(cols, names)
                row, lo = row + hi - lo, hi
        trim()

    return run


def align(docs: DataFrame, cfg: Align, groups: bool = False) -> DataFrame:
    """One row for each document with its counts and distinct pairs; with ``groups`` also the groups as written."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_run(cfg, groups), ALIGNED + (", groups string" if groups else ""))


def _key(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of each linked id pair: docs (documents that hold it), links, and whether docs is the highest of its A or its B id."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs"), F.sum("p.n").alias("links"))
    counts = materialize(counts, "pairs")
    # one row an id: as many as the vocabularies have
    top_a = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("top_a")))
    top_b = F.broadcast(counts.groupBy("b").agg(F.max("docs").alias("top_b")))
    return counts.join(top_a, "a").join(top_b, "b").select(
        "a", "b", "docs", "links", (F.col("docs") == F.col("top_a")).alias("best_a"), (F.col("docs") == F.col("top_b")).alias("best_b")
    )


def _hot_from(counts: DataFrame, most: int) -> tuple[int, bool]:
    """A document count from which on at most ``most`` pairs exist, a power of two, and whether all pairs are among them."""
    by_bits = counts.groupBy(F.length(F.bin("docs")).alias("bits")).count().collect()  # 64 rows at most
    least, held = 1 << 62, 0
    for bits, n in sorted(by_bits, reverse=True):
        held += n
        if held > most:
            return least, False
        least = 1 << (bits - 1)
    return least, True


def digest(docs: DataFrame, cfg: Align) -> DataFrame:
    """The operator's contract."""
    aligned = materialize(align(docs, cfg), "aligned")
    counts = materialize(pair_counts(aligned).select(_key(F.col("a"), F.col("b")).alias("k"), "docs", "best_a"), "counts")
    links = aligned.select("row", F.explode("pairs").alias("p")).select("row", _key(F.col("p.a"), F.col("p.b")).alias("k"), F.col("p.n").alias("n"))
    least, every = _hot_from(counts, cfg.hot_pairs)
    sums = [F.sum(F.when(F.col("best_a"), F.col("n"))).alias("best"), F.sum(F.col("n") * F.col("docs")).alias("total")]
    hot = F.broadcast(counts.where(F.col("docs") >= least))
    joined = links.join(hot, "k", "inner" if every else "left")
    parts = joined.groupBy("row").agg(*sums)
    if not every:
        rest = joined.where(F.col("docs").isNull()).select("row", "k", "n").join(counts.where(F.col("docs") < least), "k")
        parts = parts.unionByName(rest.groupBy("row").agg(*sums))
        parts = parts.groupBy("row").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return aligned.drop("pairs").join(parts, "row", "left").select(
        "doc_id", *NUMBERS, zero("best").alias("n_best"), zero("total").alias("count_sum"), "groups_sha256"
    )
