"""Phrase collocations per language by hashed level-wise counting (PCY, DHP).

Pass k counts the k-word phrases that may still be frequent and, in the same scan, the (k+1)-word phrases by hash bucket.
A phrase is counted exactly only if three bits are set: its bucket of the last pass reached ``least``, and both of its
(k-1)-word parts are frequent (Apriori; frequent phrases set their bit of a second bitmap). A phrase enters the buckets of the
next length only if both of its parts were counted here (DHP). Bits are never missing for a frequent phrase, and what passes is
counted exactly, so hash collisions cost time and nothing else.

Scans are numpy over a batch's bytes; a task adds up its batches, Spark adds up tasks. Bitmaps have ``buckets`` bits whatever
the corpus is, the only thing that every task holds; frequent phrases stay tables and meet by joins.

Defined results: null text is empty, null lang is ``und``; repeated rows count again; phrases never cross a piece or a text;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystat.llm.common import materialize
from quarrystat.llm.texthash import LOWER, hashed_words, mix, trim

#: What ends a piece, and what else stands between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
WORD, BLANK, END = range(3)
UNKNOWN = "und"


@dataclass(frozen=True)
class Mine:
    least: int = 100
    longest: int = 5
    top: int = 2000
    #: A phrase is dropped if a longer one holds it and has this share of its count, in per cent.
    inside: int = 100
    #: Counters and bits; more buckets tell more phrases apart.
    buckets: int = 1 << 22
    chunk: int = 1 << 16
    batch_bytes: int = 1_500_000
    #: Distinct phrases that a task adds up before it hands them on.
    held_rows: int = 150_000


def _kinds() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(BLANKS)] = BLANK
    out[list(PIECE_ENDS)] = END
    return out


def _spread(k: int) -> np.ndarray:
    return mix(np.arange(101, 101 + k, dtype=np.uint64)) | np.uint64(1)


def _lang_hash(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) << 16 | len(x) & 0xFFFF for x in langs], dtype=np.uint64))


class Words:
    """The words of a batch: codes into ``names``, hashes ``h``, pieces and languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array, kinds: np.ndarray):
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        base, size = int(off[0]), int(off[-1] - off[0])
        raw = np.frombuffer((data.slice(base, size).to_pybytes() if size else b"").translate(LOWER), dtype=np.uint8)
        off = off - base
        self.langs = langs.dictionary_encode()
        self.lang_names = self.langs.dictionary.to_pylist()
        kind = kinds[raw]
        word = kind == WORD
        edge = np.empty(size, dtype=bool)
        edge[:1] = True
        edge[1:] = word[1:] != word[:-1]
        edge[off[:-1][np.diff(off) > 0]] = True
        begin = np.flatnonzero(edge)
        cut = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, size).astype(np.int32)), pa.py_buffer(raw))
        coded = cut.dictionary_encode()
        mine = word[begin]
        code = coded.indices.to_numpy(zero_copy_only=False)[mine]
        starts = begin[mine]
        met = np.zeros(len(coded.dictionary), dtype=bool)
        met[code] = True
        self.names = coded.dictionary.filter(pa.array(met))
        self.code = (np.cumsum(met) - 1)[code]
        names = self.names.to_pylist()
        self.h = hashed_words([" ".join(names)], lower=False)[0][self.code] if names else np.zeros(0, dtype=np.uint64)
        doc = np.searchsorted(off, starts, "right") - 1
        ends = np.cumsum(kind == END)[starts] if size else starts
        apart = np.ones(len(starts), dtype=bool)
        apart[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
        self.piece = np.cumsum(apart)
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False)[doc]
        self.salt = _lang_hash(self.lang_names)[self.lang] if len(doc) else np.zeros(0, dtype=np.uint64)

    def bucket(self, k: int, buckets: int) -> np.ndarray:
        """Of the k words from each word on, wherever they lie."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return _bucket(sum(self.h[j : n + j] * m for j, m in enumerate(_spread(k))) + self.salt[:n], buckets)

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece."""
        n = max(0, len(self.h) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def counted(self, at: np.ndarray, k: int) -> pa.Table:
        """Distinct phrases of k words that start ``at``, with their number; equal codes are equal words."""
        size, key = len(self.names), self.lang[at].astype(np.int64)
        room = max(1, len(self.lang_names))
        for j in range(k):
            if room * size >= 1 << 62:
                key, seen = pd.factorize(key)
                room = len(seen)
            key = key * size + self.code[at + j]
            room *= size
        group, distinct = pd.factorize(key)
        first = np.empty(len(distinct), dtype=np.int64)
        first[group[::-1]] = at[::-1]
        n = np.bincount(group, minlength=len(distinct))
        parts = [self.names.take(pa.array(self.code[first + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        return pa.table({"lang": self.langs.dictionary.take(pa.array(self.lang[first])), "phrase": phrase, "n": n})


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(buckets)).astype(np.int64)


#: Either a phrase with a count, or a chunk of bucket counts.
PART = "lang string, phrase string, n long, chunk int, counts binary"


def _phrases(t: pa.Table) -> Iterator[pa.RecordBatch]:
    n = len(t)
    none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    t = t.combine_chunks()
    columns = [t[c].combine_chunks() if n else pa.array([], t[c].type) for c in ("lang", "phrase", "n")]
    yield pa.RecordBatch.from_arrays([*columns, *none], ["lang", "phrase", "n", "chunk", "counts"])


def _chunks(counts: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    for c, lo in enumerate(range(0, len(counts), chunk)):
        part = counts[lo : lo + chunk]
        if part.any():
            columns = [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "chunk", "counts"])


def _scan(cfg: Mine, k: int, reached: bytes | None, frequent: bytes | None):
    """Pass k; ``reached``: bits of buckets of k words, ``frequent``: bits of frequent phrases of k-1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        open_bits = lambda b: np.unpackbits(np.frombuffer(b, dtype=np.uint8)).view(bool)
        may, good = (open_bits(reached), open_bits(frequent)) if k > 1 else (None, None)
        counts = np.zeros(cfg.buckets if k < cfg.longest else 0, dtype=np.int32)
        held: list[pa.Table] = []

        def together() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            return t.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(sizes):
                # about batch_bytes of text; a longer text stands alone
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + cfg.batch_bytes, "right")))
                w = Words(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), kinds)
                keep = w.within(k)
                if k > 1:
                    part = good[w.bucket(k - 1, cfg.buckets)]
                    keep &= part[:-1][: len(keep)] & part[1:][: len(keep)]
                    keep &= may[w.bucket(k, cfg.buckets)]
                held.append(w.counted(np.flatnonzero(keep), k))
                if k < cfg.longest:
                    n = max(0, len(keep) - 1)
                    longer = keep[:n] & keep[1 : n + 1] & w.within(k + 1)
                    np.add.at(counts, w.bucket(k + 1, cfg.buckets)[longer], 1)
                if sum(map(len, held)) > 2 * cfg.held_rows:
                    held = [together()]
                    if len(held[0]) > cfg.held_rows:
                        yield from _phrases(held.pop())
                    pa.default_memory_pool().release_unused()
                del w
                lo = hi
        if held:
            yield from _phrases(together())
        # counts past ``least`` decide as ``least`` does
        yield from _chunks(np.minimum(counts, cfg.least), cfg.chunk)
        trim()

    return run


def _bits(chunks: DataFrame, cfg: Mine, least: int) -> bytes:
    """Bits of the buckets whose counts reach ``least``; a chunk's counts are added up in one group, as many as tasks."""

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.chunk, dtype=np.int64)
        for batch in rows:
            for x in batch.column("counts"):
                found = np.frombuffer(x.as_buffer(), dtype=np.int32)
                total[: len(found)] += found
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["chunk", "bits"])

    out = bytearray(cfg.buckets // 8)
    size = cfg.chunk // 8
    for chunk, bits in chunks.groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect():  # buckets / 8 bytes
        out[chunk * size : (chunk + 1) * size] = bits
    return bytes(out)


def _marked(frequent: DataFrame, cfg: Mine, k: int) -> bytes:
    """Bits of the frequent phrases of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cfg.buckets, dtype=np.int32)
        for batch in batches:
            phrases = batch.column(1).to_pylist()
            h, off = hashed_words(phrases, lower=False)
            if len(h):
                salt = _lang_hash(batch.column(0).to_pylist())
                counts[_bucket(sum(h[off[:-1] + j] * m for j, m in enumerate(_spread(k))) + salt, cfg.buckets)] = 1
        for out in _chunks(counts, cfg.chunk):
            yield out.select(["chunk", "counts"])

    return _bits(frequent.select("lang", "phrase").mapInArrow(run, "chunk int, counts binary"), cfg, 1)


def frequent_phrases(docs: DataFrame, cfg: Mine = Mine()) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, k, f) of the phrases of up to ``longest`` words with ``least`` occurrences, and (lang, n) of words."""
    if cfg.buckets % cfg.chunk or cfg.chunk % 8:
        raise ValueError("buckets must be whole chunks, chunks whole bytes")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    plain = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"))
    levels, reached, marked, words = [], None, None, None
    for k in range(1, cfg.longest + 1):
        parts = materialize(plain.mapInArrow(_scan(cfg, k, reached, marked), PART), f"pass{k}")
        counted = parts.where(F.col("chunk").isNull())
        if k == 1:
            words = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        level = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= cfg.least)
        levels.append(materialize(level.select("lang", "phrase", F.lit(k).alias("k"), "f"), f"level{k}"))
        if k == cfg.longest or levels[-1].isEmpty():
            break
        reached, marked = _bits(parts.where(F.col("chunk").isNotNull()), cfg, cfg.least), _marked(levels[-1], cfg, k)
    return reduce(DataFrame.unionByName, levels), words


def scored(docs: DataFrame, cfg: Mine = Mine()) -> DataFrame:
    """All candidates with their worst cut: lang, phrase, k, a, cut, l, r, n, score, and ``within``, the highest count of a
    candidate one word longer that holds the phrase (null: none). Any longer one counts no more than the one between."""
    found, words = frequent_phrases(docs, cfg)
    every = found.where(F.col("k") > 1).withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    sub = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = every.select("lang", "phrase", "k", "a", "w", cut).select(
        "lang", "phrase", "k", "a", "cut", sub(F.lit(1), F.col("cut")).alias("left"), sub(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        part = found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.join(words, "lang").select(
        "lang", "phrase", "k", "a", "n", "cut", "l", "r", (whole("a") * whole("n") * 1000).alias("over"), (whole("l") * whole("r")).alias("under")
    )
    # whole division of decimals: products may pass 64 bits, the score does not
    worst = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r", "k", "a", "n")).alias("x")
    )
    subs = F.explode(F.array(sub(F.lit(1), F.col("k") - 1), sub(F.lit(2), F.col("k") - 1))).alias("phrase")
    around = every.where(F.col("k") > 2).select("lang", subs, "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    return worst.select("lang", "phrase", "x.*").join(around, ["lang", "phrase"], "left")


def digest(docs: DataFrame, cfg: Mine = Mine()) -> DataFrame:
    """The operator's contract: each language's first phrases."""
    kept = scored(docs, cfg).where(F.col("within").isNull() | (100 * F.col("within") < cfg.inside * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of 64 parts of a language, then the first of those
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    kept = kept.withColumn("place", F.row_number().over(some)).where(F.col("place") <= cfg.top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= cfg.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
