"""Token-ID output: documents are encoded, written as wavelet-matrix shards in doc_id order, and read back.

Texts are dealt out by ranges of (doc_id, text hash) and sorted within a partition, so shards follow each other in
ascending doc_id order. A task closes a shard at ``shard_tokens``; one document is never split. Each shard is one byte
string (see ``wavelet``), one row of a Parquet table in the shared folder, the only store that executors share. A shard knows
the ids before it in its partition; the ids before a partition come from totals by partition, as many rows as partitions.

Ids are those of the tokenizers library on the whole text with add_special_tokens=False (see ``byte_bpe``): the string of a
special token in a text becomes that token's id. With ``special_as_text`` it is ordinary text.

Defined results: null text is empty and has the end id only; rows of equal doc_id follow each other by text hash and text;
a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystat.llm.byte_bpe import ByteBpe
from quarrystat.llm.common import materialize
from quarrystat.llm.texthash import trim, worker_cache
from quarrystat.llm.wavelet import WaveletMatrix, encode


@dataclass(frozen=True)
class Output:
    tokenizer: str
    end_id: int = 0
    shard_tokens: int = 1_000_000
    #: Pieces in each of the two generations of the cache.
    cached: int = 500_000
    batch_bytes: int = 4_000_000
    special_as_text: bool = False


def encoder(cfg: Output) -> ByteBpe:
    cache = worker_cache()
    if cache.get("encoder", (None,))[0] != cfg:
        cache["encoder"] = (cfg, ByteBpe(cfg.tokenizer, cfg.cached, cfg.special_as_text))
    return cache["encoder"][1]


#: ``before``: ids of the partition's shards before this one.
SHARD = "part int, shard int, before long, n_tokens long, blob binary"


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Rows of a batch in slices of about ``most`` bytes of text; a longer text stands alone."""
    texts = batch.column(1)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.column(0).slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo)
        lo = hi


def _write(cfg: Output):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(cfg)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal ids, held, counts, shard, before
            tokens = np.concatenate(held)
            blob = encode(tokens, ids, np.concatenate(counts))
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(tokens)], pa.int64())]
            out = pa.RecordBatch.from_arrays([*row, pa.array([blob], pa.binary())], ["part", "shard", "before", "n_tokens", "blob"])
            ids, held, counts, shard, before = [], [], [], shard + 1, before + len(tokens)
            return out

        for batch in batches:
            for docs, texts in _slices(batch, cfg.batch_bytes):
                tokens, n = enc.encode(texts, cfg.end_id)
                ends = np.cumsum(n)
                lo, at, size = 0, 0, sum(map(len, held))
                while lo < len(docs):
                    # up to the document that fills the shard
                    hi = min(len(docs), int(np.searchsorted(ends, at + cfg.shard_tokens - size, "left")) + 1)
                    ids += docs[lo:hi]
                    held.append(tokens[at : ends[hi - 1]])
                    counts.append(n[lo:hi])
                    size += int(ends[hi - 1]) - at
                    lo, at = hi, int(ends[hi - 1])
                    if size >= cfg.shard_tokens:
                        yield close()
                        size = 0
        if ids:
            yield close()
        trim()

    return run


def write_shards(docs: DataFrame, cfg: Output) -> DataFrame:
    """The table of shards (part, shard, n_tokens, blob), in ascending (part, shard) order of doc_id."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64("text")
    ordered = plain.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), h).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), h, "text"
    )
    return materialize(ordered.mapInArrow(_write(cfg), SHARD), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            wm = WaveletMatrix(blob.as_buffer().to_pybytes())
            tokens = wm.tokens()
            ends = np.cumsum(wm.counts)
            starts = ends - wm.counts
            view = memoryview(tokens).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(wm.doc_ids, pa.int64()), pa.array(starts + start), pa.array(wm.counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        trim()


def read_shards(shards: DataFrame) -> DataFrame:
    """The operator's contract, from the shards alone."""
    by_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as partitions, a number that the session sets
    base = by_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "blob")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, cfg: Output) -> DataFrame:
    return read_shards(write_shards(docs, cfg))


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """Where a token occurs: rows (part, shard, n, first), its count and its first position in each shard that holds it,
    both from the bit-planes without decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(i) for i in range(3))):
                wm = WaveletMatrix(blob.as_py())
                if n := wm.rank(token, wm.n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()], pa.int32()), pa.array([shard.as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([wm.select(token, 0)], pa.int64())],
                        ["part", "shard", "n", "first"],
                    )

    return shards.select("part", "shard", "blob").mapInArrow(run, "part int, shard int, n long, first long")
