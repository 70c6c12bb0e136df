"""Vectorised words and 64-bit hashes of whole texts, for Python workers.

All docs of a batch share one byte buffer. A word's hash is a polynomial over a random byte table, taken from prefix sums
modulo 2^64, then mixed; so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000


def worker_cache() -> dict:
    """A dict that lives as long as the worker process, whatever task it serves."""
    import pyspark

    return pyspark.__dict__.setdefault("_quarrystat_cache", {})


def trim() -> None:
    """Give freed memory back to the system: workers are kept for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _tables(n: int) -> dict:
    """Byte table and powers of an odd base and of its inverse, at least n of them."""
    cache = worker_cache()
    t = cache.get("hash_tables")
    if t is None or len(t["pow"]) < n:
        rng = np.random.default_rng(20240517)
        table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 2**64)
        size = max(n, CHUNK_BYTES + 1)
        powers = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p, dtype=np.uint64))
        t = {"bytes": table, "pow": powers[0], "inv": powers[1]}
        if size <= 8 * CHUNK_BYTES:
            cache["hash_tables"] = t
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Lower-cases A-Z; bytes of longer characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def space_table() -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def count_words(text: str | None) -> int:
    """Number of space-separated words."""
    if not text:
        return 0
    word = space_table()[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    return int(word[0]) + int(np.count_nonzero(word[1:] & ~word[:-1]))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about CHUNK_BYTES together; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > CHUNK_BYTES:
            yield at, i
            at, held = i, 0
        held += n + 1
    if at < len(texts):
        yield at, len(texts)


def hashed_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-separated words of all texts, and the word offsets of each text (one more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = b"\n".join(raw) + b"\n"
    if lower:
        buf = buf.translate(LOWER)
    a = np.frombuffer(buf, dtype=np.uint8)
    word = space_table()[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]  # the buffer ends in a space, so edges pair up
    t = _tables(len(a) + 1)
    sums = np.cumsum(t["bytes"][a] * t["pow"][: len(a)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = mix((sums[ends - 1] - before) * t["inv"][starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return h, np.searchsorted(starts, bounds)


def shingles(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none make none."""
    mult = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
    mult = np.concatenate([mult, mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)])
    for lo, hi in chunks(texts):
        h, off = hashed_words(texts[lo:hi])
        n = len(h)
        every = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            every += h[j : n - k + 1 + j] * mult[j] if n >= k else 0
        every = mix(every)
        for d in range(hi - lo):
            s, e = off[d], off[d + 1]
            if e - s >= k:
                yield np.unique(every[s : e - k + 1])
            elif e > s:
                yield mix(np.sum(h[s:e] * mult[: e - s], dtype=np.uint64, keepdims=True) + np.uint64(e - s))
            else:
                yield np.zeros(0, dtype=np.uint64)
