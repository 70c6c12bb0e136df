"""Wavelet matrix over token ids: bit-planes with rank and select, in one byte string.

Tokens are renumbered by their place among the shard's distinct ids, so there are only as many planes as these need.
Layout, little-endian: magic ``QWM1``, u32 tokens n, u32 planes b, u32 documents d, u32 distinct ids a; u32 zeros[b]; a x u32
ids, ascending; d x i64 doc_id, d x u8 null flag, d x u32 token count; then for each plane (highest bit first) u32 counts of ones before each block of 512 bits,
and ceil(n / 8) bytes of bits, least significant first. Each plane holds one bit of every token in that plane's order; the
next plane's order puts the tokens with a 0 here first, both parts keeping their order.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"QWM1", 512


def encode(tokens: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """The file of one shard; ``tokens`` (ids below 2^20) are those of all its documents, one after another."""
    seen = np.bincount(tokens, minlength=1) > 0
    ids = np.flatnonzero(seen)
    bits = max(1, int(len(ids) - 1).bit_length())
    place = np.zeros(len(seen), dtype=np.uint16 if bits <= 16 else np.uint32)
    place[ids] = np.arange(len(ids))
    x = place[tokens]
    n = len(x)
    zeros, body = [], []
    y = np.empty_like(x)
    for p in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << p)) != 0
        packed = np.packbits(one, bitorder="little")
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8)
        before = np.concatenate(([0], np.cumsum(ones.sum(axis=1, dtype=np.uint32)))).astype("<u4")
        body += [before.tobytes(), packed.tobytes()]
        high = int(before[-1])
        zeros.append(n - high)
        np.compress(one, x, out=y[n - high :])
        np.compress(~one, x, out=y[: n - high])
        x, y = y, x
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = MAGIC + struct.pack("<IIII", n, bits, len(doc_ids), len(ids)) + np.array(zeros, dtype="<u4").tobytes()
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    table = [ids.astype("<u4").tobytes(), named.tobytes(), null.tobytes(), np.array(counts, dtype="<u4").tobytes()]
    return b"".join([head, *table, *body])


class WaveletMatrix:
    """Reader of one shard's bytes; nothing is unpacked until asked for."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        self.n, self.bits, d, a = struct.unpack_from("<IIII", blob, 4)
        at = 20
        self.zeros = np.frombuffer(blob, "<u4", self.bits, at).astype(np.int64)
        at += 4 * self.bits
        self.ids = np.frombuffer(blob, "<u4", a, at)
        at += 4 * a
        ids = np.frombuffer(blob, "<i8", d, at)
        null = np.frombuffer(blob, np.uint8, d, at + 8 * d)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.counts = np.frombuffer(blob, "<u4", d, at + 9 * d).astype(np.int64)
        at += 13 * d
        blocks, width = -(-self.n // BLOCK) + 1, -(-self.n // 8)
        self.before, self.planes = [], []
        for _ in range(self.bits):
            self.before.append(np.frombuffer(blob, "<u4", blocks, at))
            self.planes.append(np.frombuffer(blob, np.uint8, width, at + 4 * blocks))
            at += 4 * blocks + width

    def _place(self, token: int) -> int | None:
        """Place of a token among the distinct ids; None if the shard lacks it."""
        i = int(np.searchsorted(self.ids, token))
        return i if i < len(self.ids) and int(self.ids[i]) == token else None

    def _bit(self, p: int, i: int) -> int:
        return (int(self.planes[p][i >> 3]) >> (i & 7)) & 1

    def _ones(self, p: int, i: int) -> int:
        """Ones before position i of plane p."""
        b = i // BLOCK
        first, last = b * (BLOCK // 8), i >> 3
        out = int(self.before[p][b]) + int(np.bitwise_count(self.planes[p][first:last]).sum())
        return out + ((int(self.planes[p][last]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """Token at position i."""
        out = 0
        for p in range(self.bits):
            b, ones = self._bit(p, i), self._ones(p, i)
            out = 2 * out + b
            i = int(self.zeros[p]) + ones if b else i - ones
        return int(self.ids[out])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        place, lo = self._place(token), 0
        if place is None:
            return 0
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, i)
            if (place >> (self.bits - 1 - p)) & 1:
                lo, i = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, i = lo - a, i - b
        return i - lo

    def _select_bit(self, p: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of plane p."""
        before, lo, hi = self.before[p], 0, len(self.before[p]) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            ones = int(before[mid])
            if (ones if bit else min(mid * BLOCK, self.n) - ones) <= k:
                lo = mid
            else:
                hi = mid - 1
        b, ones = lo, int(before[lo])
        part = np.unpackbits(self.planes[p][b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(part == bit)[k - (ones if bit else b * BLOCK - ones)])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token; ValueError if there are fewer."""
        if k < 0 or k >= self.rank(token, self.n):
            raise ValueError("no such occurrence")
        place, lo = self._place(token), 0
        for p in range(self.bits):
            ones = self._ones(p, lo)
            lo = int(self.zeros[p]) + ones if (place >> (self.bits - 1 - p)) & 1 else lo - ones
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = (place >> (self.bits - 1 - p)) & 1
            i = self._select_bit(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order, plane by plane from the lowest."""
        x = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        y = np.empty_like(x)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[p])
            y[np.flatnonzero(~one)] = x[:z]
            y[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (self.bits - 1 - p))
            x, y = y, x
        return self.ids[x]
