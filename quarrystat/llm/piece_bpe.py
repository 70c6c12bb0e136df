"""Whole texts to piece ids by a sentencepiece BPE model, a batch at a time.

No piece of the model holds a space after another character, so merges never cross from a character to a following space:
a text is the sequence of its units, each a run of spaces and what follows it. A batch's units are dictionary-encoded and only
unknown distinct units reach the model. Texts come with a space in front, which stands for the space that the model adds.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

#: Longer units are not kept.
KEPT_BYTES = 200
MARK = "▁"


class PieceBpe:
    """``encode`` gives the model's ids. ``cached`` units in each of two generations bound what is remembered."""

    def __init__(self, path: str, cached: int):
        import sentencepiece

        self.model, self.cached = sentencepiece.SentencePieceProcessor(model_file=path), cached
        pieces = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode("x", out_type=str)[0][0] != MARK:
            raise ValueError("not a model that puts its space mark first")
        self.space = self.model.piece_to_id(MARK)
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)
        raw = lambda i, p: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode()
        self.bytes = pa.array([b"" if special(i) else raw(i, p) for i, p in enumerate(pieces)], pa.binary())
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        # a single space would be an empty text to the model
        ids = [i if i else [self.space] for i in self.model.encode([u[1:] for u in missing], num_threads=1)]
        raw = np.array(list(chain.from_iterable(ids)), dtype="<i4").tobytes()
        ends = (4 * np.cumsum(list(map(len, ids)), dtype=np.int64)).tolist()
        return {u: raw[a:b] for u, a, b in zip(missing, [0, *ends], ends)}

    def _values(self, units: list[str]) -> list[bytes]:
        found = list(map(self.new.get, units))
        unknown = [u for u, b in zip(units, found) if b is None]
        if not unknown:
            return found
        if len(self.new) + len(unknown) > self.cached:
            self.old, self.new = self.new, {}
        told = {u: self.old[u] for u in unknown if u in self.old}
        told |= self._learn([u for u in unknown if u not in told])
        self.new.update({u: b for u, b in told.items() if len(u) <= KEPT_BYTES})
        return [told[u] if b is None else b for u, b in zip(units, found)]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their number in each; texts lie between consecutive ``off`` and are empty or start with a space."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
        space = raw == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[off[:-1][np.diff(off) > 0]] = True
        begin = np.flatnonzero(start)
        edges = np.append(begin, len(raw)).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = cut.dictionary_encode()
        values = self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, long = gather(values, coded.indices.to_numpy())
        ends = np.append(0, np.cumsum(long))
        return ids, np.diff(ends[np.searchsorted(begin, off)])


def gather(values: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit ids of all units in order, and the number of each unit's."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    table = np.frombuffer(b"".join(values), dtype="<i4")
    long = sizes[code]
    ends = np.cumsum(long)
    at = np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - long), long)
    return table[at + np.arange(len(at))], long
