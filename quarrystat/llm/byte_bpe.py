"""Whole texts to token ids by a byte-level BPE tokenizer, a batch at a time and without Python code per piece.

The tokenizer's pattern is applied to all texts of an Arrow array at once: characters get classes (letter, number, space,
other white space, other), a piece starts where the pattern starts a match, and the pieces, which are slices of the array's
own buffer, are dictionary-encoded. Only a batch's distinct pieces are looked up; unknown ones go to the tokenizer's own model.
Ids are gathered by piece. Classes are asked of the tokenizer itself, once for each code point that occurs.

A text that holds the string of an added token goes to the tokenizer whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNKNOWN, LETTER, NUMBER, OTHER, SPACE, WHITE = range(6)
#: Longer pieces are not kept.
KEPT_BYTES = 200


class ByteBpe:
    """``encode`` gives the tokenizer's ids. ``cached`` pieces in each of two generations bound what is remembered."""

    def __init__(self, path: str, cached: int, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.cached = self.tokenizer.model, cached
        # byte-level letters: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: 256 + i for i, b in enumerate(hidden)}
        self.split = self.tokenizer.pre_tokenizer
        plain = isinstance(self.split, ByteLevel) and self.split.use_regex and not self.split.add_prefix_space
        if not plain or self.tokenizer.normalizer is not None or self._letters("\x00 aé") != "ĀĠaÃ©":
            raise ValueError("not a byte-level tokenizer with the known pattern")
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.classes = np.zeros(0x110000, dtype=np.uint8)
        self._classify(np.arange(0x80))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _letters(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.shown)

    def _classify(self, points: np.ndarray) -> None:
        """Classes by how the tokenizer splits a character from a letter, a number and a mark."""
        one = lambda s: len(self.split.pre_tokenize_str(s)) == 1
        for p in points.tolist():
            c = chr(p)
            self.classes[p] = SPACE if c == " " else LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else WHITE

    def _characters(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets and classes of all characters."""
        if not len(raw) or raw.max() < 0x80:
            return np.arange(len(raw), dtype=np.int32), self.classes[raw]
        at = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
        lead = raw[at]
        classes = self.classes[np.minimum(lead, 0x7F)]
        many = np.flatnonzero(lead >= 0x80)
        start, lead = at[many], lead[many].astype(np.int32)
        tail = lambda j: (raw[np.minimum(start + j, len(raw) - 1)] & 0x3F).astype(np.int32)
        two = (lead & 0x1F) << 6 | tail(1)
        three = (lead & 0x0F) << 12 | tail(1) << 6 | tail(2)
        four = (lead & 0x07) << 18 | tail(1) << 12 | tail(2) << 6 | tail(3)
        points = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
        met = np.zeros(0x110000, dtype=bool)
        met[points] = True
        self._classify(np.flatnonzero(met & (self.classes == UNKNOWN)))
        classes[many] = self.classes[points]
        return at, classes

    def starts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces start; texts lie between consecutive ``off``."""
        at, cls = self._characters(raw)
        n = len(at)
        if not n:
            return np.zeros(0, dtype=np.int32)
        first = np.zeros(n + 4, dtype=bool)  # starts of texts, and the end
        first[np.searchsorted(at, off)] = True
        first[n:] = True
        white = cls >= SPACE
        start = np.empty(n + 4, dtype=bool)
        start[0] = True
        # a run of one class is a piece and a single space before it belongs to it
        start[1:n] = np.where(white[1:], ~white[:-1], (cls[1:] != cls[:-1]) & (cls[:-1] != SPACE))
        # of several white characters before another character the last stands apart
        last = np.zeros(n, dtype=bool)
        last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
        start[:n] |= last | first[:n]
        mark = np.flatnonzero((raw[at] == 0x27) & start[:n])
        letter = lambda j: np.where(first[mark + j], 0, raw[at[np.minimum(mark + j, n - 1)]])
        one = letter(1)
        two = np.where(one == 0, 0, letter(2))
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 1] = False
        start[mark[long] + 2] = False
        start[mark[long] + 3] = True
        return at[start[:n]]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        tokenize, ids, sizes = self.model.tokenize, [], []
        for p in missing:
            found = tokenize(p.replace(" ", "Ġ") if p.isascii() and p.isprintable() else self._letters(p))
            ids.append([t.id for t in found])
            sizes.append(len(found))
        raw = np.array(list(chain.from_iterable(ids)), dtype=self.kind).tobytes()
        ends = (np.cumsum(sizes, dtype=np.int64) * np.dtype(self.kind).itemsize).tolist()
        return {p: raw[a:b] for p, a, b in zip(missing, [0, *ends], ends)}

    def _values(self, pieces: list[str], whole: set[str]) -> list[bytes]:
        """Ids of distinct pieces, as bytes."""
        found = list(map(self.new.get, pieces))
        unknown = [p for p, b in zip(pieces, found) if b is None]
        if not unknown:
            return found
        if len(self.new) + len(unknown) > self.cached:
            self.old, self.new = self.new, {}
        told = {p: self.old[p] for p in unknown if p in self.old}
        told |= self._learn([p for p in unknown if p not in told and p not in whole])
        self.new.update(told if max(map(len, unknown)) <= KEPT_BYTES else {p: b for p, b in told.items() if len(p) <= KEPT_BYTES})
        for p in whole:
            told[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return [told[p] if b is None else b for p, b in zip(pieces, found)]

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and the number of ids of each text. Null is empty."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1]
        base, size = int(off[0]), int(off[-1] - off[0])
        raw = np.frombuffer(data, dtype=np.uint8)[base : base + size] if size else np.zeros(0, dtype=np.uint8)
        off = off - base
        begin = self.starts(raw, off)
        whole: set[str] = set()
        for name in self.added:
            for d in np.flatnonzero(pc.match_substring(texts, name).to_numpy(zero_copy_only=False)).tolist():
                whole.add(texts[d].as_py())
                begin = begin[(begin <= off[d]) | (begin >= off[d + 1])]
        # an empty piece closes each text
        edges = np.sort(np.concatenate([begin, off[1:], off[-1:]]), kind="stable").astype(np.int32)
        cut = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = cut.dictionary_encode()
        end = np.array([end_id], dtype=self.kind).tobytes()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        empty = pieces.index("")
        pieces[empty] = "a"  # any piece: its value is replaced
        values = self._values(pieces, whole)
        values[empty] = end
        width = len(end)
        sizes = np.fromiter(map(len, values), dtype=np.int32, count=len(values)) // width
        table = np.frombuffer(b"".join(values), dtype=self.kind)
        code = coded.indices.to_numpy()
        long = sizes[code]
        ends = np.cumsum(long, dtype=np.int32)  # fewer ids than bytes
        at = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[code] - (ends - long), long)
        at += np.arange(len(at), dtype=np.int32)
        return table[at], np.diff(ends[np.flatnonzero(code == empty)].astype(np.int64), prepend=0)
