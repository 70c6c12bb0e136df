"""A linear-chain conditional random field over word-shape features, in numpy.

A word's score for a label is a sum of weights of its own features and of those of its neighbours up to two words away in the
same line, so scores of all words of a batch are gathered from tables of distinct shapes and known words. A word whose score
for ``O`` is higher than any other by more than transitions can make up is O in the best path whatever its neighbours are; only
the runs of other words are decoded, by Viterbi, many runs at once. The result is the best path of each whole line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OUTSIDE = "O"
#: Places of the features of a word: its own, one and two words before, one word after.
PLACES = (0, -1, -2, 1)
#: Shapes longer than this are cut; the word itself is not.
SHAPE_CHARS = 24
EDGES = "\"'()[]{}<>.,;:!?„“”»«"
_EDGE_CLASS = "[" + re.escape(EDGES) + "]"


def shapes(words: pa.Array) -> pa.Array:
    """Letters by case as X and x, runs as one; each digit as 9; other characters as they are."""
    out = words
    for pattern, to in ((r"\p{Lu}+", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+", "x"), (r"[0-9]", "9"), (r"9{12,}", "9+")):
        out = pc.replace_substring_regex(out, pattern=pattern, replacement=to)
    return pc.utf8_slice_codeunits(out, 0, SHAPE_CHARS)


def cores(words: pa.Array) -> pa.Array:
    """Words in lower case without marks at their edges, but for a closing colon."""
    out = pc.replace_substring_regex(pc.utf8_lower(words), pattern=f"^{_EDGE_CLASS}+", replacement="")
    colon = pc.ends_with(out, pattern=":")
    out = pc.replace_substring_regex(out, pattern=f"{_EDGE_CLASS}+$", replacement="")
    return pc.if_else(colon, pc.binary_join_element_wise(out, ":", ""), out)


def shape_features(shape: str) -> list[str]:
    """The shape itself, without marks at its edges, its closing mark, and what it holds."""
    core = shape.strip(EDGES)
    digits = core.count("9")
    out = [f"shape={shape}", f"core={core}", f"end={shape[-1] if shape and shape[-1] in EDGES else ''}"]
    out += [f"digits={min(digits, 12) if digits else 0}", f"kinds={''.join(sorted(set(re.sub('[^Xx9]', '.', core))))}"]
    return out


@dataclass(frozen=True)
class Crf:
    """Weights by (place, feature) as rows of a matrix, transitions, and the words that are features of their own."""

    labels: tuple[str, ...]
    index: dict
    weights: np.ndarray
    moves: np.ndarray
    known: tuple[str, ...]

    def swing(self) -> float:
        """The most that transitions can gain when a word leaves O."""
        t = self.moves
        gain = np.maximum((t - t[:, :1]).max(0), 0) + np.maximum((t - t[:1]).max(1), 0)  # a line's edge has no transition
        return float(gain[1:].max())

    def _rows(self, features: list[list[str]], place: int) -> np.ndarray:
        out = np.zeros((len(features) + 1, len(self.labels)), dtype=np.float32)
        for i, names in enumerate(features):
            at = [self.index[place, f] for f in names if (place, f) in self.index]
            out[i] = self.weights[at].sum(0)
        return out

    def scores(self, names: pa.Array, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of all words (``code`` into distinct ``names``) by label; ``first``: a line starts at the word."""
        known = pa.array(self.known, pa.string())
        number = lambda words: pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy(zero_copy_only=False)
        # words of small letters only, most of all: shape x, and themselves without marks
        other = pc.invert(pc.and_(pc.utf8_is_lower(names), pc.utf8_is_alpha(names)))
        rest = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        odd = names.filter(other)
        shape = shapes(odd).dictionary_encode()
        told = [shape_features(s) for s in ["x", *shape.dictionary.to_pylist()]]
        of_shape, of_word = np.zeros(len(names), dtype=np.int32), number(names).copy()
        of_shape[rest] = shape.indices.to_numpy(zero_copy_only=False) + 1
        of_word[rest] = number(cores(odd))
        n = len(code)
        line = np.cumsum(first)
        out = np.zeros((n, len(self.labels)), dtype=np.float32)
        for place in PLACES:
            table = self._rows(told, place)[of_shape] + self._rows([[f"word={w}"] for w in self.known], place)[of_word]
            edge = self._rows([["edge"]], place)[0]
            if place == 0:
                out += table[code]
                continue
            lo, hi = max(0, -place), n - max(0, place)  # the words that have a word there
            if hi <= lo:
                out += edge
                continue
            there = table[code[lo + place : hi + place]]
            there[np.flatnonzero(line[lo:hi] != line[lo + place : hi + place])] = edge
            out[lo:hi] += there
            out[:lo] += edge
            out[hi:] += edge
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The labels of the best paths; 0 is O."""
        out = np.zeros(len(scores), dtype=np.int8)
        if not len(scores):
            return out
        open_ = scores[:, 0] - scores[:, 1:].max(1) <= self.swing()
        start = open_.copy()
        start[1:] &= ~open_[:-1] | first[1:]
        begin = np.flatnonzero(start)
        stop = open_.copy()
        stop[:-1] &= ~open_[1:] | first[1:]
        size = np.flatnonzero(stop) + 1 - begin
        closes = np.append(first[1:], True)
        # longest runs first: at each step the runs that go on are the first ones
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        ends = begin + size - 1
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(longest), "left")  # runs longer than j words
        # a run starts a line, or a word that is O comes before it; the same at its end
        best = scores[begin] + np.where(first[begin][:, None], 0, self.moves[0])
        back: list[np.ndarray] = []
        for j in range(1, longest):
            n = live[j]
            ways = best[:n, None, :] + self.moves.T[None]  # [run, to, from]
            choice = ways.argmax(2).astype(np.int8)
            back.append(choice)
            best[:n] = np.take_along_axis(ways, choice[:, :, None], 2)[:, :, 0] + scores[begin[:n] + j]
        label = (best + np.where(closes[ends][:, None], 0, self.moves[:, 0])).argmax(1) if len(begin) else np.zeros(0, dtype=np.int64)
        out[ends] = label
        for j in range(longest - 1, 0, -1):
            n = live[j]
            label[:n] = back[j - 1][np.arange(n), label[:n]]
            out[begin[:n] + j - 1] = label[:n]
        return out


def train(lines: list[list[tuple[str, str]]], labels: tuple[str, ...], least_word: int = 2, steps: int = 300, penalty: float = 0.02) -> Crf:
    """Weights of highest penalised likelihood of labelled lines, lists of (word, label), by Adam from zero.

    A word outside of all findings that ``least_word`` lines hold is a feature of its own. The labelled lines are a small table; its number of rows is
    the caller's limit.
    """
    seen: dict[str, int] = {}
    every = pa.array([w for line in lines for w, _ in line], pa.string())
    ends = np.cumsum(list(map(len, lines))).tolist()
    by_line = lambda x: [x[a:b] for a, b in zip([0, *ends], ends)]
    core, shape = by_line(cores(every).to_pylist()), by_line(shapes(every).to_pylist())
    for line, words in zip(lines, core):
        for w in {w for (_, label), w in zip(line, words) if label == OUTSIDE}:
            seen[w] = seen.get(w, 0) + 1
    known = tuple(sorted(w for w, n in seen.items() if n >= least_word and not any(c.isdigit() for c in w)))
    own = set(known)
    index: dict[tuple[int, str], int] = {}
    number = lambda key: index.setdefault(key, len(index))
    longest = max(map(len, lines))
    active: list[list[list[int]]] = []
    for line, words, forms in zip(lines, core, shape):
        told = [shape_features(s) for s in forms]
        told = [f + ([f"word={w}"] if w in own else []) for f, w in zip(told, words)]
        active.append([[number((p, f)) for p in PLACES for f in (told[i + p] if 0 <= i + p < len(line) else ["edge"])] for i in range(len(line))])
    k, rows, m = len(labels), len(lines), len(index)
    gold = np.zeros((rows, longest), dtype=np.int64)
    there = np.zeros((rows, longest), dtype=bool)
    flat_row, flat_at, flat_f = [], [], []
    for r, line in enumerate(lines):
        for i, (_, label) in enumerate(line):
            gold[r, i], there[r, i] = labels.index(label), True
            flat_row += [r] * len(active[r][i])
            flat_at += [i] * len(active[r][i])
            flat_f += active[r][i]
    spot = np.array(flat_row) * longest + np.array(flat_at)
    flat_f = np.array(flat_f)
    order = np.argsort(flat_f, kind="stable")
    by_feature, cut = spot[order], np.searchsorted(flat_f[order], np.arange(m))
    by_spot = np.searchsorted(spot, np.flatnonzero(there))
    w, t = np.zeros((m, k)), np.zeros((k, k))
    mean, var = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    eye = np.eye(k)
    top = lambda x: x.max(1, keepdims=True)
    for step in range(1, steps + 1):
        s = np.zeros((rows * longest, k))
        s[np.flatnonzero(there)] = np.add.reduceat(w[flat_f], by_spot)
        s = s.reshape(rows, longest, k)
        e = np.exp(t)
        up, down = np.zeros_like(s), np.zeros_like(s)
        up[:, 0] = s[:, 0]
        for i in range(1, longest):
            most = top(up[:, i - 1])
            new = np.log(np.exp(up[:, i - 1] - most) @ e) + most + s[:, i]
            up[:, i] = np.where(there[:, i, None], new, up[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = s[:, i + 1] + down[:, i + 1]
            new = np.log(np.exp(after - top(after)) @ e.T) + top(after)
            down[:, i] = np.where(there[:, i + 1, None], new, 0)
        total = top(up[:, -1]) + np.log(np.exp(up[:, -1] - top(up[:, -1])).sum(1, keepdims=True))
        chance = np.exp(up + down - total[:, None])
        wrong = np.where(there[:, :, None], chance - eye[gold], 0).reshape(-1, k)
        slope_w = np.add.reduceat(wrong[by_feature], cut) + penalty * w
        slope_t = penalty * t
        for i in range(1, longest):
            before, after = up[:, i - 1], s[:, i] + down[:, i]
            scale = np.where(there[:, i, None], np.exp(top(before) + top(after) - total), 0)
            both = (np.exp(before - top(before)) * scale).T @ np.exp(after - top(after)) * e
            np.subtract.at(both, (gold[there[:, i], i - 1], gold[there[:, i], i]), 1)
            slope_t = slope_t + both
        for x, slope, a, b in ((w, slope_w, mean[0], var[0]), (t, slope_t, mean[1], var[1])):
            a += 0.1 * (slope - a)
            b += 0.01 * (slope * slope - b)
            x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, index, w.astype(np.float32), t.astype(np.float32), known)
