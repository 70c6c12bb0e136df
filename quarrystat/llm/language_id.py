"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a fixed random vector of +1 and -1, drawn from a seed and its code point. The
trigram abc is the product of a's vector shifted twice, b's shifted once and c's: binding by multiplication, order by
permutation. A text's profile is the sum of its trigrams' vectors, bundled by their counts; a language's prototype is the
sum of the profiles of its training texts. A text gets the language whose prototype has the highest cosine with it.

Bundling is a sum, so tasks add up partial prototypes and send one vector for each language they hold; the prototypes
(languages x dimensions) are a bounded model, checked against ``max_languages``, and are sent to the prediction tasks.

Training uses the text and non-null lang of rows whose crc32(doc_id as text) mod 5 is not 0. A prediction uses text only.

Defined results: null text or text without a letter is ``und`` with score 0; without any training row every text is
``und``; equal cosines give the alphabetically first language; a null doc_id is held out, as the crc32 of an empty
string is 0, and so kept out of training; repeated rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.texthash import worker_cache


@dataclass(frozen=True)
class Profile:
    dimensions: int = 1024
    seed: int = 7
    max_languages: int = 4096
    #: Trigram vectors that a worker keeps; others are computed when met.
    cached: int = 30_000


GAP = 32


def _letters() -> np.ndarray:
    """By code point: 0 for no letter, else the code point itself."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.array([c if chr(c).isalpha() else GAP for c in range(0x110000)], dtype=np.int64)
    return cache["letters"]


def letter_vector(code: int, cfg: Profile) -> np.ndarray:
    return np.random.default_rng([cfg.seed, code]).integers(0, 2, cfg.dimensions).astype(np.int8) * 2 - 1


class Space:
    """Trigram vectors, made from letter vectors and kept up to a bound."""

    def __init__(self, cfg: Profile):
        self.cfg = cfg
        self.letters: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.rows = np.zeros((cfg.cached, cfg.dimensions), dtype=np.int8)
        self.known = np.zeros(0, dtype=np.int64)  # sorted keys
        self.place = np.zeros(0, dtype=np.int64)

    def _letter(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if c not in self.letters:
            v = letter_vector(c, self.cfg)
            self.letters[c] = (np.roll(v, 2), np.roll(v, 1), v)
        return self.letters[c]

    def vector(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return self._letter(a)[0] * self._letter(b)[1] * self._letter(c)[2]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of distinct sorted ``keys``, times their counts."""
        out = np.zeros(self.cfg.dimensions, dtype=np.float64)
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        have = self.known[at] == keys if len(self.known) else np.zeros(len(keys), dtype=bool)
        new = keys[~have]
        room = new[: self.cfg.cached - len(self.known)]
        if len(room):
            first = len(self.known)
            for i, k in enumerate(room.tolist()):
                self.rows[first + i] = self.vector(k)
            known = np.concatenate((self.known, room))
            order = np.argsort(known)
            self.place = np.concatenate((self.place, np.arange(first, first + len(room))))[order]
            self.known = known[order]
            return self.bundle(keys, counts)
        for k, n in zip(new.tolist(), counts[~have].tolist()):
            out += self.vector(k).astype(np.float64) * n
        rows = self.place[at[have]]
        weight = counts[have].astype(np.float32)
        for i in range(0, len(rows), 4096):  # exact: sums of integers below 2^24
            out += weight[i : i + 4096] @ self.rows[rows[i : i + 4096]].astype(np.float32)
        return out


def space(cfg: Profile) -> Space:
    cache = worker_cache()
    if cache.get("hd", (None,))[0] != cfg:
        cache["hd"] = (cfg, Space(cfg))
    return cache["hd"][1]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct trigram keys of the whole text, runs of other characters being one gap, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = _letters()[codes]
    c = np.concatenate(([GAP], c, [GAP]))
    c = c[np.concatenate(([True], (c[1:] != GAP) | (c[:-1] != GAP)))]
    if len(c) < 3:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)


def _learn(cfg: Profile):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def fold() -> None:
            for lang, c in counts.items():
                keys = np.array(sorted(c), dtype=np.int64)
                v = space(cfg).bundle(keys, np.array([c[k] for k in keys.tolist()]))
                sums[lang] = sums.get(lang, 0) + v
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, n = trigrams(text)
                c = counts.setdefault(lang, {})
                for k, x in zip(keys.tolist(), n.tolist()):
                    c[k] = c.get(k, 0) + x
            if sum(map(len, counts.values())) > 200_000:
                fold()
        fold()
        if sums:
            rows = [(lang, i, int(x)) for lang, v in sums.items() for i, x in enumerate(v)]
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], ["lang", "i", "x"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def prototypes(docs: DataFrame, cfg: Profile = Profile()) -> tuple[list[str], np.ndarray]:
    """Learned languages, sorted, and their unit prototypes."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    partial = rows.select("text", "lang").mapInArrow(_learn(cfg), "lang string, i int, x long")
    sums = partial.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")
    )
    found = sums.select("lang", F.transform("v", lambda e: e["x"]).alias("v")).limit(cfg.max_languages + 1).collect()
    if len(found) > cfg.max_languages:
        raise ValueError(f"more than {cfg.max_languages} languages: raise max_languages")
    found.sort(key=lambda r: r["lang"])
    m = np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), cfg.dimensions)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return [r["lang"] for r in found], m / np.where(norms == 0, 1, norms)


def _predict(cfg: Profile, langs: list[str], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for text in batch.column(2).to_pylist():
                keys, n = trigrams(text)
                v = space(cfg).bundle(keys, n) if len(keys) and langs else None
                norm = float(np.sqrt(v @ v)) if v is not None else 0.0
                if not norm:
                    best.append("und")
                    score.append(0.0)
                    continue
                cos = model @ v / norm
                i = int(np.argmax(cos))
                best.append(langs[i])
                score.append(min(1.0, max(0.0, float(cos[i]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def digest(docs: DataFrame, cfg: Profile = Profile()) -> DataFrame:
    """The operator's contract: a prediction for each document."""
    langs, model = prototypes(docs, cfg)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(cfg, langs, model), "doc_id long, held_out boolean, lang_pred string, score double")
