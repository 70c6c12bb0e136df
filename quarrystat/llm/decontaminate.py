"""Benchmark decontamination.

Every window of ten consecutive item words (a shorter item is one window) goes into a hash set that all tasks hold. The
set is a constant of the plan: an array of buckets addressed by the low bits of a window's hash, each holding the few
(hash, window number) pairs that fall there. Each document is scanned in place: the hash of the words at each position
picks a bucket, a found hash is verified by comparing the words themselves, and the hits of the row give spans, items
and removals. Documents are never exploded, shuffled or joined.

The set's size is checked: up to ``MAX_WINDOWS`` windows form one block; a larger benchmark is scanned in several blocks,
each a pass over a table that carries the hits so far. So memory stays bounded while no window is dropped.

Defined results: null or empty text, of items or documents, has no words; repeated rows each get a result; repeated items
count once per item_id; a null item_id takes part in hits but not in the item list; an empty benchmark hits nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import alnum_words, covered, let, materialize, without_clash

WINDOW = 10
MAX_WINDOWS = 100_000
HIT = "array<struct<at:int,len:int,items:array<string>>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: len, words (joined by spaces), items (sorted item_ids) and hash h."""
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))))
    spans = rows.select("item_id", "w", at.alias("i")).select(
        "item_id", F.slice("w", F.col("i") + 1, window).alias("w")
    )
    # xxhash64 passes over nulls, so a shorter window hashes as its own words do
    h = F.xxhash64(*[F.get("w", F.lit(j)) for j in range(window)])
    return spans.groupBy(h.alias("h"), F.size("w").alias("len"), F.array_join("w", " ").alias("words")).agg(
        F.sort_array(F.collect_set("item_id")).alias("items")
    )


def _tables(rows: list) -> dict[int, Column]:
    """For each window length a constant struct: b = buckets of (h, n), t = words by n, i = items by n."""
    out = {}
    for k in sorted({r["len"] for r in rows}):
        own = [r for r in rows if r["len"] == k]
        slots = 1 << max(4, (4 * len(own) - 1).bit_length())
        buckets: list = [None] * slots
        for n, r in enumerate(own):
            slot = r["h"] & (slots - 1)
            buckets[slot] = [*(buckets[slot] or []), {"h": r["h"], "n": n}]
        text = json.dumps({"b": buckets, "t": [r["words"] for r in own], "i": [r["items"] for r in own]})
        out[k] = F.from_json(F.lit(text), "b array<array<struct<h:bigint,n:int>>>, t array<string>, i array<array<string>>")
    return out


def _scan(words: Column, k: int, table: Column) -> Column:
    """Verified hits of windows of k words in one document."""

    def found(t: Column) -> Column:
        mask = F.size(t["b"]).cast("long") - 1
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        )
        number = lambda h, i: F.get(
            F.filter(
                F.get(t["b"], h.bitwiseAND(mask).cast("int")),
                lambda e: (e["h"] == h) & (F.get(t["t"], e["n"]) == F.array_join(F.slice(words, i + 1, k), " ")),
            ),
            F.lit(0),
        )["n"]
        placed = F.transform(hashes, lambda h, i: F.when(
            F.get(t["b"], h.bitwiseAND(mask).cast("int")).isNotNull(),
            F.struct(i.alias("at"), F.lit(k).alias("len"), F.get(t["i"], number(h, i)).alias("items")),
        ))
        return F.filter(placed, lambda x: x["items"].isNotNull())

    return F.when(F.size(words) >= k, let(table, found)).otherwise(F.array().cast(HIT))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    keep: list[str] | None = None,
) -> tuple[DataFrame, str]:
    """``keep`` columns (default: all) with ``{prefix}n`` (words) and ``{prefix}hits`` (spans sorted by start)."""
    prefix = without_clash(docs)
    n, hits, text = f"{prefix}n", f"{prefix}hits", f"{prefix}text"
    keep = docs.columns if keep is None else keep
    columns = [F.col(f"`{c}`") for c in keep]
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    out = docs.select(*columns, F.col("text").alias(text), F.array().cast(HIT).alias(hits))
    for b in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("words", F.lit(b"salt")), F.lit(blocks)) == b)
        tables = _tables(block.collect())

        def row(w: Column) -> Column:
            found = F.concat(F.col(hits), *[_scan(w, k, t) for k, t in tables.items()])
            return F.struct(F.size(w).cast("long").alias("n"), F.sort_array(found).alias("hits"))

        done = out.select(*columns, text, let(alnum_words(F.col(text)), row).alias(prefix))
        out = done.select(*columns, text, F.col(f"{prefix}.n").alias(n), F.col(f"{prefix}.hits").alias(hits))
        if b + 1 < blocks:
            out = materialize(out.drop(n), "scanned")
    return out.drop(text), prefix


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The operator's contract: one row for each document with its hit words and the items found in it."""
    out, p = scan(docs, benchmark, window, max_windows, ["doc_id"])
    items = F.sort_array(F.array_distinct(F.flatten(F.transform(F.col(f"{p}hits"), lambda x: x["items"]))))
    n_hit = covered(F.col(f"{p}hits")).cast("long")
    rows = out.select("doc_id", F.col(f"{p}n").alias("n_words"), n_hit.alias("n_hit"), items.alias("items"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    out, p = scan(docs, benchmark, window)
    return out.where(F.size(f"{p}hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents; in a contaminated one the text becomes its clean words, lower-cased, joined by single spaces."""
    out, p = scan(docs, benchmark, window)
    hit = lambda i: F.exists(F.col(f"{p}hits"), lambda x: (i >= x["at"]) & (i < x["at"] + x["len"]))
    clean = let(alnum_words(F.col("text")), lambda w: F.array_join(F.filter(w, lambda _, i: ~hit(i)), " "))
    text = F.when(F.size(f"{p}hits") == 0, F.col("text")).otherwise(clean)
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
