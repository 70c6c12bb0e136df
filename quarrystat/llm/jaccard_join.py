"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct k-word shingles (64-bit hashes). All pairs of sets with Jaccard similarity of at least
num/den are linked; the result is one row for each document. Steps:

1. Equal sets form classes (128-bit set fingerprints, pre-aggregated); one set of each class goes on.
2. Candidate groups. Every set uses the shingles below a hash threshold that depends on its size scheme, or its first p
   shingles if these are more, p being the prefix that any linked pair must share under one order. Their frequency over
   all sets is counted; shingles are ordered by frequency, so passages that many documents share come last, and a set
   whose p first shingles occur nowhere else leaves here. The others meet in lists by shingle; a list links its sets,
   ordered by size, to the first of each run without a size gap: as many edges as entries. Connected sets form a group
   that no linked pair can leave.
3. Token-group matrix. Candidate groups are cut into pieces of bounded documents and shingles; pairs of pieces are the
   tasks. In a task, sets are partitioned by their smallest shingle; each part stores its token union; the product of the
   set matrix and the union matrix bounds the overlap of a set with all members of a part; only parts whose bound and
   sizes qualify are opened, and there all overlaps are exact.
4. Components of the links name the smallest doc_id reachable.

Nothing is dropped, capped or sampled. Copies never meet in pairs; near copies meet in matrix products, of which only
star edges and counts leave a task.

Defined results: null text, or text without words, has an empty set, links with nothing and is its own component; repeated
rows are exact copies; rows that share a doc_id with different texts keep their own sets, and their component is the
smallest doc_id of what either reaches; rows without doc_id link like others, and component_id is null only where no row
reached has a doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystat.llm.common import materialize, without_clash
from quarrystat.llm.components import components
from quarrystat.llm.texthash import mix, shingles, trim


@dataclass(frozen=True)
class Join:
    """Shingle length and threshold num/den; ``piece_docs`` and ``piece_shingles`` bound a matrix task's side."""

    k: int = 4
    num: int = 85
    den: int = 100
    piece_docs: int = 1000
    piece_shingles: int = 1_500_000
    #: Rows of one shingle list after which its frequency counts as "very high"; order only, no row is lost.
    saturated: int = 50_000
    broadcast_rows: int = 200_000


#: Schemes by set size: (from, below which a set is in this scheme alone). Shingle shares follow from the threshold.
SCHEMES = ((0, 64), (64, 256), (256, None))


def _scheme_shares(cfg: Join) -> list[float]:
    loose = 1 - cfg.num / cfg.den
    return [1.0, min(1.0, 2.6 * loose), min(1.0, 1.5 * loose)]


def _prefix(n: int, cfg: Join) -> int:
    return n - -(-cfg.num * n // cfg.den) + 1


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    a = int(np.sum(mix(s ^ np.uint64(0x243F6A8885A308D3)), dtype=np.uint64).view(np.int64))
    b = int(np.sum(mix(s + np.uint64(0x452821E638D01377)), dtype=np.uint64).view(np.int64))
    return a, b


SIG = "doc_id long, n long, f1 long, f2 long"
ENTRY = "tok long, f1 long, n int, held int"


def _signatures(cfg: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column(1).to_pylist(), cfg.k)
            rows = [(len(s), *_fingerprint(s)) for s in sets]
            n, f1, f2 = zip(*rows) if rows else ((), (), ())
            marks = batch.select(batch.schema.names[2:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), *marks.columns],
                ["doc_id", "n", "f1", "f2", *marks.schema.names],
            )
            trim()

    return run


def _marked(cfg: Join):
    """Texts with the fingerprint of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_fingerprint(s) for s in shingles(batch.column(1).to_pylist(), cfg.k)]
            f1, f2 = zip(*marks) if marks else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), batch.column(1)], ["f1", "f2", "text"])

    return run


def _entries(cfg: Join):
    """Shingles that may stand in a set's prefix; a set seen before in this task adds none."""
    shares = _scheme_shares(cfg)
    limits = [np.uint64(min(2**64 - 1, int(x * 2**64))) for x in shares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            toks, docs, sizes, helds, lens = [], [], [], [], []
            for s in shingles(batch.column(1).to_pylist(), cfg.k):
                n = len(s)
                if not n:
                    continue
                f = _fingerprint(s)
                if f in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(f)
                for i, (low, top) in enumerate(SCHEMES):
                    if n < low or top is not None and n * cfg.num > top * cfg.den:
                        continue
                    count = max(int(np.searchsorted(s, limits[i])), _prefix(n, cfg)) if shares[i] < 1 else n
                    toks.append(s[:count] * np.uint64(8) + np.uint64(i))  # three lost bits only merge lists
                    docs.append(f[0])
                    sizes.append(n)
                    helds.append(count)
                    lens.append(count)
            if toks:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(toks).view(np.int64)),
                        pa.array(np.repeat(np.array(docs, dtype=np.int64), lens)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), lens)),
                        pa.array(np.repeat(np.array(helds, dtype=np.int32), lens)),
                    ],
                    ["tok", "f1", "n", "held"],
                )
            del toks
            trim()

    return run


def _shared(cfg: Join):
    """From entries sorted by (tok, f1): those of shingles in two sets or more, with the number of these."""

    def told(tok, f1, n, held, often) -> Iterator[pa.RecordBatch]:
        if not len(tok):
            return
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (f1[1:] != f1[:-1])))
        tok, f1, n, held = tok[new], f1[new], n[new], held[new]
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        count = np.diff(np.concatenate((first, [len(tok)])))
        df = np.minimum(np.repeat(count, count), cfg.saturated) if not often else np.full(len(tok), cfg.saturated)
        keep = df >= 2
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(f1[keep]), pa.array(tok[keep]), pa.array(df[keep].astype(np.int32)), pa.array(n[keep]), pa.array(held[keep])],
                ["f1", "tok", "df", "n", "held"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, often = None, None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held_back is not None:
                cols = [np.concatenate(x) for x in zip(held_back, cols)]
            if not len(cols[0]):
                continue
            at = 0
            if often is not None:  # the run of this shingle is known to be long
                at = int(np.searchsorted(cols[0], often, "right"))
                yield from told(*[c[:at] for c in cols], True)
            last = cols[0][-1]
            cut = max(at, int(np.searchsorted(cols[0], last)))
            yield from told(*[c[at:cut] for c in cols], False)
            held_back = [c[cut:] for c in cols]
            if len(held_back[0]) >= cfg.saturated:
                often = last
                yield from told(*held_back, True)
                held_back = [c[:0] for c in held_back]
            elif last != often:
                often = None
        if held_back is not None:
            yield from told(*held_back, False)

    return run


def _salts(cfg: Join) -> F.Column:
    """Sublists of a shingle's list; 'very high' frequencies have no known number."""
    return F.when(F.col("df") >= cfg.saturated, F.lit(4096)).otherwise(F.lit(1) + F.floor(F.col("df") / 500)).cast("long")


def run_heads(lists: DataFrame, cfg: Join) -> DataFrame:
    """Edges (u, v) from every set of a shingle's list (tok, salt, f1, n) to the smallest set of its run, a run being sets
    without a size gap that no link can span.

    Sublists find their own runs first. A run covers a range of sizes, and at most one run begins per size gap, so what is
    left of a list is a few rows for each salt, and overlapping ranges of one list meet in a second window.
    """
    sub = Window.partitionBy("tok", "salt").orderBy("n", "f1")
    gap = F.lag("n").over(sub) * cfg.den < F.col("n") * cfg.num
    runs = lists.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(sub))
    own = Window.partitionBy("tok", "salt", "run").orderBy("n", "f1")
    headed = runs.select("tok", "n", "f1", F.first("f1").over(own).alias("head"), F.first("n").over(own).alias("low"))
    inner = headed.select(F.col("f1").alias("u"), F.col("head").alias("v"))
    ranges = headed.groupBy("tok", "head").agg(F.min("low").alias("low"), F.max("n").alias("high"))
    whole = Window.partitionBy("tok").orderBy("low", "high", "head")
    reach = F.max("high").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach * cfg.den < F.col("low") * cfg.num, 1).otherwise(0)
    joined = ranges.withColumn("apart", apart).withColumn("run", F.sum("apart").over(whole))
    top = Window.partitionBy("tok", "run").orderBy("low", "high", "head")
    outer = joined.select(F.col("head").alias("u"), F.first("head").over(top).alias("v"))
    return inner.unionByName(outer).where("u <> v")


def candidate_groups(docs: DataFrame, cfg: Join) -> DataFrame:
    """Rows (f1, comp): sets, by the first half of their fingerprint, that may link with another set."""
    entries = docs.select("doc_id", "text").mapInArrow(_entries(cfg), ENTRY)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        entries.repartition(parts, "tok").sortWithinPartitions("tok", "f1")
        .mapInArrow(_shared(cfg), "f1 long, tok long, df int, n int, held int")
    )
    own = Window.partitionBy("f1", F.col("tok").bitwiseAND(7))
    order = own.orderBy("df", "tok")
    # Shingles in no other set come first in the order; what is left of the prefix falls on shared ones.
    prefix = F.expr(f"n - (({cfg.num} * n + {cfg.den - 1}) DIV {cfg.den}) + 1")
    ranked = met.withColumn("k", F.count("*").over(own)).withColumn("rn", F.row_number().over(order))
    lists = ranked.where(F.col("rn") <= prefix - (F.col("held") - F.col("k"))).select("tok", "f1", "n", "df")
    edges = run_heads(lists.withColumn("salt", F.pmod(F.xxhash64("f1"), _salts(cfg)).cast("int")), cfg)
    return components(edges).select(F.col("node").alias("f1"), F.col("component").alias("comp"))


def link_sets(sets: list[np.ndarray], side: np.ndarray | None, cfg: Join):
    """All links among the sets of a task: arrays (i, j) with i < j.

    side: piece of each set where two pieces meet: only pairs across them count, also if one of them is empty.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    col = np.cumsum(first) - 1
    often = np.bincount(col) > 1
    keep = often[col]
    col, owner = (np.cumsum(often) - 1)[col[keep]], owner[keep]
    width = int(often.sum())
    heads = np.array([s[0] for s in sets])
    _, part = np.unique(heads, return_inverse=True)
    parts = int(part.max()) + 1
    bound = np.zeros((m, parts), dtype=np.float32)
    block = max(256, 6_000_000 // max(m, 1))
    cuts = np.searchsorted(col, np.arange(0, width + block, block))
    for b in range(len(cuts) - 1):
        lo, hi = cuts[b], cuts[b + 1]
        w = min(block, width - b * block)
        if hi <= lo:
            continue
        rows = np.zeros((m, w), dtype=np.float32)
        rows[owner[lo:hi], col[lo:hi] - b * block] = 1
        unions = np.zeros((parts, w), dtype=np.float32)
        unions[part[owner[lo:hi]], col[lo:hi] - b * block] = 1
        bound += rows @ unions.T
    # A set shares at least ceil(t * size) shingles with any set that it links with.
    need = -(-cfg.num * sizes // cfg.den)
    least = np.full(parts, np.iinfo(np.int64).max)
    most = np.zeros(parts, dtype=np.int64)
    np.minimum.at(least, part, sizes)
    np.maximum.at(most, part, sizes)
    fits = (least[None, :] * cfg.num <= sizes[:, None] * cfg.den) & (sizes[:, None] * cfg.num <= most[None, :] * cfg.den)
    opened = (bound >= need[:, None]) & fits
    of = np.argsort(owner, kind="stable")
    cols_of = np.split(col[of], np.cumsum(np.bincount(owner, minlength=m))[:-1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero(opened.any(axis=0)):
        members, asking = np.flatnonzero(part == g), np.flatnonzero(opened[:, g])
        mine = np.concatenate([cols_of[i] for i in members]) if len(members) else np.zeros(0, dtype=np.int64)
        used, local = np.unique(mine, return_inverse=True)
        if not len(used):
            continue
        for q0 in range(0, len(asking), 1024):
            q = asking[q0 : q0 + 1024]
            overlap = np.zeros((len(q), len(members)), dtype=np.float32)
            for c0 in range(0, len(used), block):
                c1 = min(len(used), c0 + block)
                left = np.zeros((len(q), c1 - c0), dtype=np.float32)
                for r, i in enumerate(q):
                    c = np.searchsorted(used, cols_of[i])
                    ok = (c >= c0) & (c < c1)
                    ok[ok] = used[c[ok]] == cols_of[i][ok]
                    left[r, c[ok] - c0] = 1
                right = np.zeros((len(members), c1 - c0), dtype=np.float32)
                at = np.repeat(np.arange(len(members)), [len(cols_of[i]) for i in members])
                ok = (local >= c0) & (local < c1)
                right[at[ok], local[ok] - c0] = 1
                overlap += left @ right.T
            inter = overlap.astype(np.int64)
            union = sizes[q][:, None] + sizes[members][None, :] - inter
            hit = (inter * cfg.den >= cfg.num * union) & (q[:, None] < members[None, :])
            i, j = np.nonzero(hit)
            found.append((q[i], members[j]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    pair = np.unique(i * np.int64(m) + j)
    i, j = pair // m, pair % m
    if side is not None:
        across = side[i] != side[j]
        i, j = i[across], j[across]
    return i, j


LINK = "u long, v long, links long"


def _verify(cfg: Join):
    """One task (comp, a, b): star edges of its links, and rows (u, u, links) that count partners, copies included."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        sets = list(shingles(group.column("text").to_pylist(), cfg.k))
        want = group.column("f1").to_pylist(), group.column("f2").to_pylist()
        good = [x for x in range(len(sets)) if len(sets[x]) and _fingerprint(sets[x]) == (want[0][x], want[1][x])]
        _, once = np.unique(ids[good], return_index=True)  # repeated rows of one class
        good = [good[x] for x in once]
        empty = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if len(good) < 2:
            return empty
        ids, sets = ids[good], [sets[x] for x in good]
        side, weight = group.column("piece").to_numpy()[good], group.column("copies").to_numpy()[good]
        i, j = link_sets(sets, side if key[1].as_py() != key[2].as_py() else None, cfg)
        if not len(i):
            return empty
        root = np.arange(len(ids))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        star = np.array([top(x) for x in range(len(ids))])
        links = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
        edge, linked = np.flatnonzero(star != np.arange(len(ids))), np.flatnonzero(links)
        zero = np.zeros(len(edge), dtype=np.int64)
        del sets
        trim()
        return pa.table(
            {
                "u": np.concatenate((ids[edge], ids[linked])),
                "v": np.concatenate((ids[star[edge]], ids[linked])),
                "links": np.concatenate((zero, links[linked].astype(np.int64))),
            }
        )

    return run


def _text_marks(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit("second")).alias("t2")]


def join_classes(docs: DataFrame, cfg: Join = Join(), marks: bool = False) -> DataFrame:
    """Rows (doc_id, n, component_id, n_links), one for each row of ``docs``; with ``marks`` also the text's hashes t1, t2 and
    ``group``, a number for each group of linked documents, null for a document without words."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = plain.select("*", *_text_marks(F.col("text"))) if marks else plain
    sig = materialize(signed.mapInArrow(_signatures(cfg), SIG + (", t1 long, t2 long" if marks else "")), "signatures")
    full = sig.where("n > 0")
    # a class is a node by its place in the written table, whether any of its rows has a doc_id or not
    classes = materialize(
        full.groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    groups = candidate_groups(plain, cfg)
    found = materialize(groups.join(classes, "f1"), "candidates")
    sums = found.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    pieces = sums.select(
        "comp", F.greatest(F.ceil(F.col("m") / cfg.piece_docs), F.ceil(F.col("total") / cfg.piece_shingles)).cast("int").alias("pieces")
    )
    placed = found.join(pieces, "comp").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    # Piece x meets every piece: once as the first of the pair, once as the second.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda y: F.struct(F.least(y, F.col("piece")).alias("a"), F.greatest(y, F.col("piece")).alias("b")),
    )
    tasks = placed.select("comp", "rep", "node", "f1", "f2", "copies", "piece", meets.alias("at"))
    small = found.count() <= cfg.broadcast_rows
    near = F.broadcast(tasks) if small else tasks
    named_rows = plain.join(near, plain["doc_id"] == near["rep"]).select("text", *tasks.columns)
    # classes without any doc_id find one of their texts by the set itself
    lost = tasks.where("rep IS NULL")
    marked = plain.where("doc_id IS NULL").mapInArrow(_marked(cfg), "f1 long, f2 long, text string")
    lost_rows = marked.join(F.broadcast(lost) if small else lost, ["f1", "f2"]).groupBy(*lost.columns).agg(F.first("text").alias("text"))
    rows = named_rows.unionByName(lost_rows).withColumn("at", F.explode("at"))
    links = materialize(
        rows.select("comp", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "node", "text", "f1", "f2", "copies", "piece")
        .groupBy("comp", "a", "b")
        .applyInArrow(_verify(cfg), LINK),
        "links",
    )
    tops = components(links.where("u <> v").select("u", "v"))
    # only classes with links are members
    members = classes.join(tops, "node").select("node", "rep", "component")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    counts = links.groupBy("u").agg(F.sum("links").alias("links"))
    linked = members.join(least, "component").select("node", "least", "component").join(counts, F.col("node") == F.col("u"), "left")
    named = classes.join(linked, "node", "left").select(
        "f1", "f2", F.coalesce("least", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("group"),
    )
    return sig.join(named, ["f1", "f2"], "left").select(
        "doc_id",
        "n",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        *(["t1", "t2", F.when(F.col("n") > 0, F.col("group")).alias("group")] if marks else []),
    )


def digest(docs: DataFrame, cfg: Join = Join()) -> DataFrame:
    """The operator's contract."""
    return join_classes(docs, cfg).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame, cfg: Join) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, then the smallest text hash; a doc_id of two texts is two
    documents, and one without doc_id stays only where its group has no other. Documents without words all stay, once where
    doc_id and text are repeated."""
    named = materialize(join_classes(docs, cfg, marks=True).select("doc_id", "t1", "t2", "group"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("x")
    grouped = named.where("group IS NOT NULL").groupBy("group").agg(first).select("x.doc_id", "x.t1", "x.t2")
    wordless = named.where("group IS NULL").select("doc_id", "t1", "t2").distinct()
    rows = named.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("_rows"))
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])
    stay = grouped.unionByName(wordless)
    kept = materialize(stay.join(rows, on(stay, rows)).select(stay["doc_id"], stay["t1"], stay["t2"], "_rows"), "kept")
    repeated = kept.where("_rows > 1").limit(1).count() > 0
    small = kept.count() <= cfg.broadcast_rows
    p = without_clash(docs)
    ids = {"doc_id": f"{p}id", "t1": f"{p}t1", "t2": f"{p}t2", "_rows": f"{p}rows"}
    kept = kept.withColumnsRenamed(ids)
    marks = [m.alias(f"{p}{c}") for m, c in zip(_text_marks(F.col("text").cast("string")), "ab")]
    marked = docs.select("*", *marks)
    meet = marked["doc_id"].cast("long").eqNullSafe(kept[f"{p}id"]) & (marked[f"{p}a"] == kept[f"{p}t1"]) & (marked[f"{p}b"] == kept[f"{p}t2"])
    out = marked.join(F.broadcast(kept) if small else kept, meet)
    if repeated:  # rows of one doc_id and text
        again = out.where(F.col(f"{p}rows") > 1).dropDuplicates(["doc_id", f"{p}a", f"{p}b"])
        out = out.where(F.col(f"{p}rows") == 1).unionByName(again)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
