"""Mixing sources to target weights.

A tree of domain, language and source splits a token budget by integer weights. A node's capacity is the sum of its
leaves' tokens times ``max_epochs``. From the root down each parent fills its children like connected vessels: a child
gets its weighted share or its capacity, and what it cannot take goes to its siblings; only what all of them cannot take
together was never given to the parent. So shortages move among siblings before ancestors.

Each leaf then takes whole epochs and the prefix of one more. The order of epoch e is the hexadecimal order of
md5(seed, e, doc_id, repeat number); the prefix is the longest whose tokens fit the budget's rest. Hash order is cut into
``BUCKETS`` ranges by the first digits: sums by range (pre-aggregated) find the one range where a leaf's budget ends, and
only that range of a leaf is ordered by a window. No leaf, not even one with a third of all rows, meets in one task.

Only DataFrame functions are used. The tree, a row for each leaf, is joined to the documents by broadcast up to
``MAX_BROADCAST_LEAVES`` leaves and by key beyond that.

Defined results: null domain, lang or source is a node of its own, beside one of any name; a node of weight 0 gets only what its
siblings can't take; null or empty text has no tokens and rides along free
of charge where its place in the order falls in a started epoch's prefix; equal doc_ids are told apart by the text's md5 and stay
together if equal; an empty table or a budget of 0 gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystat.llm.common import materialize, space_words, without_clash

HEX_DIGITS = 3
BUCKETS = 16**HEX_DIGITS
MAX_BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Weights of nodes by name; unnamed nodes weigh ``other``. ``budget_percent`` is of the table's own tokens."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 3, "forum": 2})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    budget_percent: int = 80
    max_epochs: int = 2
    seed: int = 17
    #: Domain of a document, as SQL over its columns: here by the last digit of its source.
    domain_sql: str = (
        "CASE WHEN RIGHT(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web'"
        " WHEN RIGHT(source, 1) IN ('5', '6', '7') THEN 'books' ELSE 'forum' END"
    )


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == _node(F.lit(k)), F.lit(v)).otherwise(out)
    return out.cast("long")


def _node(name: Column) -> Column:
    """Names of nodes: a null is a node of its own, whatever other names there are."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("<null>"))


def _shown(node: Column) -> Column:
    return F.when(node.startswith("="), F.substr(node, F.lit(2))).otherwise(node)


def fill(children: DataFrame, parents: list[str], budget: str, capacity: str, weight: str, out: str, order: list[str]) -> DataFrame:
    """Adds ``out``: the share of ``budget`` (of the parent) for each child. Rows are tree nodes, never documents. Children of
    weight 0 share, as equals, what their siblings can't hold."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    last = F.col(weight) == 0
    left = F.greatest(F.col(budget) - F.coalesce(F.sum(F.when(~last, F.col(capacity))).over(family), F.lit(0)), F.lit(0))
    children = children.withColumn("_own", F.when(last, left).otherwise(F.col(budget)))
    children = children.withColumn("_last", last).withColumn("_w", F.when(last, F.lit(1)).otherwise(F.col(weight)))
    budget, weight = "_own", "_w"
    of = Window.partitionBy(*parents, "_last")
    ratio = F.col(capacity) / F.col(weight)
    ordered = of.orderBy("_ratio", *order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))) / F.sum(weight).over(after)
    rows = children.withColumn("_ratio", ratio).withColumn("_level", level)
    rows = rows.withColumn("_all", F.sum(capacity).over(of)).withColumn("_top", F.max("_level").over(of))
    share = F.when(F.col("_all") <= F.col(budget), F.col(capacity)).otherwise(
        F.least(F.col(capacity), F.floor(F.col("_top") * F.col(weight)).cast("long"))
    )
    return rows.withColumn(out, share.cast("long")).drop("_ratio", "_level", "_all", "_top", "_own", "_last", "_w")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``b`` (tokens for the leaf) to rows (d, l, s, tokens)."""
    w = leaves.withColumn("c", (F.col("tokens") * mix.max_epochs).cast("long"))
    by_d = w.groupBy("d").agg(F.sum("c").alias("cd"), F.sum("tokens").alias("td"))
    by_d = by_d.withColumn("w", _weight(F.col("d"), mix.domains, mix.other)).withColumn(
        "B", F.expr(f"(SUM(td) OVER (PARTITION BY 1) * {mix.budget_percent}) DIV 100").cast("long")
    )
    by_d = fill(by_d, [], "B", "cd", "w", "bd", ["d"]).select("d", "bd")
    by_l = w.groupBy("d", "l").agg(F.sum("c").alias("cl"))
    by_l = by_l.join(by_d, "d").withColumn("w", _weight(F.col("l"), mix.languages, mix.other))
    by_l = fill(by_l, ["d"], "bd", "cl", "w", "bl", ["l"]).select("d", "l", "bl")
    w = w.join(by_l, ["d", "l"]).withColumn("w", _weight(F.col("s"), mix.sources, mix.other))
    return fill(w, ["d", "l"], "bl", "c", "w", "b", ["s"]).select("d", "l", "s", "tokens", "b")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns (default: all) of the chosen documents with ``{prefix}`` d, l, s, tokens and copies."""
    p = without_clash(docs, "d", "l", "s")
    keep = docs.columns if keep is None else keep
    columns = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(
        *columns,
        _node(F.expr(mix.domain_sql)).alias(f"{p}d"),
        _node(F.col("lang")).alias(f"{p}l"),
        _node(F.col("source")).alias(f"{p}s"),
        F.size(space_words(F.col("text"))).cast("long").alias(f"{p}t"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(f"{p}id"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(f"{p}x"),
    )
    rows = materialize(rows, "counted")
    small = rows.select(*[F.col(p + a).alias(b) for a, b in (("d", "d"), ("l", "l"), ("s", "s"), ("t", "t"), ("id", "id"), ("x", "x"))])
    leaves = materialize(
        leaf_budgets(small.groupBy("d", "l", "s").agg(F.sum("t").alias("tokens")).where("tokens > 0"), mix)
        .withColumn("full", F.expr("b DIV tokens"))
        .withColumn("rest", F.expr("b % tokens")),
        "leaves",
    )
    few = leaves.count() <= MAX_BROADCAST_LEAVES
    hint = F.broadcast if few else (lambda x: x)
    # The place of a document in the one epoch of its leaf that is taken in part; epochs count from 0.
    key = lambda x, q: F.md5(
        F.concat_ws("|", F.lit(str(mix.seed)), F.col("full").cast("string"), F.col(q + "id"), F.col(q + "x")).cast("binary")
    )
    placed = small.join(hint(leaves), ["d", "l", "s"]).withColumn("k", key(None, ""))
    placed = placed.withColumn("bucket", F.substring("k", 1, HEX_DIGITS))
    sums = placed.groupBy("d", "l", "s", "rest", "bucket").agg(F.sum("t").alias("t"))
    upto = Window.partitionBy("d", "l", "s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sums.withColumn("cum", F.sum("t").over(upto))
        .where("cum > rest")
        .groupBy("d", "l", "s")
        .agg(F.min_by(F.struct("bucket", (F.col("cum") - F.col("t")).alias("before")), "bucket").alias("e"))
        .select("d", "l", "s", F.col("e.bucket").alias("cut"), F.col("e.before").alias("before"))
    )
    edge = placed.join(hint(cut), ["d", "l", "s"]).where("bucket = cut")
    within = Window.partitionBy("d", "l", "s").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        edge.withColumn("cum", F.col("before") + F.sum("t").over(within))
        .where("cum <= rest")
        .groupBy("d", "l", "s")
        .agg(F.max("k").alias("last"))
    )
    # A document is in the prefix if its key is below the cut bucket or up to the last key that fits in it.
    ends = materialize(
        leaves.join(cut, ["d", "l", "s"], "left").join(last, ["d", "l", "s"], "left").select(
            *[F.col(c).alias(f"{p}e_{c}") for c in ("d", "l", "s")], "full", F.when(F.col("rest") > 0, F.greatest("cut", "last")).alias("end"),
        ).withColumnsRenamed({"full": f"{p}full", "end": f"{p}end"}),
        "ends",
    )
    on = [F.col(f"{p}{c}") == F.col(f"{p}e_{c}") for c in ("d", "l", "s")]
    chosen = rows.join(hint(ends), on)
    k = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col(f"{p}full").cast("string"), F.col(f"{p}id"), F.col(f"{p}x")).cast("binary"))
    part = F.when(k <= F.col(f"{p}end"), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col(f"{p}full") + part).cast("long")
    names = {f"{p}copies": copies}
    return chosen.withColumns(names).where(F.col(f"{p}copies") > 0), p


def digest(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each chosen document: its leaf, its tokens and how many epochs hold it."""
    out, p = mix_documents(docs, mix, ["doc_id"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _shown(F.col(f"{p}d")).alias("domain"),
        _shown(F.col(f"{p}l")).alias("lang"),
        _shown(F.col(f"{p}s")).alias("source"),
        F.col(f"{p}t").alias("n_tokens"),
        F.col(f"{p}copies").alias("copies"),
    )


def take(docs: DataFrame, mix: Mix) -> DataFrame:
    """The chosen documents with their own columns, a row for each epoch that holds them."""
    out, p = mix_documents(docs, mix)
    rows = out.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
