"""Quality rules with adaptive thresholds.

Fixed base rules come first. What passes them fills mergeable quantile sketches, one per language, source and feature:
log-linear histograms whose bucket keeps the eight leading bits of an integer feature, so a quantile is at most 1/128
too low. Sketches merge by adding counts: sources into languages and languages into the corpus. Fences from the
quartiles of the smallest level with enough documents replace fixed cut-offs, and a join of documents with their
fences gives the verdict.

Only DataFrame functions are used. Documents are never moved by key: the fences (a row for each language and source)
are broadcast when their count is below ``MAX_BROADCAST_GROUPS`` and joined by key beyond it, on the narrow features.

Defined results: null or empty text has no words and fails the base rules; null ``lang`` or ``source`` is a group of its
own; repeated rows each get the same verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrystat.llm.common import covered, let, materialize, space_words, without_clash

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MAX_BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class Rules:
    """Parameters. Features are integers: symbol, dup_line and repeat in 1/10000, mean word length in 1/100."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: Documents that a level's sketch needs; else the next level (language, corpus) is used.
    min_group: int = 200
    #: Fence: quartile + reach * max(interquartile range, least spread).
    reach: int = 3
    symbol_spread: int = 100
    dup_line_spread: int = 1200
    repeat_spread: int = 667
    word_length_reach: int = 6
    word_length_spread: int = 30
    #: Word length is judged in documents of so many words at least.
    word_length_min_words: int = 50


FEATURES = ("symbol", "dup_line", "repeat", "word_length")


def _repeat_words(words: Column, k: int) -> Column:
    """Words inside windows of k words that occur twice or more in the text."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    )

    def spread(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda x, i: (x["h"].eqNullSafe(F.get(s, i - 1)["h"])) | (x["h"].eqNullSafe(F.get(s, i + 1)["h"])),
        )
        return let(
            placed,
            lambda s: covered(
                F.sort_array(F.transform(twice(s), lambda x: F.struct(x["i"].alias("at"), F.lit(k).alias("len"))))
            ),
        )

    none = F.lit(0)
    return F.when(F.size(words) < k, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(spread(h)))
    )


def base_metrics(text: Column, rules: Rules) -> Column:
    """Struct of the base counts of one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\x09-\\x0D]"))
    return let(
        space_words(text),
        lambda w: let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w, rules.window).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.length(text).cast("long").alias("n_code_points"),
            ),
        ),
    )


def _share(part: str, whole: str, scale: int) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({scale} * {part}) DIV {whole} ELSE 0 END"


def featurize(docs: DataFrame, prefix: str, rules: Rules, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, struct ``{prefix}m`` of counts and features, and group keys ``{prefix}l/s``."""
    m, f = f"{prefix}m", f"{prefix}f"
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    out = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        key("lang").alias(f"{prefix}l"),
        key("source").alias(f"{prefix}s"),
        base_metrics(F.col("text"), rules).alias(m),
    )
    failed = (F.col(f"{m}.n_words") < rules.min_words) | (
        100 * F.col(f"{m}.n_repeat_words") > rules.max_repeat_percent * F.col(f"{m}.n_words")
    )
    return out.withColumn(f"{prefix}failed", failed).withColumn(
        f,
        F.struct(
            F.expr(_share(f"{m}.n_symbols", f"{m}.n_code_points", 10000)).alias("symbol"),
            F.expr(_share(f"{m}.n_dup_lines", f"{m}.n_lines", 10000)).alias("dup_line"),
            F.expr(_share(f"{m}.n_repeat_words", f"{m}.n_words", 10000)).alias("repeat"),
            F.expr(_share(f"{m}.word_chars", f"{m}.n_words", 100)).alias("word_length"),
        ),
    )


def sketches(featured: DataFrame, prefix: str) -> DataFrame:
    """Sketch rows (l, s, feature, bucket, n) of the documents that pass the base rules."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{prefix}f.{x}").alias("v")) for x in FEATURES])
    )
    rows = featured.where(~F.col(f"{prefix}failed")).select(
        F.col(f"{prefix}l").alias("l"), F.col(f"{prefix}s").alias("s"), pairs.alias("p")
    )
    shift = "GREATEST(0, LENGTH(BIN(p.v)) - 8)"
    bucket = F.expr(f"SHIFTLEFT(SHIFTRIGHT(p.v, {shift}), {shift})")
    return rows.groupBy("l", "s", F.col("p.feature").alias("feature"), bucket.alias("bucket")).agg(
        F.count("*").alias("n")
    )


def _quartiles(sketch: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """q1, q3 and count for each key and feature; the rows of one key are the buckets of one sketch, a bounded number."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "feature")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = merged.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    return cum.groupBy(*keys, "feature").agg(
        F.max("total").alias(names[0]),
        F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bucket"))).alias(names[1]),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bucket"))).alias(names[2]),
    )


def fences(sketch: DataFrame, rules: Rules) -> DataFrame:
    """One row for each language and source: highest allowed feature values and lowest word length."""
    own = _quartiles(sketch, ["l", "s"], ["n0", "a0", "b0"])
    lang = _quartiles(sketch, ["l"], ["n1", "a1", "b1"])
    every = _quartiles(sketch, [], ["n2", "a2", "b2"])
    rows = own.join(lang, ["l", "feature"]).join(every, ["feature"])
    pick = lambda c: (
        F.when(F.col("n0") >= rules.min_group, F.col(f"{c}0"))
        .when(F.col("n1") >= rules.min_group, F.col(f"{c}1"))
        .otherwise(F.col(f"{c}2"))
    )
    rows = rows.select("l", "s", "feature", pick("a").alias("q1"), pick("b").alias("q3"))
    spread = {
        "symbol": (rules.reach, rules.symbol_spread),
        "dup_line": (rules.reach, rules.dup_line_spread),
        "repeat": (rules.reach, rules.repeat_spread),
        "word_length": (rules.word_length_reach, rules.word_length_spread),
    }
    step = lambda x: spread[x][0] * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread[x][1]))
    of = lambda x, v: F.max(F.when(F.col("feature") == x, v))
    return rows.groupBy("l", "s").agg(
        *[of(x, F.col("q3") + step(x)).alias(f"{x}_hi") for x in FEATURES],
        of("word_length", F.col("q1") - step("word_length")).alias("word_length_lo"),
    )


def judge(docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns (default: all) with struct columns of counts and features and a boolean ``{prefix}kept``.

    Returns the frame and the prefix of its working columns. The features are computed once and written to the shared
    folder; sketches and verdicts read them from there.
    """
    prefix = without_clash(docs, "_q_")
    keep = docs.columns if keep is None else keep
    featured = materialize(featurize(docs, prefix, rules, keep), "quality")
    limits = materialize(fences(sketches(featured, prefix), rules), "fences")
    if limits.count() <= MAX_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    named = limits.select(*[F.col(c).alias(f"{prefix}t_{c}") for c in limits.columns])
    joined = featured.join(
        named, (F.col(f"{prefix}l") == F.col(f"{prefix}t_l")) & (F.col(f"{prefix}s") == F.col(f"{prefix}t_s")), "left"
    )
    f, t = f"{prefix}f", f"{prefix}t"
    ok = F.lit(True)
    for x in ("symbol", "dup_line", "repeat"):
        ok = ok & (F.col(f"{f}.{x}") <= F.col(f"{t}_{x}_hi"))
    length = (F.col(f"{prefix}m.n_words") < rules.word_length_min_words) | F.col(f"{f}.word_length").between(
        F.col(f"{t}_word_length_lo"), F.col(f"{t}_word_length_hi")
    )
    kept = F.coalesce(~F.col(f"{prefix}failed") & ok & length, F.lit(False))
    return joined.withColumn(f"{prefix}kept", kept), prefix


def digest(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The operator's contract: one row for each document with its counts and verdicts."""
    out, p = judge(docs, rules, ["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(
        F.col("doc_id").cast(T.LongType()).alias("doc_id"),
        *[F.col(f"{p}m.{c}").alias(c) for c in counts],
        F.col(f"{p}failed").alias("base_failed"),
        F.col(f"{p}kept").alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    out, p = judge(docs, rules)
    return out.where(F.col(f"{p}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
