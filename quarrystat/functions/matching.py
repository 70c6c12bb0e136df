"""Name patterns, similarities, hashes and robust scales as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str | None:
    """A regular expression for one exclusion pattern: ``re:`` a regular expression of at most 200 characters (None if it is
    not one), SQL LIKE where it has % or no glob character but _, a glob where it has * or ?, else the exact name."""
    p = pattern.strip().lower()
    if p.startswith("re:"):
        try:
            return re.compile(p[3:]).pattern if len(p) <= 203 else None
        except re.error:
            return None
    if "%" in p:
        p = p.replace("%", "*").replace("_", "?")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^a-z0-9 ])", r"\\\1", c) for c in p) + "$"


def excluded(name: Column, patterns: list[str]) -> Column:
    """Whether a trimmed name matches any pattern, without regard to case; null names are not excluded."""
    found = [r for p in patterns if (r := pattern_regex(p)) is not None]
    low = F.lower(F.trim(name))
    return F.coalesce(low.rlike("|".join(f"(?:{r})" for r in found)), F.lit(False)) if found else F.lit(False)


def sorted_tokens(name: Column) -> Column:
    """Lower-case tokens of letters and digits, sorted."""
    return F.array_sort(F.array_remove(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), ""))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 less the edits between the sorted tokens, in per cent of the longer."""
    x, y = F.array_join(sorted_tokens(a), " "), F.array_join(sorted_tokens(b), " ")
    return F.floor(100.0 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))).cast("long")


def fuzzy_links(left: DataFrame, right: DataFrame, threshold: int = 82, least: int = 4, share: float = 0.6, overlap: int = 2) -> DataFrame:
    """Best right name for each left name (both: id, name): equal sets of tokens, else a token-sort ratio of ``threshold`` or
    more, else at least ``overlap`` shared tokens and ``share`` of the shorter's; then the smallest id.

    Names of equal sorted tokens are one class. Classes of equal sets of tokens are joined by their set, whatever their tokens'
    length; other classes meet in blocks of a shared token of ``least`` characters, where a token of many classes is split by
    hashing the left side, so that no block is one task. A name without letters and digits has no tokens and no link."""
    salts = 16
    key = F.array_join(sorted_tokens(F.col("name")), " ")
    as_set = lambda c: F.array_join(F.array_distinct(F.split(c, " ")), " ")
    named = left.where("name IS NOT NULL").select(F.col("id").alias("left_id"), key.alias("left_key")).where("left_key <> ''")
    tokens = lambda p: F.array_distinct(F.array_remove(F.split(f"{p}_key", " "), "")).alias(f"{p}_tokens")
    block = lambda df, p: df.withColumn("token", F.explode(F.filter(f"{p}_tokens", lambda t: F.length(t) >= least)))
    a = block(named.select("left_key").distinct().select("left_key", tokens("left")), "left").withColumn("salt", F.pmod(F.xxhash64("left_key"), F.lit(salts)))
    classes = right.where("name IS NOT NULL").groupBy(key.alias("right_key")).agg(F.min("id").alias("right_id")).where("right_key <> ''")
    # a smallest id for each set of tokens
    sets = classes.groupBy(as_set("right_key").alias("set")).agg(F.min("right_id").alias("right_id"))
    equal = named.select("left_key", as_set("left_key").alias("set")).distinct().join(sets, "set").select("left_key", "right_id")
    b = block(classes.select("right_key", "right_id", tokens("right")), "right").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    # a pair is looked at under the smallest of its shared tokens only
    pairs = a.join(b, ["token", "salt"]).where(F.col("token") == F.array_min(F.filter(F.array_intersect("left_tokens", "right_tokens"), lambda t: F.length(t) >= least)))
    shared = F.size(F.array_intersect("left_tokens", "right_tokens"))
    ratio = F.floor(100.0 * (1 - F.levenshtein("left_key", "right_key") / F.greatest(F.length("left_key"), F.length("right_key"), F.lit(1)))).cast("long")
    scored = pairs.select("left_key", "right_id", ratio.alias("ratio"), shared.alias("shared"), F.least(F.size("left_tokens"), F.size("right_tokens")).alias("shorter"))
    kind = F.when(F.col("ratio") >= threshold, "fuzzy").when((F.col("shared") >= overlap) & (F.col("shared") >= share * F.col("shorter")), "tokens")
    near = scored.withColumn("kind", kind).where("kind IS NOT NULL").select("left_key", "right_id", "kind", F.col("ratio").alias("score"))
    kept = near.unionByName(equal.withColumn("kind", F.lit("exact")).withColumn("score", F.lit(100).cast("long")))
    best = F.max(F.struct(F.when(F.col("kind") == "exact", 2).when(F.col("kind") == "fuzzy", 1).otherwise(0).alias("k"), "score", (-F.col("right_id")).alias("r"), "kind"))
    linked = kept.groupBy("left_key").agg(best.alias("b")).select("left_key", (-F.col("b.r")).alias("right_id"), "b.kind", "b.score")
    return named.join(linked, "left_key").select("left_id", "right_id", "kind", "score")


def edit_pairs(strings: DataFrame, code: str, edits: int) -> DataFrame:
    """All pairs (a, b, d) of distinct strings, a before b in length and then in order, within ``edits`` edits; null is no string.

    A string cut into ``edits`` + 1 segments keeps one of them unchanged under ``edits`` edits, moved by no more places than there
    are edits. So strings meet by (length, segment's number, segment's text): shorter ones with their segments, longer ones with
    their parts around each segment's place. A string of up to ``edits`` characters has empty segments; it meets the strings of up
    to twice that length, whose number the alphabet bounds, by length.
    """
    own = strings.select(F.col(code).cast("string").alias("s")).where("s IS NOT NULL").distinct().withColumn("n", F.length("s"))
    k = edits + 1
    start = lambda n, i: F.floor(n * i / k).cast("int")
    segments = F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: F.struct(F.col("n").alias("n"), i.alias("i"), F.substr("s", start(F.col("n"), i) + 1, start(F.col("n"), i + 1) - start(F.col("n"), i)).alias("part")))
    short = own.where(F.col("n") > edits).select(F.col("s").alias("a"), F.explode(segments).alias("at"))

    def around(n: Column) -> Column:
        """Parts of s that may be a segment of a string of length n: moved by at most ``edits``, and by what the lengths allow."""
        size = lambda i: start(n, i + 1) - start(n, i)
        places = lambda i: F.sequence(F.greatest(start(n, i) - edits, F.lit(0)), F.least(start(n, i) + edits, F.col("n") - size(i)))
        some = lambda i: F.greatest(start(n, i) - edits, F.lit(0)) <= F.least(start(n, i) + edits, F.col("n") - size(i))
        parts = lambda i: F.when(some(i), F.transform(places(i), lambda p: F.struct(n.alias("n"), i.alias("i"), F.substr(F.col("s"), p + 1, size(i)).alias("part"))))
        return F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.lit(edits)), parts), lambda x: x.isNotNull()))

    lengths = F.sequence(F.greatest(F.col("n") - edits, F.lit(edits + 1)), F.col("n"))
    probes = F.when(F.col("n") > edits, F.array_distinct(F.flatten(F.transform(lengths, around))))
    long = own.where(F.col("n") > edits).select(F.col("s").alias("b"), F.explode(probes).alias("at"))
    met = short.join(long, "at").select("a", "b")
    few = own.where(F.col("n") <= 2 * edits)
    tiny = few.where(F.col("n") <= edits).select(F.col("s").alias("a"), F.explode(F.sequence(F.col("n"), F.col("n") + edits)).alias("n")).join(few.select(F.col("s").alias("b"), "n"), "n").select("a", "b")
    ordered = F.struct(F.length("a"), F.col("a")) < F.struct(F.length("b"), F.col("b"))
    pairs = met.unionByName(tiny).where(ordered).distinct()
    # beyond the threshold the distance is -1
    return pairs.withColumn("d", F.levenshtein("a", "b", edits)).where("d >= 0")


def alignment_score(a: Column, b: Column, match: int = 2, miss: int = -1) -> Column:
    """Best local alignment score of two strings (Smith and Waterman), gaps and misses costing the same."""
    places = lambda s: F.sequence(F.lit(1), F.length(s))
    chars = lambda s: F.when(F.length(s) > 0, F.transform(places(s), lambda i: F.substr(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    first = F.struct(F.lit(0).alias("best"), F.concat(F.array(F.lit(0)), F.transform(chars(b), lambda _: F.lit(0))).alias("row"))

    def step(acc: Column, x: Column) -> Column:
        def cell(s: Column, y: Column) -> Column:
            j = F.size(s["out"])
            value = F.greatest(F.lit(0), F.get(acc["row"], j - 1) + F.when(x == y, match).otherwise(miss), F.get(acc["row"], j) + miss, s["last"] + miss)
            return F.struct(value.alias("last"), F.concat(s["out"], F.array(value)).alias("out"))

        row = F.aggregate(chars(b), F.struct(F.lit(0).alias("last"), F.array(F.lit(0)).alias("out")), cell, lambda s: s["out"])
        return F.struct(F.greatest(acc["best"], F.array_max(row)).alias("best"), row.alias("row"))

    return F.aggregate(chars(a), first, step, lambda acc: acc["best"])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of two maps from term to weight."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.element_at(b, k), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def simhash(tokens: Column) -> Column:
    """64-bit sign hash of an array of tokens: bit i is set where more token hashes have it than not."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    votes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.shiftrightunsigned(h, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, 1).otherwise(-1)))
    bits = F.transform(votes, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def robust_scale(df: DataFrame, value: str) -> DataFrame:
    """One row (n, log1p, centre, scale): median and 1.4826 MAD; where that is zero IQR / 1.349, then the deviation, then 1.
    Values of at least zero with a skewness over 2 are taken as log(1 + x) first."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    told = x.agg(F.skewness("x").alias("skew"), F.min("x").alias("low"))
    x = x.crossJoin(F.broadcast(told)).select(F.coalesce((F.col("skew") > 2) & (F.col("low") >= 0), F.lit(False)).alias("log1p"), "x")
    x = x.select("log1p", F.when(F.col("log1p"), F.log1p("x")).otherwise(F.col("x")).alias("x"))
    first = x.agg(F.count("*").alias("n"), F.coalesce(F.max("log1p"), F.lit(False)).alias("log1p"), F.percentile("x", F.lit([0.25, 0.5, 0.75])).alias("q"), F.stddev_pop("x").alias("sd"))
    mad = x.select("x").crossJoin(F.broadcast(first)).agg(F.percentile(F.abs(F.col("x") - F.col("q")[1]), 0.5).alias("mad"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("q")[2] > F.col("q")[0], (F.col("q")[2] - F.col("q")[0]) / 1.349).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return first.crossJoin(F.broadcast(mad)).select("n", "log1p", F.round(F.col("q")[1], 9).alias("centre"), F.round(scale, 9).alias("scale"))
