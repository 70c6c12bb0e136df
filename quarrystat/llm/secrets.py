"""Secret scans with a random forest that removes false positives.

Every run of eight value characters or more is a candidate, wherever it stands in a text's space-separated words: whole
values, values with the marks of passwords, and the parts of paths and dotted values. So minified JSON, CSV, query strings
and connection strings give all of theirs; a run is scored with the name before it as its key. Each candidate is described
by its length, its character transitions (runs of a kind, steps between vowels and consonants), digits, capitals, marks, distinct characters, dictionary coverage, its path form,
known key prefixes and the words around it. A random forest, trained on labelled findings, gives each candidate the
probability of being a secret. A password of several words counts as its words.

The labelled findings are short texts made by rule from a seed (``labelled_findings``): keys, tokens and passwords in their
usual surroundings, and look-alikes: digests, identifiers, versions, paths, card numbers, placeholders. Their number,
``Forest.findings``, is fixed. The trained trees become one SQL expression, so scanning is a projection of each row and
moves no data; a very long text costs as much as its words.

Only DataFrame functions and JVM classes are used. Defined results: null or empty text has no candidates; repeated rows each
get a result; an empty table gives an empty result; equal candidates in one text are each scored in their own place.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.llm.common import let, space_words, without_clash


@dataclass(frozen=True)
class Forest:
    findings: int = 6000
    trees: int = 15
    depth: int = 8
    seed: int = 11
    threshold: float = 0.5


#: Words that tell of secrets, words that tell of other things, key prefixes, common words inside names.
TELLING = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
OTHERWISE = "sha[0-9]*|md5|checksum|digest|hash|commit|revision|uuid|guid|etag|version|isbn|issn|card|phone|order|invoice|example|sample|dummy|placeholder|url|http|file|path|git|checkout|merge|branch|integrity|base64|image|img|src|href|class|package|import|asset|trace|span|session|build"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ|SG\\\\.|npm_|dop_v1_|hf_"
DICTIONARY = ["access", "account", "address", "application", "article", "build", "change", "client", "code", "config", "content", "count", "data", "default", "document", "example", "file", "group", "image", "index", "item", "key", "language", "list", "local", "manager", "message", "model", "name", "number", "object", "order", "page", "password", "path", "placeholder", "product", "project", "release", "report", "request", "response", "result", "sample", "secret", "server", "service", "session", "source", "status", "string", "system", "table", "test", "text", "time", "token", "update", "user", "value", "version", "your"]

#: Value runs of eight characters or more, from wide to narrow: with the marks of passwords, of keys and paths, and their parts.
LOOSE = r"[A-Za-z0-9!#$%*+./@\\^_~-]{7,}[A-Za-z0-9!#$%*+/@\\^_~-](?:={1,2}(?![A-Za-z0-9]))?"
VALUE = r"[A-Za-z0-9+/_.~-]{7,}[A-Za-z0-9+/_~-](?:={1,2}(?![A-Za-z0-9]))?"
#: A word without digits, marks, inner dots or case changes; its runs count only in a text that tells of secrets.
TELLTALE = r"[0-9!#$%*@\\^/_+=~]|[a-z][A-Z]|[.-]."
PART = r"(?<![A-Za-z0-9_-])(?:(?<=[/.])[A-Za-z0-9_-]{8,}+|[A-Za-z0-9_-]{8,}+(?=[/.][A-Za-z0-9+/_~-]))"
#: Characters of the words before that count as surroundings, so that a text without spaces costs as much as its length.
NEAR = 64


def _features(x: Column, i: Column, near: Column, word: Column) -> Column:
    """Struct of features of the value run x (key, value) in word i, with its value."""
    v, key = x["value"], x["key"]
    n = F.greatest(F.length(v), F.lit(1))
    name, rest = F.regexp_extract(key, "[a-z0-9_-]*[^a-z0-9]*$", 0), x["rest"]
    runs = v
    for kind, mark in (("[a-z]+", "!"), ("[A-Z]+", "@"), ("[0-9]+", "#"), ("[^A-Za-z0-9!@#]+", "$")):
        runs = F.regexp_replace(runs, kind, F.lit(mark.replace("$", "\\$")))
    # vowels and consonants as one letter each: pronounceable names alternate, keys and digests do not
    kinds = F.translate(F.lower(v), "abcdefghijklmnopqrstuvwxyz", "vcccvcccvcccccvcccccvccccc")
    steps = lambda *pairs: sum((n - F.length(F.replace(kinds, F.lit(p), F.lit("")))) / 2 for p in pairs)
    gone = lambda pattern, x=v: (n - F.length(F.regexp_replace(x, pattern, ""))).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.struct(
        v.alias("value"),
        i.alias("at"),
        n.cast("double").alias("length"),
        (F.length(runs) / n).alias("transitions"),
        (steps("cv", "vc") / n).alias("alternations"),
        (gone("[0-9]") / n).alias("digits"),
        (gone("[A-Z]") / n).alias("capitals"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"),
        (gone("|".join(DICTIONARY), F.lower(v)) / n).alias("dictionary"),
        (gone("[A-Z]?[a-z]{3,}") / n).alias("wordlike"),
        flag(v.rlike(r"\.[A-Za-z]{2,5}$") | rest.rlike(r"^\.[a-z]{2,5}\b")).alias("extension"),
        flag(key.rlike("[?&][a-z]{1,2}=$") | word.rlike("base64,|sha[0-9]+-")).alias("blob"),
        gone("[/.]").alias("path"),
        gone(r"[!#$%*@\\^]").alias("marks"),
        flag(v.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        flag(v.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-")).alias("uuid"),
        flag(v.rlike(f"^(?:{PREFIXES})".replace("\\\\", "\\"))).alias("prefix"),
        flag(name.rlike(f"(?:{TELLING})[^a-z]*$")).alias("key"),
        flag(key.rlike("//[^/@]*:$")).alias("user"),
        flag(near.rlike(f"(?:{TELLING})")).alias("telling"),
        flag(near.rlike(f"\\b(?:{OTHERWISE})") | name.rlike(OTHERWISE) | F.lower(v).rlike("example|sample|dummy|placeholder|changeme|your")).alias("otherwise"),
    )


FEATURES = ("length", "transitions", "alternations", "digits", "capitals", "distinct", "dictionary", "wordlike", "extension", "blob", "path", "marks", "hex", "uuid", "prefix", "key", "user", "telling", "otherwise")


def _runs(word: Column, pattern: str, only: str | None = None) -> Column:
    """Array of (key, value, rest) of a word's runs in their order; the key is the run before with what lies between, the rest
    what lies between the run and the next."""

    def of(found: Column) -> Column:
        gaps = F.split(word, pattern, -1)
        key = lambda k: F.lower(F.right(F.concat(F.coalesce(F.get(found, k - 1), F.lit("")), F.get(gaps, k)), F.lit(NEAR)))
        rows = F.transform(found, lambda v, k: F.struct(key(k).alias("key"), v.alias("value"), F.get(gaps, k + 1).alias("rest")))
        return F.filter(rows, lambda x: x["value"].rlike(only)) if only else rows

    return let(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), of)


def _none() -> Column:
    return F.array().cast("array<struct<key:string,value:string,rest:string>>")


def candidates(text: Column) -> Column:
    """Array of feature structs of all value runs of a text, by word. Runs of a plain word (no ``TELLTALE``) in a text without
    any telling word have value and place only: they are no secrets."""

    def of(words: Column, tells: Column) -> Column:
        def word(i: Column) -> Column:
            w = F.get(words, i)
            near = F.lower(F.concat_ws(" ", *[F.right(F.get(words, i - k), F.lit(NEAR)) for k in (3, 2, 1)]))
            found = let(w, lambda w: F.concat(_runs(w, VALUE), F.when(w.rlike(r"[!#$%*@\\^]"), _runs(w, LOOSE, r"[!#$%*@\\^]")).otherwise(_none()), F.when(w.rlike("[/.]"), _runs(w, PART)).otherwise(_none())))
            whole = let(near, lambda near: F.transform(found, lambda x: _features(x, i, near, w)))
            plain = F.transform(F.regexp_extract_all(w, F.lit(VALUE), F.lit(0)), lambda v: F.struct(v.alias("value"), i.alias("at"), *[F.lit(None).cast("double").alias(c) for c in FEATURES]))
            return F.when(tells | w.rlike(TELLTALE), whole).otherwise(plain)

        places = F.filter(F.transform(words, lambda w, i: F.when(F.length(w) >= 8, i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(places, word))

    tells = F.coalesce(text.rlike(f"(?i)(?:{TELLING})"), F.lit(False))
    return let(F.struct(space_words(text).alias("w"), tells.alias("t")), lambda x: of(x["w"], x["t"]))


def labelled_findings(n: int, seed: int) -> list[dict]:
    """n short texts with whether they hold a secret, and the secret."""
    r = random.Random(seed)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa = lambda k: some("0123456789abcdef", k)
    prose = lambda: " ".join(some(low, r.randint(2, 9)) for _ in range(3))
    name = lambda sep: sep.join(r.choice(DICTIONARY) for _ in range(r.randint(2, 4)))
    told = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "access_key", "auth_token", "client_secret"])
    said = lambda: r.choice(["sha256", "md5", "commit", "checksum", "revision", "uuid", "digest", "etag", "file", "order"])
    mixed = low + up + digits
    word = lambda: some(low, r.randint(8, 14))
    shout = lambda: r.choice(["", "!!", "%%%", "***", "$$", ".##"])
    hard = lambda: f"{some(up, 1)}{some(low, r.randint(2, 5))}{some(digits, 1)}{some(mixed, r.randint(4, 9))}"
    marked = lambda: f"{some(up, 1)}{r.choice('@!#$%*^')}{some(low, r.randint(2, 4))}{some(digits, r.randint(1, 2))}{some(low, 2)}{r.choice('!#$*')}{some(digits, r.randint(2, 4))}"
    phrase = lambda: "".join(some(low, r.randint(4, 8)) + some(digits, r.randint(0, 3)) for _ in range(r.randint(2, 3))) + some(digits, 1)
    title = lambda: some(up, 1) + some(low, r.randint(3, 8))
    key = lambda: r.choice([f"AKIA{some(up + '234567', 16)}", f"ghp_{some(mixed, 36)}", f"sk-{some(mixed, r.randint(32, 48))}", some(mixed, r.randint(16, 40)), hexa(r.choice([32, 40]))])
    sure = lambda: r.choice([f"AKIA{some(up + '234567', 16)}", f"ghp_{some(mixed, 36)}", f"sk-{some(mixed, r.randint(32, 48))}"])
    true = [
        lambda: f"{prose()} |AKIA{some(up + '234567', 16)}| {prose()}",
        lambda: f"{prose()} |ghp_{some(mixed, 36)}| {prose()}",
        lambda: f"{prose()} |sk-{some(mixed, r.randint(32, 48))}| {prose()}",
        lambda: f'{prose()} {told()} = "|{hexa(r.choice([32, 40, 64]))}|" {prose()}',
        lambda: f"{prose()} {told()}=|{hexa(r.randint(12, 40))}| {prose()}",
        lambda: f"{prose()} {told()}=|{some(mixed + '+/', r.randint(12, 40))}| {prose()}",
        lambda: f"{prose()} {told()}: |{some(mixed, r.randint(16, 40))}| {prose()}",
        lambda: f"authorization: bearer |eyJ{some(mixed, r.randint(30, 80))}| {prose()}",
        lambda: f"{prose()} |xoxb-{some(digits, 12)}-{some(mixed, 24)}| {prose()}",
        lambda: f'{prose()} {{"id":{r.randint(1, 10**9)},"{told()}":"|{key()}|","user":"{word()}"}} {prose()}',
        lambda: f"{prose()} https://{some(low, 8)}.example.com/{name('/')}?{told()}=|{key()}|&v={r.randint(1, 9)} {prose()}",
        lambda: f"{prose()} |{sure()}|,{word()},{name('-')}-{r.randint(1, 9)} {prose()}",
        lambda: f"{prose()} {word()},{r.randint(1, 10**9)},|{sure()}| {prose()}",
        lambda: f"{prose()} https://{some(low, 8)}.example.com/{word()}/|{sure()}| {prose()}",
        lambda: f"{prose()} {r.choice(['postgres', 'mysql', 'mongodb', 'amqp', 'redis'])}://{some(low, r.randint(4, 9))}:|{hard()}|@{r.choice(['db', some(low, 6)])}:{r.randint(1000, 9999)}/{some(low, 6)} {prose()}",
        lambda: f"{prose()} {told()}=|{marked()}| {prose()}",
        lambda: f'{prose()} {told()} = "|{marked()}|" {prose()}',
        lambda: f"{prose()} {told()}=|{hard()}| {prose()}",
        lambda: f"{prose()} {told()}=|{some(low, r.randint(10, 18))}| {prose()}",
        lambda: f"{prose()} {told()}{r.choice([': ', '=', ' = ', ' is '])}|{phrase()}| {prose()}",
        lambda: f"{prose()} {told()}: |{some(low + digits, r.randint(14, 24))}| {prose()}",
        lambda: f"{prose()} {told().upper()}{r.choice(['=', ': ', ' '])}|{some(low + digits, r.randint(16, 32))}| {prose()}",
        lambda: f"{prose()} {r.choice(['export ', 'set ', ''])}{word().upper()}_{told().upper()}={r.choice(['', chr(34)])}|{key()}| {prose()}",
        lambda: f"{prose()} {told()} {r.choice(['is', 'was', ''])} |{hard()}| {prose()}",
        lambda: f"{prose()} {told()}: |{some(mixed + digits, r.randint(14, 24))}| {prose()}",
    ]
    false = [
        lambda: f"{prose()} {said()} {hexa(r.choice([32, 40, 64]))} {prose()}",
        lambda: f"{prose()} {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)} {prose()}",
        lambda: f"{prose()} {some(digits, r.randint(12, 19))} {prose()}",
        lambda: f"{prose()} {name('_')}_{r.randint(1, 99)} {prose()}",
        lambda: f"{prose()} {name('-')}-{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)} {prose()}",
        lambda: f"{prose()} /usr/{name('/')}/{some(low, 6)}{r.randint(1, 99)}.txt {prose()}",
        lambda: f"{prose()} https://{some(low, 8)}.example.com/{name('/')}?id={r.randint(1, 10**9)} {prose()}",
        lambda: f"{prose()} {told()}=your_{name('_')}_here1 {prose()}",
        lambda: f"{prose()} {told()} = \"example{r.randint(1000, 99999)}placeholder\" {prose()}",
        lambda: f"{prose()} {some(low, r.randint(8, 14))}{some(up, 1)}{some(low, 6)} {prose()}",
        lambda: f"{prose()} {some(up, r.randint(12, 18))} {prose()}",
        lambda: f"{prose()} {some(low, 6)}{r.randint(1, 99)}@{some(low, 7)}.example.org {prose()}",
        lambda: f"{prose()} 20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00 {prose()}",
        lambda: f"{prose()} AKIA{some(up, 9)}EXAMPLE {prose()}",
        lambda: f"{prose()} {'.'.join(str(r.randint(1, 255)) for _ in range(4))} {prose()}",
        lambda: f"{prose()} +{r.randint(1, 99)}-{some(digits, 3)}-{some(digits, 3)}-{some(digits, 4)} {prose()}",
        lambda: f"{prose()} {some(up, r.randint(8, 12))}!!{some(up, 4)} {prose()}",
        lambda: f"{prose()} {word()} {word()} {some(up, 1)}{word()}. {some(up, 1)}{word()} {prose()}",
        lambda: f"{prose()} {told()}: {word()} {word()} {prose()}",
        lambda: f'{prose()} {{"{said()}":"{hexa(r.choice([32, 40, 64]))}","id":"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}","{name("_")}":"{word()}"}} {prose()}',
        lambda: f"{prose()} {r.randint(1, 10**9)},{word()},20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)},{some(digits, 12)},{name('_')} {prose()}",
        lambda: f"{prose()} https://{some(low, 8)}.example.com/{name('/')}/{word()}-{word()}?page={some(digits, 8)}&order={word()} {prose()}",
        lambda: f"{prose()} {word()}://{some(low, 7)}.example.com:{r.randint(1000, 9999)}/{word()} {prose()}",
        lambda: f"{prose()} {some(low, r.randint(3, 8))}.{some(digits, 2)}@{some(low, 5)}{r.randint(1, 9)}.example.{r.choice(['com', 'org', 'net'])}{shout()} {prose()}",
        lambda: f"{prose()} {'.'.join(str(r.randint(1, 255)) for _ in range(4))}{shout()} {prose()}",
        lambda: f"{prose()} {r.choice(['', '+1-'])}{some(digits, 3)}-{some(digits, 4)}{shout()} {some(digits, 16)}{shout()} {prose()}",
        lambda: f"{prose()} {word()}{shout()} {some(up, r.randint(6, 12))}{shout()} {r.choice('#*$%&|') * r.randint(8, 20)} {prose()}",
        lambda: f"{prose()} {some(low, 6)}{some(up, 1)}{some(low, 6)}({name('_')},{word()}.{word()}) {prose()}",
        lambda: f"{prose()} {some(up, r.randint(2, 9))}!! {some(up, r.randint(8, 14))}!! {some(up, r.randint(4, 9))}.!! {prose()}",
        lambda: f"{prose()} {hexa(r.choice([32, 40, 40, 64]))} {prose()}",
        lambda: f"git {r.choice(['show', 'revert', 'reset --hard', 'cherry-pick'])} {hexa(r.choice([12, 20, 40]))} {prose()}",
        lambda: f'{prose()} "{r.choice(["resolved", "sum", "content"])}": "sha{r.choice([1, 256, 384])}-{some(mixed + "+/", r.choice([27, 43, 64, 86]))}==" {prose()}',
        lambda: f"{prose()} {r.choice(['DSC', 'PXL', 'VID', 'Scan'])}_20{r.randint(10, 29)}{some(digits, 4)}_{some(digits, 6)}.{r.choice(['png', 'jpeg', 'mp4', 'heic'])} {prose()}",
        lambda: f"{prose()} {r.choice(['org', 'net', 'io'])}.{some(low, 5)}.{word()}.{''.join(title() for _ in range(r.randint(2, 4)))} {prose()}",
        lambda: f"{prose()} {''.join(title() for _ in range(r.randint(2, 5)))}.{r.choice(['java', 'py', 'cs', 'tsx'])} {prose()}",
        lambda: f"{prose()} data:{r.choice(['font/woff', 'image/gif', 'audio/mp3'])};base64,{some(mixed + '+/', r.randint(30, 120))}= {prose()}",
        lambda: f"{prose()} https://{some(low, 6)}.example.com/{some(low, 4)}?{some(low, 1)}={some(mixed + '_-', r.randint(8, 12))} {prose()}",
        lambda: f"{prose()} /{some(low, 6)}/{word()}.{r.choice([hexa(8), some(mixed, 8), hexa(16)])}.{r.choice(['css', 'js', 'woff2', 'svg'])} {prose()}",
        lambda: f"{prose()} {word()}-{r.choice([hexa(8), some(low + digits, 10)])}.{r.choice(['css', 'js', 'png'])} {prose()}",
        lambda: f"{prose()} {r.choice(['request', 'trace', 'job', 'span'])} {r.choice([hexa(16), hexa(32), some(low + digits, 12)])} {prose()}",
        lambda: f"{prose()} {phrase()} {prose()}",
    ]
    out = []
    for i in range(n):
        secret = i % 2
        text = r.choice(true if secret else false)()
        out.append({"text": text.replace("|", ""), "secret": secret, "value": text.split("|")[1] if secret else ""})
    return out


def train(spark: SparkSession, cfg: Forest) -> str:
    """SQL expression over a feature struct ``f``: the forest's probability of a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = F.explode(F.from_json(F.lit(json.dumps(labelled_findings(cfg.findings, cfg.seed))), "array<struct<text:string,value:string>>"))
    found = spark.range(1, numPartitions=1).select(rows.alias("r")).select("r.value", F.explode(candidates(F.col("r.text"))).alias("f"))
    inside = F.col("value").contains(F.col("f.value")) | F.col("f.value").contains(F.col("value"))
    found = found.where("f.length IS NOT NULL").select(((F.length("value") > 0) & inside).cast("double").alias("label"), "f")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.select("label", "f.*"))
    model = RandomForestClassifier(
        numTrees=cfg.trees, maxDepth=cfg.depth, seed=cfg.seed, featureSubsetStrategy="onethird", maxBins=64
    ).fit(table.select("label", "features").coalesce(1))

    def sql(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / sum(stats):.6f}D"
        split = node.split()
        return f"IF(f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    trees = [sql(t.rootNode()) for t in model._java_obj.trees()]
    return f"IF(f.length IS NULL, 0D, ({' + '.join(trees)}) / {len(trees)})"


def scan(docs: DataFrame, cfg: Forest = Forest()) -> tuple[DataFrame, str]:
    """All columns and ``{prefix}found``: array of (at, value, score) for every candidate."""
    prefix = without_clash(docs)
    forest = train(docs.sparkSession, cfg)
    work = docs.withColumn(f"{prefix}c", candidates(F.col("text")))
    score = F.expr(f"transform({prefix}c, f -> named_struct('at', f.at, 'value', f.value, 'score', {forest}))")
    return work.withColumn(f"{prefix}found", score).drop(f"{prefix}c"), prefix


def digest(docs: DataFrame, cfg: Forest = Forest()) -> DataFrame:
    """One row for each document: its candidates, the secrets among them, and their digest."""
    out, p = scan(docs.select("doc_id", "text"), cfg)
    secrets = F.filter(F.col(f"{p}found"), lambda x: x["score"] >= cfg.threshold)
    rows = out.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(f"{p}found").cast("long").alias("n_candidates"), secrets.alias("s"))
    return rows.select(
        "doc_id",
        "n_candidates",
        F.size("s").cast("long").alias("n_secrets"),
        F.transform("s", lambda x: x["at"].cast("long")).alias("secret_words"),
        F.sha2(F.array_join(F.transform("s", lambda x: x["value"]), "\n"), 256).alias("secrets_sha256"),
        F.coalesce(F.round(F.array_max(F.transform("s", lambda x: x["score"])), 4), F.lit(0.0)).alias("score"),
    )


def redact(docs: DataFrame, cfg: Forest = Forest(), mark: str = "<secret>") -> DataFrame:
    """The documents with the values of secrets replaced by ``mark`` wherever they stand in their text."""
    out, p = scan(docs, cfg)
    values = F.transform(F.filter(F.col(f"{p}found"), lambda x: x["score"] >= cfg.threshold), lambda x: x["value"])
    text = F.aggregate(values, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
