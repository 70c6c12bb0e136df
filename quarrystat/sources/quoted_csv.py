"""CSV with line breaks inside quotes, cut into records split by split."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.plans.scratch import materialize
from quarrystat.sources.splits import by_split, joined_pieces, split_lines, start_states, with_states


class Quotes:
    """Whether a line ends inside a quoted field. A quote opens at a field's start only; doubled quotes are characters."""

    def __init__(self, sep: str = ",", quote: str = '"'):
        q, s = re.escape(quote), re.escape(sep)
        self.quote, self.rest = quote, re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}")
        self.field = re.compile(f"{q}[^{q}]*(?:{q}{q}[^{q}]*)*{q}[^{s}]*(?:{s}|$)|(?!{q})[^{s}]*(?:{s}|$)")
        self.end = re.compile(f"[^{s}]*(?:{s}|$)")

    def after(self, line: str, inside: bool) -> bool:
        if not inside and self.quote not in line:
            return False
        at = 0
        if inside:
            m = self.rest.match(line)
            if not m:
                return True
            at = self.end.match(line, m.end()).end()
        while at < len(line):
            m = self.field.match(line, at)
            if not m:
                return True
            at = m.end()
        return False


def _states(lines: DataFrame, quotes: Quotes) -> DataFrame:
    def outcomes(mine: Iterator[str]) -> dict:
        now, ever = [False, True], [False, False]
        for line in mine:
            now = [quotes.after(line, x) for x in now]
            ever = [a or b for a, b in zip(ever, now)]
        return {"plain": now[0], "quoted": now[1], "plain_crossed": ever[0], "quoted_crossed": ever[1]}

    compose = lambda now, row: {"inside": bool(row["quoted"] if now["inside"] else row["plain"])}
    schema = "plain boolean, quoted boolean, plain_crossed boolean, quoted_crossed boolean"
    return start_states(lines, outcomes, schema, compose, {"inside": False}, "inside boolean")


def _records(quotes: Quotes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "seq", "place", "text", "ends"]
        for (file, start, inside), lines in by_split(batches):
            held, going, seq, rows = [], inside, 0, []
            for line in lines:
                open_ = quotes.after(line, inside)
                held.append(line if open_ else line.removesuffix("\r"))
                if not open_:
                    rows.append((file, start, seq, 0 if going else None, "\n".join(held), "record" if going else None))
                    held, going, seq = [], False, seq + 1
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names)
                        rows = []
                inside = open_
            if held:
                rows.append((file, start, seq, 0 if going else 1, "\n".join(held) + "\n", None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names)

    return run


TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
PIECE = "file string, start long, seq long, place long, text string, ends string"


def quoted_breaks(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> tuple[DataFrame, bool]:
    """The states of all splits, and whether any quoted line break occurs."""
    states = materialize(_states(split_lines(spark, path), Quotes(sep, quote)), "csv_states")
    broken = states.where("inside OR plain_crossed").limit(1).count() > 0
    return states.select("file", "start", "inside"), broken


def records(spark: SparkSession, path: str, states: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """Records (file, start, seq, text) of all files; the first of a file has start 0 and seq 0."""
    cut = materialize(with_states(split_lines(spark, path), states).mapInArrow(_records(Quotes(sep, quote)), PIECE), "csv_records")
    across = joined_pieces(cut.where("place IS NOT NULL"), "seq")
    # an open quote at the end of a file closes there
    whole = across.select("file", F.col("opened").alias("start"), "seq", F.regexp_replace("text", "\n$", "").alias("text"))
    return cut.where("place IS NULL").select("file", "start", "seq", "text").unionByName(whole)


#: Types that a column may have, narrowest first.
TYPES_TRIED = ("int", "bigint", "double", "date", "timestamp", "boolean")


def typed(df: DataFrame) -> DataFrame:
    """String columns in the first type that all of their values have; one aggregate job."""
    value = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(""))
    fits = lambda c, t: F.coalesce(F.min((value(c).isNull() | value(c).try_cast(t).isNotNull()).cast("int")), F.lit(1)) == 1
    # a date is written with a month and a day, a truth value as a word
    forms = {"date": r"^\d{4}-\d{1,2}-\d{1,2}$", "timestamp": r"^\d{4}-\d{1,2}-\d{1,2}[ T]", "boolean": "(?i)^(true|false)$"}
    like = lambda c, t: F.coalesce(F.min((value(c).isNull() | value(c).rlike(forms[t])).cast("int")), F.lit(1)) == 1 if t in forms else F.lit(True)
    some = lambda c: F.count(value(c)) > 0
    told = df.agg(*[(fits(c, t) & like(c, t) & some(c)).alias(f"{i}|{t}") for i, c in enumerate(df.columns) for t in TYPES_TRIED]).first()
    kind = [next((t for t in TYPES_TRIED if told[f"{i}|{t}"]), "string") for i in range(len(df.columns))]
    return df.select(*[value(c).try_cast(t).alias(c) if t != "string" else value(c).alias(c) for c, t in zip(df.columns, kind)])


def read_quoted(spark: SparkSession, path: str, states: DataFrame, sep: str = ",", quote: str = '"') -> tuple[DataFrame, list[str]]:
    """The table and its header's names as they stand; each file's first record is its header."""
    rows = records(spark, path, states, sep, quote)
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE"}
    header = rows.where("start = 0 AND seq = 0").orderBy("file").limit(1).first()
    if header is None:
        return spark.createDataFrame([], "column string"), ["column"]
    wide = F.from_csv(F.lit(header["text"]), ", ".join(f"c{i} string" for i in range(header["text"].count(sep) + 1)), options)
    names = [n for n in spark.range(1).select(wide.alias("h")).first()["h"]]
    while len(names) > 1 and names[-1] is None and not header["text"].rstrip("\n").endswith(sep):
        names.pop()  # separators inside quoted names
    body = rows.where("NOT (start = 0 AND seq = 0) AND trim(text) <> ''")
    parsed = body.select(F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), options).alias("r")).select("r.*")
    return typed(materialize(parsed, "csv")), [n or "" for n in names]
