"""Rows of SQL dumps, cut split by split: statements of many lines, many rows a statement, column lists, quotes, comments.

The automaton's states are the kinds of text that a line may end in (plain, three quotes, a block comment), with the depth of
parentheses and the number of VALUES words since the statement began, which are relative to the split's start until a semicolon
comes. Units are statements' heads up to VALUES and the rows behind them, so a statement of any number of rows is cut like any
other. Rows that follow a head of an earlier split get it from the last head before, one for each split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystat.plans.scratch import materialize
from quarrystat.sources.splits import by_split, joined_pieces, split_lines, start_states, with_states

PLAIN, SINGLE, DOUBLE, BACK, COMMENT = range(5)
OPENS = {"'": SINGLE, '"': DOUBLE, "`": BACK, "/*": COMMENT}
MARK = re.compile(r"['\"`();]|--|/\*|\bvalues\b", re.I)


class Lexer:
    """Splits a line into (text, mark) in a state: marks are ( ) ; and values outside of quotes; comments have no text.
    ``escapes``: a backslash in a quote takes the next character with it."""

    def __init__(self, escapes: bool):
        before = r"(?:[^\\{0}]|\\.|\\$)*" if escapes else "[^{0}]*"
        self.close = {SINGLE: re.compile(before.format("'") + "'"), DOUBLE: re.compile(before.format('"') + '"'), BACK: re.compile("[^`]*`"), COMMENT: re.compile(r".*?\*/")}

    def cut(self, line: str, state: int) -> tuple[list[tuple[str, str]], int]:
        out, at, n, kept = [], 0, len(line), 0
        while at <= n:
            if state != PLAIN:
                m = self.close[state].match(line, at)
                if not m:
                    if state != COMMENT:
                        out.append((line[kept:], ""))
                    return out, state
                at = m.end()
                kept = at if state == COMMENT else kept
                state = PLAIN
                continue
            m = MARK.search(line, at)
            if not m:
                break
            mark = m[0].lower()
            if mark == "--":
                out.append((line[kept : m.start()], ""))
                return out, PLAIN
            if mark in OPENS:
                state = OPENS[mark]
                if state == COMMENT:
                    out.append((line[kept : m.start()], ""))
                at = m.end()
                continue
            out.append((line[kept : m.end()], mark))
            at = kept = m.end()
        out.append((line[kept:], ""))
        return out, state


def _outcomes(lexer: Lexer):
    def run(lines: Iterator[str]) -> dict:
        now = list(range(5))
        depth, ended, values, seen = [0] * 5, [False] * 5, [0] * 5, [{} for _ in range(5)]
        for line in lines:
            cuts: dict[int, tuple] = {}
            for h in range(5):
                if now[h] not in cuts:
                    cuts[now[h]] = lexer.cut(line, now[h])
                marks, after = cuts[now[h]]
                now[h] = after
                for _, mark in marks:
                    if mark == "(":
                        depth[h] += 1
                    elif mark == ")":
                        depth[h] -= 1
                    elif mark == ";":
                        depth[h], ended[h], values[h] = 0, True, 0
                    elif mark and ended[h]:
                        values[h] += depth[h] == 0
                    elif mark:
                        seen[h][str(depth[h])] = seen[h].get(str(depth[h]), 0) + 1
        return {"outcome": json.dumps([list(x) for x in zip(now, depth, ended, values, seen)])}

    return run


def _compose(now: dict, row: dict) -> dict:
    after, depth, ended, values, seen = json.loads(row["outcome"])[now["state"]]
    if ended:
        return {"state": after, "depth": depth, "words": values}
    return {"state": after, "depth": now["depth"] + depth, "words": now["words"] + seen.get(str(-now["depth"]), 0)}


UNIT = "file string, start long, seq long, kind string, head string, text string, place long, ends string"
_NAMES = [x.split()[0] for x in UNIT.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _units(lexer: Lexer):
    """Rows by kind: ``row`` (one row of values, its head if it stands in the split), ``other`` (a statement without values),
    ``piece`` (of a unit that crosses splits) and one ``split`` (the last head that ends in the split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, state, depth, words), lines in by_split(batches):
            out: list[tuple] = []
            going, held, head, last, seq = words == 0 or words == 1 and depth > 0, [], None, None, 0

            def put(kind: str) -> None:
                nonlocal going, held, seq, head, last
                text, held = "".join(held), []
                if going:
                    out.append((file, start, seq, "piece", None, text, 0, kind))
                elif kind == "head":
                    head = last = text
                else:
                    out.append((file, start, seq, kind, head, text, None, None))
                if going and kind == "head":
                    head = None  # known from its pieces
                going, seq = False, seq + 1

            for line in lines:
                marks, state = lexer.cut(line, state)
                for text, mark in marks:
                    if words == 0:
                        held.append(text)
                    elif words == 1 and (depth > 0 or mark == "("):
                        held.append(text if depth > 0 else "(")
                    depth += (mark == "(") - (mark == ")")
                    if mark == ";":
                        if words == 0:
                            put("other")
                        depth, words, held = 0, 0, []
                    elif mark == "values" and depth == 0:
                        words += 1
                        if words == 1:
                            put("head")
                    elif mark == ")" and depth == 0 and words == 1:
                        put("row")
                if held:
                    held.append("\n")
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)
                    out.clear()
            if words == 0 or words == 1 and depth > 0:
                out.append((file, start, seq, "piece", head, "".join(held), 0 if going else 1, None))
            out.append((file, start, seq + 1, "split", last, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return run


def units(spark: SparkSession, path: str, escapes: bool = False) -> DataFrame:
    """Units (file, start, seq, kind, head, text) of a dump: rows with their statement's head, and other statements."""
    lexer = Lexer(escapes)
    states = start_states(split_lines(spark, path), _outcomes(lexer), "outcome string", _compose, {"state": PLAIN, "depth": 0, "words": 0}, "state int, depth int, words int")
    states = materialize(states.drop("outcome"), "dump_states")
    cut = materialize(with_states(split_lines(spark, path), states).mapInArrow(_units(lexer), UNIT), "dump_units")
    across = joined_pieces(cut.where("kind = 'piece'"), "head", "seq")
    open_row = F.col("ends").isNull() & F.col("text").startswith("(")
    across = materialize(across.select("file", "at", F.when(open_row, F.raise_error(F.lit("the dump ends inside a row")).cast("string")).otherwise(F.col("ends")).alias("kind"), "text", "opened", "head", "seq"), "dump_across")
    # the head in force where a split starts, or once a head that came in pieces ends in it
    pieced = across.where("kind = 'head'").select("file", F.col("at").alias("start"), F.col("text").alias("pieced"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = cut.where("kind = 'split'").select("file", "start", F.col("head").alias("last")).join(pieced, ["file", "start"], "left")
    last = last.select("file", "start", F.coalesce("pieced", F.last(F.coalesce("last", "pieced"), True).over(before)).alias("force"))
    whole = across.where("kind IN ('row', 'other')").select("file", F.col("opened").alias("start"), "seq", "kind", "head", "text")
    every = cut.where("kind IN ('row', 'other')").select("file", "start", "seq", "kind", "head", "text").unionByName(whole)
    known = every.where("head IS NOT NULL OR kind = 'other'")
    found = every.where("head IS NULL AND kind = 'row'").join(last, ["file", "start"]).select("file", "start", "seq", "kind", F.col("force").alias("head"), "text")
    return known.unionByName(found)


NAME = r"(?:`[^`]+`|\"[^\"]+\"|\w+)"
INTO = rf"(?is)^\s*(?:insert|replace)\s+(?:\w+\s+)*?into\s+((?:{NAME}\s*\.\s*)?{NAME})\s*(?:\((.*)\))?\s*values\s*$"
CREATE = rf"(?is)^\s*create\s+(?:\w+\s+)*?table\s+(?:if\s+not\s+exists\s+)?((?:{NAME}\s*\.\s*)?{NAME})\s*\((.*)\)[^)]*$"
#: Words that start a part of CREATE TABLE which is no column.
NO_COLUMN = {"primary", "unique", "key", "constraint", "foreign", "check", "index", "fulltext", "exclude"}


def _bare(name: str) -> str:
    """The last part of a name, without its quotes."""
    return re.findall(NAME, name.strip())[-1].strip("`\"")


def parts(body: str, escapes: bool) -> list[str]:
    """A list in parentheses cut at its own commas."""
    lexer, out, held, depth, state = re.compile(r"[(),'\"`]"), [], 0, 0, None
    for m in lexer.finditer(body):
        c = m[0]
        if state:
            if c == state and not (escapes and (len(body[: m.start()]) - len(body[: m.start()].rstrip("\\"))) % 2):
                state = None
        elif c in "'\"`":
            state = c
        elif c == ",":
            if depth == 0:
                out.append(body[held : m.start()])
                held = m.end()
        else:
            depth += 1 if c == "(" else -1
    return [*out, body[held:]]


ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def scalar(token: str, escapes: bool) -> str | None:
    """A value as a string; NULL and nothing are null."""
    t = token.strip()
    if not t or t.upper() == "NULL":
        return None
    if len(t) > 1 and t[0] == t[-1] == "'":
        inner = t[1:-1].replace("''", "'")
        return re.sub(r"(?s)\\(.)", lambda m: ESCAPED.get(m[1], m[1]), inner) if escapes else inner.replace("\\'", "'")
    return t


def read_sql_dump(spark: SparkSession, path: str, table: str | None = None, escapes: bool = False) -> DataFrame:
    """Rows of the INSERT and REPLACE statements of one table (default: the first that is created), all columns as strings.

    Columns are those of CREATE TABLE, or of the first INSERT with a column list; a column that a statement does not name is
    null. A row with more or fewer values than columns is an error. ``escapes``: backslash escapes in quotes.
    """
    found = units(spark, path, escapes)
    named = lambda kind, pattern: found.where(F.col("kind") == kind).withColumn("table", F.lower(F.regexp_replace(F.regexp_extract("head" if kind == "row" else "text", pattern, 1), "^.*\\.\\s*|[`\"]", "")))
    creates = named("other", CREATE).where("table <> ''")
    if table:
        creates = creates.where(F.col("table") == table.lower())
    first = creates.agg(F.min(F.struct("file", "start", "seq", "table", "text")).alias("x")).first()["x"]
    if first:
        table = first["table"]
        body = re.match(CREATE, first["text"])[2]
        names = [p.split() for p in parts(body, escapes)]
        columns = [_bare(p[0]) for p in names if p and p[0].lower() not in NO_COLUMN]
    rows = named("row", INTO).where("table <> ''")
    if table:
        rows = rows.where(F.col("table") == table.lower())
    if not first:
        listed = rows.where(F.regexp_extract("head", INTO, 2) != "").agg(F.min(F.struct("file", "start", "seq", "head", "table")).alias("x")).first()["x"]
        if not listed:
            raise ValueError(f"no CREATE TABLE and no column list of {table or 'any table'} in {path}")
        columns = [_bare(c) for c in re.match(INTO, listed["head"])[2].split(",")]
        rows = rows.where(F.col("table") == listed["table"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c.lower(): i for i, c in enumerate(columns)}
        known: dict[str, list[int]] = {}
        for batch in batches:
            out: list[list[str | None]] = [[] for _ in columns]
            for head, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if head not in known:
                    names = re.match(INTO, head)[2]
                    known = {head: [place[_bare(c).lower()] for c in names.split(",")] if names else list(range(len(columns)))}
                cells = [scalar(p, escapes) for p in parts(text[1:-1], escapes)]
                if len(cells) != len(known[head]):
                    raise ValueError(f"{len(cells)} values for {len(known[head])} columns: {text[:200]}")
                row: list[str | None] = [None] * len(columns)
                for i, x in zip(known[head], cells):
                    row[i] = x
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], columns)

    return rows.select("head", "text").mapInArrow(parse, ", ".join(f"`{c}` string" for c in columns))
