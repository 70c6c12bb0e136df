"""Guarded ad-hoc SQL: one read-only statement with a row cap, decided by the parsed plan and not by forbidden words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class NotAllowed(ValueError):
    """The statement is not a single query, or its result is over the cap."""


#: Parts of names of plan nodes that write, change the session or run programs.
WRITES = ("command", "insertinto", "createtable", "createview", "replace", "drop", "alter", "delete", "update", "merge", "write", "scripttransformation", "compound", "cache", "setcatalog")
#: Table functions of the language itself; others may read files or run programs.
TABLES = {"range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack", "json_tuple", "values", "variant_explode", "variant_explode_outer"}
#: Functions that call any Java method.
CALLS = {"reflect", "java_method", "try_reflect"}


def _children(node) -> Iterator:
    for name in ("children", "innerChildren"):
        found = getattr(node, name)()
        for i in range(found.size()):
            yield found.apply(i)


def _nodes(node, seen_depth: int = 0) -> Iterator:
    """All plan nodes and expressions of a parsed plan, common table expressions and subqueries included."""
    yield node
    for child in _children(node):
        yield from _nodes(child, seen_depth + 1)
    kind = node.getClass().getName()
    if ".plans.logical." in kind or ".analysis." in kind and hasattr(node, "expressions"):
        try:
            found = node.expressions()
        except Exception:  # an unresolved expression, not a plan
            return
        for i in range(found.size()):
            yield from _nodes(found.apply(i), seen_depth + 1)
    elif "Subquery" in kind or kind.endswith((".Exists", ".InSubquery", ".ListQuery", ".LateralSubquery")):
        try:
            yield from _nodes(node.plan(), seen_depth + 1)
        except Exception:  # its query is among the children
            return


def guarded_sql(spark: SparkSession, sql: str, max_rows: int | None = None, args: dict | None = None) -> DataFrame:
    """The query's lazy result. Commands (DDL, DML, SET, CACHE) are refused before anything runs, wherever they stand: after
    common table expressions, as one of several inserts from one source, or in a script; so are calls of Java methods, files
    named by their path, and table functions other than the language's own.

    With ``max_rows`` at most max_rows + 1 rows are counted, and a larger result is refused.
    """
    text = sql.strip().rstrip(";")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if not text.lower().lstrip("( \n").startswith(("select", "with", "values", "from")):
        raise NotAllowed("only a single SELECT or WITH query is allowed")
    for node in _nodes(parsed):
        kind = node.getClass().getName()
        name = kind.rsplit(".", 1)[-1].lower()
        if ".plans.logical." in kind or ".execution." in kind or ".commands." in kind:
            if ".command." in kind or any(w in name for w in WRITES):
                raise NotAllowed("only queries are allowed")
        if name == "unresolvedrelation":
            parts = node.multipartIdentifier()
            words = [parts.apply(i) for i in range(parts.size())]
            # format.`path` reads a file; a table of the catalog has its name there
            if len(words) > 1 and not spark.catalog.tableExists(".".join(f"`{w.replace('`', '``')}`" for w in words)):
                raise NotAllowed("only tables and views are read, not files")
        elif name == "unresolvedtablevaluedfunction":
            parts = node.name()
            if parts.size() > 1 or parts.apply(0).lower() not in TABLES:
                raise NotAllowed("only table functions of the language are allowed")
        elif name == "unresolvedfunction":
            parts = node.nameParts()
            if parts.apply(parts.size() - 1).lower() in CALLS:
                raise NotAllowed("calls of Java methods are not allowed")
    out = spark.sql(text, args=args or {})
    if max_rows is not None and out.limit(max_rows + 1).count() > max_rows:
        raise NotAllowed(f"more than {max_rows} rows")
    return out


def statement_id(sql: str) -> str:
    """Stable name of a statement: sha256 of its text with runs of white space collapsed."""
    return hashlib.sha256(" ".join(sql.split()).encode()).hexdigest()
