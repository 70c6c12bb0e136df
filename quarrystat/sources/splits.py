"""Text whose units cross lines and file splits: quoted line breaks of CSV, statements of SQL dumps.

A reader that cuts a file anywhere doesn't know whether a split starts inside a quote. So each split is run through a small
automaton from every state it may start in; the outcomes are functions from state to state and compose along a file, which
gives each split its true start. A second pass cuts the units that lie within a split, and what crosses splits is put together
from its pieces, a group for each such unit. No task reads more than a split and no unit is lost at a boundary.

Splits are those of Spark's text reader; a split that the first pass has not seen (the cluster's size changed between the
passes) is an error, never a guess.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, file, start) in order within their split of the file, which begins at byte ``start``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Lines of each split of a partition, with the values of the other columns, which are the same for a split."""
    def rows() -> Iterator[tuple[tuple, str]]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            others = list(zip(*[batch.column(i).to_pylist() for i in range(1, batch.num_columns)]))
            yield from zip(others, texts)

    it = rows()
    held = next(it, None)
    while held is not None:
        key = held[0]

        def mine() -> Iterator[str]:
            nonlocal held
            while held is not None and held[0] == key:
                yield held[1] or ""
                held = next(it, None)

        lines = mine()
        yield key, lines
        for _ in lines:  # what the caller left
            pass


def start_states(lines: DataFrame, outcomes: Callable, schema: str, compose: Callable, first: dict, state: str) -> DataFrame:
    """Table (file, start, state columns, outcome columns): the state in which each split starts, and its outcome.

    ``outcomes(lines)`` gives the split's outcome as a dict of columns of ``schema``; ``compose(state, outcome)`` gives the state
    after it. A file's splits are composed in one group of one row a split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), mine in by_split(batches):
            row = {"file": file, "start": start, **outcomes(mine)}
            yield pa.RecordBatch.from_pandas(pd.DataFrame([row]), preserve_index=False)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], dict(first)
        for row in pdf.sort_values("start").to_dict("records"):
            out.append({**now, **row})
            now = compose(now, row)
        return pd.DataFrame(out)

    found = lines.mapInArrow(run, f"file string, start long, {schema}")
    return found.groupBy("file").applyInPandas(fold, f"file string, start long, {state}, {schema}")


def with_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines (value, file, start) with their split's state columns, in the same order; ``states`` has one row a split."""
    joined = lines.join(F.broadcast(states.withColumn("known", F.lit(True))), ["file", "start"], "left")
    known = F.when(F.col("known"), F.col("start")).otherwise(F.raise_error(F.lit("file splits changed between the passes")).cast("long"))
    rest = [c for c in states.columns if c not in ("file", "start")]
    return joined.select("value", "file", known.alias("start"), *rest)


def joined_pieces(pieces: DataFrame, *first: str) -> DataFrame:
    """Units that cross splits, from pieces (file, start, place, text, ends): place 0 goes on from the split before, place 1 opens
    at the end of its split; ``ends`` is what the unit is once its last piece closes it, null before. ``first``: columns of the
    opening piece to keep. Result: file, at (the split that closes it), text, ends, opened (its first split)."""
    order = Window.partitionBy("file").orderBy("start", "place")
    unit = F.sum("place").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.struct("start", "place", "text", *first)
    rows = pieces.withColumn("unit", unit).groupBy("file", "unit").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.max("ends").alias("ends"), F.max("start").alias("at")
    )
    opening = F.get("parts", F.lit(0))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return rows.select("file", "at", text.alias("text"), "ends", opening["start"].alias("opened"), *[opening[c].alias(c) for c in first])
