"""Numbered rows, batches, artifacts and workbooks."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystat.plans.scratch import materialize


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with row_index from 0 by ``order``: partitions are ranges, and a partition's first number is the rows before it,
    from one count a partition; nothing is sorted in one task."""
    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    marked = parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    marked = materialize(marked, "numbered")  # the counts and the rows must see the same partitions
    counts = marked.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.join(F.broadcast(counts.select("_p", before.alias("_b"))), "_p").withColumn("row_index", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def batches(df: DataFrame, index: str, size: int, columns: list[str] | None = None, limit: int | None = None) -> Iterator[DataFrame]:
    """Consecutive slices of ``size`` rows by an index column, each a filter that reaches the scan, not an offset."""
    top = df.agg(F.max(index)).first()[0]
    end = -1 if top is None else min(top, limit - 1 if limit is not None else top)
    for lo in range(0, end + 1, size):
        part = df.where((F.col(index) >= lo) & (F.col(index) <= min(lo + size - 1, end)))
        yield part.select(*columns) if columns else part


def append_rows(df: DataFrame, path: str) -> None:
    """Rows appended to a table; Spark's committer shows them whole or not at all."""
    df.write.mode("append").parquet(path)


def write_artifact(df: DataFrame, path: str, kind: str) -> None:
    """A result as json, csv (with a header) or md (a table of text), replaced as a whole."""
    if kind in ("json", "csv"):
        df.write.mode("overwrite").options(header=True).format(kind).save(path)
    elif kind == "md":
        cell = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |"))
        head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))], "o int, value string")
        rows = head.unionByName(df.select(F.lit(2).alias("o"), line.alias("value")))
        rows.orderBy("o", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")


SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet(raw: bytes, number: int) -> list[list[str | None]]:
    """Cells of a workbook's sheet as strings, by row and column; formulas give their kept values."""
    book = zipfile.ZipFile(BytesIO(raw))
    names, shared = book.namelist(), []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{SPACE}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SPACE}si")]
    rows = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{SPACE}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{SPACE}c"):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                at = at * 26 + ord(letter) - 64
            cells += [None] * (at - 1 - len(cells) if at else 0)
            value, text = c.find(f"{SPACE}v"), "".join(t.text or "" for t in c.iter(f"{SPACE}t"))
            kind = c.get("t")
            cells.append(shared[int(value.text)] if kind == "s" and value is not None else text if kind == "inlineStr" else value.text if value is not None else None)
        rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A workbook's sheet, its first row the header; all columns strings. Several workbooks of one header are read together,
    each by one task: a workbook is one zipped file, so it can't be split."""
    from quarrystat.sources.readers import unique_headers

    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").head()
    rows = _sheet(bytes(first["content"]), sheet) if first else []
    if not rows:
        return spark.createDataFrame([], "column string")
    names = unique_headers([c or "" for c in rows[0]])

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            for raw in pdf["content"]:
                found = [(r + [None] * len(names))[: len(names)] for r in _sheet(bytes(raw), sheet)[1:]]
                yield pd.DataFrame(found, columns=names, dtype=object)

    return files.select("content").mapInPandas(parse, ", ".join(f"`{c}` string" for c in names))
