"""Versioned tables: appended under a version and in row ranges, read by version and range with partition pruning.

A version's rows are numbered from 0 in a given order and cut into ranges of ``size`` rows, each a folder
``version=v/rows=k``. A read of some versions or of a range of row numbers names the folders that it needs in the plan, and a
join with a small table of versions prunes while it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.sources.sinks import numbered


class Versions:
    def __init__(self, path: str, size: int = 1_000_000):
        self.path, self.size = path.rstrip("/"), size

    def write(self, df: DataFrame, version: str, order: list[str]) -> None:
        """Write a version as a whole, its rows numbered by ``order``; writing it again replaces it and leaves the others."""
        rows = numbered(df, order).withColumn("version", F.lit(version)).withColumn("rows", F.floor(F.col("row_index") / self.size).cast("long"))
        rows.drop("version").write.mode("overwrite").partitionBy("rows").parquet(f"{self.path}/version={version}")

    def read(self, spark: SparkSession, version: str | None = None, first: int | None = None, last: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a version (default: of all) with ``version`` and ``row_index``, from row ``first`` to ``last``, both included."""
        out = spark.read.parquet(self.path).withColumn("version", F.col("version").cast("string"))
        if version is not None:
            out = out.where(F.col("version") == version)
        if first is not None:
            out = out.where((F.col("rows") >= first // self.size) & (F.col("row_index") >= first))
        if last is not None:
            out = out.where((F.col("rows") <= last // self.size) & (F.col("row_index") <= last))
        keep = columns or [c for c in out.columns if c not in ("version", "rows", "row_index")]
        return out.select("version", "row_index", *[F.col(f"`{c}`") for c in keep])

    def scoped(self, versions: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows of the versions of a table (version, its other columns are kept), found while the join runs."""
        spark = versions.sparkSession
        return self.read(spark, columns=columns).join(versions, "version")


def matching(df: DataFrame, when: dict) -> DataFrame:
    """Rows whose columns, as strings, are among the values of ``when`` (a value or a list). A name that ends in ``_in`` with a list
    names the column without it and compares trimmed strings. None matches null only; a column that isn't there is null, and
    the empty string for ``_in``."""
    for name, want in when.items():
        many = isinstance(want, (list, tuple, set))
        trimmed = many and name.endswith("_in")
        column = name.removesuffix("_in") if trimmed else name
        values = list(want) if many else [want]
        own = F.col(f"`{column}`").cast("string") if column in df.columns else F.lit("" if trimmed else None).cast("string")
        shown = [str(v).strip() if trimmed else str(v) for v in values if v is not None]
        found = F.coalesce((F.trim(own) if trimmed else own).isin(*shown), F.lit(False)) if shown else F.lit(False)
        df = df.where(found | own.isNull() if None in values else found)
    return df
