"""Sources and sinks: CSV, JSON, Parquet, SQL dumps; normalisation and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.sources.quoted_csv import quoted_breaks, read_quoted
from quarrystat.sources.sql_dump import read_sql_dump


def unique_headers(names: list[str]) -> list[str]:
    """Blank names become ``column``; a repeated name gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in (n.strip() or "column" for n in names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """Read a tabular file; ``kind`` is csv, json, jsonl, parquet, xlsx or sql, by default the path's extension.

    CSV fields may hold line breaks in quotes; doubled quotes are quotes unless an ``escape`` is given."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        sep, quote = options.get("sep", options.get("delimiter", ",")), options.get("quote", '"')
        utf8 = options.get("encoding", options.get("charset", "utf-8")).lower() in ("utf-8", "utf8")
        if not {"multiLine", "escape", "lineSep"} & options.keys():
            if utf8 and len(sep) == len(quote) == 1:
                states, broken = quoted_breaks(spark, path, sep, quote)
                if broken:
                    df, names = read_quoted(spark, path, states, sep, quote)
                    return df.toDF(*unique_headers(names))
            else:
                options["multiLine"] = "true"
            options["escape"] = quote
        df = spark.read.options(header=True, inferSchema=True, **options).csv(path)
        # Spark renames repeated headers, so the header line is read apart
        names = spark.read.options(**(options | {"header": "false", "inferSchema": "false"})).csv(path).head()
        return df.toDF(*unique_headers([n or "" for n in names])) if names is not None and len(names) == len(df.columns) else df
    if kind in ("json", "jsonl"):
        return spark.read.options(multiLine=kind == "json", **options).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        from quarrystat.sources.sinks import read_xlsx

        return read_xlsx(spark, path)
    if kind == "sql":
        return read_sql_dump(spark, path)
    raise ValueError(f"unknown kind {kind}")


def normalise(df: DataFrame, least: float = 0.98) -> DataFrame:
    """Strings trimmed, lower-cased, white space collapsed, empty to null; columns numeric in ``least`` of their values, and
    not named like ids, become doubles. One aggregate job decides for all columns."""
    texts = [c for c, t in df.dtypes if t == "string"]
    clean = lambda c: F.nullif(F.lower(F.regexp_replace(F.trim(F.col(f"`{c}`")), "\\s+", " ")), F.lit(""))
    number = lambda c: F.regexp_replace(clean(c), "[,_]", "").try_cast("double")
    shares = df.agg(*[F.avg(F.when(clean(c).isNotNull(), number(c).isNotNull().cast("int"))).alias(c) for c in texts]).first() if texts else {}
    numeric = {c for c in texts if "id" not in c.lower() and (shares[c] or 0) >= least}
    return df.select(*[(number(c) if c in numeric else clean(c)).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: dtype, rows, missing share, distinct values, min, max, mean, population std."""
    kinds = dict(df.dtypes)
    plain = lambda c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
    parts = []
    for c in df.columns:
        x, none = F.col(f"`{c}`"), F.lit(None).cast("double")
        v = x.cast("double") if plain(c) else none
        stats = (F.count("*"), F.avg(x.isNull().cast("int")), F.countDistinct(x), F.min(v), F.max(v), F.avg(v), F.stddev_pop(v))
        parts.append(F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("dtype"), *[s.alias(n) for s, n in zip(stats, ("n", "missing", "distinct", "lo", "hi", "mean", "std"))]))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
