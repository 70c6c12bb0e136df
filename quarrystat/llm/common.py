"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts, as Java regular expressions.
SPACE_RUN = "[ \\x09-\\x0D]+"
NON_ALNUM_RUN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Folders of local sessions without the setting.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``; a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:  # the setting itself can't be changed in a running session
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='quarrystat-')}"
        found = _LOCAL[app]
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint, survives lost executors and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quarrystat/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """As ``materialize``, in as many buckets of ``key`` as shuffles have partitions: joins and groups by the key don't move
    the rows again. The table's name leaves the catalog at once; its files stay in the shared folder."""
    spark = df.sparkSession
    name = f"quarrystat_{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", f"{scratch_dir(spark)}/quarrystat/{name}").saveAsTable(name)
    out = spark.table(name)  # resolved to its files here
    spark.sql(f"DROP TABLE {name}")
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """Array of maximal runs of characters that are not space, tab, or \\n to \\r. Null text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def alnum_words(text: Column) -> Column:
    """Array of words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased. Null text: empty array."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_ALNUM_RUN), "")


def covered(starts: Column) -> Column:
    """Number of positions covered by spans, an array of structs (at, len) sorted by ``at``."""
    zero = F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        stop = s["at"] + s["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(s["at"], acc["end"]))).cast("int").alias("n"),
            F.greatest(acc["end"], stop).cast("int").alias("end"),
        )

    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def without_clash(df: DataFrame, *names: str) -> str:
    """A column prefix that no column of ``df`` starts with, for working columns beside the caller's own."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in (*df.columns, *names)):
        prefix = f"_{prefix}"
    return prefix
