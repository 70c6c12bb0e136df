"""A table of totals by key that a stream's batches are upserted into, each exactly once.

Keys are dealt to buckets. A batch's totals are added to the present version of the buckets that it touches and written as new
versions; then one small file, written apart and renamed, names the version of every bucket. It is the commit: a batch that died
before it left nothing that is read, and is done again from the same versions; a batch whose file is there is not done again.
Buckets that a batch doesn't touch are neither read nor written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How two totals of a column become one.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


class Upserts:
    """``totals``: name of a total -> (kind, column), kind one of sum, min, max, count."""

    def __init__(self, path: str, keys: list[str], totals: dict[str, tuple[str, str]], buckets: int = 64):
        if any(kind not in MERGES for kind, _ in totals.values()):
            raise ValueError(f"totals are {', '.join(MERGES)}")
        self.path, self.keys, self.totals, self.buckets = path.rstrip("/"), keys, totals, buckets

    def _files(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at, at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self, spark: SparkSession) -> list[int]:
        """Numbers of the committed batches, in order."""
        at, fs = self._files(spark)
        folder = at(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def versions(self, spark: SparkSession, batch: int | None = None) -> dict[int, int]:
        """The version of each bucket after the last commit (before ``batch``)."""
        done = [b for b in self.commits(spark) if batch is None or b < batch]
        if not done:
            return {}
        at, fs = self._files(spark)
        stream = fs.open(at(f"{self.path}/commits/{done[-1]}.json"))
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _commit(self, spark: SparkSession, batch: int, versions: dict[int, int]) -> None:
        at, fs = self._files(spark)
        apart, final = at(f"{self.path}/commits/_{batch}.tmp"), at(f"{self.path}/commits/{batch}.json")
        out = fs.create(apart, True)
        try:
            out.write(bytearray(json.dumps(versions).encode()))
        finally:
            out.close()
        if not fs.rename(apart, final):
            raise OSError(f"batch {batch} could not be committed")

    def _read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.parquet(*paths) if paths else None

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Upsert the rows of one batch; the form of ``foreachBatch``."""
        spark = rows.sparkSession
        if batch in self.commits(spark):
            return
        first = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        new = rows.groupBy(*self.keys).agg(*[first[kind](c).alias(n) for n, (kind, c) in self.totals.items()])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        before = self.versions(spark, batch)
        # the new totals stand in the folder once, so that a bucket's old rows are read for touched buckets only
        made = f"{self.path}/batches/{batch}"
        new.withColumn("bucket", bucket).write.mode("overwrite").parquet(made)
        new = spark.read.parquet(made)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # as many as buckets
        old = self._read(spark, {b: before[b] for b in touched if b in before})
        every = new.drop("bucket").unionByName(old) if old is not None else new.drop("bucket")
        merged = every.groupBy(*self.keys).agg(*[MERGES[kind](n).alias(n) for n, (kind, _) in self.totals.items()])
        if touched:
            out = merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
            out.parquet(f"{self.path}/data/version={batch}")
        self._commit(spark, batch, before | dict.fromkeys(touched, batch))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def table(self, spark: SparkSession) -> DataFrame | None:
        """The totals after the last commit; None before the first."""
        return self._read(spark, self.versions(spark))

    def vacuum(self, spark: SparkSession) -> None:
        """Remove batches' totals and versions that the last two commits don't name."""
        at, fs = self._files(spark)
        done = self.commits(spark)[-2:]
        named = {v for b in done for v in self.versions(spark, b + 1).values()}
        for folder, keep in (("data", {f"version={v}" for v in named}), ("batches", {str(b) for b in done[-1:]})):
            if fs.exists(at(f"{self.path}/{folder}")):
                for f in fs.listStatus(at(f"{self.path}/{folder}")):
                    if f.getPath().getName() not in keep:
                        fs.delete(f.getPath(), True)
