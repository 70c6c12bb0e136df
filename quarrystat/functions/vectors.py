"""Exact vector search: a bounded set of query vectors against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of one packed block.
BLOCK = 8192


def l2(a: Column, b: Column) -> Column:
    """Squared distance as a double."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _packed(rows: DataFrame, key: str, vector: str, names: tuple[str, str, str], k: int | None) -> DataFrame:
    """Blocks of rows of equal width in the order of their ids: ids, doubles in one binary, width. Of equal vectors in a block the
    first ``k`` stay, as no more can be among the nearest k."""
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(names[0], T.ArrayType(kind)), T.StructField(names[1], T.BinaryType()), T.StructField(names[2], T.LongType())])

    def pack(batches):
        for batch in batches:
            batch = pa.table([batch.column(0), batch.column(1)], names=["id", "v"]).sort_by("id").combine_chunks()
            widths = np.asarray(pc.fill_null(pc.list_value_length(batch["v"]), -1))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                part = batch.take(pa.array(at))
                flat = part["v"].combine_chunks().flatten() if width > 0 else pa.array([], pa.float64())
                x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), max(width, 0))
                if k and len(at) > k:
                    _, group = np.unique(x, axis=0, return_inverse=True)
                    order = np.argsort(group := group.ravel(), kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
                    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
                    at = np.sort(order[place < k])
                    part, x = part.take(pa.array(at)), x[at]
                for i in range(0, len(x), BLOCK):
                    ids = part["id"].combine_chunks().slice(i, BLOCK)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
                    yield pa.RecordBatch.from_arrays([lists, pa.array([np.ascontiguousarray(x[i : i + BLOCK]).tobytes()], pa.binary()), pa.array([int(width)], pa.int64())], names=list(names))

    return rows.select(F.col(key), F.col(vector)).mapInArrow(pack, schema)


def _nearest(v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, of items and their distances: the ``k`` nearest of each query, ties by the items' order.

    A matrix product bounds the distances; those within reach of the k-th are taken exactly. NaN is farthest."""
    found = []
    length = (v * v).sum(1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        own = (part * part).sum(1)
        with np.errstate(all="ignore"):
            about = own[:, None] + length - 2 * (part @ v.T)
            about[~np.isfinite(about)] = np.inf
            few = about[:, :: max(1, len(v) // max(1000, 2 * k))]
            last = np.partition(few, k - 1, axis=1)[:, k - 1] if few.shape[1] > k else np.full(len(part), np.inf)
            i, j = np.nonzero(about <= (last + 1e-9 * (own + length.max(initial=0.0)))[:, None]) if np.isfinite(last).all() and np.isfinite(length).all() else np.nonzero(np.ones(about.shape, bool))
            exact = np.zeros(len(i))
            for c in range(v.shape[1]):  # in the order of the plain sum
                exact += (v[j, c] - part[i, c]) ** 2
            exact = np.sqrt(exact)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        starts = np.flatnonzero(np.r_[True, np.diff(i) > 0]) if len(i) else np.array([], int)
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        keep = place < k
        found.append((i[keep] + at, j[keep], exact[keep]))
    return tuple(np.concatenate([f[x] for f in found]) for x in range(3))


def knn(items: DataFrame, queries: DataFrame, k: int, item_id: str, query_id: str, vector: str) -> DataFrame:
    """Rows (query_id, item_id, distance, rank): the k nearest of each query, ties by item_id; null distances are last.

    Items and queries are packed into blocks, every block of items meets every block of queries, and each such pair keeps k rows
    a query before anything is shuffled by query. Vectors of different widths have a null distance.
    """
    left = _packed(items, item_id, vector, ("_items", "_v", "_vw"), k)
    right = _packed(queries, query_id, vector, ("_queries", "_q", "_qw"), None)
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("distance", T.DoubleType())])

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, asked = batch.column("_items")[r].values, batch.column("_queries")[r].values
                w, u = batch.column("_vw")[r].as_py(), batch.column("_qw")[r].as_py()
                if w == u >= 0:
                    v, q = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(n, w) for c, n in (("_v", len(ids)), ("_q", len(asked))))
                    i, j, d = _nearest(v, q, k)
                    d = pa.array(d)
                else:
                    n = min(k, len(ids))
                    i, j = np.repeat(np.arange(len(asked)), n), np.tile(np.arange(n), len(asked))
                    d = pa.nulls(len(i), pa.float64())
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), ids.take(pa.array(j)), d], names=["query_id", "item_id", "distance"])

    left = left.repartition(2 * items.sparkSession.sparkContext.defaultParallelism)  # few files make few tasks
    near = left.crossJoin(right).mapInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "item_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


class VectorStore:
    """Collections of vectors as append-only Parquet tables: a row adds or deletes an item, the latest row of an item counts.

    Nothing is rewritten, so readers see whole appends and a state ``as_of`` any earlier time; ``compact`` folds the rows."""

    SCHEMA = "collection string, item_id string, embedding array<float>, created_at timestamp, deleted boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        rows.select("collection", "item_id", "embedding", "created_at", "deleted").write.mode("append").partitionBy("collection").parquet(self.path)

    def add(self, collection: str, items: DataFrame) -> None:
        """``items``: item_id, embedding, created_at."""
        self._append(items.select(F.lit(collection).alias("collection"), F.col("item_id").cast("string").alias("item_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("created_at").cast("timestamp").alias("created_at"), F.lit(False).alias("deleted")))

    def delete(self, collection: str, ids: DataFrame) -> None:
        """``ids``: item_id, created_at (the time of the deletion)."""
        self._append(ids.select(F.lit(collection).alias("collection"), F.col("item_id").cast("string").alias("item_id"), F.lit(None).cast("array<float>").alias("embedding"), F.col("created_at").cast("timestamp").alias("created_at"), F.lit(True).alias("deleted")))

    def items(self, collection: str, as_of: str | None = None) -> DataFrame:
        """Living items (item_id, embedding, created_at), at ``as_of`` if given; the collection prunes the files read."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("collection") == collection)
        if as_of is not None:
            rows = rows.where(F.col("created_at") <= F.lit(as_of).cast("timestamp"))
        last = rows.groupBy("item_id").agg(F.max_by(F.struct("embedding", "created_at", "deleted"), F.struct("created_at", "deleted")).alias("r"))
        return last.where("NOT r.deleted").select("item_id", "r.embedding", "r.created_at")

    def collections(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = rows.groupBy("collection", "item_id").agg(F.max_by("deleted", F.struct("created_at", "deleted")).alias("gone"))
        return last.groupBy("collection").agg(F.sum((~F.col("gone")).cast("long")).alias("items"))

    def search(self, collection: str, queries: DataFrame, k: int, as_of: str | None = None) -> DataFrame:
        """``queries``: query_id, embedding."""
        return knn(self.items(collection, as_of), queries, k, "item_id", "query_id", "embedding")
