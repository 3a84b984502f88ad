"""Nearest int8 vectors for a table of queries: inverted lists, and the exact scan as the same search over all lists.

A k-means fit on a bounded sample gives LISTS centroids at most; every vector is
dealt to the list of its nearest one. A list's vectors are packed into blocks of
BLOCK rows, so a hot list is many blocks; queries are packed too, by the lists
that they visit. Packs meet by list in one join, and a pair is one matrix
product. A pair gives a query's first k rows; the rows of all pairs meet by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lists, rows of the fit for each list, and rows of a block and of a pack of queries, at most.
LISTS, FIT, BLOCK, SLAB = 1024, 64, 2048, 512
BLOCK_SQL = "list int, block int, dim int, ids array<string>, scales array<double>, vectors binary"
SLAB_SQL = "list int, probes array<string>, probe_scales array<double>, probe_vectors binary"
_FOUND = pa.schema([("probe", pa.string()), ("id", pa.string()), ("dot", pa.int64()), ("similarity", pa.float64())])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of dim small integers as rows."""
    ends = np.asarray(column.offsets)
    return np.asarray(column.values, np.float64)[ends[0] : ends[-1]].reshape(len(column), dim)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means, from evenly spaced rows of the sample; empty ones are dropped."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1), 1e-12)[:, None]
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


class VectorLists:
    """Inverted lists of one model's vectors (chunk_id, dim, scale, embedding), in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, dim: int, centroids: np.ndarray):
        self.spark, self.root, self.dim, self.centroids = spark, root, dim, centroids

    @staticmethod
    def built(vectors: DataFrame, root: str, dim: int, lists: int | None = None) -> "VectorLists":
        """Rows whose vector hasn't the dimension stand in no list. lists: else the square root of their number."""
        from tidemark.sources.store import reliable

        fit = _fitting(reliable(vectors.select("chunk_id", "scale", "embedding")), dim)  # else each filter computes the vectors anew
        n = fit.count()
        lists = lists or max(1, min(LISTS, int(n**0.5)))
        sample = fit.select("embedding").orderBy(F.xxhash64("id"), "id").limit(FIT * lists).toArrow().column(0).combine_chunks()
        index = VectorLists(vectors.sparkSession, root, dim, centroids_of(matrix(sample, dim), lists))
        index._write(index._listed(fit), "error")
        return index

    def _listed(self, fit: DataFrame) -> DataFrame:
        centroids, dim = self.centroids, self.dim

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("embedding"), dim)
                near = np.argmax(x @ centroids.T, axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near), b.column("id"), b.column("scale"), b.column("embedding")], names=["list", "id", "scale", "embedding"])

        return fit.mapInArrow(place, "list int, id string, scale double, embedding array<tinyint>")

    def _write(self, listed: DataFrame, mode: str) -> None:
        """Packs rows into blocks; block numbers go by the ids' hashes, so that a list of any size spreads."""
        from tidemark.sources.store import reliable

        listed, dim = reliable(listed), self.dim
        sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = listed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # a row a list, LISTS at most

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            x = matrix(rows.column("embedding").combine_chunks(), dim).astype(np.int8)
            row = {"list": key[0].as_py(), "block": key[1].as_py(), "dim": dim, "ids": rows.column("id").to_pylist(), "scales": rows.column("scale").to_pylist(), "vectors": x.tobytes()}
            return pa.Table.from_pylist([row], schema=pa.schema([("list", pa.int32()), ("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.string())), ("scales", pa.list_(pa.float64())), ("vectors", pa.binary())]))

        packed = dealt.drop("blocks").groupBy("list", "block").applyInArrow(pack, BLOCK_SQL)
        packed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(self.root)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK_SQL).parquet(self.root)

    def remove(self, gone: DataFrame) -> None:
        """Vectors of the chunk_ids of `gone` leave their lists; only those lists are written again. A list may become empty."""
        from tidemark.sources.store import reliable

        ids = gone.select(F.col("chunk_id").cast("string").alias("id")).distinct()
        held = self.blocks().select("list", F.explode("ids").alias("id")).join(ids, "id").select("list").distinct()
        touched = reliable(self.blocks().join(held, "list"))
        dim = self.dim

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    x = np.frombuffer(r["vectors"], np.int8).reshape(-1, dim)
                    yield pa.RecordBatch.from_arrays([pa.array([r["list"]] * len(x), pa.int32()), pa.array(r["ids"]), pa.array(r["scales"]), pa.array(list(x), pa.list_(pa.int8()))], names=["list", "id", "scale", "embedding"])

        rest = touched.mapInArrow(unpack, "list int, id string, scale double, embedding array<tinyint>").join(ids, "id", "left_anti").select("list", "id", "scale", "embedding")
        # A list that loses all its rows keeps an empty block, so that its old ones are overwritten.
        rest = reliable(rest)
        bare = held.join(rest.select("list").distinct(), "list", "left_anti").select("list", F.lit(0).alias("block"), F.lit(dim).alias("dim"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<double>").alias("scales"), F.lit(b"").alias("vectors"))
        bare = reliable(bare)
        self._write(rest, "overwrite")
        bare.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(self.root)

    def search(self, queries: DataFrame, k: int, visits: int | None = None, floor: float | None = None, but_self: bool = False) -> DataFrame:
        """probe, id, dot, similarity, place: the first k of each query (probe, scale, embedding), ties by id.

        visits: lists whose centroids are nearest to the query; none given is all
        of them, the exact scan. but_self: a vector isn't its own neighbour.
        """
        centroids, dim, n = self.centroids, self.dim, min(visits or len(self.centroids), len(self.centroids))
        slab = pa.schema([("list", pa.int32()), ("probes", pa.list_(pa.string())), ("probe_scales", pa.list_(pa.float64())), ("probe_vectors", pa.binary())])

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, SLAB):
                    part = b.slice(at, SLAB)
                    x = matrix(part.column("embedding"), dim)
                    order = np.argpartition(-(x @ centroids.T), n - 1, axis=1)[:, :n]
                    probes, scales = part.column("id").to_pylist(), part.column("scale").to_pylist()
                    for one in np.unique(order):
                        i = np.flatnonzero((order == one).any(1))
                        yield pa.RecordBatch.from_pylist([{"list": int(one), "probes": [probes[j] for j in i], "probe_scales": [scales[j] for j in i], "probe_vectors": x[i].astype(np.int8).tobytes()}], schema=slab)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in (y for i in range(b.num_rows) for y in b.slice(i, 1).to_pylist()):
                    q, x = (np.frombuffer(r[c], np.int8).reshape(-1, dim).astype(np.float64) for c in ("probe_vectors", "vectors"))
                    dots = q @ x.T
                    near = dots * np.array(r["scales"])[None, :] * np.array(r["probe_scales"])[:, None]
                    if but_self:
                        same = np.array(r["probes"], object)[:, None] == np.array(r["ids"], object)[None, :]
                        near[same] = -np.inf
                    if floor is not None:
                        near[near < floor] = -np.inf
                    for i in range(len(q)):
                        first = np.argsort(-near[i], kind="stable")[:k]  # rows stand in order of id
                        first = first[near[i, first] > -np.inf]
                        yield pa.RecordBatch.from_arrays([pa.array([r["probes"][i]] * len(first), pa.string()), pa.array([r["ids"][j] for j in first], pa.string()), pa.array(dots[i, first].astype(np.int64)), pa.array(near[i, first])], schema=_FOUND)

        slabs = _fitting(queries, dim, "probe").mapInArrow(route, SLAB_SQL)
        found = slabs.join(self.blocks().where(F.size("ids") > 0), "list").mapInArrow(meet, "probe string, id string, dot long, similarity double")
        place = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("place", place).where(F.col("place") <= k)


def _fitting(vectors: DataFrame, dim: int, id_: str = "chunk_id") -> DataFrame:
    """id, scale, embedding of the rows whose vector has the dimension and no null."""
    fit = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("scale").isNotNull() & F.col(id_).isNotNull()
    return vectors.where(F.col("embedding").isNotNull() & fit).select(F.col(id_).cast("string").alias("id"), F.col("scale").cast("double").alias("scale"), "embedding")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """probes, recall: the share of the exact rows (probe, id) that were found, over all probes."""
    hit = exact.select("probe", "id").join(found.select("probe", "id", F.lit(1).alias("hit")), ["probe", "id"], "left")
    return hit.agg(F.count_distinct("probe").alias("probes"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
