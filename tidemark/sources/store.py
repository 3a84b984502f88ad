"""The week-partitioned store: Parquet tables by shard, ledgers, drafts, JSON lines.

An episode lives in the shard of its start week with all its events, chunks
and vectors. Readers list the directories anew with each query.

An ingest is a transaction: its tables are written aside, marked as ready, and
then moved file by file. A lost driver leaves either all of an episode or
nothing: opening the store, or a retry under the same name, finishes what was
ready. A transaction of one name is done once.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.dates import shard_bounds, shard_of
from tidemark.functions.text import folded_terms, query_term_list
from tidemark.operators.many import query_blocks, search_block
from tidemark.operators.retrieve import Query, best_blocks, block_bounds, block_maxima, block_of, bm25_many, chunk_lengths, hard_filter, in_slots, inverted_index, known_source, search_one, shards_for, slot_ranges, with_provenance

#: Shards that a filter names and that are moved file by file; more are joined, and moved as a whole table.
NAMES = 200


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine the warehouse serves; on a cluster it must be named."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """df, its lineage cut by a checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


@contextmanager
def spread(spark: SparkSession):
    """Small tables of many weeks are written by all cores: a file a week takes time, whatever it holds, and Spark joins partitions up to 1 MB by default."""
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Files:
    """Files and folders by any path that Spark can read and write."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def children(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def touch(self, path: str) -> None:
        p, fs = self._at(path)
        fs.create(p, True).close()

    def move(self, path: str, folder: str, name: str) -> None:
        p, fs = self._at(path)
        to, _ = self._at(folder)
        fs.mkdirs(to)
        there = self.spark._jvm.org.apache.hadoop.fs.Path(to, name)
        if not fs.rename(p, there) and (fs.exists(p) or not fs.exists(there)):  # another finisher may have moved it
            raise OSError(f"{path} can't be moved to {folder}")

    def move_new(self, path: str, to: str) -> bool:
        """Moves a folder to where nothing is yet; False if something is."""
        (src, _), (dst, fs) = self._at(path), self._at(to)
        if fs.exists(dst):
            return False
        fs.mkdirs(dst.getParent())
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # unlike FileSystem.rename this never moves into a folder that another writer has just made
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, none)
        except Py4JJavaError:
            return False
        return True


class Store(Files):
    """Tables below a root path that Spark can read and write.

    Opening a store finishes the transactions that are ready and brings the
    schema up to date. What isn't ready yet may be another writer's and stays.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        self.root = root.rstrip("/")
        self.finish()
        self.migrate()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table under its fixed schema; absent tables are empty."""
        return self._read_at(schemas.struct(table), self.path(table))

    def within(self, table: str, shards: list[str]) -> DataFrame:
        """The table's rows in these shards. A long list is a table to join: as a literal it would stand in every copy of the plan on the driver."""
        t = self.read(table)
        if len(shards) <= NAMES:
            return t.where(F.col("shard").isin(shards))
        names = self.spark.createDataFrame([(s,) for s in shards], "shard string")
        return t.where(F.col("shard").between(min(shards), max(shards))).join(F.broadcast(names), "shard", "left_semi").select(*t.columns)

    def _read_at(self, schema, *paths: str, base: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema)
        try:
            return (reader if base is None else reader.option("basePath", base)).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, table: str, df: DataFrame) -> None:
        """Rows added to a table; columns it lacks are null."""
        if table in schemas.SHARDED:
            self._dealt(table, df).write.mode("append").options(**schemas.WRITTEN.get(table, {})).partitionBy("shard").parquet(self.path(table))
        else:
            self._fitted(table, df).write.mode("append").parquet(self.path(table))

    def ingest(self, episodes: DataFrame, events: DataFrame, chunks: DataFrame, name: str | None = None) -> None:
        """Episodes to the shard of their start, events, chunks and their index along with them: all of it or nothing.

        A name is ingested once. If an earlier call under it got as far as its
        mark, that call's rows are published and these are left alone.
        """
        name = name or uuid.uuid4().hex
        if self._known(name):
            return
        e = reliable(episodes.withColumn("shard", shard_of(F.col("ts_start"))))
        of = e.select(F.col("id").alias("episode_id"), "shard")
        c = chunks.join(of, "episode_id")
        self._commit(name, {"events": events.join(of, "episode_id"), "chunks": c, **self._index(lambda aside: self._read_at(schemas.struct("chunks"), f"{aside}/chunks")), "episodes": e})

    def _index(self, chunks) -> dict:
        """Postings, the maxima of their blocks and lengths, each from what is written aside before it: texts are joined and dealt once."""
        kept = lambda aside: chunks(aside).select("shard", F.col("id").alias("chunk_id"), "text", block_of(F.col("ts_capture")).alias("block"))
        held = lambda aside: self._read_at(schemas.struct("postings"), f"{aside}/postings")
        return {"postings": lambda aside: inverted_index(kept(aside), "block"), "maxima": lambda aside: block_maxima(held(aside)), "lengths": lambda aside: chunk_lengths(kept(aside))}

    def _known(self, name: str) -> bool:
        """Whether a transaction of this name is done; one that is ready is finished first."""
        if not self.exists(f"{self.root}/_done/{name}") and self.exists(f"{self.root}/_pending/{name}/_READY"):
            self._publish(name)
        return self.exists(f"{self.root}/_done/{name}")

    def _commit(self, name: str, tables: dict, instead_of: list[str] = ()) -> None:
        """Writes the tables aside, marks them as ready, and publishes them in place of the files `instead_of` (paths below the root).

        A table is a DataFrame, or makes one of what is written aside before it,
        row by row: that is dealt already, and isn't shuffled again.
        """
        aside = f"{self.root}/_pending/{name}"
        self.delete(aside)
        for table, df in tables.items():
            rows = self._sorted(table, df(aside)) if callable(df) else self._dealt(table, df)
            with spread(self.spark):
                rows.write.mode("overwrite").options(**schemas.WRITTEN.get(table, {})).partitionBy("shard").parquet(f"{aside}/{table}")
        if instead_of:
            self.spark.createDataFrame([(x,) for x in instead_of], "path string").coalesce(1).write.text(f"{aside}/_instead_of")
        self.touch(f"{aside}/_READY")
        self._publish(name)

    def _publish(self, name: str) -> None:
        """Moves a ready transaction's files to their tables, the episodes last, and removes those that they replace. Done again, it does what is left."""
        aside = f"{self.root}/_pending/{name}"
        for table in sorted((t for t in self.children(aside) if not t.startswith("_")), key=lambda t: (t == "episodes", t)):
            self.delete(f"{aside}/{table}/_SUCCESS")
            dealt = self.children(f"{aside}/{table}")
            if len(dealt) > NAMES and self.move_new(f"{aside}/{table}", self.path(table)):  # a new table of many shards goes as a whole
                continue
            for shard in dealt:
                for part in self.children(f"{aside}/{table}/{shard}") if shard.startswith("shard=") else ():
                    self.move(f"{aside}/{table}/{shard}/{part}", f"{self.path(table)}/{shard}", f"{name}-{part}")
        if self.exists(f"{aside}/_instead_of"):
            for (old,) in self.spark.read.text(f"{aside}/_instead_of").toLocalIterator():  # files of the shards concerned
                self.delete(f"{self.root}/{old}")
        self.touch(f"{self.root}/_done/{name}")
        self.delete(aside)

    def finish(self) -> list[str]:
        """Publishes the transactions that were ready when their driver was lost; returns their names."""
        ready = [n for n in self.children(f"{self.root}/_pending") if self.exists(f"{self.root}/_pending/{n}/_READY")]
        for n in ready:
            self._publish(n)
        return ready

    def recover(self) -> list[str]:
        """finish, and drops what wasn't ready: for the only writer of a store. Returns the names of those finished."""
        done = self.finish()
        for name in self.children(f"{self.root}/_pending"):
            self.delete(f"{self.root}/_pending/{name}")
        return done

    def compact(self, table: str, most: int = 1) -> list[str]:
        """Writes the shards of more than `most` files anew, as few sorted files; returns the shards. Rows stay as they are."""
        files = {s: self.children(f"{self.path(table)}/{s}") for s in self.children(self.path(table)) if s.startswith("shard=")}
        small = {s: f for s, f in files.items() if len(f) > most}
        if small:
            old = [f"{table}/{s}/{x}" for s, f in small.items() for x in f]
            rows = self._read_at(schemas.struct(table), *[f"{self.root}/{x}" for x in old], base=self.path(table))
            self._commit(f"compact-{uuid.uuid4().hex}", {table: rows}, old)
        return [s.removeprefix("shard=") for s in small]

    def version(self) -> int:
        """The schema version that the store was last brought to; 0 for a new one."""
        held = [int(x.removeprefix("version=")) for x in self.children(f"{self.root}/_schema")]
        return max(held, default=0)

    def migrate(self) -> list[int]:
        """Applies the schema versions above the store's; returns them. Columns that files lack read as null."""
        if self.version() > schemas.SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {self.version()}, this is {schemas.SCHEMA_VERSION}")
        steps = [v for v in sorted(schemas.VERSIONS) if v > self.version()]
        for v in steps:
            if any(t in ("postings", "maxima") and not self.exists(self.path(t)) for t in schemas.VERSIONS[v]) and self.exists(self.path("chunks")):
                self.reindex()
            self.touch(f"{self.root}/_schema/version={v}")
        return steps

    def reindex(self) -> None:
        """Writes postings, maxima and lengths anew from the chunks."""
        old = [f"{t}/{s}/{x}" for t in ("postings", "maxima", "lengths") for s in self.children(self.path(t)) for x in self.children(f"{self.path(t)}/{s}")]
        self._commit(f"reindex-{uuid.uuid4().hex}", self._index(lambda _: self.read("chunks")), old)

    def catalog(self, shards: list[str], slots: list[tuple[int, int]] | None = None) -> DataFrame:
        """What search_many ranks, without text: the chunks of these shards (and slots) that have their event, with their episode's application and keys."""
        part = lambda table: self.within(table, shards)
        of = part("episodes").select("shard", F.col("id").alias("episode_id"), "app_name", "bundle_id", "entity_keys")
        chunks = part("chunks").select("shard", F.col("id").alias("chunk_id"), "episode_id", "event_id", "ts_capture")
        chunks = chunks if slots is None else chunks.where(in_slots(block_of(F.col("ts_capture")), slots))
        return chunks.join(part("events").select("shard", F.col("id").alias("event_id")), ["shard", "event_id"], "left_semi").join(of, ["shard", "episode_id"])

    def statistics(self, shards: list[str]) -> DataFrame:
        return self.within("lengths", shards).groupBy("shard").agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))

    def keyword_postings(self, q: Query, shards: list[str], pool: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The postings that can reach the first `pool` rows of a shard's keyword list (q's own pool, if not given), and shard, term, n of q's terms.

        A block's bound adds up what its terms can give at most. The blocks of
        the greatest bounds are scored first; where they hold `pool` chunks that
        obey q's filters, the last of these says what a block must promise to
        be read at all. Blocks outside the range go in any case. Numbers of
        blocks leave the cluster, of which a year has some 35,000.
        """
        terms, pool = folded_terms(query_term_list(q.text)), pool or q.pool
        if not terms:
            return self.read("postings").limit(0), self.read("maxima").select("shard", "term", "n").limit(0)
        part = lambda table: self.within(table, shards).where(F.col("term").isin(terms))
        counts, stats = part("maxima").groupBy("shard", "term").agg(F.sum("n").alias("n")), self.statistics(shards)
        inside = F.lit(True) if q.time_range is None else F.col("block").between(*[block_of(F.lit(t)) for t in q.time_range])
        merged = part("maxima").where(inside).groupBy("shard", "term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        bounds, postings = block_bounds(merged, counts, stats), part("postings").where(inside)
        numbers = lambda df: slot_ranges([r[0] for r in df.select("block").distinct().toLocalIterator()])
        first = numbers(best_blocks(bounds, 2 * pool))
        wanted = self.spark.createDataFrame([(0, s, i, t) for s in shards for i, t in enumerate(terms)], "probe int, shard string, nth int, term string")
        scores = bm25_many(postings.where(in_slots(F.col("block"), first)), stats, wanted, counts)
        able = self.catalog(shards, first).where(hard_filter(q)).select("shard", "chunk_id")
        nth = F.row_number().over(W.partitionBy("shard").orderBy("score", "chunk_id"))
        least = scores.join(able, ["shard", "chunk_id"]).withColumn("nth", nth).where(F.col("nth") == pool).select("shard", (-F.col("score")).alias("least"))
        kept = bounds.join(least, "shard", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return postings.where(in_slots(F.col("block"), numbers(kept))), counts

    def search(self, q: Query, query_vector: tuple[list[int], float, str] | None = None) -> DataFrame:
        """chunk_id, episode_id, text, score, source, provenance, ts_capture, place: the answer to q.

        Only the shards that the range meets are read, of their postings the
        blocks that can matter, their vectors as they are stored. A chunk without its event isn't found; text
        and provenance are fetched for the answer's rows alone.
        """
        names = shards_for(self.shards(), q.time_range)
        part = lambda table: self.within(table, names)
        vectors = part("vectors") if query_vector is not None else None
        postings, counts = self.keyword_postings(q, names)
        found = search_one(self.spark, q, self.catalog(names), postings, self.statistics(names), names, vectors, query_vector, counts=counts)
        return self.answered(found, names)

    def search_table(self, queries: DataFrame) -> DataFrame:
        """The answers to a table of queries (as query_rows gives them), with their probe, in one plan over the whole store: a pass for each block of queries."""
        names = self.shards()
        of = lambda rows: search_block(self.spark, rows, queries.schema, self.catalog(names), self.read("postings"), self.statistics(names), names)
        return reduce(DataFrame.unionByName, [self.answered(F.broadcast(of(rows)), names, ["probe"]) for rows in query_blocks(queries)])

    def answered(self, found: DataFrame, shards: list[str], by: list[str] = ()) -> DataFrame:
        """found (by.., shard, chunk_id, episode_id, score, place) with text, source, provenance and time."""
        part = lambda table: self.within(table, shards)
        meta = part("chunks").select("shard", F.col("id").alias("chunk_id"), "event_id", "text", "ts_capture", known_source(F.col("source")).alias("source"))
        events = part("events").select("shard", "id", "provenance")
        return with_provenance(found.join(meta, ["shard", "chunk_id"]), events).select(*by, "chunk_id", "episode_id", "text", "score", "source", "provenance", "ts_capture", "place")

    def _fitted(self, table: str, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(table)])

    def _dealt(self, table: str, df: DataFrame) -> DataFrame:
        """Rows of a shard in as few files as their size asks for, a hot shard in several, sorted by what readers look for."""
        return self._sorted(table, df.hint("rebalance", F.col("shard")))

    def _sorted(self, table: str, df: DataFrame) -> DataFrame:
        return self._fitted(table, df).sortWithinPartitions("shard", *schemas.SORTED[table])

    def shards(self, table: str = "episodes") -> list[str]:
        """Ids of the existing shards, sorted; one short string a week leaves the cluster."""
        return sorted(r[0] for r in self.read(table).select("shard").distinct().toLocalIterator())

    def in_range(self, table: str, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
        """A table's rows in the shards whose week meets [lo, hi]: a filter on the partition column."""
        names = [s for s in self.shards(table) if shard_bounds(s)[0] <= hi and shard_bounds(s)[1] > lo]
        return self.within(table, names)

    def purge_before(self, cutoff: dt.datetime) -> list[str]:
        """Drop the shards that end at or before cutoff, whole directories at a time; returns their ids."""
        gone = [s for s in self.shards() if shard_bounds(s)[1] <= cutoff]
        for table in schemas.SHARDED:
            for s in gone:
                self.delete(f"{self.path(table)}/shard={s}")
        return gone

    def upsert_vectors(self, new: DataFrame, name: str | None = None) -> None:
        """Vectors by chunk_id, one of the new in place of the old; only the shards concerned are written again.

        Of several new rows of a chunk the one of the greatest model_id, then
        embedding, stays. A transaction, as ingest is.
        """
        name = name or uuid.uuid4().hex
        if self._known(name):
            return
        fresh = self._fitted("vectors", new)
        w = W.partitionBy("shard", "chunk_id").orderBy(F.desc("model_id"), F.desc("embedding"), F.desc("scale"))
        fresh = reliable(fresh.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"))
        self._replace_vectors(name, fresh.select("shard", "chunk_id"), fresh)

    def remove_vectors(self, gone: DataFrame, name: str | None = None) -> None:
        """The vectors of (shard, chunk_id) go; those that have none are no fault."""
        name = name or uuid.uuid4().hex
        if not self._known(name):
            self._replace_vectors(name, reliable(gone.select("shard", "chunk_id").distinct()), None)

    def _replace_vectors(self, name: str, gone: DataFrame, fresh: DataFrame | None) -> None:
        at = self.path("vectors")
        names = [f"shard={r[0]}" for r in gone.select("shard").distinct().toLocalIterator()]  # a short string a week
        files = [f"vectors/{s}/{x}" for s in names for x in self.children(f"{at}/{s}")]
        old = self._read_at(schemas.struct("vectors"), *[f"{self.root}/{x}" for x in files], base=at) if files else self.spark.createDataFrame([], schemas.struct("vectors"))
        kept = old.join(gone, ["shard", "chunk_id"], "left_anti").select(*old.columns)
        self._commit(name, {"vectors": kept if fresh is None else kept.unionByName(fresh.select(*old.columns))}, files)

    def fetch(self, table: str, id_: str) -> DataFrame:
        return self.read(table).where(F.col("id") == id_)

    def count(self, table: str, model: str | None = None) -> int:
        t = self.read(table)
        return (t if model is None else t.where(F.col("model_id") == model)).count()

    def ledger(self, table: str, since: dt.datetime | None = None, **equal) -> DataFrame:
        """A ledger's rows in order of time, since an instant and with given values."""
        t = self.read(table)
        if since is not None:
            t = t.where(F.col("ts") >= F.lit(since))
        for name, value in equal.items():
            t = t.where(F.col(name) == value)
        return t.orderBy("ts")


def latest_vectors(df: DataFrame, order: str) -> DataFrame:
    """The last row of each chunk_id."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc(order)))).where("rn = 1").drop("rn")


def write_jsonl(events: DataFrame, path: str, ts: str = "ts") -> None:
    """A JSON line per row, in a directory per day, instants in ISO-8601."""
    events.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").partitionBy("day").json(path)
