"""Hybrid retrieval: BM25, recency and vector lists under hard filters, fused and diversified.

Corpus statistics are per shard and unfiltered; filters cut each candidate list
before its limit. Every ranking has a total order, ties falling to chunk_id.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import shard_bounds
from tidemark.functions.text import FOLDS, UPPER, bare_words, entity_match, folded_terms, query_term_list, search_terms, term_count
from tidemark.functions.vectors import int_dot

K1, B, RARE_IDF = 1.2, 0.75, 1e-6
RRF_K, EPISODE_CAP, FLOOR, CLAMP = 60, 3, 0.3, 200
#: A block of postings: the chunks captured in one slot of so many seconds.
BLOCK_SECONDS = 900
#: Rounding may lift a score above its block's bound by less than this.
SLACK = 1 + 1e-9


@dataclass
class Query:
    """What to look for. A range is closed at both ends; empty app and entities filter nothing."""

    text: str = ""
    time_range: tuple[dt.datetime, dt.datetime] | None = None
    app: str | None = None
    entities: list[str] = field(default_factory=list)
    limit: int = 8

    @property
    def clamped(self) -> int:
        return min(max(self.limit, 0), CLAMP)

    @property
    def pool(self) -> int:
        return max(5 * self.clamped, 50)


def hard_filter(q: Query) -> Column:
    """The predicate on ts_capture, app_name, bundle_id and entity_keys that every list obeys."""
    clauses = []
    if q.time_range:
        clauses.append(F.col("ts_capture").between(F.lit(q.time_range[0]), F.lit(q.time_range[1])))
    if q.app:
        clauses.append((F.col("app_name") == q.app) | (F.col("bundle_id") == q.app))
    clauses += [entity_match(F.col("entity_keys"), e) for e in q.entities if e]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def inverted_index(chunks: DataFrame, *more: str) -> DataFrame:
    """shard, term, chunk_id, len, more columns of the chunk, tf of every term of every chunk: written once, read by each query.

    Nothing is shuffled. A batch's rows come in the order shard, term, more,
    chunk_id, so that a sort behind it only merges.
    """
    kept = chunks.select("shard", "chunk_id", *more, bare_words(F.coalesce("text", F.lit(""))).alias("words"))
    of = kept.schema
    out = T.StructType([of["shard"], T.StructField("term", T.StringType()), of["chunk_id"], T.StructField("len", T.IntegerType()), *[of[m] for m in more], T.StructField("tf", T.LongType())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield from _counted(b.slice(at, 1000), more)

    return kept.mapInArrow(run, out)


def _counted(b: pa.RecordBatch, more: tuple[str, ...]):
    """The postings of a batch of chunks, sorted."""
    words = pc.split_pattern(b.column("words"), " ")
    coded = words.flatten().dictionary_encode()
    folded = pa.array([w if w.isascii() else w.translate(FOLDS) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    terms, order = folded.dictionary, pc.sort_indices(folded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[folded.indices.to_numpy()][coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy())
    empty = pc.index(terms, "").as_py()
    some = code != (place[empty] if empty >= 0 else -1)
    doc, code = doc[some], code[some]
    if not len(doc):
        return
    by = pc.sort_indices(pa.table({c: b.column(c) for c in ("shard", *more, "chunk_id")}), sort_keys=[(c, "ascending") for c in ("shard", *more, "chunk_id")]).to_numpy()
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by))
    shard = b.column("shard").dictionary_encode()
    shard_nth = pc.sort_indices(pc.sort_indices(shard.dictionary)).to_numpy()[pc.fill_null(shard.indices, 0).to_numpy()].astype(np.int64) if len(shard.dictionary) else np.zeros(b.num_rows, np.int64)
    length = np.bincount(doc, minlength=b.num_rows).astype(np.int32)
    key, tf = np.unique((shard_nth[doc] * len(terms) + code) * len(by) + nth[doc], return_counts=True)
    own, term = by[key % len(by)], order[key // len(by) % len(terms)]
    for at in range(0, len(key), 1 << 16):
        o, t = pa.array(own[at : at + (1 << 16)]), pa.array(term[at : at + (1 << 16)])
        columns = {"shard": b.column("shard").take(o), "term": terms.take(t), "chunk_id": b.column("chunk_id").take(o), "len": pa.array(length[o.to_numpy()])}
        columns |= {m: b.column(m).take(o) for m in more} | {"tf": pa.array(tf[at : at + (1 << 16)].astype(np.int64))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def block_of(ts: Column) -> Column:
    """The number of the slot in which a chunk was captured; -1 without a time."""
    return F.coalesce(F.floor(F.unix_seconds(ts.cast("timestamp")) / BLOCK_SECONDS), F.lit(-1)).cast("int")


def block_maxima(postings: DataFrame) -> DataFrame:
    """shard, term, block, n, max_tf, min_len: what bounds a term's scores in a block, whatever the statistics will be.

    Postings of a block that stand one after the other, as they are stored,
    become one row, and nothing is shuffled; a block can have several rows,
    which readers add up.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            new[1:] = False
            for c in ("shard", "term", "block"):
                x = b.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            at = pa.array(first)
            counts = np.diff(np.append(first, b.num_rows)).astype(np.int64), np.maximum.reduceat(b.column("tf").to_numpy(), first), np.minimum.reduceat(b.column("len").to_numpy(), first)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("shard", "term", "block")), *map(pa.array, counts)], names=["shard", "term", "block", "n", "max_tf", "min_len"])

    return postings.select("shard", "term", "block", "tf", "len").mapInArrow(run, "shard string, term string, block int, n long, max_tf long, min_len int")


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """shard, chunk_id, len (terms) of every chunk, of which shard_stats are counts and means."""
    return chunks.select("shard", "chunk_id", term_count(F.col("text")).alias("len"))


def shard_stats(chunks: DataFrame) -> DataFrame:
    """shard, n_chunks, avg_len."""
    return chunks.groupBy("shard").agg(F.count("*").alias("n_chunks"), F.avg(term_count(F.col("text"))).alias("avg_len"))


def rarity() -> Column:
    """A term's weight where n of n_chunks chunks hold it."""
    idf = F.ln((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return F.when(idf <= 0, F.lit(RARE_IDF)).otherwise(idf)


def bm25_part(tf: str, length: str) -> Column:
    """A term's part of a score: of n_chunks chunks of mean length avg_len, n hold it."""
    return rarity() * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("avg_len")))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """shard, chunk_id, score (smaller is better) of the chunks that hold a term.

    The term filter reaches the scan; scores add up term by term in the
    terms' order, so that equal texts score alike everywhere.
    """
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("shard", "term").agg(F.count("*").alias("n"))
    s = hits.join(df, ["shard", "term"]).join(stats, "shard")
    s = s.withColumn("part", bm25_part("tf", "len"))
    parts = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("part"))), F.lit(0.0)) for t in terms]
    return s.groupBy("shard", "chunk_id").agg((-reduce(lambda a, b: a + b, parts)).alias("score"))


def ranked(df: DataFrame, order: list[Column], pool: int, per_shard: bool = True) -> DataFrame:
    """shard, chunk_id, rank of the first `pool` rows (of each shard)."""
    w = W.partitionBy("shard").orderBy(*order) if per_shard else W.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool).select("shard", "chunk_id", "rank")


def reciprocal_ranks(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """shard, chunk_id, score: the sum of 1 / (k + rank) over the lists, added in the lists' order."""
    tagged = [d.withColumn("list", F.lit(i)) for i, d in enumerate(lists)]
    together = reduce(DataFrame.unionByName, tagged)
    terms = [F.coalesce(F.lit(1.0) / (k + F.max(F.when(F.col("list") == i, F.col("rank")))), F.lit(0.0)) for i in range(len(lists))]
    return together.groupBy("shard", "chunk_id").agg(reduce(lambda a, b: a + b, terms).alias("score"))


def diversified(fused: DataFrame, limit: int | Column, cap: int = EPISODE_CAP, by: list[str] | None = None, id_: str = "chunk_id") -> DataFrame:
    """fused (.., episode_id, score) plus place up to limit: `cap` an episode first, then the rest in fused order.

    A null episode isn't capped. by: groups that are ranked apart.
    """
    order = [F.desc("score"), F.col(id_)]
    by = by or []
    of_episode = F.row_number().over(W.partitionBy(*by, "episode_id").orderBy(*order))
    d = fused.withColumn("beyond", F.col("episode_id").isNotNull() & (of_episode > cap))
    place = F.row_number().over(W.partitionBy(*by).orderBy("beyond", *order))
    return d.withColumn("place", place).where(F.col("place") <= limit).drop("beyond")


def knn(vectors: DataFrame, ints: list[int], scale: float, model: str, floor: float = FLOOR) -> DataFrame:
    """shard, chunk_id, similarity of the model's vectors at `floor` or above.

    The query is a literal: one pass over the vectors, no join. Rows whose
    vector doesn't have the stated dimension are skipped.
    """
    q = F.array(*[F.lit(int(x)).cast("tinyint") for x in ints])
    fit = vectors.where((F.col("model_id") == model) & (F.size("embedding") == F.col("dim")) & (F.col("dim") == len(ints)))
    return fit.withColumn("similarity", int_dot(F.col("embedding"), q) * F.col("scale").cast("double") * F.lit(float(scale))).where(F.col("similarity") >= floor)


def candidate_lists(chunks: DataFrame, q: Query, index: DataFrame | None = None, stats: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: tuple[list[int], float, str] | None = None) -> list[DataFrame]:
    """The keyword, recency and vector lists that apply, each filtered and then cut to the pool."""
    able = chunks.where(hard_filter(q))
    terms, out = folded_terms(query_term_list(q.text)), []
    if terms:
        scores = bm25(index if index is not None else inverted_index(chunks), stats if stats is not None else shard_stats(chunks), terms)
        out.append(ranked(able.select("shard", "chunk_id").join(scores, ["shard", "chunk_id"]), [F.col("score"), F.col("chunk_id")], q.pool))
    if not terms or q.time_range:
        out.append(ranked(able, [F.desc("ts_capture"), F.col("chunk_id")], q.pool))
    if vectors is not None and query_vector is not None:
        near = knn(vectors, *query_vector)
        out.append(ranked(able.select("shard", "chunk_id").join(near.select("chunk_id", "similarity"), "chunk_id"), [F.desc("similarity"), F.col("chunk_id")], q.pool))
    return out


def query_rows(spark: SparkSession, queries: list[Query]) -> DataFrame:
    """Queries as rows: probe (their place in the list), text, lo, hi, app, entities, limit."""
    rows = [(i, q.text, *(q.time_range or (None, None)), q.app, [e for e in q.entities if e], q.limit) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "probe int, text string, lo timestamp, hi timestamp, app string, entities array<string>, limit int")


def week_rows(spark: SparkSession, shards: list[str]) -> DataFrame:
    """shard, start, end. A name a week is a table, since as literals they would stand in every copy of the plan."""
    return spark.createDataFrame([(s, *shard_bounds(s)) for s in shards], "shard string, start timestamp, end timestamp")


def pairs(queries: DataFrame, shards: list[str], pruned: bool) -> DataFrame:
    """Each query with each shard, or with each that its range meets (all, without one): an equi-join later on, not a comparison of ranges."""
    meets = F.lit(not pruned) | F.col("lo").isNull() | ((F.col("start") <= F.col("hi")) & (F.col("end") > F.col("lo")))
    return queries.join(F.broadcast(week_rows(queries.sparkSession, shards)), meets).drop("start", "end")


def _obeys() -> Column:
    """hard_filter, with the query's fields as columns lo, hi, app, entities beside the chunk's."""
    inside = F.col("lo").isNull() | F.col("ts_capture").between(F.col("lo"), F.col("hi"))
    app = F.col("app").isNull() | (F.col("app") == "") | (F.col("app_name") == F.col("app")) | (F.col("bundle_id") == F.col("app"))
    lower = lambda c: F.translate(c, UPPER, UPPER.lower())
    wanted = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: e != "")
    held = F.coalesce(F.transform("entity_keys", lower), F.array().cast("array<string>"))
    keys = F.forall(wanted, lambda e: F.array_contains(held, lower(e)))
    return inside & F.coalesce(app, F.lit(False)) & keys


def search_many(queries: DataFrame, catalog: DataFrame, index: DataFrame, stats: DataFrame, shards: list[str], near: DataFrame | None = None, pruned: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """probe, shard, chunk_id, episode_id, score, place: the answers to a table of queries, in one plan.

    queries: as query_rows gives them. catalog: shard, chunk_id, episode_id,
    ts_capture, app_name, bundle_id, entity_keys; no text moves. near: probe,
    shard, chunk_id, similarity. A query's keyword list is that of its terms, its recency
    list comes where it has a range or no term, its vector list where near has
    it; all are ranked by one shuffle. Each shard gives its diversified top
    list; several shards' lists are fused by rank again and diversified again.
    """
    q = queries.withColumn("clamped", F.greatest(F.least("limit", F.lit(CLAMP)), F.lit(0))).withColumn("pool", F.greatest(F.col("clamped") * 5, F.lit(50))).where("clamped > 0")
    q = pairs(q.withColumn("terms", search_terms(F.coalesce("text", F.lit("")))).drop("text"), shards, pruned)
    narrow = catalog.select("shard", "chunk_id", "episode_id", "ts_capture", "app_name", "bundle_id", "entity_keys")
    wanted = ["probe", "shard", "lo", "hi", "app", "entities", "pool"]
    scores = bm25_many(index, stats, q.select("probe", "shard", F.posexplode("terms").alias("nth", "term")), counts)
    lists = [entry(scores.join(q.select(*wanted), ["probe", "shard"]).join(narrow, ["shard", "chunk_id"]).where(_obeys()), 0, F.col("score"))]
    lists.append(recency_list(narrow, q))
    if near is not None:
        close = near.select("probe", "shard", "chunk_id", "similarity").join(q.select(*wanted), ["probe", "shard"])
        lists.append(entry(close.join(narrow, ["shard", "chunk_id"]).where(_obeys()), 2, -F.col("similarity")))
    return fused(queries, lists)


def entry(df: DataFrame, i: int, key: Column) -> DataFrame:
    return df.select("probe", "shard", "chunk_id", "episode_id", "pool", F.lit(i).alias("list"), key.cast("double").alias("key"))


def recency_list(narrow: DataFrame, q: DataFrame) -> DataFrame:
    """The recency list, of queries with a range or without a term."""
    recent = q.where((F.size("terms") == 0) | F.col("lo").isNotNull()).select("probe", "shard", "lo", "hi", "app", "entities", "pool")
    return entry(narrow.join(recent, "shard").where(_obeys()), 1, -F.unix_micros(F.col("ts_capture").cast("timestamp")))


def fused(queries: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """The answers (search_many) to queries (probe, limit) by their lists."""
    # The greatest pool is a literal, so that each task keeps that many of a list at most before the shuffle.
    rank = F.row_number().over(W.partitionBy("probe", "shard", "list").orderBy("key", "chunk_id"))
    ranked_lists = reduce(DataFrame.unionByName, lists).withColumn("rank", rank).where(F.col("rank") <= 5 * CLAMP).where(F.col("rank") <= F.col("pool"))
    parts = [F.coalesce(F.lit(1.0) / (RRF_K + F.max(F.when(F.col("list") == i, F.col("rank")))), F.lit(0.0)) for i in range(len(lists))]
    summed = ranked_lists.groupBy("probe", "shard", "chunk_id").agg(F.max("episode_id").alias("episode_id"), reduce(lambda a, b: a + b, parts).alias("score"))
    limits = queries.select("probe", F.col("limit").alias("most"), F.greatest(F.least("limit", F.lit(CLAMP)), F.lit(0)).alias("clamped"))
    top = diversified(summed.join(limits, "probe"), F.col("clamped"), by=["probe", "shard"])
    of_probe = W.partitionBy("probe")
    several = F.min("shard").over(of_probe) != F.max("shard").over(of_probe)  # a set of them would be copied into each row
    again = F.when(several, F.lit(1.0) / (RRF_K + F.col("place"))).otherwise(F.col("score"))
    final = diversified(top.withColumn("score", again).drop("place"), F.col("most"), by=["probe"])
    return final.select("probe", "shard", "chunk_id", "episode_id", "score", "place")


def bm25_many(index: DataFrame, stats: DataFrame, wanted: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """probe, shard, chunk_id, score of the chunks that hold a term; wanted: probe, shard, nth, term.

    Counts are per shard and term, over all chunks: those of the index, unless
    counts (shard, term, n) are given for an index of some blocks. Parts add up in the terms'
    order, so that equal texts score alike.
    """
    terms = wanted.select("shard", "term").distinct()
    hits = index.join(terms, ["shard", "term"])
    n = counts if counts is not None else hits.groupBy("shard", "term").agg(F.count("*").alias("n"))
    s = hits.join(n, ["shard", "term"]).join(stats, "shard")
    s = s.select("shard", "term", "chunk_id", bm25_part("tf", "len").alias("part")).join(wanted, ["shard", "term"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "part"))), lambda x: x["part"])  # MAX_TERMS at most
    return s.groupBy("probe", "shard", "chunk_id").agg((-F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).alias("score"))


def block_bounds(maxima: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """shard, block, bound, n: no chunk of the block scores above the bound, and n chunks at least hold a term."""
    of = maxima.withColumnRenamed("n", "held").join(counts, ["shard", "term"]).join(stats, "shard")
    return of.groupBy("shard", "block").agg((F.sum(bm25_part("max_tf", "min_len")) * SLACK).alias("bound"), F.max("held").alias("n"))


def best_blocks(bounds: DataFrame, rows: int) -> DataFrame:
    """The blocks of the greatest bounds of each shard, as many as hold so many rows. A shard has as many blocks as a week has slots."""
    before = W.partitionBy("shard").orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1)
    return bounds.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < rows).drop("before")


def slot_ranges(blocks: list[int], most: int = 64) -> list[tuple[int, int]]:
    """`most` closed ranges at most that cover the numbers: of the gaps between them the widest stay."""
    xs = sorted(set(blocks))
    gaps = sorted(range(1, len(xs)), key=lambda i: (xs[i - 1] - xs[i], i))[: most - 1]
    cuts = [0, *sorted(i for i in gaps if xs[i] - xs[i - 1] > 1), len(xs)]
    return [(xs[a], xs[b - 1]) for a, b in zip(cuts, cuts[1:]) if a < b]


def in_slots(block: Column, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [block.between(lo, hi) for lo, hi in ranges], F.lit(False))


def hybrid_search(chunks: DataFrame, q: Query, index: DataFrame | None = None, stats: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: tuple[list[int], float, str] | None = None) -> DataFrame:
    """chunk_id, episode_id, text, score, source, provenance, ts_capture, place: the answer to one query, by search_many.

    chunks: shard, chunk_id, episode_id, text, ts_capture, source, provenance,
    app_name, bundle_id, entity_keys. Text is fetched last, for the rows of the
    answer. The terms and the vector are literals, so that they reach the scans.
    """
    spark = chunks.sparkSession
    names = sorted(r[0] for r in chunks.select("shard").distinct().toLocalIterator())  # a short string a week
    found = search_one(spark, q, chunks, index if index is not None else inverted_index(chunks), stats if stats is not None else shard_stats(chunks), names, vectors, query_vector, False)
    meta = chunks.select("shard", "chunk_id", "text", "ts_capture", known_source(F.col("source")).alias("source"), known_provenance(F.col("provenance")).alias("provenance"))
    return found.join(meta, ["shard", "chunk_id"]).select("chunk_id", "episode_id", "text", "score", "source", "provenance", "ts_capture", "place")


def search_one(spark: SparkSession, q: Query, catalog: DataFrame, index: DataFrame, stats: DataFrame, shards: list[str], vectors: DataFrame | None = None, query_vector: tuple[list[int], float, str] | None = None, pruned: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """search_many for one query whose terms and vector are literals."""
    terms = folded_terms(query_term_list(q.text))
    near = None
    if vectors is not None and query_vector is not None:
        near = knn(vectors, *query_vector).select(F.lit(0).alias("probe"), "shard", "chunk_id", "similarity")
    hits = index.where(F.col("term").isin(terms)) if terms else index.limit(0)
    return search_many(query_rows(spark, [q]), catalog, hits, stats, shards, near, pruned, counts).drop("probe")


def known_source(source: Column) -> Column:
    return F.when(source.isin("ax", "ocr", "audio"), source).otherwise(F.lit("ax"))


def known_provenance(p: Column) -> Column:
    """An unknown label counts as untrusted."""
    return F.when(p.isin("untrusted_ambient", "user_input", "system"), p).otherwise(F.lit("untrusted_ambient"))


def with_provenance(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """chunks with their event's provenance (events: id, and shard where chunks have it); a chunk without its event goes."""
    by = ["shard", "event_id"] if "shard" in chunks.columns else ["event_id"]
    return chunks.join(events.withColumnRenamed("id", "event_id").select(*by, known_provenance(F.col("provenance")).alias("provenance")), by)


def shards_for(names: list[str], time_range: tuple[dt.datetime, dt.datetime] | None) -> list[str]:
    """The shards whose week meets a closed range; all without one."""
    if time_range is None:
        return sorted(names)
    lo, hi = time_range
    return sorted(n for n in names if shard_bounds(n)[0] <= hi and shard_bounds(n)[1] > lo)


def unembedded(chunks: DataFrame, vectors: DataFrame, model: str, batch: int | None = None) -> DataFrame:
    """Chunks without a vector of the model, newest first; one anti join, whatever the backlog."""
    done = vectors.where(F.col("model_id") == model).select("chunk_id")
    left = chunks.join(done, "chunk_id", "left_anti").orderBy(F.desc("ts_capture"), "chunk_id")
    return left if batch is None else left.limit(batch)


def recall_at(results: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """probes, hits, recall: share of the probes whose expected label is among their first k results."""
    hit = results.where(F.col("place") <= k).join(expected, ["probe", "label"], "left_semi").select("probe").distinct()
    all_ = expected.select("probe").distinct().join(hit.withColumn("hit", F.lit(1)), "probe", "left")
    return all_.agg(F.count("*").alias("probes"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
