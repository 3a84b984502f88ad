"""A table of queries: slices, blocks and what they leave out give the lists that rows would, and nothing is shuffled twice."""

import datetime as dt
import random
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import many, retrieve
from tidemark.sources.store import Store

START = dt.datetime(2026, 1, 5)


def filled(spark, path, n=120):
    """Chunks of three weeks: a hot one, episodes of many chunks, equal texts, marks in two forms, a null key, a chunk without its event."""
    r = random.Random(4)
    words = "alpha beta gamma delta Épsilon épsilon zeta eta theta iota kappa".split()
    times = [START + dt.timedelta(minutes=7 * i if i < n * 2 // 3 else 700 * i) for i in range(n)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 6))) if i % 9 else "alpha beta" for i in range(n)]
    rows = [(f"{i:05d}", f"e{i // 11:03d}", t, x, "ax") for i, (t, x) in enumerate(zip(times, texts))]
    chunks = spark.createDataFrame(rows, "id string, episode_id string, ts_capture timestamp, text string, source string").withColumn("event_id", F.col("id"))
    keys = F.when(F.col("episode_id") < "e003", F.array(F.lit("DE"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("en")))
    episodes = chunks.groupBy(F.col("episode_id").alias("id")).agg(F.min("ts_capture").alias("ts_start"), F.max("ts_capture").alias("ts_end")).withColumn("episode_id", F.col("id"))
    episodes = episodes.withColumn("app_name", F.when(F.col("id") > "e001", F.concat(F.lit("app"), (F.substring("id", 2, 3).cast("int") % 2).cast("string")))).withColumn("bundle_id", F.lit("b")).withColumn("entity_keys", keys).drop("episode_id")
    events = chunks.where("id <> '00004'").select("id", "episode_id", F.col("ts_capture").alias("ts"), F.lit("system").alias("provenance"))
    s = Store(spark, path)
    s.ingest(episodes, events, chunks)
    return s


QUERIES = [
    retrieve.Query("alpha beta", limit=5), retrieve.Query("epsilon zeta the", limit=8), retrieve.Query("gamma", (START, START + dt.timedelta(days=3)), limit=4), retrieve.Query("nothing here"),
    retrieve.Query("", (START, START + dt.timedelta(days=9)), limit=3), retrieve.Query("", limit=3), retrieve.Query("theta alpha", app="app1", limit=30), retrieve.Query("beta", entities=["De"], limit=2), retrieve.Query("iota", app="b", entities=["EN", ""]), retrieve.Query("kappa", limit=0),
]


def test_slices_and_blocks_give_the_rows_of_the_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(many, "SLICE", 16)
    monkeypatch.setattr(many, "QUERIES", 4)
    s = filled(spark, f"file://{tmp_path}/s")
    names, asked = s.shards(), retrieve.query_rows(spark, QUERIES)
    assert len(names) > 2 and max(r.n_chunks for r in s.statistics(names).collect()) > 2 * many.SLICE
    rows = lambda df: sorted((r.probe, r.chunk_id, r.episode_id, round(r.score, 12), r.place) for r in df.collect())
    want = rows(retrieve.search_many(asked, s.catalog(names), s.read("postings"), s.statistics(names), names))
    found = s.search_table(asked)
    assert "collect_set" not in found._jdf.queryExecution().analyzed().toString()  # a query's weeks, copied into each of its rows: work with the square of the weeks
    got = rows(found)
    assert got == want and {r[0] for r in got} == {0, 1, 2, 4, 5, 6, 7, 8}


def test_a_slice_keeps_what_can_have_a_place(spark, tmp_path):
    """Each query took its whole pool, 50 chunks of each week, through five shuffles."""
    s = filled(spark, f"file://{tmp_path}/s")
    names = s.shards()
    (block,) = many.query_blocks(retrieve.query_rows(spark, QUERIES[:1]))
    found = many.keyword_lists(many.Block(block), s.catalog(names), s.read("postings"), s.statistics(names), retrieve.week_rows(spark, names))
    most = {r.shard: r["count"] for r in found.groupBy("shard").count().collect()}
    held = {r.shard: r["count"] for r in s.read("postings").where("term IN ('alpha', 'beta')").select("shard", "chunk_id").distinct().groupBy("shard").count().collect()}
    assert max(held.values()) > 25 and 5 <= max(most.values()) < 15


def test_the_index_is_made_where_the_texts_are(spark):
    """Postings were shuffled once, their maxima twice."""
    rows = [("2026-W02", "a", "one two one", 5), ("2026-W02", "b", "Two", 5), ("2026-W02", "c", None, 5), ("2026-W03", "d", " ,", 6)]
    chunks = spark.createDataFrame(rows, "shard string, chunk_id string, text string, block int").coalesce(1)
    postings = retrieve.inverted_index(chunks, "block")
    maxima = retrieve.block_maxima(postings)
    for df in (postings, maxima):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, postings.collect())) == [("2026-W02", "one", "a", 3, 5, 2), ("2026-W02", "two", "a", 3, 5, 1), ("2026-W02", "two", "b", 1, 5, 1)]
    assert sorted(map(tuple, maxima.collect())) == [("2026-W02", "one", 5, 1, 2, 3), ("2026-W02", "two", 5, 2, 1, 1)]


def test_terms_are_split_and_counted_as_by_index_terms(spark):
    odd = ["", " ", "a", "É é E", "ΟΔΟΣ οδος", "́", "x́ý z", "a_b-c1²½", "İstanbul ǅ", "ß ŉ ﬁ", "日本 語゙", "á̂b\nc", "ab\u0000cd", None]
    df = spark.createDataFrame(list(enumerate(odd)), "chunk_id int, text string").withColumn("shard", F.lit("w"))
    want = sorted((r.chunk_id, r.term, r.tf) for r in df.select("chunk_id", F.explode(text.index_terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).collect())
    assert sorted((r.chunk_id, r.term, r.tf) for r in retrieve.inverted_index(df).collect()) == want
    assert all(r.a == r.b for r in df.where("text IS NOT NULL").select(F.size(text.index_terms(F.col("text"))).alias("a"), text.term_count(F.col("text")).alias("b")).collect())
    assert all(unicodedata.category(c).startswith("L") for c in text.COMPOSED + text.BASES)


def test_small_tables_of_many_weeks_are_written_by_several_tasks(spark, tmp_path):
    """One task wrote the episodes' files of all weeks, one after the other."""
    s = Store(spark, f"file://{tmp_path}/w")
    rows = spark.range(4000).selectExpr("lpad(cast(id AS string), 6, '0') AS id", "timestampadd(WEEK, cast(id % 400 AS int), timestamp'2020-01-06 00:00:00') AS t")
    e = rows.selectExpr("id", "t AS ts_start", "t AS ts_end")
    s.ingest(e, rows.selectExpr("id", "id AS episode_id", "t AS ts").limit(0), rows.selectExpr("id", "id AS event_id", "id AS episode_id", "'x' AS text", "t AS ts_capture").limit(0))
    tasks = {f.split("part-")[1][:5] for w in s.children(s.path("episodes")) if w.startswith("shard=") for f in s.children(f"{s.path('episodes')}/{w}")}
    assert len(s.shards()) == 400 and len(tasks) > 1
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize") != "16k"
