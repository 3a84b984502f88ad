"""Views of the driver's tables in the engine's terms, in Spark and, as SQL, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import shard_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as captured events, one an hour; episodes are tens of documents."""
    d = table(spark, sf_dir, "documents")
    ts = F.expr("timestampadd(HOUR, doc_id, timestamp_ntz'2026-01-05 00:00:00')")
    return d.select(F.col("doc_id").alias("event_id"), ts.alias("ts"), F.floor(F.col("doc_id") / 10).cast("long").alias("episode_id"), F.when(F.col("doc_id") % 5 == 0, "ocr").otherwise("ax").alias("source"), F.col("source").alias("app"), "lang", "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per captured event, with its episode's application, keys and shard."""
    e = capture_events(spark, sf_dir)
    first = F.min_by(F.struct("app", "lang"), "event_id")
    ep = e.groupBy("episode_id").agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), first.alias("f"))
    ep = ep.select("episode_id", "ts_start", "ts_end", F.col("f.app").alias("app_name"), F.concat(F.lit("com.example."), F.col("f.app")).alias("bundle_id"), F.array("f.lang").alias("entity_keys"), shard_of(F.col("ts_start")).alias("shard"))
    return e.join(ep, "episode_id").select("shard", F.col("event_id").alias("chunk_id"), "episode_id", "text", F.col("ts").alias("ts_capture"), "source", F.lit("untrusted_ambient").alias("provenance"), "app_name", "bundle_id", "entity_keys")


def app_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.concat(F.lit("com.example."), "event_type").alias("bundle"), F.col("event_type").alias("app"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("url"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as drafts; the key is that of priority, day and status."""
    from tidemark.functions.text import external_key

    o = table(spark, sf_dir, "orders")
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    status = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "draft").otherwise("approved")
    return o.select(F.col("o_orderkey").alias("id"), external_key(F.col("o_orderpriority"), day, F.col("o_orderstatus")).alias("external_key"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))




EVENTS_SQL = """capture_events AS (SELECT doc_id AS event_id, TIMESTAMP '2026-01-05 00:00:00' + to_hours(CAST(doc_id AS INT)) AS ts, doc_id // 10 AS episode_id,
  CASE WHEN doc_id % 5 = 0 THEN 'ocr' ELSE 'ax' END AS source, source AS app, lang, text FROM documents)"""
SHARD_SQL = "printf('%04d-W%02d', isoyear({0}), weekofyear({0}))"
CHUNKS_SQL = EVENTS_SQL + f""",
episodes AS (SELECT episode_id, min(ts) AS ts_start, max(ts) AS ts_end, arg_min(app, event_id) AS app_name, arg_min(lang, event_id) AS lang FROM capture_events GROUP BY episode_id),
chunks AS (SELECT {SHARD_SQL.format("ts_start")} AS shard, event_id AS chunk_id, e.episode_id, text, ts AS ts_capture, source, 'untrusted_ambient' AS provenance,
  app_name, 'com.example.' || app_name AS bundle_id, [p.lang] AS entity_keys FROM capture_events e JOIN episodes p USING (episode_id))"""
CONTEXTS_SQL = "app_contexts AS (SELECT event_id, ts, user_id, 'com.example.' || event_type AS bundle, event_type AS app, 'user ' || user_id AS title FROM events)"
DRAFTS_SQL = """drafts AS (SELECT o_orderkey AS id, o_orderpriority || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':' || substr(sha256(o_orderpriority || chr(31) || strftime(o_orderdate, '%Y-%m-%d') || chr(31) || o_orderstatus), 1, 16) AS external_key,
  CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'draft' ELSE 'approved' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"""
