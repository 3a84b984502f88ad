"""From signals to a filed and searchable store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_goldens import signals
from tidemark.__main__ import main
from tidemark.functions import vectors
from tidemark.operators import embed, exclude, sessions
from tidemark.sources.store import Store
from tidemark.streaming import engine


def test_closed_episodes_are_filed_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    sink = engine.CatalogSink(store, f"file://{tmp_path}/staging")
    rows = engine.folded(signals(spark)).collect()
    schema = engine.folded(signals(spark)).schema
    for i, part in enumerate((rows[:7], rows[7:])):
        sink(spark.createDataFrame(part, schema), i)
    sink(spark.createDataFrame(rows[7:], schema), 1)  # a retried batch
    assert store.count("episodes") == 6 and store.count("events") == 2 * 5
    assert store.read("chunks").where("text LIKE 'draft%'").count() == 4
    assert store.read("episodes").where("ts_end < ts_start").count() == 0


def test_search_command(spark, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/store")
    t = dt.datetime(2026, 1, 6)
    store.ingest(
        spark.createDataFrame([("E1", t, t, "b", "a", ["x"]), ("E2", t, t, "b", "a", ["x"])], "id string, ts_start timestamp, ts_end timestamp, bundle_id string, app_name string, entity_keys array<string>"),
        spark.createDataFrame([("V1", "E1", t, "untrusted_ambient"), ("V2", "E2", t, "user_input")], "id string, episode_id string, ts timestamp, provenance string"),
        spark.createDataFrame([("C1", "E1", "V1", "the budget review was moved", t, "ax"), ("C2", "E2", "V2", "lunch menu", t, "ax")], "id string, episode_id string, event_id string, text string, ts_capture timestamp, source string"),
    )
    assert main(["search", "--store", f"file://{tmp_path}/store", "budget review"]) == 0
    said = capsys.readouterr().out
    assert "⟦the budget review was moved⟧" in said and "[1] ax" in said
    assert store.count("vectors", "hash-512") == 2
    assert main(["version"]) == 0 and main(["simulate"]) == 0


def test_hashing_places_are_those_of_the_columns(spark):
    texts = ["Hello, big world", "a", "", "é b"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.b): r.n for r in d.select("id", F.explode(vectors.features(F.col("text"))).alias("f")).groupBy("id", vectors.bucket512(F.col("f")).alias("b")).agg(F.count("*").alias("n")).collect()}
    for i, v in enumerate(embed.HashingModel().embed(texts, "document")):
        own = {b: n for (j, b), n in got.items() if j == i}
        assert {int(b) for b in v.nonzero()[0]} == set(own)
    full = 0xCBF29CE484222325
    for byte in b"hello":
        full = ((full ^ byte) * 0x100000001B3) % 2**64
    assert int(embed.places([b"hello"])[0]) == full % 512


def test_backlog_and_model_swap(spark):
    chunks = spark.createDataFrame([("s", f"c{i}", f"text {i}", i) for i in range(4)], "shard string, chunk_id string, text string, ts_capture int")
    first = embed.embedded(chunks.where("chunk_id < 'c2'"))
    assert sorted(r.chunk_id for r in embed.embed_backlog(chunks, first).collect()) == ["c2", "c3"]
    other = embed.HashingModel()
    other.model_id = "m2"
    assert embed.embed_backlog(chunks, first, other).count() == 4
    ints, scale, _ = embed.query_vector("text 1")
    row = first.where("chunk_id = 'c1'").first()
    assert list(row.embedding) == ints and row.scale == pytest.approx(scale)


def test_policy_columns(spark):
    d = spark.createDataFrame([("AXSecureTextField", None, ["a", "b"], ["1", None]), (None, "x", ["a"], ["1", "2"])], "role string, subrole string, n array<string>, v array<string>")
    got = d.select(exclude.is_secure(F.col("role"), F.col("subrole")).alias("s"), exclude.attributes(F.col("n"), F.when(F.size("n") == F.size("v"), F.col("v"))).alias("m")).collect()
    assert [r.s for r in got] == [True, False] and got[0].m == {"a": "1"}


def test_sweeps_store_changes_only(spark):
    rows = [(1, 7, "x"), (2, 7, "x"), (3, 7, "y"), (5, 7, "y"), (1, 8, "x")]
    c = spark.createDataFrame(rows, "sweep long, window_id long, hash string")
    got = {(r.sweep, r.window_id) for r in sessions.sweep_distinct(c).where("stored").collect()}
    assert got == {(1, 7), (3, 7), (5, 7), (1, 8)}
    windows = c.selectExpr("sweep", "window_id", "'com.example.a' AS bundle", "'a' AS app", "'t' AS title", "cast(null AS string) AS url", "hash AS text")
    swept = sessions.ambient_sweeps(windows)
    assert {(r.sweep, r.window_id) for r in swept.where("outcome = 'stored'").collect()} == got
    assert sessions.sweep_log(swept).count() == 12
    assert sessions.sweep_stats(swept).first().asDict() == {"ambient_episodes": 4, "ambient_events": 4, "ambient_provider_calls": 5, "ambient_dedup_skips": 1}
