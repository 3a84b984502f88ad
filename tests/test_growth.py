"""Steps whose work must not grow faster than the input."""

import datetime as dt

from tidemark.operators import chunk, serve
from tidemark.sources import store


def test_gap_frames_grow_from_row_to_row(spark, monkeypatch):
    """A frame that ends unbounded is gone through anew for each row: work with the square of a slice."""
    plans, cut = [], store.reliable
    monkeypatch.setattr(store, "reliable", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or cut(df))
    at = [0.0, 1.5, 9.99, 10.0, 10.5, 19.0, 20.0, 31.0, 31.0, 45.0]
    rows = spark.createDataFrame([(k, t, i) for k in "ab" for i, t in enumerate(at)], "k string, at double, n int")
    got = sorted((r.k, r.at) for r in serve.admitted_gap(rows, "k", "at", 10.0).collect())
    assert got == [(k, t) for k in "ab" for t in (0.0, 10.0, 20.0, 31.0, 45.0)]
    assert plans and not any("unboundedfollowing" in p.lower() for p in plans)


def test_chunks_are_packed_once(spark):
    events = spark.createDataFrame([(1, "One here. Two there."), (2, "One here. Two there."), (3, ""), (4, None)], "event_id long, text string")
    judged = chunk.chunking_stage(events)
    assert "aggregate(" not in judged._jdf.queryExecution().analyzed().toString()
    assert sorted((r.event_id, r.ordinal, r.verdict) for r in judged.collect()) == [(1, 0, "retained"), (2, 0, "exact")]
    plan = chunk.chunk_text(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(aggregate(" not in plan  # no early filter that packs a text a second time


def test_weeks_stand_in_no_plan_and_a_new_table_is_moved_whole(spark, tmp_path, monkeypatch):
    """As literals, thousands of weeks stood in each of the many copies of a plan on the driver; files were moved one by one."""
    moved, move = [], store.Store.move
    monkeypatch.setattr(store.Store, "move", lambda self, *a: moved.append(a) or move(self, *a))
    s = store.Store(spark, f"file://{tmp_path}/weeks")
    rows = spark.range(300).selectExpr("cast(id AS string) AS id", "timestampadd(WEEK, id, timestamp'2020-01-06 00:00:00') AS t")
    episodes = rows.selectExpr("id", "t AS ts_start", "t AS ts_end", "'a' AS app_name")
    events = rows.selectExpr("id", "id AS episode_id", "t AS ts", "'system' AS provenance")
    chunks = rows.selectExpr("id", "id AS event_id", "id AS episode_id", "concat('word', id, ' word') AS text", "t AS ts_capture", "'ax' AS source")
    s.ingest(episodes, events, chunks)
    names = s.shards()
    assert len(names) == 300 and not moved
    asked = spark.createDataFrame([(0, "word7", None, None), (1, "word", dt.datetime(2021, 1, 5), dt.datetime(2021, 1, 12))], "probe int, text string, lo timestamp, hi timestamp")
    asked = asked.selectExpr("*", "CAST(NULL AS string) AS app", "CAST(NULL AS array<string>) AS entities", "5 AS limit")
    found = s.search_table(asked)
    plan = found._jdf.queryExecution().toString()
    assert sum(n in plan for n in names) <= 2  # the ends of the range
    assert sorted((r.probe, r.chunk_id) for r in found.collect()) == [(0, "7"), (1, "53")]
    again = rows.where("id < 3").selectExpr("concat('x', id) AS id", "t")
    s.ingest(again.selectExpr("id", "t AS ts_start", "t AS ts_end"), again.selectExpr("id", "id AS episode_id", "t AS ts"), again.selectExpr("id", "id AS event_id", "id AS episode_id", "'word' AS text", "t AS ts_capture"))
    assert moved and s.count("chunks") == 303 and s.count("episodes") == 303
