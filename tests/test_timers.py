"""Timers of the stream: they fire without a tick, at their own times, and survive a restart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import engine, timers

SIGNALS = "stream string, seq long, ts double, kind string, bundle string, app string, title string, text string"


def workdays(seed, streams=6, n=40):
    """Signals of several streams: bursts of typing, changes, pauses beyond the idle bound; no ticks."""
    r, rows = random.Random(seed), []
    for s in range(streams):
        t, here = 1000.0 + s, ("mail", "inbox")
        for seq in range(n):
            t += r.choice([0.5, 1.0, 1.5, 3.0, 20.0, 31.0, 250.0, 299.0, 300.0, 700.0])
            kind = r.choices(["app_change", "text_signal", "clipboard", "activity"], [4, 6, 1, 4])[0]
            if kind == "app_change":
                here = (r.choice(["mail", "editor", "chat"]), r.choice(["inbox", "draft"]))
            rows.append((f"u{s}", seq, t, kind, here[0], here[0], here[1], None if kind == "activity" and r.random() < 0.5 else f"text {r.randint(0, 5)}"))
        if s % 2:
            rows.append((f"u{s}", n, t + 5.0, "finish", None, None, None, None))
    return rows


def brute(rows, **bounds):
    """Each stream replayed by an engine whose clock is advanced in small steps between signals."""
    out = []
    for s in sorted({r[0] for r in rows}):
        e = engine.Engine(**bounds)
        for x in sorted((dict(zip(["stream", "seq", "ts", "kind", "bundle", "app", "title", "text"], r, strict=True)) for r in rows if r[0] == s), key=lambda x: x["seq"]):
            for now in (x["ts"] - 900 + k / 4 for k in range(3601)):
                if e.due() is not None and e.due() <= now:
                    out += [(s, *map(r.get, engine.OUT[1:])) for r in e.advance(now)]
            out += [(s, *map(r.get, engine.OUT[1:])) for r in e.feed(x)]
        out += [(s, *map(r.get, engine.OUT[1:])) for r in e.advance(1e12)]
    return sorted(out, key=str)


def test_batch_form_fires_at_the_due_times(spark):
    rows = workdays(1)
    got = sorted(map(tuple, engine.folded(spark.createDataFrame(rows, SIGNALS), timers=True).collect()), key=str)
    assert got == brute(rows)
    kinds = [r[3] for r in got]
    assert kinds.count("close") > 10 and kinds.count("open") == kinds.count("close")


def test_each_timer_alone():
    feed = lambda e, ts, kind, text=None, seq=0: e.feed({"seq": seq, "ts": ts, "kind": kind, "bundle": "b", "app": "b", "title": "t", "text": text})
    e = engine.Engine()
    assert [r["kind"] for r in feed(e, 0.0, "app_change", "a")] == ["open", "screen"] and e.due() == 300.0
    feed(e, 10.0, "text_signal", "typed")
    assert e.due() == 12.0 and [(r["kind"], r["ts"], r["text"]) for r in e.advance(12.0)] == [("screen", 12.0, "typed")]
    feed(e, 20.0, "activity", "scrolled")
    assert e.due() == 42.0 and [(r["kind"], r["ts"], r["text"]) for r in e.advance(50.0)] == [("screen", 42.0, "scrolled")]
    assert [(r["kind"], r["ts"]) for r in e.advance(1000.0)] == [("close", 20.0)] and e.due() is None
    feed(e, 2000.0, "activity", "back")
    feed(e, 2001.0, "text_signal", "x")
    assert e.due() == 2003.0
    feed(e, 2002.0, "app_change", "y")  # the same context: the deadline stays
    assert e.due() == 2003.0
    e.feed({"seq": 9, "ts": 2002.5, "kind": "finish", "bundle": None, "app": None, "title": None, "text": None})
    assert e.s.deadline is None and e.advance(5000.0) == []


def started(spark, df, tmp_path, name, sink=None):
    w = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
    return w.format("parquet").option("path", str(tmp_path / name))


@pytest.fixture
def timed(spark):
    before = spark.conf.get(timers.PROVIDER[0])
    yield timers.with_timers(spark)
    spark.conf.set(timers.PROVIDER[0], before)


def files(spark, rows, schema, folder, parts):
    """One file a micro-batch, in order of time over all streams, and a last row that moves the watermark beyond all timers."""
    ts = [x.split()[0] for x in schema.split(", ")].index("ts")
    rows = sorted(rows, key=lambda r: r[ts])
    for i in range(parts):
        some = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(folder / f"{i:02d}"))
        time.sleep(0.02)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_stream_with_timers_is_the_batch_form_across_a_restart(timed, tmp_path):
    rows = workdays(2, streams=4, n=25)
    last = [("zz", 0, 1e7, "app_change", "b", "b", "t", "x")]
    files(timed, rows, SIGNALS, tmp_path / "in", 3)
    out = timers.captured(source(timed, tmp_path / "in", SIGNALS))
    for _ in range(2):  # the second run starts from the checkpoint of the first
        q = started(timed, out, tmp_path, "out").trigger(availableNow=True).start()
        q.awaitTermination(200)
        files(timed, last, SIGNALS, tmp_path / "in" / "more", 1) if not (tmp_path / "in" / "more").exists() else None
    got = timed.read.schema(engine.OUT_SQL).parquet(str(tmp_path / "out")).where("stream <> 'zz'")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_idle_and_debounce_fire_by_the_clock_with_no_further_input(timed, tmp_path):
    rows = [("u", 0, 0.0, "app_change", "b", "b", "t", "first"), ("u", 1, 0.5, "text_signal", "b", "b", "t", "typed")]
    timed.createDataFrame(rows, SIGNALS).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    out = timers.captured(source(timed, tmp_path / "in", SIGNALS), event_time=False, idle=3.0, debounce=1.0, ttl_ms=600_000)
    q = out.writeStream.format("memory").queryName("by_clock").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and timed.table("by_clock").where("kind = 'close'").count() == 0:
            time.sleep(1)
        got = [(r.kind, r.ts, r.text) for r in timed.table("by_clock").orderBy("ts", F.desc("kind")).collect()]
    finally:
        q.stop()
    assert sorted(got, key=str) == sorted([("open", 0.0, None), ("screen", 0.0, "first"), ("screen", 1.5, "typed"), ("close", 0.0, None)], key=str)


def titles_brute(rows, gap):
    out = []
    for s in sorted({r[0] for r in rows}):
        last = at = wait = None
        for _, _, t, title in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            while wait is not None and at + gap <= t:
                if wait != last:
                    last, at = wait, at + gap
                    out.append((s, at, last, "trailing"))
                wait = None
            if at is not None and t < at + gap:
                wait = title
            elif title != last:
                last, at = title, t
                out.append((s, t, title, "leading"))
        if wait is not None and wait != last:
            out.append((s, at + gap, wait, "trailing"))
    return sorted(out)


def test_titles_have_both_edges(timed, tmp_path):
    r, rows, schema = random.Random(7), [], "stream string, seq long, ts double, title string"
    for s in ("a", "b", "c"):
        t = 10.0
        for seq in range(40):
            t += r.choice([0.25, 0.5, 1.0, 2.5, 6.0])
            rows.append((s, seq, t, r.choice(["x", "y", "z"])))
    files(timed, [*rows, ("zz", 0, 1e6, "end")], schema, tmp_path / "in", 3)
    q = started(timed, timers.coalesced(source(timed, tmp_path / "in", schema), 3.0), tmp_path, "out").trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = timed.read.schema("stream string, ts double, title string, edge string").parquet(str(tmp_path / "out")).where("stream <> 'zz'")
    want = titles_brute(rows, 3.0)
    assert sorted(map(tuple, got.collect())) == want and {r[3] for r in want} == {"leading", "trailing"}
