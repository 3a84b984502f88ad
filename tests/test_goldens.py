"""Known answers of the engine's operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text, vectors
from tidemark.operators import chunk, exclude, filing, neardup, redact, retrieve, serve, sessions
from tidemark.streaming import engine


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# text


def test_normalize_and_titles(spark):
    r = one(spark, text.normalize(F.lit(" a \t b\n")).alias("n"), text.window_title(F.lit("⠋ Build ▄ log")).alias("t"), text.window_title(F.lit("⠋⠙ ")).alias("none"))
    assert (r.n, r.t, r.none) == ("a b", "Build log", None)


def test_sentences_and_tokens(spark):
    r = one(spark, text.sentences(F.lit("a.b! c d. e")).alias("s"), text.token_estimate(F.lit("a b c")).alias("t"), text.token_estimate(F.lit(None).cast("string")).alias("z"))
    assert (r.s, r.t, r.z) == (["a.b!", "c d.", "e"], 4, 0)


def test_query_terms():
    assert text.query_term_list("What did the team say about Q3-pricing, pricing?") == ["team", "say", "about", "q3", "pricing"]
    assert text.query_term_list("?! the of a") == []
    assert len(text.query_term_list(" ".join(f"w{i}" for i in range(40)))) == 12


def test_external_key(spark):
    import hashlib

    r = one(spark, text.external_key(F.lit("daily"), F.lit("2026-01-05"), F.lit("notes")).alias("k"))
    assert r.k == "daily:2026-01-05:" + hashlib.sha256("daily\u001f2026-01-05\u001fnotes".encode()).hexdigest()[:16]


def test_weeks(spark):
    got = spark.createDataFrame([("2026-01-05",), ("2025-12-31",), ("2027-01-01",)], "d string").select(dates.shard_of(F.col("d").cast("timestamp")).alias("s")).collect()
    assert [r.s for r in got] == ["2026-W02", "2026-W01", "2026-W53"]
    assert dates.shard_bounds("2026-W02") == (dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 12))
    assert dates.shard_name(dt.datetime(2025, 12, 31)) == "2026-W01"
    assert one(spark, dates.shard_start(F.lit("week")).alias("s")).s is None


@pytest.mark.parametrize(
    "said,day",
    [
        ("next Friday", "2026-01-16"), ("Friday", "2026-01-09"), ("last monday", "2025-12-29"), ("this Monday", "2026-01-05"), ("January 3", "2027-01-03"), ("Feb 30", None), ("2026-13-01", None),
        ("today", "2026-01-05"), ("tmrw", "2026-01-06"), ("yesterday", "2026-01-04"), ("5th March, 2026", "2026-03-05"), ("Sept. 1", "2026-09-01"), ("nothing", None), ("on 2026/02/03 or today", "2026-02-03"),
    ],
)
def test_event_dates(spark, said, day):
    r = one(spark, dates.event_date(F.lit(f"we meet {said} ok"), F.lit("2026-01-05 10:00:00").cast("timestamp")).cast("string").alias("d"))
    assert r.d == day


# chunks and near-duplicates


def test_chunk_packing(spark):
    words = lambda s: F.size(text.word_list(s))
    d = spark.createDataFrame([(1, "a b c. d e f. g h i. j k l."), (2, " ".join(f"w{i}" for i in range(20))), (3, ""), (4, None)], "id long, text string")
    got = chunk.chunk_text(d, target=5, most=8, estimate=words).orderBy("id", "ordinal").collect()
    assert [(r.id, r.chunk, r.token_count) for r in got if r.id == 1] == [(1, "a b c. d e f.", 6), (1, "g h i. j k l.", 6)]
    assert [r.token_count for r in got if r.id == 2] == [8, 8, 4]
    assert {r.id for r in got} == {1, 2}


def test_coefficients_and_signature():
    assert neardup.coefficients()[:3] == ((650919837, 4085868455), (2731572125, 2803953172), (4243718002, 739400477))
    assert neardup.signature_of("") == [neardup.EMPTY] * 128
    assert int(neardup.fnv32([b"a"])[0]) == 0xE40C292C


def test_collapse_keeps_the_first_of_each(spark):
    docs, offered = [[f"d{k}w{i}" for i in range(50)] for k in range(10)], []
    for k, w in enumerate(docs):
        offered.append(" ".join(w))
        if k < 5:
            offered += [" ".join(w[: 50 - s] + [f"x{k}{s}"] * s) for s in (1, 2)] + [" ".join(w)]
    got = neardup.collapse(spark.createDataFrame(list(enumerate(offered)), "seq long, text string")).collect()
    verdicts = [r.verdict for r in sorted(got, key=lambda r: r.seq)]
    assert len(verdicts) == 25 and verdicts.count("retained") == 10
    assert all(r.kept_as <= r.seq for r in got)


def sequential(texts, threshold):
    """The rule itself: each text against the retained ones before it that share a band."""
    kept, out = [], []
    for i, t in enumerate(texts):
        s = neardup.signature_of(t)
        best = None
        for j, r in kept:
            if any(s[k : k + 8] == r[k : k + 8] for k in range(0, 128, 8)):
                x = sum(a == b for a, b in zip(s, r, strict=True)) / 128
                if x >= threshold and (best is None or x > best[0]):
                    best = (x, j)
        out.append(("near", best[1]) if best else ("retained", i))
        if not best:
            kept.append((i, s))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_collapse_rounds_are_the_sequential_rule(spark, threshold):
    texts = [" ".join(f"c{(i * 2 + j)}" for j in range(60)) for i in range(25)] + [" ".join(f"e{(i + j)}" for j in range(90)) for i in range(12)]
    got = neardup.collapse(spark.createDataFrame(list(enumerate(texts)), "seq long, text string"), threshold).collect()
    assert [(r.verdict, r.kept_as) for r in sorted(got, key=lambda r: r.seq)] == sequential(texts, threshold)


# redaction and policy


def test_redaction(spark):
    rows = [(1, "k sk-abcdefghij0123456789 x"), (2, "4111 1111 1111 1111 2"), (3, "4111-1111-1111-1112"), (4, "-----BEGIN PRIVATE KEY-----\nA\n-----END PRIVATE KEY-----"), (5, None), (6, "mail a@b.c"), (7, "code ABC-123")]
    got = {r.id: (r.text, r.redaction_flags) for r in redact.redact(spark.createDataFrame(rows, "id long, text string"), custom=[("ticket", 8, r"ABC-\d+")]).collect()}
    assert got == {1: ("k [redacted:apiKey] x", 1), 2: ("[redacted:creditCard]", 4), 3: ("4111-1111-1111-1112", 0), 4: ("[redacted:privateKey]", 2), 5: (None, 0), 6: ("mail a@b.c", 0), 7: ("code [redacted:ticket]", 8)}


def test_card_runs(spark):
    runs = ["4111111111111111", "4111111111111112", "41111111111111112", "378282246310005", "1234567890123456789", "123"]
    got = spark.createDataFrame([(r,) for r in runs], "r string").select("r", text.card_run(F.col("r")).alias("c")).collect()
    assert {r.r: r.c for r in got} == {r: redact.is_card_run(r) for r in runs}


def test_exclusions(spark):
    d = spark.createDataFrame([("COM.BITWARDEN.desktop", "B", None, None), ("x", "X", "New Incognito tab", None), ("x", "X", "t", "https://bank.example/in"), ("x", "X", None, None)], "bundle string, app string, title string, url string")
    rules = (*exclude.DEFAULT_RULES, ("url", "BANK.", "redact"), ("regex", "(", "never_capture"), ("schedule", "x", "never_capture"))
    assert [r.m for r in d.select(exclude.exclusion_mode(rules).alias("m")).collect()] == ["never_capture", "never_capture", "redact", "capture"]


def test_ocr_lines(spark):
    runs = [("i", "world", 0.900, 0.5), ("i", "hello", 0.905, 0.1), ("i", "below", 0.88, 0.0), ("i", "chained", 0.894, 0.9)]
    r = exclude.assembled_ocr(spark.createDataFrame(runs, "image string, text string, top double, left double")).first()
    assert r.text == "hello world chained\nbelow"


def test_sweep_plan(spark):
    cols = "sweep long, window_id long, pid long, bundle string, app string, title string, layer int, width int, height int, on_screen boolean, sharing_none boolean"
    rows = [(1, i, 10 + i, "b", "a", f"t{i}", 0, 300 + i, 300, True, False) for i in range(15)] + [(1, 50, 60, "b", "a", "hid", 0, 900, 900, True, True), (1, 51, 60, "b", "a", "same pid", 0, 900, 900, True, False), (1, 52, 61, "com.figma.Desktop", "F", None, 0, 950, 900, True, False), (1, 53, 62, "b", "a", None, 0, 900, 900, True, False), (1, 54, 63, "b", "a", "focus", 0, 990, 900, True, False)]
    focused = spark.createDataFrame([(1, 63, "focus")], "sweep long, pid long, title string")
    got = [r.window_id for r in exclude.sweep_plan(spark.createDataFrame(rows, cols), focused).orderBy("place").collect()]
    assert got == [52, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4]


# retrieval


def test_reciprocal_ranks(spark):
    lists = [spark.createDataFrame([("s", c, i + 1) for i, c in enumerate(ids)], "shard string, chunk_id string, rank int") for ids in ("xyz", "yxw")]
    got = retrieve.reciprocal_ranks(lists).orderBy(F.desc("score"), "chunk_id").collect()
    assert [r.chunk_id for r in got] == ["x", "y", "w", "z"]
    assert got[0].score == 1 / 61 + 1 / 62 and got[2].score == 1 / 63


@pytest.mark.parametrize("limit,cap,want", [(3, 2, ["a1", "a2", "b1"]), (4, 2, ["a1", "a2", "b1", "a3"])])
def test_diversified(spark, limit, cap, want):
    rows = [("a1", "a", 9.0), ("a2", "a", 8.0), ("a3", "a", 7.0), ("b1", "b", 1.0)]
    got = retrieve.diversified(spark.createDataFrame(rows, "chunk_id string, episode_id string, score double"), limit, cap).orderBy("place").collect()
    assert [r.chunk_id for r in got] == want


CORPUS = [
    ("garden", "com.example.notes", "Notes", ["plants"], ["Tomatoes need repotting before the frost.", "Order compost for the raised bed."], 1.0),
    ("insurance", "com.example.web", "Browser", ["carrier"], ["Insurance renewal quote for the van, excess raised.", "Compare with the other carrier."], 3.5),
    ("backup", "com.example.shell", "Shell", ["nas"], ["rsync of the photo archive stalled", "The archive disk reports bad sectors."], 5.0),
    ("choir", "com.example.mail", "Mail", ["anna"], ["Rehearsal of the choir moves to the town hall.", "Bring the alto parts."], 31.0),
    ("recipe", "com.example.reader", "Reader", ["bread"], ["Sourdough starter, feed twice a day.", "Bake at high heat with steam."], 50.0),
]


def corpus(spark):
    base, rows, n = dt.datetime(2027, 1, 15, 8), [], 0
    for label, bundle, app, keys, texts, hours in CORPUS:
        for t in texts:
            n += 1
            ts = base - dt.timedelta(hours=hours)
            rows.append((dates.shard_name(ts), f"c{n:02d}", label, t, ts, "ax", "weird", app, bundle, keys))
    return base, spark.createDataFrame(rows, "shard string, chunk_id string, episode_id string, text string, ts_capture timestamp_ntz, source string, provenance string, app_name string, bundle_id string, entity_keys array<string>")


def test_search_recalls_each_probe(spark):
    base, chunks = corpus(spark)
    probes = {"when is the choir rehearsal": "choir", "van insurance renewal": "insurance", "photo archive rsync": "backup", "tomatoes repotting": "garden", "sourdough starter": "recipe"}
    for p, want in probes.items():
        top = retrieve.hybrid_search(chunks, retrieve.Query(p)).orderBy("place").limit(3).collect()
        assert want in [r.episode_id for r in top] and top[0].provenance == "untrusted_ambient"
    six = retrieve.hybrid_search(chunks, retrieve.Query("", (base - dt.timedelta(hours=6), base))).collect()
    assert {r.episode_id for r in six} == {"garden", "insurance", "backup"}
    assert [r.episode_id for r in retrieve.hybrid_search(chunks, retrieve.Query("archive", app="Shell", entities=["NAS"])).collect()] == ["backup"] * 2
    assert retrieve.hybrid_search(chunks, retrieve.Query("archive", limit=0)).count() == 0


def test_vectors(spark):
    d = vectors.quantize(spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [-3.0, 4.0, 9.0])], "id long, v array<double>"), "v", 2)
    got = {r.id: (r.ints, r.scale) for r in d.collect()}
    assert got[1][0] == [95, 127] and got[2] == ([0, 0], 1.0) and got[3][0] == [-95, 127]
    stored = spark.createDataFrame([("s", "a", "m", 2, got[1][1], got[1][0]), ("s", "b", "m", 2, got[3][1], got[3][0]), ("s", "c", "other", 2, 1.0, [1, 1]), ("s", "d", "m", 2, 1.0, [1])], "shard string, chunk_id string, model_id string, dim int, scale float, embedding array<tinyint>")
    assert [r.chunk_id for r in retrieve.knn(stored, got[1][0], got[1][1], "m").collect()] == ["a"]


def test_shards_for():
    names = ["2026-W02", "2026-W03", "2026-W10"]
    assert retrieve.shards_for(names, (dt.datetime(2026, 1, 11, 23), dt.datetime(2026, 1, 12))) == names[:2]
    assert retrieve.shards_for(names, None) == names


# serving and filing


def test_windows_and_errors():
    now = dt.datetime(2026, 1, 5, 10)
    assert serve.resolve_window("yesterday", now) == (dt.datetime(2026, 1, 4), dt.datetime(2026, 1, 5))
    assert serve.resolve_window("1.5h", now) == (dt.datetime(2026, 1, 5, 8, 30), now)
    assert serve.resolve_window("2026-01-01T00:00:00Z..2026-01-02T00:00:00Z", now)[1] == dt.datetime(2026, 1, 2)
    for bad in ("0h", "6H", "later", "b..a"):
        with pytest.raises(serve.ToolError, match="EMPTY_RANGE"):
            serve.resolve_window(bad, now)
    with pytest.raises(serve.ToolError, match="INVALID_ARGUMENTS"):
        serve.parse_instant("2026-01-01T00:00:00.5Z")


def test_throttle_counts_admitted_calls_only(spark):
    t = serve.Throttle()
    assert [t.admit(0.0) for _ in range(31)].count(True) == 30
    assert not t.admit(59.9) and t.admit(60.0)
    calls = spark.createDataFrame([("a", i, float(i)) for i in range(8)] + [("b", 0, 0.0)], "client string, seq long, at double")
    got = serve.throttled(calls, 2, 3.0).orderBy("client", "seq").collect()
    assert [r.admitted for r in got] == [True, True, False, True, True, False, True, True, True]


def test_key_session():
    k = serve.KeySession()
    assert not any(k.attempt(float(i), False) for i in range(5)) and not k.attempt(6.0, True)
    assert k.attempt(66.0, True) and k.is_open(66.0 + 12 * 3600 - 1) and not k.is_open(66.0 + 12 * 3600)


def test_tools(spark):
    base, chunks = corpus(spark)
    tools = serve.MemoryTools(lambda q: retrieve.hybrid_search(chunks, q))
    assert tools.call("search_memory", {"query": "van insurance renewal", "limit": 1.5}, base)[0]["episode_id"] == "insurance"
    assert len(tools.call("recent_activity", {"window": "6h"}, base)) == 6
    for bad in ({"query": " "}, {"query": "x", "limit": 0}, {"query": "x", "time_range": {"start": "2026"}}):
        with pytest.raises(serve.ToolError, match="INVALID_ARGUMENTS"):
            tools.call("search_memory", bad, base)
    with pytest.raises(serve.ToolError, match="INVALID_ARGUMENTS"):
        tools.call("write", {}, base)


def test_fences_cannot_be_forged(spark):
    d = spark.createDataFrame([(1, 1, "a⟧b⟦c", "untrusted_ambient", "ax", 5, 77), (1, 2, "mine", "user_input", "ax", 6, 77)], "q int, place int, text string, provenance string, source string, ts long, episode_id long")
    got = [r.snippet for r in serve.cited(d).orderBy("place").collect()]
    assert got == ["[1] ax · 5 · episode 77\n⟦a]b[c⟧", "[2] ax · 6 · episode 77\nmine"]
    assert serve.rendered(d, ["q"]).first().answer.endswith("\n".join(got))


@pytest.mark.parametrize(
    "payload,reason",
    [
        ("{}", None), ('{"commitments":[{"text":"a","due":null}]}', None), ("[]", "not a JSON object"), ("{", "not a JSON object"), (None, "not a JSON object"), ('{"x":1}', "unknown field: x"), ('{"reading":[{"title":"http://x"}]}', "URL in payload"),
        ('{"reading":[{"title":"http:\\/\\/x"}]}', "URL in field"), ('{"reading":[{"text":"a"}]}', "malformed schema"), ('{"log_entries":[{"text":"a","ts":"monday"}]}', "malformed schema"), ('{"log_entries":[{"text":" "}]}', "empty text"),
        ('{"log_entries":[{"text":"' + "a" * 2001 + '"}]}', "text too long"), ('{"log_entries":[' + ",".join(['{"text":"a"}'] * 201) + "]}", "too many items"),
    ],
)
def test_rejections(payload, reason):
    assert filing.rejection(payload) == reason


def test_page(spark):
    import json

    d = spark.createDataFrame([('{"commitments":[{"text":"ship \\"x\\"","due":"2026-02-01T09:00:00Z"}],"log_entries":[{"text":"met"}]}',), ("{}",)], "payload string")
    pages = [json.loads(r.p) for r in filing.validated(d).select(filing.page_json(F.lit('Day "one": x'), F.col("extract")).alias("p")).collect()]
    assert pages[0]["title"] == 'Day "one": x'
    assert pages[0]["children"][1] == {"object": "block", "type": "to_do", "to_do": {"rich_text": [{"type": "text", "text": {"content": 'ship "x" (due 2026-02-01)'}}], "checked": False}}
    assert [c["type"] for c in pages[1]["children"]] == ["paragraph"]


def test_drafts(spark):
    new = spark.createDataFrame([(1, "k1", 5), (2, "k1", 4), (3, "k2", 1)], "id long, external_key string, created_at long")
    assert [r.id for r in filing.idempotent_insert(new, new.where("id = 3")).collect()] == [2]
    drafts = spark.createDataFrame([(1, "draft"), (2, "approved"), (3, "committed")], "id long, status string")
    acts = spark.createDataFrame([(1, "approve"), (1, "commit"), (2, "commit"), (3, "undo"), (2, "dismiss"), (9, "undo")], "id long, action string")
    got = {(r.id, r.action): (r.result, r.new_status) for r in filing.transitions(drafts, acts).collect()}
    assert got == {(1, "approve"): ("ok", "approved"), (1, "commit"): ("illegal_transition", "draft"), (2, "commit"): ("ok", "committed"), (3, "undo"): ("ok", "undone"), (2, "dismiss"): ("ok", "dismissed"), (9, "undo"): ("not_found", None)}


# sessions and the engine


def test_idle_gap_is_closed_at_the_bound(spark):
    base = dt.datetime(2026, 1, 5)
    rows = [(i, base + dt.timedelta(seconds=s)) for i, s in enumerate((0, 299, 599, 898))]
    got = sessions.idle_sessions(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")).orderBy("session").collect()
    assert [(r.n_events) for r in got] == [2, 2]


WORKDAY = [
    (0, "app_change", "editor", "notes.md", "draft of the plan"), (30, "text_signal", "editor", "notes.md", None), (33, "tick", None, None, "draft of the plan, second part"), (40, "text_signal", "editor", "notes.md", None),
    (45, "tick", None, None, "draft of the plan, second part"), (50, "clipboard", "editor", "notes.md", "a quoted line"), (90, "app_change", "browser", "timetable", "trains on monday"), (500, "tick", None, None, "trains on monday"),
    (520, "tick", None, None, "trains on monday"), (700, "activity", None, None, "trains on monday"), (720, "finish", None, None, None),
]


def workday():
    return [{"seq": i, "ts": float(t), "kind": k, "bundle": b, "app": b, "title": title, "text": x} for i, (t, k, b, title, x) in enumerate(WORKDAY)]


def counters(rows):
    kinds = [r["kind"] for r in rows]
    return [kinds.count(k) for k in ("open", "close", "screen", "clipboard", "skip")]


def test_replay_counters():
    out, state = engine.replay(workday())
    assert counters(out) == [3, 3, 4, 1, 1] and state.provider_calls == 5
    assert [r["ts"] for r in out if r["kind"] == "close"] == [90.0, 90.0, 720.0]


def test_engine_honours_modes():
    mode = lambda x: {"editor": "never_capture", "browser": "redact"}.get(x["bundle"], "capture")
    out, _ = engine.replay(workday(), mode)
    assert all(r["app"] != "editor" for r in out)
    assert {r["text"] for r in out if r["kind"] == "screen"} == {redact.PLACEHOLDER}


def signals(spark):
    rows = [(s, r["seq"], r["ts"], r["kind"], r["bundle"], r["app"], r["title"], r["text"]) for s in ("u1", "u2") for r in workday()]
    return spark.createDataFrame(rows, "stream string, seq long, ts double, kind string, bundle string, app string, title string, text string")


def test_folded_is_the_replay_of_each_stream(spark):
    got = engine.folded(signals(spark)).orderBy("stream", "seq").collect()
    for s in ("u1", "u2"):
        assert counters([r.asDict() for r in got if r.stream == s]) == [3, 3, 4, 1, 1]


def test_stream_result_is_the_batch_result(spark, tmp_path):
    rows = signals(spark)
    for i in range(3):  # three files, three micro-batches
        rows.where(F.floor(F.col("seq") / 4) == i).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = engine.streamed(source).writeStream.format("memory").queryName("engine_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("engine_out").collect()
    want = engine.folded(rows).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
