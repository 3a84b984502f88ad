"""The week-partitioned store."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import retrieve
from tidemark.sources import store as st


def seeded(spark, root):
    s = st.Store(spark, f"file://{root}/store")
    weeks = {"E1": dt.datetime(2026, 1, 6), "E2": dt.datetime(2026, 1, 7), "E3": dt.datetime(2026, 3, 4)}
    episodes = spark.createDataFrame([(e, t, t, "b", "a") for e, t in weeks.items()], "id string, ts_start timestamp, ts_end timestamp, bundle_id string, app_name string")
    events = spark.createDataFrame([(f"{e}-ev", e, t + dt.timedelta(days=9)) for e, t in weeks.items()], "id string, episode_id string, ts timestamp")
    chunks = spark.createDataFrame([(f"{e}-c{i}", e, f"{e}-ev", "text", t) for e, t in weeks.items() for i in range(2)], "id string, episode_id string, event_id string, text string, ts_capture timestamp")
    s.ingest(episodes, events, chunks)
    return s


def test_rows_live_in_their_episode_s_week(spark, tmp_path):
    s = seeded(spark, tmp_path)
    assert s.shards() == ["2026-W02", "2026-W10"]
    assert {r.shard for r in s.read("events").where("episode_id = 'E1'").collect()} == {"2026-W02"}
    assert s.count("chunks") == 6 and s.fetch("episodes", "E3").first().app_name == "a"


def test_pruning_reaches_the_scan(spark, tmp_path):
    s = seeded(spark, tmp_path)
    df = s.in_range("chunks", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 31))
    assert df.count() == 4
    assert "PartitionFilters: [isnotnull(shard" in df._jdf.queryExecution().toString() or "shard" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:80]


def test_purge_drops_whole_weeks(spark, tmp_path):
    s = seeded(spark, tmp_path)
    assert s.purge_before(dt.datetime(2026, 1, 12)) == ["2026-W02"]
    assert s.shards() == ["2026-W10"] and s.count("chunks") == 2 and s.count("events") == 1
    assert s.purge_before(dt.datetime(2026, 3, 8, 23)) == []


def test_vectors_replace_by_chunk(spark, tmp_path):
    s = seeded(spark, tmp_path)
    make = lambda model, ids: spark.createDataFrame([(i, model, 2, 1.0, [1, 2], sh) for i, sh in ids], "chunk_id string, model_id string, dim int, scale float, embedding array<tinyint>, shard string")
    s.upsert_vectors(make("m1", [("E1-c0", "2026-W02"), ("E3-c0", "2026-W10")]))
    s.upsert_vectors(make("m2", [("E1-c0", "2026-W02"), ("E1-c1", "2026-W02")]))
    assert s.count("vectors", "m1") == 1 and s.count("vectors", "m2") == 2


def test_ledgers_append_in_order(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/l")
    assert s.ledger("egress_ledger").count() == 0
    for day in (3, 1, 2):
        s.append("egress_ledger", spark.createDataFrame([(dt.datetime(2026, 1, day), "p", 10 * day)], "ts timestamp, process string, byte_count long"))
    assert [r.byte_count for r in s.ledger("egress_ledger").collect()] == [10, 20, 30]
    assert s.ledger("egress_ledger", since=dt.datetime(2026, 1, 2), process="p").count() == 2


def test_json_lines_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 5, 23)), (2, dt.datetime(2026, 1, 6, 1))], "id long, ts timestamp")
    st.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(p.name for p in (tmp_path / "j").glob("day=*")) == ["day=2026-01-05", "day=2026-01-06"]


def test_latest_vector(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "chunk_id string, seq long")
    assert {(r.chunk_id, r.seq) for r in st.latest_vectors(df, "seq").collect()} == {("a", 3), ("b", 2)}
    assert st.reliable(df).where(F.col("seq") > 1).count() == 2


def one_episode(spark):
    t = dt.datetime(2026, 1, 6)
    episodes = spark.createDataFrame([("E1", t, t), ("E2", dt.datetime(2026, 3, 4), t)], "id string, ts_start timestamp, ts_end timestamp")
    events = spark.createDataFrame([("V1", "E1", t, "user_input"), ("V2", "E2", t, "odd")], "id string, episode_id string, ts timestamp, provenance string")
    chunks = spark.createDataFrame([("C1", "E1", "V1", "budget review moved", t, "ax"), ("C2", "E2", "V2", "lunch budget", t, "ocr"), ("C3", "E2", "gone", "budget without an event", t, "ax")], "id string, episode_id string, event_id string, text string, ts_capture timestamp, source string")
    return episodes, events, chunks


def sizes(s):
    return {t: s.count(t) for t in ("episodes", "events", "chunks", "postings", "maxima", "lengths")}


class Stopped(Exception):
    pass


def stopping(monkeypatch, after):
    """The store's driver is lost after so many moves."""
    moved, move = [], st.Store.move

    def some(self, *a):
        if len(moved) == after:
            raise Stopped
        moved.append(a)
        move(self, *a)

    monkeypatch.setattr(st.Store, "move", some)
    return moved


def test_a_crash_at_each_file_and_a_retry_give_each_row_once(spark, tmp_path, monkeypatch):
    rows = one_episode(spark)
    whole = st.Store(spark, f"file://{tmp_path}/whole")
    with monkeypatch.context() as m:
        moved = stopping(m, -1)
        whole.ingest(*rows, "n")
    want = sizes(whole)
    assert want["chunks"] == 3 and len(moved) >= 10
    for after in range(len(moved)):
        root = f"file://{tmp_path}/{after}"
        with monkeypatch.context() as m:
            stopping(m, after)
            try:
                st.Store(spark, root).ingest(*rows, "n")
                raise AssertionError("it wasn't stopped")
            except Stopped:
                pass
        if after % 2:  # a retry in the same way, or a new opening alone
            st.Store(spark, root).ingest(*rows, "n")
        assert sizes(st.Store(spark, root)) == want, after


def test_a_retry_by_the_same_store_object(spark, tmp_path, monkeypatch):
    s, rows = st.Store(spark, f"file://{tmp_path}/s"), one_episode(spark)
    with monkeypatch.context() as m:
        stopping(m, 3)
        try:
            s.ingest(*rows, "n")
        except Stopped:
            pass
    s.ingest(*rows, "n")
    s.ingest(*rows, "n")
    assert sizes(s)["events"] == 2 and sizes(s)["chunks"] == 3 and s.children(f"{s.root}/_pending") == []


def test_recover_drops_what_is_not_ready(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s")
    s.touch(f"{s.root}/_pending/half/events/shard=2026-W02/part-0.parquet")
    assert st.Store(spark, s.root).children(f"{s.root}/_pending") == ["half"]  # may be another writer's
    assert s.recover() == [] and s.children(f"{s.root}/_pending") == []


def test_opening_migrates_and_indexes(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s")
    assert s.version() == st.schemas.SCHEMA_VERSION and s.migrate() == []
    s.ingest(*one_episode(spark))
    want = sorted(map(tuple, s.read("postings").collect()))
    for old in ("postings", "maxima", "lengths", "_schema"):  # as a store of version 2 was left
        s.delete(s.path(old))
    s.touch(f"{s.root}/_schema/version=2")
    again = st.Store(spark, s.root)
    assert again.version() == st.schemas.SCHEMA_VERSION and sorted(map(tuple, again.read("postings").collect())) == want and again.count("lengths") == 3
    again.reindex()
    assert sorted(map(tuple, again.read("postings").collect())) == want
    s.touch(f"{s.root}/_schema/version=9")
    try:
        st.Store(spark, s.root)
        raise AssertionError("a newer store was opened")
    except ValueError:
        pass


def test_vectors_are_one_a_chunk_and_can_go(spark, tmp_path, monkeypatch):
    s = seeded(spark, tmp_path)
    make = lambda rows: spark.createDataFrame([(c, m, 2, 1.0, v, sh) for c, m, v, sh in rows], "chunk_id string, model_id string, dim int, scale float, embedding array<tinyint>, shard string")
    s.upsert_vectors(make([("E1-c0", "m1", [1, 2], "2026-W02"), ("E1-c0", "m1", [3, 4], "2026-W02"), ("E1-c1", "m1", [5, 6], "2026-W02"), ("E3-c0", "m1", [7, 8], "2026-W10")]))
    assert sorted((r.chunk_id, r.embedding) for r in s.read("vectors").collect()) == [("E1-c0", [3, 4]), ("E1-c1", [5, 6]), ("E3-c0", [7, 8])]
    new = make([("E1-c0", "m1", [9, 9], "2026-W02"), ("E3-c1", "m1", [1, 1], "2026-W10")])
    with monkeypatch.context() as m:
        stopping(m, 1)
        try:
            s.upsert_vectors(new, "again")
        except Stopped:
            pass
    s.upsert_vectors(new, "again")
    assert sorted((r.chunk_id, r.embedding) for r in s.read("vectors").collect()) == [("E1-c0", [9, 9]), ("E1-c1", [5, 6]), ("E3-c0", [7, 8]), ("E3-c1", [1, 1])]
    s.remove_vectors(spark.createDataFrame([("2026-W02", "E1-c0"), ("2026-W02", "none"), ("2026-W44", "x")], "shard string, chunk_id string"))
    assert sorted(r.chunk_id for r in s.read("vectors").collect()) == ["E1-c1", "E3-c0", "E3-c1"]


def test_compaction_keeps_the_rows(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s")
    for i in range(3):
        e, v, c = one_episode(spark)
        tag = lambda df, *cols: df.withColumns({x: F.concat(F.col(x), F.lit(f"-{i}")) for x in cols})  # noqa: B023, E731
        s.ingest(tag(e, "id"), tag(v, "id", "episode_id"), tag(c, "id", "episode_id", "event_id"))
    before = sorted(map(tuple, s.read("postings").collect()))
    assert s.compact("postings") == ["2026-W02", "2026-W10"] and s.compact("postings") == []
    assert sorted(map(tuple, s.read("postings").collect())) == before
    assert all(len(s.children(f"{s.path('postings')}/{x}")) == 1 for x in ("shard=2026-W02", "shard=2026-W10"))


def searchable(spark, root):
    """A store of three weeks with several sessions, applications and keys; one chunk's event is missing."""
    s, start = st.Store(spark, root), dt.datetime(2026, 1, 5)
    words = ["budget", "review", "deploy", "café", "kernel", "invoice", "the"]
    episodes = [(f"E{i:02d}", start + dt.timedelta(hours=30 * i), start + dt.timedelta(hours=30 * i + 1), f"app{i % 3}", f"com.app{i % 3}", [f"Key{i % 2}"]) for i in range(14)]
    events = [(f"V{i:02d}-{k}", e[0], e[1], ["user_input", "odd", None][k % 3]) for i, e in enumerate(episodes) for k in range(4) if (i, k) != (3, 1)]
    chunks = [(f"C{i:02d}-{k}", e[0], f"V{i:02d}-{k}", " ".join(words[(i * k + j * (k + 1)) % 7] for j in range(5 + k)), e[1] + dt.timedelta(minutes=k), ["ax", "x"][k % 2]) for i, e in enumerate(episodes) for k in range(4)]
    s.ingest(
        spark.createDataFrame(episodes, "id string, ts_start timestamp, ts_end timestamp, app_name string, bundle_id string, entity_keys array<string>"),
        spark.createDataFrame(events, "id string, episode_id string, ts timestamp, provenance string"),
        spark.createDataFrame(chunks, "id string, episode_id string, event_id string, text string, ts_capture timestamp, source string"),
    )
    return s


def asked():
    week = (dt.datetime(2026, 1, 12), dt.datetime(2026, 1, 18))
    return [
        retrieve.Query("budget review"), retrieve.Query("kernel", week), retrieve.Query("", week, limit=3), retrieve.Query("deploy invoice", app="com.app1"), retrieve.Query("café", entities=["KEY1", ""]),
        retrieve.Query("nothing like it"), retrieve.Query("the of"), retrieve.Query("budget", limit=0), retrieve.Query("invoice", app="nobody"), retrieve.Query("budget", (dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 2))),
    ]


def test_a_table_of_queries_gives_each_query_s_own_answer(spark, tmp_path):
    s, queries = searchable(spark, f"file://{tmp_path}/s"), asked()
    got = {}
    for r in s.search_table(retrieve.query_rows(spark, queries)).collect():
        got.setdefault(r.probe, []).append(tuple(r)[1:])
    for i, q in enumerate(queries):
        assert sorted(got.get(i, []), key=str) == sorted(map(tuple, s.search(q).collect()), key=str), q
    assert len(got[0]) == 8 and len(got[2]) == 3 and 7 not in got and 9 not in got
    assert all("C03-1" != r[0] for rows in got.values() for r in rows)  # its event is missing


def test_search_prunes_weeks_and_moves_no_text(spark, tmp_path):
    s = searchable(spark, f"file://{tmp_path}/s")
    plan = s.search(asked()[1])._jdf.queryExecution().executedPlan().toString()
    assert "[2026-W03]" in plan or "shard#" in plan
    reads = [x for x in plan.split("ReadSchema: ")[1:]]
    assert sum("text:string" in x.split(">")[0] for x in reads) == 1
    keyword = s.search(retrieve.Query("budget review"))
    assert {r.provenance for r in keyword.collect()} <= {"user_input", "untrusted_ambient"}


def test_search_with_a_vector_and_a_corrupt_one(spark, tmp_path):
    s = searchable(spark, f"file://{tmp_path}/s")
    of = {r.id: r.shard for r in s.read("chunks").select("id", "shard").collect()}
    rows = [("C00-0", 2, [100, 0]), ("C05-2", 2, [90, 10]), ("C07-1", 2, [1]), ("C08-1", 3, [100, 0]), ("C09-0", 2, [0, 100])]
    s.upsert_vectors(spark.createDataFrame([(c, "m", d, 0.01, v, of[c]) for c, d, v in rows], "chunk_id string, model_id string, dim int, scale float, embedding array<tinyint>, shard string"))
    found = [r.chunk_id for r in s.search(retrieve.Query("zzz"), query_vector=([100, 0], 0.01, "m")).orderBy("place").collect()]
    assert found == ["C00-0", "C05-2"]  # ragged and odd rows are skipped, the last is below the floor


def test_terms_meet_whatever_the_form(spark, tmp_path):
    import unicodedata

    s, t = st.Store(spark, f"file://{tmp_path}/s"), dt.datetime(2026, 1, 6)
    words = ["Café", "naïveté", "Ελλάδα", "Йогурт", "Ångström", "tiếng", "Ёлка"]
    texts = [(w, unicodedata.normalize(form, w)) for w in words for form in ("NFC", "NFD")]
    s.ingest(
        spark.createDataFrame([("E", t, t)], "id string, ts_start timestamp, ts_end timestamp"),
        spark.createDataFrame([(f"V{i}", "E", t, "system") for i in range(len(texts))], "id string, episode_id string, ts timestamp, provenance string"),
        spark.createDataFrame([(f"C{i:02d}", "E", f"V{i}", x, t, "ax") for i, (_, x) in enumerate(texts)], "id string, episode_id string, event_id string, text string, ts_capture timestamp, source string"),
    )
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")
    queries = [retrieve.Query(q) for w in words for q in (unicodedata.normalize("NFC", w.upper()), bare(w))]
    found = {}
    for r in s.search_table(retrieve.query_rows(spark, queries)).collect():
        found.setdefault(r.probe, set()).add(r.chunk_id)
    for i in range(len(queries)):
        assert found[i] == {f"C{2 * (i // 2):02d}", f"C{2 * (i // 2) + 1:02d}"}, queries[i]
    assert {r.chunk_id for r in s.search(queries[4]).collect()} == found[4]


def many_chunks(spark, root, parts=2):
    """Two weeks of 1,500 chunks each, 8 a block, in several transactions whose blocks meet; some are rich in a word, some have no time."""
    import random

    s, r = st.Store(spark, root), random.Random(7)
    words = [f"w{i}" for i in range(30)]
    starts = [dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 12)]
    spark_rows = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    for part in range(parts):
        episodes, events, chunks = [], [], []
        for w, start in enumerate(starts):
            e = f"E{w}-{part}"
            episodes.append((e, start, start, f"app{part}", "b", ["Key"]))
            for i in range(part, 1500, parts):
                t = start + dt.timedelta(seconds=900 * (i // 8) + i % 8)
                text = " ".join(r.choices(words, k=r.randint(5, 40)) + (["budget"] * (3 if i // 8 in (20, 21, 90) else 1) if i % 3 == 0 else []) + (["review"] if i % 5 == 0 else []))
                chunks.append((f"C{w}-{i:04d}", e, f"V{w}-{i}", text, None if i % 97 == 0 else t, "ax"))
                if i % 50:
                    events.append((f"V{w}-{i}", e, t, "system"))
        s.ingest(
            spark_rows(episodes, "id string, ts_start timestamp, ts_end timestamp, app_name string, bundle_id string, entity_keys array<string>"), spark_rows(events, "id string, episode_id string, ts timestamp, provenance string"),
            spark_rows(chunks, "id string, episode_id string, event_id string, text string, ts_capture timestamp, source string"),
        )
    return s


def read_rows(df):
    """Rows that the scan of a plan without shuffles handed on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_blocks_of_postings_are_skipped_and_the_answer_stays(spark, tmp_path):
    s = many_chunks(spark, f"file://{tmp_path}/s")
    week = (dt.datetime(2026, 1, 12), dt.datetime(2026, 1, 13, 5))
    queries = [
        retrieve.Query("budget"), retrieve.Query("budget review", limit=3), retrieve.Query("w3 budget review", week), retrieve.Query("budget", app="app1"), retrieve.Query("review w1 w2", entities=["key"], limit=30),
        retrieve.Query("budget", app="nobody"), retrieve.Query("absent"), retrieve.Query("budget absent"), retrieve.Query("w5", (week[0], week[0])),
    ]
    whole = {}
    for x in s.search_table(retrieve.query_rows(spark, queries)).collect():  # reads all postings of its terms
        whole.setdefault(x.probe, []).append(tuple(x)[1:])
    for i, q in enumerate(queries):
        assert sorted(map(tuple, s.search(q).collect())) == sorted(whole.get(i, [])), q
    names = s.shards()
    budget = s.read("postings").where("term = 'budget'")
    some, counts = s.keyword_postings(retrieve.Query("budget"), names, pool=10)
    assert {(x.shard, x.n) for x in counts.collect()} == {(x.shard, x["count"]) for x in budget.groupBy("shard").count().collect()}
    assert 0 < some.count() < budget.count() / 4
    assert s.keyword_postings(retrieve.Query("absent"), names)[0].count() == 0 and s.keyword_postings(retrieve.Query(""), names)[0].count() == 0
    # A filter that the first blocks don't satisfy leaves all blocks to be read.
    assert s.keyword_postings(retrieve.Query("budget", app="nobody"), names, pool=10)[0].count() == budget.count()


def test_skipped_blocks_are_not_decoded(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(st.schemas.WRITTEN, "postings", {"parquet.page.row.count.limit": "64"})  # a term has more pages than one, as it has at scale
    s = many_chunks(spark, f"file://{tmp_path}/s", 1)
    term = s.read("postings").where("term = 'w7'")
    last = term.agg(F.max("block")).first()[0]
    some = term.where(retrieve.in_slots(F.col("block"), [(last - 60, last - 58), (last - 9, last - 9)]))
    n, read, of_term, of_all = some.count(), read_rows(some), read_rows(term), read_rows(s.read("postings"))
    assert 0 < n <= read < of_term / 2 < of_all / 10


def test_maxima_bound_every_score(spark, tmp_path):
    s = many_chunks(spark, f"file://{tmp_path}/s")
    names = s.shards()
    terms = ["budget", "review", "w3"]
    m = s.read("maxima").where(F.col("term").isin(terms)).groupBy("shard", "term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    bounds = retrieve.block_bounds(m, m.groupBy("shard", "term").agg(F.sum("n").alias("n")), s.statistics(names))
    scores = retrieve.bm25(s.read("postings"), s.statistics(names), terms)
    of = s.read("postings").select("shard", "chunk_id", "block").distinct()
    both = scores.join(of, ["shard", "chunk_id"]).join(bounds, ["shard", "block"])
    assert both.where(-F.col("score") > F.col("bound")).count() == 0 and both.count() == scores.count()


def test_ranges_of_slots():
    assert retrieve.slot_ranges([]) == [] and retrieve.slot_ranges([5, 3, 4, 9, 3]) == [(3, 5), (9, 9)]
    assert retrieve.slot_ranges([1, 3, 10, 12, 30], most=2) == [(1, 12), (30, 30)]
    assert len(retrieve.slot_ranges(list(range(0, 1000, 2)), most=8)) == 8


def test_a_chunk_counts_its_own_terms(spark):
    rows = [("2026-W02", "C1", "Budget budget, review; the BUDGET"), ("2026-W02", "C2", ""), ("2026-W02", "C3", None), ("2026-W03", "C4", "x"), ("2026-W03", "C5", "!!")]
    got = {tuple(r) for r in retrieve.inverted_index(spark.createDataFrame(rows, "shard string, chunk_id string, text string")).select("shard", "chunk_id", "term", "tf", "len").collect()}
    assert got == {("2026-W02", "C1", "budget", 3, 5), ("2026-W02", "C1", "review", 1, 5), ("2026-W02", "C1", "the", 1, 5), ("2026-W03", "C4", "x", 1, 1)}
