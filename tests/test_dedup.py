"""Near-duplicate state that outlives a batch, and flat signatures against text-by-text ones."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import neardup
from tidemark.sources.store import Store
from tidemark.streaming import engine


def plain_signature(text):
    """Text by text, shingle by shingle, as the definition says."""
    w = text.split()
    grams = w if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = []
    for g in grams:
        h = 2166136261
        for byte in g.encode():
            h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
        hashes.append(h)
    return [min(((a * x + b) % neardup.PRIME for x in hashes), default=neardup.EMPTY) for a, b in neardup.coefficients()]


def test_flat_signatures():
    r = random.Random(5)
    words = ["a", "bb", "ccc", "é", "日本", "long" * 9, "x"]
    texts = ["", " ", "one", "one two", "a b c", "\n a \t b c  d ", "same same same same same"] + [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(120)]
    want = [plain_signature(t) for t in texts]
    for most in (3, 1 << 15):
        assert neardup.signatures_of(texts, most=most).tolist() == want
    assert neardup.signatures_of([]).shape == (0, 128)
    assert neardup.fnv32([b"", b"a", b"foobar"]).tolist() == [2166136261, 0xE40C292C, 0xBF9CF968]
    assert np.array_equal(neardup.signatures_of(["x y z"] * 3)[0], neardup.signature_of("x y z"))


def texts(seed=3, n=60):
    """Prose, exact copies, near copies, and near copies of near copies."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.random()
        if not out or kind < 0.4:
            out.append(" ".join(f"w{r.randint(0, 400)}" for _ in range(60)))
        elif kind < 0.6:
            out.append(r.choice(out) + r.choice(["", " ", "\n"]))
        else:
            w = r.choice(out).split()
            w[r.randrange(len(w))] = f"n{i}"
            out.append(" ".join(w))
    return [*out, None, "", "short one", "short one"]


def keyed(rows):
    start = dt.datetime(2026, 1, 5)
    return [(f"c{i:03d}|x", start + dt.timedelta(seconds=i // 2), t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("cuts", [(20, 41), (1, 2, 30, 31, 60)])
def test_batches_give_the_rows_of_one(spark, tmp_path, cuts):
    rows, schema = keyed(texts()), "id string, at timestamp, text string"
    one = neardup.DupIndex(spark, f"file://{tmp_path}/one").judge(spark.createDataFrame(rows, schema), 0)
    want = sorted(map(tuple, one.collect()))
    assert {v[1] for v in want} == {"retained", "exact", "near"}
    many, got = neardup.DupIndex(spark, f"file://{tmp_path}/many"), []
    edges = [0, *cuts, len(rows)]
    edges = [e if e in (0, len(rows)) else e - e % 2 for e in edges]  # rows of one instant stay together
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = spark.createDataFrame(rows[a:b], schema)
        if n == 1:  # a batch that is judged, lost and judged again
            many.judge(part, n)
        got += list(map(tuple, many.judge(part, n).collect()))
        if n == 2:
            many.compact(2)
    assert sorted(got) == want
    # what one table's collapse says of them is the same
    plain = neardup.collapse(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "seq long, text string")).collect()
    assert [(rows[r.seq][0], r.verdict, rows[r.kept_as][0]) for r in sorted(plain, key=lambda r: r.seq)] == [v[:3] for v in want]


def test_scopes_are_apart(spark, tmp_path):
    index, body, start = neardup.DupIndex(spark, f"file://{tmp_path}/s"), " ".join(map(str, range(50))), dt.datetime(2026, 1, 5)
    make = lambda rows: spark.createDataFrame([(i, s, start, t) for i, s, t in rows], "id string, scope string, at timestamp, text string")
    assert {r.verdict for r in index.judge(make([("a", "u", body), ("b", "v", body), ("c", "v", body + " x")]), 0).where("id <> 'c'").collect()} == {"retained"}
    got = {r.id: (r.verdict, r.kept_as) for r in index.judge(make([("d", "u", body), ("e", "w", body), ("f", "u", body + " y")]), 1).collect()}
    assert got == {"d": ("exact", "a"), "e": ("retained", "e"), "f": ("near", "a")}


def captured(spark, rows):
    return spark.createDataFrame(rows, engine.OUT_SQL)


def test_the_sink_stores_a_repeated_chunk_once_over_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    sink = engine.CatalogSink(store, f"file://{tmp_path}/staging", merge_every=2)
    body = " ".join(f"word{i}" for i in range(60))

    def episode(n, t, text):
        row = lambda seq, kind, x: ("u", 10 * n + seq, t + seq, kind, n, "b", "a", "t", x, None if x is None else "h", 0, 1, 0)
        return [row(0, "open", None), row(1, "screen", text), row(2, "close", None)]

    batches = [episode(1, 1e9, body), episode(2, 1e9 + 100, body), episode(3, 1e9 + 200, body.replace("word7 ", "other ")), episode(4, 1e9 + 300, "something else entirely")]
    for i, rows in enumerate(batches):
        sink(captured(spark, rows), i)
    sink(captured(spark, batches[-1]), 3)  # a retried batch
    assert store.count("events") == 4 and sorted(r.episode_id for r in store.read("chunks").collect()) == ["u-1", "u-4"]


def greedy(signatures, threshold=neardup.THRESHOLD, rows=neardup.PERMUTATIONS // neardup.BANDS):
    """Row by row: the links of retained rows to those that collapse, by every pair that shares a band."""
    kept, links = [], []
    share = lambda a, b: any(a[i : i + rows] == b[i : i + rows] for i in range(0, len(a), rows))
    for i, s in enumerate(signatures):
        near = [(k, i, sum(x == y for x, y in zip(signatures[k], s, strict=True)) / len(s)) for k in kept if share(signatures[k], s)]
        near = [x for x in near if x[2] >= threshold]
        links += near
        if not near:
            kept.append(i)
    return kept, sorted(links)


def test_a_large_bucket_takes_few_jobs_and_gives_the_links_of_row_by_row(spark, monkeypatch):
    """Rows that share a band but aren't alike once cost a round each, and a pair of signatures for each two of them."""
    r = random.Random(8)
    head, rows = [r.randrange(1 << 32) for _ in range(8)], []
    for i in range(90):
        base = head + [r.randrange(1 << 32) for _ in range(120)] if i % 3 == 0 else list(rows[-1])
        for _ in range(i % 3 * 6):
            base[8 + r.randrange(120)] = r.randrange(1 << 32)
        rows.append(base)
    jobs, cut = [], neardup._cut
    monkeypatch.setattr(neardup, "_cut", lambda df: jobs.append(1) or cut(df))
    want = greedy(rows)
    assert 30 <= len(want[0]) < 60 and len(want[1]) > 20
    given = spark.createDataFrame(list(enumerate(rows)), "seq long, signature array<bigint>")
    retained, links = neardup.retained_first(given)
    assert (sorted(x.seq for x in retained.collect()), sorted(map(tuple, links.collect()))) == want
    assert len(jobs) < 20
    # blocks smaller than the bucket change nothing
    every = given.selectExpr("seq", "0L AS key")
    whole = sorted(map(tuple, neardup.bucket_links(every, every, given, 0.85).collect()))
    assert sorted(map(tuple, neardup.bucket_links(every, every, given, 0.85, block=7).collect())) == whole and len(whole) >= len(want[1])
