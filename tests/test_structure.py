"""Stitched sessions, admission by pointers, and text of element trees."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import markup, serve, sessions


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
def test_stitched_sessions_are_those_of_one_fold(spark, slices):
    r, t, rows = random.Random(slices), dt.datetime(2026, 1, 5), []
    for i in range(600):
        t += dt.timedelta(seconds=r.choice([0, 0, 1, 60, 299, 300, 301, 5000]))
        rows.append((i, t))
    rows += [(1000 + i, rows[300][1]) for i in range(300)]  # a third of all in one instant
    rows.append((None, None))
    want, last = [], None
    for at in sorted(x for _, x in rows if x is not None):
        if last is None or (at - last).total_seconds() >= 300:
            want.append([len(want) + 1, at, at, 0])
        want[-1][2], want[-1][3], last = at, want[-1][3] + 1, at
    got = sessions.stitched_sessions(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz"), 300, slices=slices)
    assert sorted(map(list, got.collect())) == want
    assert sessions.stitched_sessions(spark.createDataFrame([], "event_id long, ts timestamp_ntz"), 300, slices=slices).count() == 0


def fold(rows, gap):
    out = []
    for k in {r[0] for r in rows}:
        last = None
        for row in sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (round(r[1] * 1e6), r[2])):
            at = round(row[1] * 1e6)
            if last is None or at - last >= round(gap * 1e6):
                out.append(row)
                last = at
    return sorted(out, key=str)


@pytest.mark.parametrize("gap", [0.5, 3.0, 15.0, 1000.0])
def test_admission_by_pointers_is_the_fold(spark, gap):
    r, rows = random.Random(3), []
    for k, n in (("hot", 900), ("a", 60), (None, 40), ("one", 1)):
        t = -20.0
        for i in range(n):
            t += r.choice([0.0, 0.0, 0.25, 0.25, 0.5, 1.0, 2.75, 15.0, 29.0, 200.0])
            rows.append((k, t, i))
    rows.append(("a", None, 99))
    df = spark.createDataFrame(rows, "client string, at double, seq int").repartition(5)
    got = serve.admitted_gap(df, "client", "at", gap)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == fold(rows, gap)
    assert serve.admitted_gap(df, "client", "at", 0).count() == len(rows) - 1
    assert serve.admitted_gap(df.limit(0), "client", "at", gap).count() == 0


PAGES = [
    (1, "<html><head><title>no</title></head><body><h1>Title &amp; more</h1><p>one<br>two</p><p title=\"tip\">three</body></html>"),
    (2, "</p></p><div>a<b>bold<i>both</b>rest</i></div><div>after</div></div>tail"),
    (3, "<div hidden>secret <p>deep</p></div><div>seen<input type=\"password\" title=\"pw\"><img alt=\"a picture\"/></div>"),
    (4, "<script>var a = '<p>x</p>';</script><style>p{}</style><!-- <p>no</p> --><p>x < y &lt; z</p><p>&amp;lt;"),
    (5, ""), (6, None), (7, "plain"), (8, "<div>" * 60 + "deep" + "</div>" * 60 + "end"), (9, "<p>x</p>" * 3000), (10, "<P>Up</P><svg><text>no</text></svg><template><div>no</div>no</template>yes<!-- open"),
    (11, "<div><div>inner</div><div hidden><div>a</div>b</div>outer</div><DIV>x</div >"),
]


def test_tree_text(spark):
    df = spark.createDataFrame(PAGES, "page_id long, html string")
    got = {r.id: r for r in markup.tree_text(df).collect()}
    assert got[1].text == "Title & more\none\ntwo\ntip\nthree"
    assert got[2].text == "a\nbold\nboth\nrest\nafter\ntail"
    assert got[3].text == "seen\na picture"
    assert got[4].text == "x\n<\ny < z\n&lt;"
    assert [got[i].text for i in (5, 6, 7)] == ["", "", "plain"] and got[5].n_nodes == 0
    assert got[8].text == "end" and got[8].n_nodes == 42
    assert got[9].n_nodes == 2500 and got[9].text.count("x") == 1250
    assert got[10].text == "Up\nyes" and got[11].text == "inner\nouter\nx"
    short = {r.id: r.text for r in markup.tree_text(df, chars=9).collect()}
    assert short[1] == "Title & m" and short[2] == "a\nbold\nbo" and markup.tree_text(df.limit(0)).count() == 0


def test_tree_text_is_its_sql(spark):
    df = spark.createDataFrame(PAGES, "page_id long, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", PAGES)
    for how in ({}, {"chars": 9}, {"most": 3, "depth": 1}):
        assert sorted(map(tuple, markup.tree_text(df, **how).collect())) == sorted(con.execute(markup.tree_sql(**how)).fetchall())


def test_depth_and_pruning_follow_the_intervals(spark):
    df = spark.createDataFrame([(1, "<a><b>x</b><b hidden>y<c>z</c></b></a>w")], "page_id long, html string")
    got = [(r.kind, r.name or r.text, r.depth, r.pruned) for r in markup.nodes(df).orderBy("pos").collect()]
    assert got == [("open", "a", 0, False), ("open", "b", 1, False), ("leaf", "x", 2, False), ("open", "b", 1, True), ("leaf", "y", 2, True), ("open", "c", 2, True), ("leaf", "z", 3, True), ("leaf", "w", 0, False)]
    assert df.select(F.lit(1)).count() == 1


def test_inverted_lists(spark, tmp_path):
    import numpy as np

    from tidemark.operators.vector_lists import VectorLists, recall

    g = np.random.default_rng(5)
    middle = g.normal(size=(12, 16))
    x = np.clip(np.round((middle[g.integers(12, size=700)] + 0.3 * g.normal(size=(700, 16))) * 30), -127, 127).astype(int)
    x[300:520] = x[7]  # copies: a hot list, and ties
    rows = [(f"c{i:04d}", 16, 0.01 + (i % 3) * 0.001, x[i].tolist()) for i in range(700)]
    odd = [("short", 16, 0.01, [1, 2]), ("none", 16, 0.01, None), ("hole", 16, 0.01, [None] * 16), (None, 16, 0.01, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "chunk_id string, dim int, scale double, embedding array<tinyint>").repartition(3)
    index = VectorLists.built(df, f"file://{tmp_path}/lists", 16)
    probes = df.where("chunk_id < 'c0700' AND cast(substr(chunk_id, 2) AS int) % 50 = 0").withColumnRenamed("chunk_id", "probe")

    def brute(held, k, floor=None):
        out = []
        for i in range(0, 700, 50):
            s = [(-(float(x[i] @ x[j]) * rows[j][2] * rows[i][2]), rows[j][0]) for j in held if j != i]
            out += [(rows[i][0], c, p + 1) for p, (v, c) in enumerate(sorted(t for t in s if floor is None or -t[0] >= floor)[:k])]
        return sorted(out)

    get = lambda found: sorted((r.probe, r.id, r.place) for r in found.collect())
    exact = index.search(probes, 10, but_self=True)
    assert get(exact) == brute(range(700), 10)
    assert get(index.search(probes, 5, floor=1.0, but_self=True)) == brute(range(700), 5, 1.0)
    assert recall(index.search(probes, 10, visits=12, but_self=True), exact).first().recall > 0.9
    assert index.search(probes, 3).where("place = 1 AND similarity > 0").count() == 14
    gone = [*range(300, 520), 1, 2]
    index.remove(spark.createDataFrame([(f"c{i:04d}",) for i in gone] + [("nobody",)], "chunk_id string"))
    assert get(index.search(probes, 10, but_self=True)) == brute([i for i in range(700) if i not in set(gone)], 10)
    index.remove(df.select("chunk_id"))
    assert index.search(probes, 10).count() == 0
