"""The pipeline's stages against brute force on a small corpus."""

import corpus_pipeline as P
from tests.llm import corpus
from tests.llm.test_operators import classes
from tidemark.llm import mixing, rules, semantic, suffix
from tidemark.llm.common import scratch


def tables(spark):
    item = corpus.prose(7007, 30)
    rows = [r for r in corpus.rows() if r[0] is not None] + [(700, f"{corpus.prose(701, 80)} {item} {corpus.prose(702, 40)}", "en", "src1", 0)]
    root = scratch(spark, "pipeline-test")
    corpus.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def test_run_is_its_stages_and_each_decides(spark):
    root, rows = tables(spark)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns

    one = P.by_rules(spark, docs, root)
    assert one.columns == columns
    kept = {r.doc_id for r in rules.judged(docs).where("kept").collect()}
    one_rows = [tuple(r) for r in one.collect()]
    assert {r[0] for r in one_rows} == kept and 95 not in kept

    two = P.one_of_each(spark, one, root)
    want = classes(one_rows)
    two_rows = [tuple(r) for r in two.collect()]
    assert two.columns == columns and sorted(r[0] for r in two_rows) == sorted({*want.values()})

    three = P.without_repeats(spark, two, root)
    three_rows = [tuple(r) for r in three.collect()]
    assert three.columns == columns and all(r[4] == len(r[1]) for r in three_rows)
    shared = corpus.prose(999, 120)
    assert sum(shared in r[1] for r in two_rows) == 10 and sum(shared in r[1] for r in three_rows) == 1
    clean = {r[0] for r in two_rows if not 80 <= r[0] < 90 and r[0] not in (96,)}
    assert all(r[1] == dict((x[0], x[1]) for x in two_rows)[r[0]] for r in three_rows if r[0] in clean)

    four = P.without_benchmark(spark, three, root)
    assert four.columns == columns and {r[0] for r in three_rows} - {r.doc_id for r in four.collect()} == {700}

    got = {r.doc_id: r.taken for r in P.run(spark, root).collect()}
    assert got == {r.doc_id: r.taken for r in mixing.mix(four).collect()} and any(got.values())


def test_stage_list():
    assert [f.__module__ for _, f in P.STAGES] == ["corpus_pipeline"] * 5
    assert suffix.LENGTH == 400 and semantic.VERBATIM <= 0.8


def test_empty_table(spark):
    root = scratch(spark, "pipeline-empty")
    corpus.empty(spark).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert P.run(spark, root).count() == 0


def test_odd_rows_pass_each_stage(spark):
    """Null ids, null, empty and wordless texts, repeated rows: as the stages' docstrings say."""
    a, b, item = corpus.prose(1, 120), corpus.prose(2, 120), corpus.prose(7007, 30)
    leak = f"{corpus.prose(3, 60)} {item} {corpus.prose(4, 60)}"
    rows = [(None, a, "en", "s", 1), (5, a, "en", "s", 1), (5, a, "en", "s", 1), (None, b, "en", None, 1), (6, None, "en", "s", 0), (7, "", "en", "s", 0), (8, " \n", "en", "s", 2), (9, leak, "en", "s", 1), (9, corpus.prose(5, 90), "en", "s", 1), (None, leak + " more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, corpus.SQL).repartition(2)
    root = scratch(spark, "pipeline-odd")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    texts = lambda df: sorted(r.text or "" for r in df.collect())
    one = P.by_rules(spark, docs, root)
    assert texts(one) == sorted(t for _, t, *_ in rows if t and t.strip())
    two = [(r.doc_id, r.text) for r in P.one_of_each(spark, docs, root).collect()]
    assert two.count((None, a)) == two.count((5, a)) == 1 and (None, b) in two and (9, corpus.prose(5, 90)) in two
    four = texts(P.without_benchmark(spark, docs, root))
    assert four == sorted(t or "" for _, t, *_ in rows if item not in (t or ""))
    five = {(r.doc_id, r.source, r.size): r.taken for r in P.mixed(spark, docs, root).collect()}
    assert five[(6, "s", 0)] == five[(7, "s", 0)] == five[(8, "s", 0)] == 0 and five[(None, None, 120)] > 0
