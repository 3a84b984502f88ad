"""op2's filters: what passes them by chance changes nothing, and texts that lose nothing stay where they are read."""

import random

import numpy as np
import pytest

from tests.llm import corpus
from tests.llm.test_repeats import brute_words
from tidemark.llm import repeats, sketch, substring


def shuffled(spark) -> int:
    """Bytes that all stages so far wrote to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_lose_nothing_are_not_shuffled(spark):
    """Both joins used to move every whole text: 2.4 GB of disk over 0.51 GB of documents."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", k=16))
    shared = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(600)) for _ in range(200)]
    # Passages that differ where they end give buckets of several segments, which must be compared by their words.
    texts += [f"{word()} {shared} {word()}" for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    before = shuffled(spark)
    got = substring.removal_report(docs).collect()
    moved = shuffled(spark) - before
    assert {x.doc_id: x.n_removed for x in got} == {i: 40 if i > 200 else 0 for i in range(203)}
    assert 0 < moved < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize("most", [2, repeats.MOST])
@pytest.mark.parametrize("chance", [False, True])
def test_what_passes_by_chance_changes_nothing(spark, monkeypatch, most, chance):
    """chance: filters so full that they let all through. most: buckets of over two segments go by window digest."""
    if chance:
        for module in (repeats, substring):
            monkeypatch.setattr(module, "membership", lambda df, n: lambda *columns: np.ones(len(columns[0]), bool))
    want = brute_words(corpus.rows())
    got = substring.removal_report(corpus.frame(spark), most=most).collect()
    assert len(got) == len(corpus.rows())
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_members_pass_and_few_others(spark):
    rows = [(i * 7919 - 5000, -i) for i in range(3000)]
    test = sketch.membership(spark.createDataFrame(rows, "a long, b long").repartition(3), len(rows))
    a, b = np.array(rows, np.int64).T
    assert test(a, b).all()
    assert test(b, a - 1).mean() < 0.03
    assert not sketch.membership(spark.createDataFrame([], "a long, b long"), 0)(a, b).any()
