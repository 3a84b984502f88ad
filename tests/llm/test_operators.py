"""op3 to op10: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm import corpus
from tidemark.llm import bagminhash, bytewords, chat, classifier, licenses, mixing, registry, rules, semantic, tokencount
from tidemark.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def joined(texts):
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])


def duck(sql, **tables):
    import pandas as pd

    c = duckdb.connect()
    for name, rows in tables.items():
        c.register(f"{name}_rows", pd.DataFrame(rows[0], columns=rows[1]))
        c.execute(f"CREATE VIEW {name} AS SELECT {rows[2]} FROM {name}_rows")
    return c.execute(sql).fetchall(), [d[0] for d in c.description]


def documents_for_duck():
    return corpus.rows(), ["doc_id", "text", "lang", "source", "n_chars"], "CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source, n_chars"


def same(got, want, columns):
    key = lambda r: tuple("~" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r)
    assert sorted(key([r[c] for c in columns]) for r in got) == sorted(key(r) for r in want)


# words


def test_words_are_the_contract_s():
    texts = ["a  b\tc", "", "x", " \n ", "é ü\x0bz", "tail "]
    data, ends = joined(texts)
    first, last, doc, h, _ = bytewords.words(data, ends)
    got = [[] for _ in texts]
    for f, t, d in zip(first, last, doc, strict=True):
        got[d].append(data[f:t].tobytes().decode())
    assert got == [WORD.findall(t) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in WORD.findall(t)})


# op3


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_is_brute_force():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(0, 80)).tolist(), r.integers(0, 6, r.integers(0, 90)).tolist()
        assert semantic.common_subsequence(a, b) == lcs(a, b)


def test_decontamination_finds_copies_and_paraphrases_and_leaves_the_rest(spark):
    items = [(i, corpus.prose(7000 + i, 20 + 3 * i)) for i in range(10)] + [(10, None), (11, "")]
    some = [r for r in corpus.rows() if r[0] is not None]
    some += [(200 + i, f"{corpus.prose(800 + i, 70)} {items[i][1]} {corpus.prose(900 + i, 50)}", "en", "s", 0) for i in range(10)]
    for i in range(10):  # every eighth word replaced
        w = items[i][1].split()
        w[3::8] = ["instead"] * len(w[3::8])
        some.append((300 + i, f"{corpus.prose(820 + i, 70)} {' '.join(w)} {corpus.prose(920 + i, 50)}", "en", "s", 0))
    some.append((400, " ".join(items[5][1].split()[:8]) + " " + corpus.prose(77, 100), "en", "s", 0))  # eight words aren't a leak
    docs, benchmark = corpus.frame(spark, some), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in semantic.matches(docs, benchmark).collect()}
    assert got == {(200 + i, i) for i in range(10)} | {(300 + i, i) for i in range(10)}
    kept = semantic.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r[0] for r in some} - {d for d, _ in got}


def test_decontamination_recall_against_brute_force(spark):
    """Each item's stretch of the right share is found at nine in ten; the brute force tries every stretch."""
    items = [(i, corpus.prose(5000 + i, 24)) for i in range(20)]
    some = [(i, f"{corpus.prose(100 + i, 37 + i)} {items[i % 20][1]} {corpus.prose(300 + i, 90)}", "en", "s", 0) for i in range(60)]
    truth = set()
    for d, t, *_ in some:
        _, h = semantic.tokens(*joined([t]))
        for i, text in items:
            _, own = semantic.tokens(*joined([text]))
            if any(lcs(own.tolist(), h[s : s + 36].tolist()) >= semantic.VERBATIM * len(own) for s in range(0, len(h), 6)):
                truth.add((d, i))
    got = {(r.doc_id, r.item_id) for r in semantic.matches(corpus.frame(spark, some), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(truth) >= 60 and len(got & truth) >= 0.9 * len(truth) and not got - truth


def test_decontamination_of_rewordings_against_brute_force(spark):
    """40 to 45 in 100 tokens replaced, the answer whole: all that decided() takes, at any place, is found."""
    items, some, truth = [(i, corpus.prose(5200 + i, 30)) for i in range(20)], [], set()
    for i in range(80):
        w, r = items[i % 20][1].split(), np.random.default_rng(i)
        other = corpus.prose(1500 + i, 30).split()
        for at in r.choice(len(w) * 2 // 3, int(len(w) * (0.4 + 0.05 * (i % 2))), replace=False):
            w[at] = other[at]
        some.append((i, f"{corpus.prose(1100 + i, 37 + i)} {' '.join(w)} {corpus.prose(1300 + i, 90)}", "en", "s", 0))
    for d, t, *_ in some:
        _, h = semantic.tokens(*joined([t]))
        for i, text in items:
            _, own = semantic.tokens(*joined([text]))
            if any(semantic.decided(own, h[s : s + 2 * len(own)].tolist()) for s in range(0, len(h), 4)):
                truth.add((d, i))
    got = {(r.doc_id, r.item_id) for r in semantic.matches(corpus.frame(spark, some), spark.createDataFrame(items, "item_id long, text string"), least_cosine=2.0).collect()}
    assert len(truth) >= 60 and len(got & truth) == len(truth)  # without any help of the latent search


def test_decontamination_of_very_long_and_very_short_items(spark):
    items = [(0, corpus.prose(5300, 3000)), (1, "quorvex blintar zumphle drackow")]
    some = [(0, f"{corpus.prose(1, 90)} {items[0][1]} {corpus.prose(2, 61)}", "en", "s", 0)]
    some += [(i, f"{corpus.prose(10 + i, 20 + i)} {items[1][1]} {corpus.prose(30 + i, 40)}", "en", "s", 0) for i in range(1, 9)]
    some.append((9, " ".join(items[0][1].split()[:1200]), "en", "s", 0))
    got = {(r.doc_id, r.item_id): r.common for r in semantic.matches(corpus.frame(spark, some), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0): 1.0} | {(i, 1): 1.0 for i in range(1, 9)}


def test_decontamination_judges_each_text(spark):
    """Only the texts that hold the item go, whatever rows share their doc_id, null ones too."""
    item = corpus.prose(7007, 30)
    leak, clean = f"{corpus.prose(61, 60)} {item} {corpus.prose(62, 60)}", corpus.prose(63, 100)
    docs = corpus.frame(spark, [(d, t, "en", "s", 0) for d, t in [(5, leak), (5, clean), (None, leak), (None, clean), (6, None), (7, "")]])
    kept = semantic.decontaminated(docs, spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, clean), (0, clean), (6, ""), (7, "")])


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert semantic.matches(corpus.empty(spark), none).count() == 0
    assert semantic.matches(corpus.frame(spark), none).count() == 0
    assert semantic.decontaminated(corpus.frame(spark), none).count() == len(corpus.rows())


# op4


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def classes(rows):
    bags = {}
    for d, t, *_ in rows:
        if d is not None:
            bags.setdefault(d, bag(t))
    top = {d: d for d in bags}
    find = lambda d: d if top[d] == d else find(top[d])
    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if similarity(bags[a], bags[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d in ids}


def test_near_duplicate_classes_are_brute_force(spark):
    want = classes(corpus.rows())
    got = bagminhash.near_duplicates(corpus.frame(spark)).collect()
    assert len(got) == len(corpus.rows())
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_one_document_of_each_class_stays(spark):
    docs = corpus.frame(spark)
    kept = bagminhash.representatives(docs)
    assert kept.columns == docs.columns
    want = classes(corpus.rows())
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted({*want.values()})
    assert bagminhash.representatives(corpus.empty(spark)).count() == 0


def test_hub_is_found_among_its_copies(spark):
    """Copies of one original differ from each other by more than the threshold: only the original links them."""
    base = corpus.prose(4242, 400).split()
    some = [(500, " ".join(base), "en", "s", 0)]
    for i in range(40):
        w = list(base)
        for k in range(3):  # ten words and so up to fifteen shingles at three places
            at = 10 + (i * 37 + k * 131) % 380
            w[at] = f"new{i}x{k}"
        some.append((i, " ".join(w), "en", "s", 0))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(corpus.frame(spark, some)).collect()}
    assert got == classes(some)


def versions(seed: int, n: int, replaced: int, of=lambda i: i):
    """Copies of one text, each with other words at some places."""
    base, some = corpus.prose(seed, 400).split(), []
    for i in range(n):
        w = list(base)
        for at in np.random.default_rng(of(i)).choice(400, replaced, replace=False):
            w[at] = f"new{i}x{at}"
        some.append((i, " ".join(w), "en", "s", 0))
    return some


@pytest.mark.parametrize("rows,items", [(bagminhash.BLOCK_ROWS, bagminhash.BLOCK_ITEMS), (50, 1 << 13)])
def test_versions_without_their_original_are_brute_force(spark, monkeypatch, rows, items):
    """Versions come in twos with other words at the same places: the two link, and no version is like many others.

    Small blocks make each two blocks of a bucket meet in a task of their own.
    """
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(bagminhash, "BLOCK_ITEMS", items)
    some = versions(4300, 800, 7, lambda i: i // 2)
    bags = [bag(t) for _, t, *_ in some[:80]]
    assert all((similarity(a, b) >= 0.8) == (i // 2 == j // 2) for i, a in enumerate(bags) for j, b in enumerate(bags))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(corpus.frame(spark, some)).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 800, 2)) == 400 and len({*got.values()}) >= 390


def test_template_pages_are_brute_force(spark):
    """Six words of a template replaced: similarities lie on both sides of the threshold."""
    some = versions(4400, 500, 6)
    want = classes(some)
    assert 100 < len({*want.values()}) < 400
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(corpus.frame(spark, some)).collect()} == want


def test_texts_that_share_a_doc_id(spark):
    """(5, x) and (5, y) are unlike each other; (7, y') is near y and (5, x) stands twice."""
    x, y = corpus.prose(51, 200), corpus.prose(52, 200)
    some = [(5, x), (5, x), (5, y), (7, y + " more"), (8, ""), (8, ""), (None, x), (None, x)]
    df = corpus.frame(spark, [(d, t, "en", "s", 0) for d, t in some])
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in bagminhash.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 0), (5, 5), (5, 5), (5, 5), (7, 5), (8, 8), (8, 8)]
    kept = sorted((r.doc_id or 0, r.text) for r in bagminhash.representatives(df).collect())
    assert kept == sorted([(0, x), (0, x), (5, x), (5, y), (8, "")])


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(5)
    gaps = []
    for trial in range(12):
        a = [f"w{trial}x{i % 25}" for i in r.integers(0, 60, 300)]
        b = list(a)
        for k in r.integers(0, 300, r.integers(1, 60)):
            b[k] = f"z{k}"
        doc, g, w = bagminhash.bag(*joined([" ".join(a), " ".join(b)]), 1)
        s = bagminhash.signatures(doc, g, w, 2, 4096)
        gaps.append((s[0] == s[1]).mean() - similarity(Counter(a), Counter(b)))
    assert abs(np.mean(gaps)) < 0.008 and np.abs(gaps).max() < 0.04


# op5


def test_classifier_learns_and_scores_all(spark):
    junk = lambda i: " ".join(f"{w.upper()}!!" for w in corpus.prose(i, 60).split())
    some = [(i, junk(i) if i % 4 == 0 else corpus.prose(i, 80), "en", "s", 0) for i in range(600)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (1, corpus.prose(1, 80), "en", "s", 0)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(600)] + [(2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality(corpus.frame(spark, some), labels).collect()
    assert len(got) == len(some) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    import zlib

    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 60 and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.95


def test_classifier_is_a_plain_one(spark):
    """Training and scores against the update rule written out coordinate by coordinate."""
    some = [(i, corpus.prose(i, 40) + " !!" * (i % 3), "en", "s", 0) for i in range(60)] + [(61, "", "en", "s", 0), (62, None, "en", "s", 0)]
    docs = corpus.frame(spark, some)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    f = classifier.Ftrl(classifier.BITS)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= f.l1 else (np.copysign(f.l1, z[i]) - z[i]) / ((f.beta + np.sqrt(n[i])) / f.alpha + f.l2)

    def vector(text):
        _, index, value = classifier.features(*joined([text or ""]), classifier.BITS)
        return [*zip(index.tolist(), (20 * value).tolist(), strict=True), (1 << classifier.BITS, 1.0)]

    def score(x):
        return 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x)))

    rows = sorted(classifier.labelled(docs.select("doc_id", "text"), labels).collect(), key=lambda r: r["rank"])
    order = np.random.default_rng(7)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            x = vector(rows[k].text)
            gap = score(x) - rows[k].label
            for i, v, w in [(i, v, weight(i)) for i, v in x]:
                z[i] += gap * v - (np.sqrt(n[i] + (gap * v) ** 2) - np.sqrt(n[i])) / f.alpha * w
                n[i] += (gap * v) ** 2
    got = {r.doc_id: r.score for r in classifier.quality(docs, labels).collect()}
    assert set(got) == {d for d, *_ in some}
    assert all(abs(got[d] - score(vector(t))) < 1e-3 for d, t, *_ in some)


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.quality(corpus.frame(spark), labels).collect()} == {0.5}
    assert classifier.quality(corpus.empty(spark), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs = corpus.frame(spark, [(i, corpus.prose(i, 50), "en", "s", 0) for i in range(100)])
    import zlib

    one = [(i, i % 2, 0) for i in range(100)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in one]
    scores = [sorted((r.doc_id, r.score) for r in classifier.quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (one, other)]
    assert scores[0] == scores[1]


# op6

TALK = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "a <turn> b </turn> c <text>\\<turn>"), (1, 2, None, None), (1, 2, "user", "tie"), (2, 0, "assistant", ""), (2, 1, "assistant", "é\U0001f600 \\\\ end\\"),
    (None, 0, "user", "no id"), (3, 0, "we<turn>ird", "x"), (1, 1, "assistant", "a <turn> b </turn> c <text>\\<turn>"), (4, 0, "assistant", "<|endoftext|>"),
]


def test_escape_round_trip():
    r = np.random.default_rng(9)
    parts = ["\\", "<", "<turn>", "</turn>", "<text>", "a", "\n", "é", "<tur", "\\<"]
    for _ in range(500):
        t = "".join(r.choice(parts, r.integers(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not re.search(r"(?<!\\)(?:\\\\)*</?turn>|(?<!\\)(?:\\\\)*<text>", e)


def test_chat_digests_are_those_of_the_input(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.assembled(rows)).collect()}
    for conv in {c for c, *_ in TALK}:
        turns = sorted((t, role or "", text or "") for c, t, role, text in TALK if c == conv)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == sum(20 + len(chat.escape(role)) + len(chat.escape(text)) for _, role, text in turns)


def test_chat_tokens_and_mask(spark):
    rows = spark.createDataFrame([t for t in TALK if t[0] == 1], "conv_id long, turn long, role string, text string")
    r = chat.conversations_of(chat.assembled(rows)).first()
    e = chat.encoder(chat.vocabulary_path())
    assert len(r.input_ids) == len(r.loss_mask) and r.input_ids.count(chat.TURN) == 5
    masked = e.decode([t for t, m in zip(r.input_ids, r.loss_mask, strict=True) if m])
    assert chat.unescape(masked) == "a <turn> b </turn> c <text>\\<turn>" * 2
    assert chat.digests(chat.assembled(rows.limit(0))).count() == 0


# op7


def test_rules_are_the_sql(spark):
    got = rules.judged(corpus.frame(spark)).collect()
    want, columns = duck(rules.oracle_sql(), documents=documents_for_duck())
    same([r.asDict() | {"js_chars": r.js_chars and round(r.js_chars, 6), "js_words": r.js_words and round(r.js_words, 6)} for r in got], want, columns)
    assert sum(r.kept for r in got) > 40 and not next(r for r in got if r.doc_id == 95).kept


def test_rules_keep_rows_whole(spark):
    docs = corpus.frame(spark)
    kept = rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 98").count() == 2 and kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id IN (90, 91, 93, 95)").count() == 0
    assert rules.kept_documents(corpus.empty(spark)).count() == 0


# op8


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["a  b", " lead", "tail ", "x y z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's we'll  don't", "\x00 nul \x00", "tab\t x \n\n y", "１２ ３", " a b", "é x", "\x1c y \x1f z"]
    some = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)] + corpus.rows()
    t = Tokenizer.from_file(path)
    cache = scratch(spark, "test-cache")
    for _ in range(2):  # the second time from the cache
        got = tokencount.token_counts(corpus.frame(spark, some), cache, path).collect()
        want = sorted((d is None, d or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in some)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.select("digest").distinct().count() == len({x or "" for _, x, *_ in some})
    assert tokencount.token_counts(corpus.empty(spark), scratch(spark, "test-cache"), path).count() == 0


def test_another_version_misses_the_cache(spark, monkeypatch):
    import public_tokenizers

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "test-cache")
    docs = corpus.frame(spark, corpus.rows()[:5])
    tokencount.token_counts(docs, cache, path)
    monkeypatch.setattr(tokencount, "tokenizer_digest", lambda p: "other")
    tokencount.token_counts(docs, cache, path)
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2


# op9


def brute_matches(text, containment=0.8):
    c = licenses.Classes(licenses.known_templates(), containment)
    _, g = licenses.shingles(*joined([text]))
    found = {}
    for half, templates in c.of.items():
        for lo in range(0, len(g), half):
            has = set(g[lo : lo + 2 * half].tolist())
            for name, own, need in templates:
                n = len(has & set(own.tolist()))
                if n >= need:
                    found[name] = max(found.get(name, 0), n / len(own))
    return found


def test_license_matches_are_brute_force(spark):
    some = list(corpus.rows())
    for i, (name, text) in enumerate(licenses.known_templates().items()):
        for k in range(6):
            some.append((1000 + 10 * i + k, f"{corpus.prose(k, 11 * k + i)} {text.upper() if k % 2 else text} {corpus.prose(50 + k, 30)}", "en", "s", 0))
        w = text.split()
        some.append((1008 + 10 * i, " ".join(w[: len(w) // 2]), "en", "s", 0))
    got = {}
    for r in licenses.scan(corpus.frame(spark, some)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    want = {d: m for d, t, *_ in some if d is not None and (m := brute_matches(t or ""))}
    assert got == want
    assert all(name in want[1000 + 10 * i] for i, name in enumerate(licenses.known_templates()))
    assert licenses.scan(corpus.empty(spark)).count() == 0


def test_bands_guarantee_collision():
    c = licenses.Classes(licenses.known_templates(), 0.8)
    for half, templates in c.of.items():
        for _, g, need in templates:
            assert (1 - need / (2 * half + len(g) - need)) ** c.bands[half] <= licenses.MISS * 1.0001


def test_long_licences_are_known_and_told_apart(spark):
    known = licenses.known_templates()
    assert {"apache-2.0-text", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "mpl-2.0-text", "cc0-1.0-text", "bsd-3-text"} <= set(known)
    names = [n for n in known if n.endswith("-text")]
    some = [(i, f"{corpus.prose(i, 700)} {known[n]} {corpus.prose(i + 1, 900)}", "en", "s", 0) for i, n in enumerate(names)]
    words = known["gpl-3.0-text"].split()
    some.append((100, " ".join(words[: int(0.7 * len(words))]), "en", "s", 0))  # too little of it
    some.append((101, " ".join(words[: int(0.9 * len(words))]), "en", "s", 0))
    got = {}
    for r in licenses.scan(corpus.frame(spark, some)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert all(n in got[i] for i, n in enumerate(names))
    long = {n for n in names if len(known[n]) > 5000}
    assert all(got[i] & long == {n} for i, n in enumerate(names) if n in long)
    assert "gpl-3.0-text" not in got.get(100, set()) and "gpl-3.0-text" in got[101]


# op10


def test_mix_is_the_sql(spark):
    some = [r for r in corpus.rows() if r[0] is not None]
    d = documents_for_duck()
    want, columns = duck(mixing.OP10_SQL, documents=(some, *d[1:]))
    same([r.asDict() for r in mixing.mix(corpus.frame(spark, some)).collect()], want, columns)


def test_mix_meets_targets_and_caps(spark):
    got = mixing.mix(corpus.frame(spark)).collect()
    assert len(got) == len(corpus.rows()) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 64 * 6, s
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    again = mixing.mix(corpus.frame(spark)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_of_nothing(spark):
    assert mixing.mix(corpus.empty(spark)).count() == 0
    assert mixing.mix(corpus.frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).where("taken = 0 AND target = 0").count() == 2


def test_golden_points(spark):
    from pyspark.sql import functions as F

    for r in spark.createDataFrame([(j,) for j in (0, 1, 2, 65535, 65536, 2**31 + 7, 2**40 + 3)], "j long").select("j", mixing.golden_point(F.col("j")).alias("u")).collect():
        assert r.u == r.j * mixing.PHI32 % 2**32


# all


def test_registry_has_each_operator_once():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run_on_any_extra_columns(spark, name, tmp_path):
    """Each query over a small table set with more columns than it knows."""
    from pyspark.sql import functions as F

    root = f"file://{tmp_path}"
    corpus.frame(spark).write.parquet(f"{root}/documents.parquet")
    more = lambda df: df.withColumns({c: F.lit(1) for c in ("source", "lang", "rank", "node")})
    more(spark.createDataFrame([(0, corpus.prose(7, 30))], "item_id long, text string")).write.parquet(f"{root}/benchmark.parquet")
    more(spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")).write.parquet(f"{root}/labels.parquet")
    more(spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")).write.parquet(f"{root}/conversations.parquet")
    vectors = [(i, [((i * 37 + j * 11) % 19 - 9) / 20 for j in range(8)], i % 3) for i in range(200)]
    clashing = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("cell", "split", "score", "vector", "place", "probe")})
    clashing.write.parquet(f"{root}/embeddings.parquet")
    assert registry.queries()[name](spark, root).count() > 0 or name.startswith(("op3", "op9"))
