"""op1 and op2 against brute force, their parts, and odd rows."""

import hashlib
import re

import numpy as np
import pytest

from tests.llm import corpus
from tidemark.llm import repeats, substring, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_everywhere(raws: list[bytes], length: int) -> list[list[bool]]:
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def report(raw: bytes, gone: list[bool]) -> tuple:
    spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
    return len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("most", [repeats.MOST, 1])
def test_suffix_report_is_brute_force(spark, most):
    """most=1 sends every bucket of different segments through the way for buckets of any size."""
    rows = corpus.rows()
    raws = [(t or "").encode() for _, t, *_ in rows]
    short = [sum(g) for g in removed_everywhere(raws, 200)]
    want = sorted((r[0] is None, r[0] or 0, *report(raw, g), n) for r, raw, g, n in zip(rows, raws, removed_everywhere(raws, 400), short, strict=True))
    got = suffix.removal_report(corpus.frame(spark), most=most).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in got) == want


def test_suffix_keeps_the_first_copy(spark):
    some = [r for r in corpus.rows() if r[0] is not None and r[0] != 98]
    got = {r.doc_id: r.text for r in suffix.deduplicated(corpus.frame(spark, some)).collect()}
    seen: set[bytes] = set()
    for doc, text, *_ in sorted(some):
        raw = (text or "").encode()
        gone, fresh = [False] * len(raw), []
        for i in range(len(raw) - 399):
            w = raw[i : i + 400]
            if w in seen:
                gone[i : i + 400] = [True] * 400
            seen.add(w)
            fresh.append(w)
        if doc == 96:  # whole characters only
            assert got[doc] == text[: len(got[doc])] or len(got[doc]) <= len(text)
            continue
        assert got[doc] == (None if text is None else bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()), doc


def test_passages_at_the_ends_of_texts_and_zero_bytes(spark):
    """Passages of 200 to 900 bytes, cut off at any place; some texts are mostly zero bytes."""
    r = np.random.default_rng(3)
    shared = [r.choice(np.frombuffer(alphabet, np.uint8), 900).tobytes() for alphabet in (b"abcdefgh ", b"\0\0\0\0\0\0\0\0\0\0\0a", b"ab")]
    texts = []
    for i in range(120):
        s = shared[i % 3]
        lo = int(r.integers(0, 500))
        fresh = r.choice(np.frombuffer(b"pqrstuv ", np.uint8), 400).tobytes()
        texts.append((fresh[: int(r.integers(0, 200))] + s[lo : lo + int(r.integers(150, 900))] + fresh[: int(r.integers(0, 2)) * 300]).decode())
    want = {}
    for at, (first, second) in enumerate(zip(*(removed_everywhere([t.encode() for t in texts], n) for n in (400, 200)), strict=True)):
        want[at] = (*report(texts[at].encode(), first), sum(second))
    got = suffix.removal_report(corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.n_passage) for x in got} == want


def test_longest_previous_is_brute_force():
    r = np.random.default_rng(6)
    for n in (1, 2, 17, 200):
        for _ in range(20):
            place, lcp = r.permutation(n), r.integers(0, 9, n).astype(np.int32)
            lcp[0] = 0
            want = [max([0, *(lcp[min(i, j) + 1 : max(i, j) + 1].min() for j in range(n) if place[j] < place[i])]) for i in range(n)]
            assert repeats.longest_previous(place, lcp, 3).tolist() == [x if x >= 3 else 0 for x in want]


def test_least_between():
    v = np.random.default_rng(2).integers(0, 99, 77).astype(np.int32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(77), np.arange(78)))
    a, b = a[a < b], b[a < b]
    assert repeats.least_between(v)(a, b).tolist() == [v[x:y].min() for x, y in zip(a, b, strict=True)]


def test_without_keeps_characters_whole():
    raw = np.frombuffer("xéy".encode(), np.uint8)
    assert suffix.without(raw, np.array([[2, 3]])).decode() == "xéy"
    assert suffix.without(raw, np.array([[1, 3]])).decode() == "xy"
    assert suffix.without(raw, np.array([[0, 2]])).decode() == "éy"


def brute_words(rows, n=20):
    seen, out = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone, own = [False] * len(w), []
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen and (seen[k][0] != doc or seen[k][1] < i):
                gone[i : i + n] = [True] * n
            seen.setdefault(k, (doc, i))
            own.append(k)
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits,most", [(None, repeats.MOST), (16, 1)])
def test_substring_report_is_brute_force(spark, bits, most):
    """16 bits make a sketch so crowded that it lets nearly everything through: results stay."""
    rows = corpus.rows()
    want = brute_words(rows)
    got = substring.removal_report(corpus.frame(spark), bits=bits, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_texts_that_share_a_doc_id(spark):
    """Two texts of one doc_id that share 25 words: the one of the lesser hash keeps them; a repeated row changes nothing."""
    shared = corpus.prose(77, 25)
    texts = [f"{corpus.prose(78, 30)} {shared}", f"{shared} {corpus.prose(79, 30)}"]
    rows = [(5, t, "en", "s", 0) for t in [*texts, texts[0]]]
    got = [r.n_removed for r in substring.removal_report(corpus.frame(spark, rows)).collect()]
    assert sorted(got) in ([0, 0, 25], [0, 25, 25])
    both = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.removal_report(corpus.frame(spark, rows), length=60, passage=60, anchor=20).collect()}
    assert all(both.values()) and len(both) == 2


def test_sketch_never_underestimates(spark):
    docs = corpus.frame(spark)
    sketch = substring.merged_sketch(docs, bits=18)
    seen: dict[int, int] = {}
    for _, t, *_ in corpus.rows():
        raw = np.frombuffer((t or "").encode(), np.uint8)
        h, _, _ = substring.split(raw, np.array([0, len(raw)]))
        for a in repeats.runs(h, np.array([0, len(h)]), 20, 6)[3].tolist():
            seen[a] = seen.get(a, 0) + 1
    often = np.array([a for a, n in seen.items() if n > 1], np.uint64)
    assert substring.estimated_repeated(sketch, often, 18).all()


def test_empty_tables(spark):
    assert suffix.removal_report(corpus.empty(spark)).count() == 0
    assert suffix.deduplicated(corpus.empty(spark)).count() == 0
    assert substring.removal_report(corpus.empty(spark)).count() == 0


def test_runs_cover_each_window_once_in_pieces():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 3, 5000).astype(np.uint64)
    ends = np.array([0, 10, 10, 4000, 5000])
    met = []
    for _, lo, hi, e in repeats.pieces(ends, 700, 50):
        first, n, *_ = repeats.runs(v[lo:hi], e, 50, 10)
        met += [lo + f + i for f, m in zip(first.tolist(), n.tolist(), strict=True) for i in range(m)]
    assert sorted(met) == [*range(10, 4000 - 49), *range(4000, 5000 - 49)]


def test_least_in_windows():
    v = np.random.default_rng(1).integers(0, 100, 257).astype(np.uint64)
    for w in (1, 3, 64, 257):
        assert repeats.least_in_windows(v, w).tolist() == [v[i : i + w].min() for i in range(257 - w + 1)]
