"""Operators 11 to 13 against brute force: BPE round trips, Merkle manifests, hard negatives."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from tidemark.llm import balltree, bpe, merkle

MODEL = public_tokenizers.path("byte_bpe_50k.json")


# ---- 11: BPE ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def odd_text(r):
    some = ["ab", "the", "aaaa", "é", "日本語", "word", "1234", "!!", "==", "  ", "\n", "\t", " x", " ", "<|endoftext|>", "’s", "'s", " ", "\x1c", "😀", "\0"]
    return "".join(r.choices(some[: r.choice([3, 6, 10, len(some)])], k=r.randint(0, 80)))


def test_pieces_and_joins_equal_the_library(library):
    r, b = random.Random(11), bpe.encoder(MODEL)
    for _ in range(1500):
        text, size, got, tree = odd_text(r), r.choice([1, 2, 3, 5, 8, 20]), [], []
        for part, parts, raw, s in bpe.pieces(b, text, size):
            ids = [i for w in s.split(" ") for i in b.word(w)] if raw else b.encode(s)
            tree.append(ids)
            if part == parts - 1:
                while len(tree) > 1:
                    tree = [b.joined(tree[i], tree[i + 1], 1) for i in range(0, len(tree), 2)]
                got, tree = got + tree[0], []
        assert got == library.encode(text, add_special_tokens=False).ids, (text, size)


def test_join_grows_to_the_ends(library):
    """Halves of a periodic word whose tokens all shift once they meet."""
    b = bpe.encoder(MODEL)
    for unit, n, cut in (("a", 1001, 500), ("ab", 700, 333), ("-", 999, 1), ("=", 640, 321)):
        whole = unit * n
        assert b.joined(b.word(whole[:cut]), b.word(whole[cut:]), 1) == library.encode(whole, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", [64, bpe.PIECE])
def test_round_trip_equals_the_library(spark, library, piece):
    r = random.Random(3)
    rows = corpus.rows() + [(200 + i, odd_text(r), "en", "s", 0) for i in range(40)] + [(300, "x" * 5000 + " y", "en", "s", 0), (301, "ab" * 40_000, "en", "s", 0), (302, " " * 3000, "en", "s", 0), (302, " " * 3000, "en", "s", 0)]
    out = sorted(map(tuple, bpe.round_trip(corpus.frame(spark, rows), MODEL, piece).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    assert out == sorted(((d, *expected(library, t)) for d, t, *_ in rows), key=str)


def test_round_trip_of_nothing(spark):
    assert bpe.round_trip(corpus.empty(spark), MODEL).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


# ---- 12: Merkle manifest ----


def levels_up(nodes):
    rows = [list(nodes)]
    while len(rows[-1]) > 1:
        rows.append([merkle.digest(rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def siblings(rows, i):
    out = []
    for row in rows[:-1]:
        first = i // 3 * 3
        out.append((row[first:i], row[i + 1 : first + 3]))
        i //= 3
    return out


def test_traversal_equals_the_levels():
    for n in [*range(1, 60), 81, 82, 243, 700]:
        leaves = [merkle.digest([str(i)]) for i in range(n)]
        rows = levels_up(leaves)
        assert list(merkle.traversal(leaves, merkle.levels_of(n))) == [siblings(rows, i) for i in range(n)]
        assert merkle.Treehash(leaves, merkle.levels_of(n), 0).value() == rows[-1][0]


def test_traversal_holds_a_few_nodes_a_level(monkeypatch):
    held, step = [], merkle.Treehash.step

    def watched(self):
        step(self)
        held.append(len(self.stack))

    monkeypatch.setattr(merkle.Treehash, "step", watched)
    list(merkle.traversal([str(i) for i in range(2000)], 7))
    assert max(held) <= 2 * 7 + 1


def brute_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    code = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, l, s, n: merkle.digest([code(d), code(s), code(l), code(n), code(t)])  # noqa: E731, E741
    import zlib

    of = {}
    for d, t, l, s, n in rows:  # noqa: E741
        even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        whole = leaf(d, t, l, s, n)
        of.setdefault(s, []).append((d is not None, d or 0, whole, leaf(d, t.replace("\n", "") if even and t is not None else t, l, s, n), d))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_up([x[2] for x in sorted(of[s])]) for s in names}
    top = levels_up([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, whole, shown, d) in enumerate(sorted(of[s])):
            path = siblings(trees[s], i) + siblings(top, k)
            root = merkle.folded(shown, path)
            out.append((d, s, whole, trees[s][-1][0], top[-1][0], merkle.digest([x for two in path for side in two for x in side]), root, root == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_brute_force(spark, levels):
    rows = [(a, (b or "")[:80] + "\n" * (i % 3) if b is not None else None, c, d if i % 11 else None, e if i % 5 else None) for i, (a, b, c, d, e) in enumerate(corpus.rows())]
    rows += [(900 + i, f"text {i}\n", "en", "hot", 5) for i in range(200)] + [(7, "same", "en", "hot", 4)] * 3 + [(8, "ä\n", None, f"é{i}", 1) for i in range(12)]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(corpus.frame(spark, rows), F.regexp_replace("text", "\n", ""), even, levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    (row,) = merkle.manifest(corpus.frame(spark, [(1, "a", "en", "s", 1)])).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == hashlib.sha256().hexdigest()
    assert merkle.manifest(corpus.empty(spark)).count() == 0


# ---- 13: hard negatives ----


def brute_negatives(rows):
    whole = [(i, -1 if v is None else v, v, (l + 1) % 10 if v is not None and v % 7 == 0 else l, [int(np.floor(256 * np.float64(c))) for c in x]) for i, (v, x, l) in enumerate(rows) if l is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, _, v, label, x in whole:
        if v is None or v % 50:
            continue
        scored = sorted(((-dot(x, y), w is None, w or 0, w, m == label) for j, _, w, m, y in whole if j != i), key=lambda t: t[:3])
        for s, _, _, w, _ in [t for t in scored if t[4]][:5]:
            hard = [t for t in scored if not t[4] and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(v, w, k + 1, t[3], -s, -t[0]) for k, t in enumerate(hard)]
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("cell", "split", "place", "probe", "score", "rank"))})


def cloud(n, dim, seed, classes=10):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(classes, dim))
    x = middle[g.integers(classes, size=n)] * 0.6 + g.normal(size=(n, dim)) * 0.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(np.float32(c)) for c in x[i]], int(g.integers(classes))) for i in range(n)]


@pytest.mark.parametrize("block_rows", [16, 100, None])
def test_hard_negatives_equal_brute_force(spark, block_rows):
    rows = cloud(900, 12, 1)
    rows += [(1000 + i, rows[50][1], 3) for i in range(200)]  # copies: ties all over
    rows += [(None, rows[3][1], 2), (2000, None, 1), (2050, rows[4][1], None), (2100, [float("nan")] * 12, 1), (2150, [None] + rows[5][1][1:], 1), (2200, [], 1), (2250, [0.5, 0.5], 1), (2300, rows[9][1] + [1.0], 1), (100, rows[100][1], 4), (100, rows[100][1], 4), (-50, rows[7][1], 5), (2350, [0.0] * 12, 1), (2400, [300.0] + [0.1] * 11, 1), (2450, [-c for c in rows[1][1]], 2)]
    got = balltree.hard_negatives(vectors(spark, rows), block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(c * 3000)) for c in x], label) for i, x, label in cloud(160, 6, 2)]
    assert sorted(map(tuple, balltree.hard_negatives(vectors(spark, rows), block_rows=32).collect()), key=str) == brute_negatives(rows)


def test_no_negatives(spark):
    for rows in ([], [(50, [1.0, 0.5], 1)], [(i, [1.0, i / 9], 11) for i in range(51, 60)], [(50 * i, [1.0, i / 9], 12) for i in range(1, 6)]):
        assert balltree.hard_negatives(vectors(spark, rows)).count() == len(brute_negatives(rows))


def test_nodes_are_left_out(monkeypatch):
    """In clustered rows most leaves are never multiplied out, and the rows found are the same."""
    g = np.random.default_rng(4)
    x = np.round(np.repeat(g.normal(size=(40, 16)) * 400, 64, axis=0) + g.normal(size=(2560, 16)) * 8)
    labels = np.repeat(np.arange(40) % 8, 64)
    t = balltree.BallTree.built(x, list(range(2560)), labels)
    seen, call = [], balltree.Products.__call__
    monkeypatch.setattr(balltree.Products, "__call__", lambda self, i, r: seen.append(len(i) * (r.stop - r.start)) or call(self, i, r))
    at = np.arange(0, 2560, 50)
    none = np.full((len(at), 1), -np.inf)
    best = balltree.searched(t, t.x[at], t.labels[at], none, -none, none, 5, True, at)
    assert sum(seen) < 0.25 * len(at) * 2560
    for k, i in enumerate(at):
        s = t.x @ t.x[i]
        ok = np.flatnonzero((t.labels == t.labels[i]) & (np.arange(2560) != i))
        want = sorted(ok, key=lambda j: (-s[j], t.ids[j]))[:5]
        assert best.row[best.probe == k].tolist() == want


def test_a_cluster_must_name_its_shared_folder():
    from tidemark.llm.common import shared_dir

    class Session:
        def __init__(self, master, there):
            self.sparkContext, self.conf = type("C", (), {"master": master}), {"spark.checkpoint.dir": there}

    assert shared_dir(Session("local[4]", None)).startswith("file:")
    assert shared_dir(Session("spark://a:7077", "hdfs://x")) == "hdfs://x"
    for master in ("spark://a:7077", "local-cluster[3,2,3000]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(Session(master, None))
