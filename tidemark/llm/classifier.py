"""Quality classifier: hashed n-gram logistic regression by follow-the-regularised-leader.

Features are hashed n-grams (one to two tokens, and one to three token shapes),
their counts over the number of tokens. A shape says whether a token is a
word, number or symbol run, how it is capitalised, and whether it repeats the
token before it; the shapes carry over to words never seen in training.

Training takes a bounded sample of labelled documents (`most`, those whose
hashed doc_id is least), makes their sparse vectors on the executors, and runs
the FTRL-proximal updates over them in one task in a fixed order. Scoring is a
sparse dot product per document with weights of a fixed size (2**BITS).

Cases: a null text counts as empty, and an empty text scores by the bias
alone; a text of any length is scored whole, in slabs of bounded size; labels with null quality or doc_id are left out; a document labelled
twice is two examples; repeated documents each get their score; a corpus
without labels scores 0.5 everywhere. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import BASE, LETTER, words
from tidemark.llm.common import bounded_batches, mixed, slabs, table, utf8_column

BITS = 18
#: Bound of the sample of labelled rows that training sees.
MOST = 8000
SLAB = 1 << 18
FOLDS = 5


def features(data: np.ndarray, ends: np.ndarray, bits: int = BITS):
    """doc, index and value of each hashed feature of each document, sorted by document and index."""
    first, last, doc, h, kind = words(data, ends, coarse=False, fold=True)
    n = len(first)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.float32)
    capital = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    caps = capital[last] - capital[first]
    shape = kind.astype(np.uint64) * np.uint64(16)
    shape += np.where(kind == LETTER, np.where(caps == 0, 0, np.where(caps >= last - first, 3, np.where(caps == 1, 1, 2))), np.minimum(last - first, 3)).astype(np.uint64)
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    shape += np.where(same, np.uint64(8), np.uint64(0))
    grams, docs = [], []
    for salt, seq, longest in ((1, h, 2), (7, shape, 3)):
        g = np.full(n, salt, np.uint64)
        for k in range(longest):
            m = n - k
            if m <= 0:
                break
            g = mixed(g[:m] * np.uint64(BASE) + seq[k:] + np.uint64(k))
            whole = doc[:m] == doc[k:]
            grams.append(g[whole])
            docs.append(doc[:m][whole])
    index = (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.concatenate(docs) << bits | index
    key, count = np.unique(key, return_counts=True)
    doc_of = key >> bits
    per_doc = np.bincount(doc, minlength=len(ends) - 1)
    return doc_of, key & ((1 << bits) - 1), (count / per_doc[doc_of]).astype(np.float32)


class Ftrl:
    """FTRL-proximal for logistic loss; index 2**bits is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.02):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[index]
        more = n + g * g
        self.z[index] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[index] = more


def trained(examples: DataFrame, bits: int = BITS, most: int = MOST, passes: int = 4, seed: int = 7) -> np.ndarray:
    """Weights (float32, bias last) from rows of text and label; the rows are bounded by the caller."""

    def vectors(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            out = {"rank": [], "label": [], "index": [], "value": []}
            for first, last in slabs(ends, SLAB):
                e = ends[first : last + 1] - ends[first]
                doc, index, value = features(data[ends[first] : ends[last]], e, bits)
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out["index"].append(index[lo:hi].astype(np.int32).tobytes())
                    out["value"].append(value[lo:hi].tobytes())
                out["rank"] += b.column("rank").to_pylist()[first:last]
                out["label"] += b.column("label").to_pylist()[first:last]
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("rank", pa.int64()), ("label", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])

    def learn(batches):
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for b in batches for i, v, y in zip(b.column("index").to_pylist(), b.column("value").to_pylist(), b.column("label").to_pylist(), strict=True)]
        model, order = Ftrl(bits), np.random.default_rng(seed)
        for _ in range(passes):
            for k in order.permutation(len(rows)):
                i, v, y = rows[k]
                model.learn(np.append(i, 1 << bits), np.append(v * 20, 1.0), y)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights().astype(np.float32).tobytes()]}, pa.schema([("weights", pa.binary())]))

    made = examples.select("rank", "label", "text").mapInArrow(vectors, "rank long, label int, index binary, value binary")
    # At most `most` sparse vectors, of some kilobytes each, meet in one task.
    one = made.repartitionByRange(1, "rank").sortWithinPartitions("rank", "label", "index")
    got = one.mapInArrow(learn, "weights binary").first()
    return np.frombuffer(got[0], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """rank, label and text of the training rows: at most `most` labels outside the held-out fold."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    chosen = chosen.select(F.col("doc_id").alias("of"), F.xxhash64("doc_id").alias("rank"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.orderBy("rank", "label").limit(most)
    # `most` rows of three numbers: the bound of the broadcast.
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("rank", "label", F.coalesce("text", F.lit("")).alias("text"))


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score of every row."""
    kept = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def score(batches):
        w = kept.value
        for b in batches:
            data, ends = utf8_column(b, "text")
            total = np.full(b.num_rows, w[-1])
            for first, last in slabs(ends, SLAB):
                doc, index, value = features(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], bits)
                total[first:last] += np.bincount(doc, w[index] * value * 20, last - first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = scored(docs, trained(labelled(docs, labels, most), most=most))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    return s.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
