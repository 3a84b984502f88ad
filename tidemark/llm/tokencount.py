"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens).
Contents are normalised (null is empty) and named by SHA-256; a tokenizer's
digest covers its file and its library's version, so another file or library
never meets old counts. Counting joins the digests to the cache, encodes each
distinct miss once, and appends the new counts.

Within a worker, text is cut before each blank that stands alone between
non-blanks. The vocabulary's split pattern always breaks there (no alternative
goes from a non-blank to a blank) and its special tokens hold no blank, so the
counts of the pieces add up to the text's; pieces met before are not encoded
again. The memory of pieces is bounded and only saves time.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated texts are
encoded once and counted for each row; a long text is one row of a task and is
counted whole; no rows give no rows and an unchanged
cache. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, scratch, table

#: Before a blank between two non-blanks (Unicode white space counts as blank).
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct pieces that each generation of a worker's memory holds.
REMEMBERED = 300_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=8)
def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's file content and its library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()


class PieceCounter:
    """Token counts of texts, with a bounded memory of pieces.

    Two generations of at most REMEMBERED pieces each: a full young one takes
    the old one's place, and old pieces that are met again move to the young.
    """

    def __init__(self, path: str):
        self.encoder, self.young, self.old = tokenizer(path), {}, {}

    def _learn(self, pieces: set[str]) -> None:
        """Puts the counts of all pieces into the young generation."""
        missing = []
        for p in pieces:
            n = self.old.get(p)
            if n is None:
                missing.append(p)
            else:
                self.young[p] = n
        for first in range(0, len(missing), 4096):
            some = missing[first : first + 4096]
            self.young.update(zip(some, (len(e.ids) for e in self.encoder.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        # A text with NUL characters goes to the library whole.
        split = [CUT.sub("\0 ", s).split("\0") if "\0" not in s else None for s in texts]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        self._learn({p for pieces in split if pieces is not None for p in pieces}.difference(self.young))
        known = self.young.__getitem__
        return [len(self.encoder.encode(s, add_special_tokens=False).ids) if pieces is None else sum(map(known, pieces)) for s, pieces in zip(texts, split, strict=True)]


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """The worker's counter, kept from task to task."""
    return PieceCounter(path)


def cached(spark, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer; an absent cache is empty."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def token_counts(docs: DataFrame, cache: str, model: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; fills the cache at path `cache`."""
    spark, version = docs.sparkSession, tokenizer_digest(model)
    bounded_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # One row stands for each distinct content; only numbers and digests are grouped and joined, a text moves once.
    one = named.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("chosen"))
    misses = one.join(cached(spark, cache, version), "digest", "left_anti")
    of = misses.select(F.col("digest").alias("miss"), "chosen")
    mine = (named["digest"] == of["miss"]) & (F.coalesce(named["doc_id"], F.lit(-(1 << 63))) == of["chosen"])
    texts = named.join(of.hint("shuffle_hash"), mine).select("digest", "text")

    def encode(batches):
        count = piece_counter(model).count
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    # Two rows of one content and one doc_id are both encoded; the cache keeps either.
    texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = cached(spark, cache, version)
    sized = named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # A new cache for each call: the query counts everything, whatever was counted before.
    return token_counts(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
