"""Near-duplicate collapse of chunks: MinHash signatures, bands, first seen wins."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.text import normalize

#: Fixed values of the signature.
PRIME, SEED, PERMUTATIONS, SHINGLE, BANDS, THRESHOLD = 4294967291, 0x5C701B6A2F9E4D13, 128, 3, 16, 0.85
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
EMPTY = 4294967295
#: Rows of a block of a bucket, and rows that a task compares at a time (a group of two blocks is held whole).
BLOCK, MOST_ROWS = 2048, 8192


@functools.lru_cache(maxsize=8)
def coefficients(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[tuple[int, int], ...]:
    """n pairs (a, b) drawn in turn from the SplitMix64 generator."""
    full, state, drawn = (1 << 64) - 1, seed, []
    for _ in range(2 * n):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = state
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ (z >> shift)) * factor) & full
        drawn.append(z ^ (z >> 31))
    return tuple((1 + a % (PRIME - 1), b % PRIME) for a, b in zip(drawn[::2], drawn[1::2], strict=True))


def shingle_bounds(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first byte, end and text of each n-word shingle of texts that lie one after the other; fewer words are a shingle each.

    data: UTF-8 with one blank between words and none at the texts' ends.
    """
    size = np.diff(ends)
    blank = np.flatnonzero(data == 32)
    first = np.sort(np.concatenate([ends[:-1][size > 0], blank + 1]))
    of = np.searchsorted(ends, first, "right") - 1
    last = np.append(first[1:] - 1, len(data))  # before the blank
    tail = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    last[tail] = ends[of[tail] + 1]  # a text's last word ends with it, no blank follows
    words = np.bincount(of, minlength=len(size))
    place = np.arange(len(of)) - np.concatenate([[0], np.cumsum(words)[:-1]])[of] if len(of) else np.zeros(0, np.int64)
    few = words[of] < n
    heads = np.flatnonzero(few | (place + n <= words[of]))
    return first[heads], last[np.where(few[heads], heads, heads + n - 1)], of[heads]


def fnv32_of(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """FNV-1a-32 of many stretches of bytes at once, byte position by byte position; those that end early drop out."""
    h, size = np.full(len(first), FNV32_OFFSET, np.uint32), last - first
    by = np.argsort(-size, kind="stable")
    at, left, out, prime = first[by], size[by], h[by], np.uint32(FNV32_PRIME)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, "left"))
        out[:live] = (out[:live] ^ data[at[:live] + k]) * prime
    h[by] = out
    return h


def fnv32(items: list[bytes]) -> np.ndarray:
    """FNV-1a-32 of many strings."""
    ends = np.cumsum([0, *map(len, items)])
    return fnv32_of(np.frombuffer(b"".join(items), np.uint8), ends[:-1], ends[1:])


def signatures_of(texts: list[str], permutations: int = PERMUTATIONS, most: int = 1 << 15) -> np.ndarray:
    """A signature per text, from one flat array of shingle hashes; a text without words has EMPTY everywhere."""
    raw = [" ".join(t.split()).encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    first, last, of = shingle_bounds(data, ends)
    x = np.unique(of.astype(np.uint64) << np.uint64(32) | fnv32_of(data, first, last))
    of, x = (x >> np.uint64(32)).astype(np.int64), x & np.uint64(0xFFFFFFFF)
    out = np.full((len(texts), permutations), EMPTY, np.uint64)
    ab = np.array(coefficients(permutations), np.uint64)
    for at in range(0, len(x), most):
        part, who = x[at : at + most], of[at : at + most]
        cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        for k in range(permutations):
            out[who[cuts], k] = np.minimum(out[who[cuts], k], np.minimum.reduceat((ab[k, 0] * part + ab[k, 1]) % np.uint64(PRIME), cuts))
    return out.astype(np.int64)


def signature_of(text: str, permutations: int = PERMUTATIONS) -> list[int]:
    return signatures_of([text or ""], permutations)[0].tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(text: pd.Series) -> pd.Series:
    """Signatures, some megabytes of text at a time."""
    given = [t if isinstance(t, str) else "" for t in text]
    out, some, held = [], [], 0
    for t in given:
        some.append(t)
        held += len(t)
        if held > 1 << 22:
            out += list(signatures_of(some))
            some, held = [], 0
    return pd.Series(out + list(signatures_of(some)), dtype=object)


def band_rows(df: DataFrame, bands: int = BANDS) -> DataFrame:
    """df plus band and key, a row for each band of `signature`; rows of different `scope`, if df has one, share no key."""
    rows, scope = PERMUTATIONS // bands, [F.col("scope")] if "scope" in df.columns else []
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.slice("signature", b * rows + 1, rows), *scope).alias("key")))
    return df.withColumn("k", F.explode(keys)).select(*df.columns, "k.band", "k.key")


def bucket_links(heads: DataFrame, members: DataFrame, signatures: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """earlier, later, jaccard of the heads with the later members that share a band and are similar enough.

    heads and members: seq, key. A bucket's signatures are gathered once and
    compared where they lie, so that only links are shuffled. A bucket of more
    than `block` rows is dealt into blocks, a group for every two of them.
    """
    both = heads.select("seq", "key", F.lit(1).alias("role")).unionByName(members.select("seq", "key", F.lit(2).alias("role")))
    both = both.groupBy("key", "seq").agg(F.bit_or("role").alias("role"))
    sizes = both.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("role").alias("roles")).where("n > 1 AND roles = 3").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = both.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("seq", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "role")
    # The values are below 2**32: half the bytes tell them apart.
    short = signatures.select("seq", F.transform("signature", lambda x: (x - (1 << 31)).cast("int")).alias("signature"))
    seq = signatures.schema["seq"].dataType
    schema = pa.schema([("earlier", to_arrow_type(seq)), ("later", to_arrow_type(seq)), ("jaccard", pa.float64())])

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows >= MOST_ROWS:
                cut = int(group_starts(held)[-1])  # the last group may go on
                if cut:
                    yield from linked(held.slice(0, cut), threshold, schema)
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from linked(held, threshold, schema)

    there = dealt.join(short, "seq").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "seq")
    found = there.mapInArrow(run, T.StructType([T.StructField("earlier", seq), T.StructField("later", seq), T.StructField("jaccard", T.DoubleType())]))
    return found.groupBy("earlier", "later").agg(F.first("jaccard").alias("jaccard"))  # of every band that they share


def group_starts(rows: pa.Table) -> np.ndarray:
    """Where groups of equal key, lo and hi begin."""
    key, lo, hi = (rows.column(c).to_numpy() for c in ("key", "lo", "hi"))
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))


def linked(rows: pa.Table, threshold: float, schema: pa.Schema, most: int = 1 << 15):
    """The links within groups of rows in order of key, lo, hi and seq, `most` pairs at a time."""
    starts, seq = group_starts(rows), rows.column("seq").combine_chunks()
    ends = np.repeat(np.append(starts[1:], rows.num_rows), np.diff(np.append(starts, rows.num_rows)))
    role, block, lo, hi = (rows.column(c).to_numpy() for c in ("role", "block", "lo", "hi"))
    signature = rows.column("signature").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    later = np.where(role & 1, ends - np.arange(rows.num_rows) - 1, 0)  # rows after a head in its group
    total = np.concatenate([[0], np.cumsum(later)])
    for at in range(0, int(total[-1]), most):
        pair = np.arange(at, min(at + most, int(total[-1])))
        a = np.searchsorted(total, pair, "right") - 1
        b = a + 1 + pair - total[a]
        # In a group of two blocks, those of one block are compared elsewhere.
        fit = (role[b] & 2 > 0) & ((lo[a] == hi[a]) | (block[a] != block[b]))
        a, b = a[fit], b[fit]
        share = (signature[a] == signature[b]).sum(axis=1) / signature.shape[1]
        near = np.flatnonzero(share >= threshold)
        if len(near):
            yield pa.RecordBatch.from_arrays([seq.take(pa.array(a[near])), seq.take(pa.array(b[near])), pa.array(share[near])], schema=schema)


def retained_of(keyed: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """seq of the rows that stay, of (seq, key) and (seq, signature), in order of seq.

    A row that comes first in all its buckets is retained, and later neighbours
    of it are collapsed: that takes large groups of near copies away. The links
    of all others are found at once. Whoever has no earlier undecided neighbour
    is retained, whoever has a retained one is collapsed, round by round: there
    are as many rounds as links in a chain, whatever the size of the buckets.
    """
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("least")).where("n > 1").select("key", "least")
    undecided = _cut(keyed.join(shared, "key").select("seq", "key", (F.col("seq") == F.col("least")).alias("leads")))
    apart = keyed.select("seq").distinct().join(undecided.select("seq").distinct(), "seq", "left_anti")  # in no bucket with another
    ahead = _cut(undecided.groupBy("seq").agg(F.min("leads").alias("free")).where("free").select("seq"))
    near = bucket_links(undecided.join(ahead, "seq"), undecided, signatures, threshold).select(F.col("later").alias("seq"))
    undecided = _cut(undecided.join(ahead.union(near).distinct(), "seq", "left_anti").select("seq", "key"))
    links = _cut(bucket_links(undecided, undecided, signatures, threshold).select("earlier", "later"))
    collapsed = links.select(F.col("later").alias("seq")).distinct()
    retained = [apart, ahead, undecided.select("seq").distinct().join(collapsed, "seq", "left_anti")]
    while links.limit(1).count():
        free = links.select(F.col("earlier").alias("seq")).distinct().join(links.select(F.col("later").alias("seq")), "seq", "left_anti")
        gone = _cut(links.join(free.withColumnRenamed("seq", "earlier"), "earlier").select(F.col("later").alias("seq")).distinct())
        left = lambda df, side: df.join(gone.withColumnRenamed("seq", side), side, "left_anti")  # noqa: B023, E731
        # Rows that only collapsed ones come before are free from now on.
        rest = left(left(links, "earlier"), "later")
        loose = left(links, "later").join(rest.select("later"), "later", "left_anti").select(F.col("later").alias("seq")).distinct()
        retained.append(_cut(loose))
        links = _cut(rest)
    return _cut(functools.reduce(DataFrame.union, retained))


def retained_first(signatures: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(retained seqs, links of them to the rest) of rows (seq, signature), in order of seq."""
    keyed = _cut(band_rows(signatures, bands).select("seq", "key"))
    retained = retained_of(keyed, signatures, threshold)
    heads, rest = keyed.join(retained, "seq"), keyed.join(retained, "seq", "left_anti")
    return retained, bucket_links(heads, rest, signatures, threshold)


def judged(df: DataFrame, stored: DataFrame | None = None, stored_bands: DataFrame | None = None, threshold: float = THRESHOLD, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(seq, verdict (retained, exact or near), kept_as, jaccard) of rows (seq, text) in order of seq, and (seq, digest, signature) of those retained.

    Equal normalised texts are exact repeats of the first. A text is near if an
    earlier retained one is similar enough, and kept as the most similar one,
    the first of equals; collapsed texts represent nothing. stored: what earlier
    calls retained, all of it earlier than these rows, with its band rows
    (seq, key); it collapses rows as if it stood before them in one table. A
    column `scope` keeps rows of different scopes apart.
    """
    scope = ["scope"] if "scope" in df.columns else []
    seen = df.select("seq", *scope, normalize(F.coalesce("text", F.lit(""))).alias("text"))
    seen = _cut(seen.withColumn("digest", F.sha2(F.concat_ws("\u001f", *scope, "text"), 256)))
    firsts = seen.groupBy("digest").agg(F.min("seq").alias("of"))
    named = _cut(seen.join(firsts, "digest").select("seq", "of", "digest"))
    distinct = named.where("seq = of").select("seq", "digest")
    known = None
    if stored is not None:
        known = _cut(distinct.join(stored.select("digest", F.col("seq").alias("kept")), "digest").select(F.col("seq").alias("of"), "kept"))
        distinct = distinct.join(known.select(F.col("of").alias("seq")), "seq", "left_anti")
    signatures = _cut(seen.join(distinct.select("seq"), "seq").select("seq", "digest", *scope, minhash("text").alias("signature")))
    keyed = _cut(band_rows(signatures.select("seq", *scope, "signature"), bands).select("seq", "key"))
    free, old = keyed, None
    if stored is not None:
        met = stored_bands.join(keyed.select("key").distinct(), "key", "left_semi")
        known_signatures = stored.select("seq", "signature").unionByName(signatures.select("seq", "signature"))
        old = _cut(bucket_links(met, keyed, known_signatures, threshold))
        free = keyed.join(old.select(F.col("later").alias("seq")).distinct(), "seq", "left_anti")
    retained = retained_of(free, signatures, threshold)
    links = bucket_links(keyed.join(retained, "seq"), keyed.join(retained, "seq", "left_anti"), signatures, threshold)
    links = links if old is None else links.unionByName(old)
    best = links.groupBy(F.col("later").alias("of")).agg(F.min(F.struct((-F.col("jaccard")).alias("far"), "earlier")).alias("b"))
    best = best.select("of", F.col("b.earlier").alias("kept_as"), (-F.col("b.far")).alias("jaccard"))
    joined = named.join(best, "of", "left")
    joined = joined.withColumn("kept", F.lit(None).cast(df.schema["seq"].dataType)) if known is None else joined.join(known, "of", "left")
    verdict = F.when(F.col("kept").isNotNull(), "exact").when(F.col("kept_as").isNotNull(), "near").when(F.col("seq") == F.col("of"), "retained").otherwise("exact")
    verdicts = joined.select("seq", verdict.alias("verdict"), F.coalesce("kept", "kept_as", "of").alias("kept_as"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))
    return verdicts, signatures.join(retained, "seq", "left_semi")


def collapse(df: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """seq, verdict, kept_as and jaccard of one table's rows (seq, text); see judged."""
    return judged(df, threshold=threshold, bands=bands)[0]


class DupIndex:
    """What has been retained so far, in a folder of its own: texts' digests and signatures, and their band rows.

    Each batch leaves a directory under its number; a batch reads those of
    smaller numbers only, so a batch that runs again gives and leaves the same.
    `compact` merges directories; readers then pass over what is merged.
    """

    WIDTH = 12

    def __init__(self, spark: SparkSession, root: str, threshold: float = THRESHOLD, bands: int = BANDS):
        from tidemark.sources.store import Files

        self.spark, self.root, self.threshold, self.bands = spark, root.rstrip("/"), threshold, bands
        self.files = Files(spark)

    def _held(self, table: str, before: int) -> list[str]:
        """Paths of the table's directories of batches below `before`: the last merged one and those after it."""
        at = f"{self.root}/{table}"
        done = {n: int(n.split("=")[1]) for n in self.files.children(at) if "=" in n and self.files.exists(f"{at}/{n}/_SUCCESS")}
        merged = max((i for n, i in done.items() if n.startswith("merged=") and i < before), default=-1)
        return [f"{at}/{n}" for n, i in done.items() if (i < before and i > merged and n.startswith("batch=")) or n == f"merged={merged}"]

    def _read(self, table: str, schema: str, before: int) -> DataFrame:
        paths = self._held(table, before)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def judge(self, rows: DataFrame, batch: int) -> DataFrame:
        """id, verdict, kept_as (an id), jaccard of rows (id, at, text, and scope if they have scopes), in order of at and id; remembers those retained."""
        seq = F.concat(F.lpad(F.lit(str(batch)), self.WIDTH, "0"), F.lpad(F.unix_micros("at").cast("string"), 20, "0"), F.col("id"))
        stored = self._read("retained", "seq string, digest string, signature array<bigint>", batch)
        bands = self._read("bands", "seq string, key bigint", batch)
        first, scope = not self._held("retained", batch), ["scope"] if "scope" in rows.columns else []
        verdicts, fresh = judged(rows.select(seq.alias("seq"), *scope, "text"), None if first else stored, None if first else bands, self.threshold, self.bands)
        verdicts, fresh = _cut(verdicts), _cut(fresh)
        fresh.select("seq", "digest", "signature").write.mode("overwrite").parquet(f"{self.root}/retained/batch={batch}")
        keys = band_rows(fresh.select("seq", *scope, "signature"), self.bands).select("seq", "key")
        keys.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.root}/bands/batch={batch}")
        of = lambda c: F.substring(c, self.WIDTH + 21, 1 << 20)
        return verdicts.select(of(F.col("seq")).alias("id"), "verdict", of(F.col("kept_as")).alias("kept_as"), "jaccard")

    def compact(self, before: int) -> None:
        """Merges the directories of batches below `before`, none of which may run again."""
        for table, by in (("retained", "digest"), ("bands", "key")):
            paths = self._held(table, before)
            if len(paths) > 1:
                self.spark.read.parquet(*paths).repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{self.root}/{table}/merged={before - 1}")
                for p in paths:
                    self.files.delete(p)


def _cut(df: DataFrame) -> DataFrame:
    from tidemark.sources.store import reliable

    return reliable(df)
