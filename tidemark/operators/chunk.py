"""Chunking: sentences packed to a target size, hard splits, volumes, exact dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalize, sentences, token_estimate, word_list

TARGET, MOST = 768, 1024
_ACC = "struct<done: array<struct<text: string, tokens: int>>, cur: string, tokens: int>"


def _packed(parts: Column, target: int, most: int) -> Column:
    """Greedy packing of (text, tokens) parts: flush before a part that would pass `most`, and once at `target`."""

    def add(acc: Column, part: Column) -> Column:
        full = (acc["tokens"] > 0) & (acc["tokens"] + part["tokens"] > most)
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["cur"].alias("text"), acc["tokens"].alias("tokens"))))).otherwise(acc["done"])
        cur = F.when(full | (acc["tokens"] == 0), part["text"]).otherwise(F.concat_ws(" ", acc["cur"], part["text"]))
        tokens = F.when(full, part["tokens"]).otherwise(acc["tokens"] + part["tokens"])
        flush = tokens >= target
        done2 = F.when(flush, F.concat(done, F.array(F.struct(cur.alias("text"), tokens.alias("tokens"))))).otherwise(done)
        return F.struct(done2.alias("done"), F.when(flush, F.lit("")).otherwise(cur).alias("cur"), F.when(flush, 0).otherwise(tokens).alias("tokens")).cast(_ACC)

    start = F.struct(F.array().cast("array<struct<text: string, tokens: int>>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("tokens")).cast(_ACC)

    def close(acc: Column) -> Column:
        return F.when(acc["tokens"] > 0, F.concat(acc["done"], F.array(F.struct(acc["cur"].alias("text"), acc["tokens"].alias("tokens"))))).otherwise(acc["done"])

    return F.aggregate(parts, start, add, close)


def chunk_text(df: DataFrame, column: str = "text", target: int = TARGET, most: int = MOST, estimate=token_estimate) -> DataFrame:
    """df plus ordinal, chunk, token_count: a row per chunk. Texts without a sentence give none.

    A sentence of more than `most` tokens is packed word by word; a chunk's
    tokens are the sum of its parts' estimates.
    """
    sized = lambda parts: F.transform(parts, lambda s: F.struct(s.alias("text"), estimate(s).cast("int").alias("tokens")))
    long = lambda s: estimate(s) > most
    hard = lambda s: F.transform(_packed(sized(word_list(s)), most + 1, most), lambda c: F.struct(c["text"], estimate(c["text"]).cast("int").alias("tokens")))
    parts = F.flatten(F.transform(sentences(F.col(column)), lambda s: F.when(long(s), hard(s)).otherwise(F.array(F.struct(s.alias("text"), estimate(s).cast("int").alias("tokens"))))))
    packed = df.withColumn("parts", parts).withColumn("packed", _packed(F.col("parts"), target, most)).drop("parts")
    # An outer explode, since Spark would pack the texts of a plain one twice, to leave out empty arrays early.
    return packed.select(*df.columns, F.posexplode_outer("packed").alias("ordinal", "c")).where("c IS NOT NULL").select(*df.columns, "ordinal", F.col("c.text").alias("chunk"), F.col("c.tokens").alias("token_count"))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order: exact dedup where the first seen wins."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


def chunking_stage(events: DataFrame, column: str = "text", **how) -> DataFrame:
    """events (event_id, text) cut to chunks and judged: event_id, ordinal, chunk, token_count, seq, verdict, kept_as.

    In order of event and ordinal a chunk is an exact repeat of a stored one, or
    near one, or stored; what collapses isn't remembered.
    """
    from tidemark.operators.neardup import collapse
    from tidemark.sources.store import reliable

    c = chunk_text(events.select("event_id", normalize(F.col(column)).alias(column)), column, **how).drop(column)
    # Packed once: the chunks are judged and then joined with their verdicts.
    c = reliable(c.withColumn("seq", F.shiftleft(F.col("event_id").cast("long"), 24) + F.col("ordinal")))
    return c.join(collapse(c.select("seq", F.col("chunk").alias("text"))).select("seq", "verdict", "kept_as"), "seq")


def stage_volume(judged: DataFrame) -> DataFrame:
    """One row of counters of a chunking stage."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    size, kept = F.length("chunk").cast("long"), F.col("verdict") == "retained"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return judged.agg(
        F.count("*").alias("produced"), n("retained").alias("stored"), n("exact").alias("exact_skips"), n("near").alias("near_skips"),
        total(size).alias("raw_chars"), total(F.when(kept, size)).alias("stored_chars"),
    )


def hourly_volume(df: DataFrame, ts: str = "ts", size: str = "n") -> DataFrame:
    """hour (number since the epoch), rows, chars."""
    hour = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    return df.groupBy(hour.alias("hour")).agg(F.count("*").alias("n_rows"), F.sum(size).cast("long").alias("n_chars"))
