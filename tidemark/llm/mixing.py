"""Mixing sources to target weights by a low-discrepancy schedule.

Slot j of the schedule maps the golden-ratio point frac(j * phi) through the
cumulative weights of the sources, so every stretch of the schedule holds each
source in its proportion. A source's slots are ranked, and rank r takes block
r modulo the number of its blocks, where the blocks are equal stretches of
words of its shuffled documents. A source whose slots would pass its target
ends with a part of a block.

Everything is DataFrame code. Ranks and running sums are two-level (a sum over
pieces, then one within each piece), so a source that holds a third of all
rows is spread over many tasks.

Cases: a null or empty text has size 0 and is never taken; a long text counts
whole and is dealt to as many blocks as it fills; repeated rows are
rows of their own; a null source is a source, the last one; no rows give no
rows; a tie in the shuffle (equal doc_id) falls to the larger text and then to
either of two equal rows, which no result tells apart. Extra columns are
carried along by `mixed_documents` and ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, table

#: 2**32 / golden ratio, odd: the additive recurrence of the golden ratio in 32 bits.
PHI32 = 2654435769
UNIT = 1 << 32
CELLS = 1024
CHUNK = 65536


def golden_point(j: Column) -> Column:
    """frac(j * phi) * 2**32, in 64-bit steps that cannot overflow."""
    low, high = j.bitwiseAND(F.lit(65535)), F.shiftright(j, 16).bitwiseAND(F.lit(65535))
    upper = (high * F.lit(PHI32)).bitwiseAND(F.lit(65535)) * F.lit(65536)
    return (upper + low * F.lit(PHI32)).bitwiseAND(F.lit(UNIT - 1))


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, weight, target: `share` of all sizes by weight, none above cap * source_size.

    A source is at its cap iff its cap per weight is no more than what a weight
    gets when all sources with less cap per weight are at theirs.
    """
    everything = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("nth", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    before = W.orderBy((F.col("cap") / F.col("weight")).asc(), "nth").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    s = s.withColumn("total", total).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= left / rest)
    gone = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    heavy = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    free = (F.col("total") - gone) * F.col("weight") / F.when(heavy > 0, heavy)
    return s.select("source", "nth", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(free).alias("target"))


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, nth (of the source), block_no, before, take: which words each slot of the mix brings.

    before is what the source has given up to the slot, take how many words of
    the block the slot brings (fewer than the block holds where the target ends).
    """
    spark = targets.sparkSession
    t = targets.where((F.col("target") > 0) & (F.col("source_size") > 0))
    t = t.withColumn("goal", F.round("target").cast("long"))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    upto = W.orderBy("nth")
    whole = F.sum("goal").over(W.partitionBy())
    t = t.withColumn("lo", F.floor((F.sum("goal").over(upto) - F.col("goal")) / whole * UNIT))
    t = t.withColumn("hi", F.floor(F.sum("goal").over(upto) / whole * UNIT))
    cells = t.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 22), F.shiftright(F.col("hi") - 1, 22))))
    # One number leaves the cluster, the count of slots; the points themselves are made on the executors.
    goal = t.agg(F.sum("goal")).first()[0] or 0
    slots = spark.range(-(-goal // block)).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.shiftright("u", 22))
    placed = slots.join(cells, "cell").where("u >= lo AND u < hi").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = placed.groupBy("nth", "chunk").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("nth").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("nth").alias("c_nth"), F.col("chunk").alias("c_chunk"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("nth", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(counts, (F.col("nth") == F.col("c_nth")) & (F.col("chunk") == F.col("c_chunk")))
    ranked = ranked.withColumn("rank", F.col("within") + F.col("first"))
    ranked = ranked.withColumn("block_no", F.col("rank") % F.col("n_blocks"))
    ranked = ranked.withColumn("before", F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + F.col("block_no") * block)
    full = F.least(F.lit(block), F.col("source_size") - F.col("block_no") * block)
    take = F.greatest(F.lit(0), F.least(full, F.col("goal") - F.col("before")))
    return ranked.select("slot", "nth", "block_no", "before", take.alias("take")).where("take > 0")


def shuffled_positions(sized: DataFrame) -> DataFrame:
    """sized plus start: the words that stand before each row in its source's shuffled order.

    The shuffle sorts by the MD5 of doc_id; its first three digits split every
    source into 4,096 pieces whose sizes are summed first.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    s = sized.withColumn("key", key).withColumn("piece", F.substring("key", 1, 3))
    pieces = s.groupBy("nth", "piece").agg(F.sum("size").alias("piece_size"))
    earlier = W.partitionBy("nth").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(F.col("nth").alias("p_nth"), F.col("piece").alias("p_piece"), F.coalesce(F.sum("piece_size").over(earlier), F.lit(0)).alias("piece_start"))
    inside = W.partitionBy("nth", "piece").orderBy("key", "doc_id", F.desc("size"), "row").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s = s.join(pieces, (F.col("nth") == F.col("p_nth")) & (F.col("piece") == F.col("p_piece")))
    return s.withColumn("start", F.col("inside") + F.col("piece_start")).drop("key", "piece", "inside", "piece_start", "p_nth", "p_piece")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    taken counts the words the mix takes of it, repeats included. A document of
    a source whose target is at most cap * source_size is never taken more than
    ceil(cap) times.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Word counts are read by five branches: the checkpoint keeps the texts from being read five times.
    sized = cut(docs.select("doc_id", "source", size.alias("size")).withColumn("row", F.monotonically_increasing_id()))
    targets = cut(source_targets(sized, weights, share, cap))
    sources = targets.select(F.col("source").alias("of"), "nth", "source_size", "target")
    s = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    s = shuffled_positions(s)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    spans = s.withColumn("b", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last))))
    slots = slot_schedule(targets, block).select(F.col("nth").alias("s_nth"), "block_no", "take")
    hit = spans.join(slots, (F.col("nth") == F.col("s_nth")) & (F.col("b") == F.col("block_no")), "left")
    base = F.col("b") * block
    overlap = F.least(F.col("start") + F.col("size"), base + F.coalesce("take", F.lit(0))) - F.greatest(F.col("start"), base)
    taken = F.sum(F.greatest(F.lit(0), F.coalesce(overlap, F.lit(0)))).alias("taken")
    return hit.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(taken).drop("row")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source),
s1 AS (SELECT *, CAST(CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before FROM s1
  WINDOW w AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap / weight <= (total - cap_before) / (all_weight - weight_before) AS capped FROM s2),
s4 AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS gone, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS heavy FROM s3),
targets AS (SELECT source, nth, source_size, CASE WHEN capped THEN cap ELSE (total - gone) * weight / heavy END AS target FROM s4),
t1 AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CAST(ceil(source_size / 64.0) AS BIGINT) AS n_blocks FROM targets WHERE target > 0 AND source_size > 0),
t2 AS (SELECT *, CAST(floor(CAST(sum(goal) OVER (ORDER BY nth) - goal AS DOUBLE) / CAST(sum(goal) OVER () AS DOUBLE) * 4294967296) AS BIGINT) AS lo,
  CAST(floor(CAST(sum(goal) OVER (ORDER BY nth) AS DOUBLE) / CAST(sum(goal) OVER () AS DOUBLE) * 4294967296) AS BIGINT) AS hi FROM t1),
points AS (SELECT r.range AS slot, CAST((CAST(r.range AS HUGEINT) * 2654435769) % 4294967296 AS BIGINT) AS u
  FROM range(CAST((SELECT (sum(goal) + 63) // 64 FROM t1) AS BIGINT)) r),
ranked AS (SELECT p.slot, t2.*, row_number() OVER (PARTITION BY t2.nth ORDER BY p.slot) - 1 AS rank FROM points p JOIN t2 ON p.u >= t2.lo AND p.u < t2.hi),
slots AS (SELECT nth AS s_nth, rank % n_blocks AS block_no, greatest(0, least(64, source_size - (rank % n_blocks) * 64,
  goal - ((rank // n_blocks) * source_size + (rank % n_blocks) * 64))) AS take FROM ranked),
placed AS (SELECT d.doc_id, d.size, t.nth, t.source_size, t.target, row_number() OVER () AS row,
  coalesce(sum(d.size) OVER (PARTITION BY t.nth ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
spans AS (SELECT *, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 AS BIGINT) + 1)) AS b FROM placed WHERE size > 0),
got AS (SELECT row, sum(greatest(0, least(start + size, b * 64 + take) - greatest(start, b * 64))) AS taken FROM spans JOIN slots ON s_nth = nth AND block_no = b GROUP BY row)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken FROM placed p LEFT JOIN got g ON g.row = p.row
"""
