"""Sessions and capture statistics of finished signal tables (the batch form of the streaming engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDLE = 300


def idle_sessions(events: DataFrame, gap: int = IDLE, by: list[str] | None = None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """by.., session, ts_start, ts_end, n_events: a gap of `gap` seconds or more starts a session.

    Without `by` there is one stream, whose time slices are worked on apart and stitched.
    """
    if not by:
        return stitched_sessions(events, gap, ts)
    w = W.partitionBy(*by).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((at - F.lag(at).over(w) >= gap * 1_000_000).cast("int"), F.lit(1))
    s = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*by, "session").agg(F.min(ts).alias("ts_start"), F.max(ts).alias("ts_end"), F.count("*").alias("n_events"))


def stitched_sessions(events: DataFrame, gap: int = IDLE, ts: str = "ts", slices: int | None = None) -> DataFrame:
    """session, ts_start, ts_end, n_events of one global stream, with no task that holds more than a slice.

    Events of one instant count as one row. Instants are cut into slices of
    about equal numbers of them, by approximate quantiles. A slice is summed up
    as its first and last instant and the sessions that start within it; a
    prefix pass over the summaries (one row a slice) gives each slice the number
    of sessions begun before it. Null instants take no part.
    """
    n = slices or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = events.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("ts")).agg(F.count("*").alias("n")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = sorted(set(at.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    at = at.withColumn("slice", place)
    within = W.partitionBy("slice").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(within) >= gap * 1_000_000).cast("long"), F.lit(0))
    local = at.withColumn("new", new)
    sums = local.groupBy("slice").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("new").alias("inside"))
    order = W.orderBy("slice")  # one row a slice
    opens = F.when(F.col("first") - F.lag("last").over(order) < gap * 1_000_000, 0).otherwise(1)
    before = F.sum(F.col("opens") + F.col("inside")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("inside")
    offsets = sums.withColumn("opens", opens).select("slice", before.alias("before"))
    numbered = local.withColumn("own", F.sum("new").over(within.rowsBetween(W.unboundedPreceding, 0))).join(F.broadcast(offsets), "slice")
    return numbered.groupBy((F.col("before") + F.col("own")).alias("session")).agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.sum("n").alias("n_events"))


def context_episodes(signals: DataFrame, key: list[str], gap: int = IDLE, by: list[str] | None = None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """signals plus episode: a new key or an idle gap starts one."""
    by = by or []
    w = W.partitionBy(*by).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    other = F.lit(False)
    for k in key:
        other = other | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    new = F.when(F.lag(at).over(w).isNull() | other | (at - F.lag(at).over(w) >= gap * 1_000_000), 1).otherwise(0)
    return signals.withColumn("new", new).withColumn("episode", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def consecutive_distinct(events: DataFrame, by: list[str], hash_: str, order: list[str]) -> DataFrame:
    """events without those whose hash is that of the one before within `by`."""
    before = F.lag(hash_).over(W.partitionBy(*by).orderBy(*order))
    return events.withColumn("before", before).where(~F.col(hash_).eqNullSafe(F.col("before"))).drop("before")


def sweep_distinct(captures: DataFrame) -> DataFrame:
    """captures (sweep long, window_id, hash) plus stored: unchanged since the sweep before, in which the window was."""
    w = W.partitionBy("window_id").orderBy("sweep")
    same = (F.lag("sweep").over(w) == F.col("sweep") - 1) & (F.lag("hash").over(w) == F.col("hash"))
    return captures.withColumn("stored", ~F.coalesce(same, F.lit(False)))


def capture_stats(log: DataFrame) -> DataFrame:
    """One row of counters of an engine's output (kind; provider_calls and idle_calls so far, by stream)."""
    n = lambda cond: F.count_if(cond)
    streams = log.groupBy("stream").agg(
        *[n(F.col("kind") == k).alias(k) for k in ("open", "close", "screen", "clipboard", "skip")],
        F.max("provider_calls").alias("calls"), F.max("idle_calls").alias("idle"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return streams.agg(
        total("open", "episodes_opened"), total("close", "episodes_closed"), total("screen", "screen_events"), total("clipboard", "clipboard_events"),
        total("skip", "dedup_skips"), total("calls", "provider_calls"), total("idle", "idle_provider_calls"),
    )


def ambient_sweeps(captures: DataFrame, rules=None) -> DataFrame:
    """The windows of sweeps as the engine sees them, plus mode, text (redacted), redaction_flags, text_hash and outcome.

    captures: sweep (consecutive numbers), window_id, bundle, app, title, url,
    text (null where nothing was read). A window's text is stored as an episode
    of its own, apart from the focused stream, unless it is that stored last
    while the window has been in each sweep. outcome: excluded, nothing, skip
    or stored. A redact rule stores a placeholder and reads nothing.
    """
    from tidemark.functions.text import capped, normalize, text_hash
    from tidemark.operators import exclude, redact

    rules = exclude.DEFAULT_RULES if rules is None else rules
    c = captures.withColumn("mode", exclude.exclusion_mode(rules))
    read = F.when(F.col("mode") == "capture", F.nullif(normalize(capped(F.col("text"))), F.lit("")))
    c = redact.redact(c.withColumn("text", read))
    masked = F.col("mode") == "redact"
    c = c.withColumn("text", F.when(masked, F.lit(redact.PLACEHOLDER)).otherwise(F.col("text")))
    c = c.withColumn("title", F.when(masked, F.lit(redact.PLACEHOLDER)).otherwise(F.col("title"))).withColumn("text_hash", F.when(F.col("text").isNotNull(), text_hash(F.col("text"))))
    w = W.partitionBy("window_id").orderBy("sweep")
    c = c.withColumn("stretch", F.col("sweep") - F.row_number().over(w))
    before = F.last("text_hash", True).over(W.partitionBy("window_id", "stretch").orderBy("sweep").rowsBetween(W.unboundedPreceding, -1))
    same = before.eqNullSafe(F.col("text_hash"))
    outcome = F.when(F.col("mode") == "never_capture", "excluded").when(F.col("text").isNull(), "nothing").when(same, "skip").otherwise("stored")
    return c.withColumn("outcome", outcome).drop("stretch")


def sweep_stats(swept: DataFrame) -> DataFrame:
    """One row of counters of ambient_sweeps: episodes, events, provider calls, skips."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    stored = F.col("outcome") == "stored"
    return swept.agg(n(stored, "ambient_episodes"), n(stored, "ambient_events"), n(F.col("mode") == "capture", "ambient_provider_calls"), n(F.col("outcome") == "skip", "ambient_dedup_skips"))


def sweep_log(swept: DataFrame) -> DataFrame:
    """sweep, window_id, step, kind, title, text, text_hash, redaction_flags: open, event and close of each stored window."""
    event = F.col("kind") == "event"
    stored = swept.where("outcome = 'stored'").select("*", F.posexplode(F.array(F.lit("open"), F.lit("event"), F.lit("close"))).alias("step", "kind"))
    return stored.select("sweep", "window_id", "step", "kind", "title", *[F.when(event, F.col(c)).alias(c) for c in ("text", "text_hash", "redaction_flags")])
