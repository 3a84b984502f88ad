"""Stateful operators with timers: capture and title coalescing that end by themselves.

Each key has typed state variables and one timer at most. With event time a
timer fires once the watermark passes it, so other keys' rows are enough; with
processing time the clock is. Rows of a micro-batch are taken in order of seq,
and whatever timer was due before a row fires before it, so the output doesn't
depend on how rows are dealt to micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.redact import redacted
from tidemark.streaming.engine import DEBOUNCE, FALLBACK, IDLE, OUT, OUT_SQL, SIGNAL_COLUMNS, Engine, State, default_mode

#: The class that keeps timers and typed variables; a session sets it before its first such query.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_timers(spark: SparkSession) -> SparkSession:
    """spark, able to run the operators of this module."""
    spark.conf.set(*PROVIDER)
    return spark


class _Timed(StatefulProcessor):
    """One timer a key: `clock` holds when it fires by event time and as it is registered (milliseconds)."""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "registered long, due double")

    def close(self) -> None:
        pass

    def _set(self, due: float | None, now: float, values) -> None:
        """Puts the key's timer at `due`, in the place of the one it has; now: the event time that has been reached."""
        held = self.timer.get() if self.timer.exists() else None
        if held is not None:
            if held[1] == due:
                return
            self.handle.deleteTimer(held[0])
            self.timer.clear()
        if due is not None:
            at = int(due * 1000) + 1 if self.event_time else values.getCurrentProcessingTimeInMs() + max(1, int((due - now) * 1000) + 1)
            self.handle.registerTimer(at)
            self.timer.update((at, due))

    def _fired(self, values) -> tuple[float, float]:
        """The due time of the timer that has fired, and the event time that is reached; the timer is gone."""
        due = self.timer.get()[1]
        self.timer.clear()
        return due, max(due, values.getCurrentWatermarkInMs() / 1000) if self.event_time else due


class Capture(_Timed):
    """The capture engine. Context, episode, clock and counters are values; the last text of each slot is a map, with a time to live if one is given."""

    def __init__(self, event_time: bool, mode, redact, bounds: dict, ttl_ms: int | None):
        super().__init__(event_time)
        self.mode, self.redact, self.bounds, self.ttl_ms = mode, redact, bounds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.context = handle.getValueState("context", "bundle string, app string, title string, has_context boolean, text string")
        self.episode = handle.getValueState("episode", "episode long, open_since double")
        self.clock = handle.getValueState("clock", "activity double, attempt double, deadline double, idle boolean")
        self.counters = handle.getValueState("counters", "provider_calls long, idle_calls long, seq long")
        self.seen = handle.getMapState("seen", "slot string", "digest string", self.ttl_ms)

    def _load(self) -> Engine:
        s = State()
        for held, names in self._values():
            if held.exists():
                for name, value in zip(names, held.get(), strict=True):
                    setattr(s, name, value)
        s.seen = {k[0]: v[0] for k, v in self.seen.iterator()} if self.seen.exists() else {}
        self.before = dict(s.seen)
        return Engine(s, self.mode, self.redact, **self.bounds)

    def _values(self):
        return (self.context, ("bundle", "app", "title", "has_context", "text")), (self.episode, ("episode", "open_since")), (self.clock, ("activity", "attempt", "deadline", "idle")), (self.counters, ("provider_calls", "idle_calls", "seq"))

    def _save(self, s: State) -> None:
        for held, names in self._values():
            held.update(tuple(getattr(s, n) for n in names))
        for slot in self.before.keys() - s.seen.keys():
            self.seen.removeKey((slot,))
        for slot, digest in s.seen.items():
            if self.before.get(slot) != digest:
                self.seen.updateValue((slot,), (digest,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        e, out, now = self._load(), [], 0.0
        for x in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            now = x["ts"]
            out += [*e.advance(now), *e.feed(x)]
        self._save(e.s)
        self._set(e.due(), now, timerValues)
        yield from (Row(**{c: r.get(c, key[0]) for c in OUT}) for r in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        e, (due, now) = self._load(), self._fired(timerValues)
        out = e.advance(now)
        self._save(e.s)
        self._set(e.due(), due, timerValues)
        yield from (Row(**{c: r.get(c, key[0]) for c in OUT}) for r in out)


def captured(signals: DataFrame, by: str = "stream", event_time: bool = True, delay: str = "0 seconds", mode=default_mode, redact=redacted, idle: float = IDLE, debounce: float = DEBOUNCE, fallback: float = FALLBACK, ttl_ms: int | None = None) -> DataFrame:
    """The capture engine over a stream of signals, without tick signals: rows of OUT_SQL.

    event_time: timers follow the watermark of ts, with this delay; else the
    clock. ttl_ms: how long a slot's last text is known, by the clock.
    """
    at = F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))
    rows = signals.select(F.col(by).cast("string").alias("stream"), *SIGNAL_COLUMNS).withColumn("at", at)
    if event_time:
        rows = rows.withWatermark("at", delay)
    processor = Capture(event_time, mode, redact, {"idle": idle, "debounce": debounce, "fallback": fallback}, None if event_time else ttl_ms)
    return rows.groupBy("stream").transformWithState(processor, OUT_SQL, "Append", "EventTime" if event_time else "ProcessingTime")


class Coalesce(_Timed):
    """The first title at once; of those within `gap` seconds the last, when the gap is over, which starts the next one."""

    def __init__(self, event_time: bool, gap: float):
        super().__init__(event_time)
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "title string, at double")
        self.waiting = handle.getValueState("waiting", "title string")

    def _flush(self, stream: str, now: float) -> list[Row]:
        """The waiting title, if its gap is over by now."""
        if not self.waiting.exists() or self.last.get()[1] + self.gap > now:
            return []
        (title,), at = self.waiting.get(), self.last.get()[1] + self.gap
        self.waiting.clear()
        if title == self.last.get()[0]:
            return []
        self.last.update((title, at))
        return [Row(stream=stream, ts=at, title=title, edge="trailing")]

    def _due(self) -> float | None:
        return self.last.get()[1] + self.gap if self.waiting.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, now = [], 0.0
        for x in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            now = x["ts"]
            out += self._flush(key[0], now)
            if self.last.exists() and now < self.last.get()[1] + self.gap:
                self.waiting.update((x["title"],))
            elif not self.last.exists() or x["title"] != self.last.get()[0]:
                self.last.update((x["title"], now))
                out.append(Row(stream=key[0], ts=now, title=x["title"], edge="leading"))
        self._set(self._due(), now, timerValues)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, now = self._fired(timerValues)
        out = self._flush(key[0], now)
        self._set(self._due(), due, timerValues)
        yield from out


def coalesced(titles: DataFrame, gap: float, by: str = "stream", event_time: bool = True, delay: str = "0 seconds") -> DataFrame:
    """stream, ts, title, edge of a stream of title changes (seq, ts, title), with leading and trailing edges."""
    rows = titles.select(F.col(by).cast("string").alias("stream"), "seq", "ts", F.coalesce("title", F.lit("")).alias("title"))
    if event_time:
        rows = rows.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("at", delay)
    return rows.groupBy("stream").transformWithState(Coalesce(event_time, gap), "stream string, ts double, title string, edge string", "Append", "EventTime" if event_time else "ProcessingTime")
