"""The capture engine: a state machine over signals, as a fold and as a streaming operator.

A stream key (a user or device) has its own machine, so streams run apart.
Signals: seq, ts, kind (app_change, text_signal, clipboard, activity, tick,
finish), bundle, app, title, text. text of app_change, activity and tick is
what a text provider would read then.
Output rows: seq, ts, kind (open, screen, clipboard, skip, close), episode, bundle, app, title, text, text_hash,
redaction_flags, provider_calls and idle_calls so far. Exclusion rules decide on
each context, and every text passes the redactor before it is hashed or stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.exclude import DEFAULT_RULES, mode_of
from tidemark.operators.redact import PLACEHOLDER, redacted

IDLE, DEBOUNCE, FALLBACK, MAX_TEXT = 300.0, 2.0, 30.0, 200_000
OUT_SQL = "stream string, seq long, ts double, kind string, episode long, bundle string, app string, title string, text string, text_hash string, redaction_flags int, provider_calls long, idle_calls long"
OUT = [c.split()[0] for c in OUT_SQL.split(", ")]
SIGNAL_COLUMNS = ["seq", "ts", "kind", "bundle", "app", "title", "text"]


@dataclass
class State:
    """What a stream remembers between signals."""

    bundle: str | None = None
    app: str | None = None
    title: str | None = None
    has_context: bool = False
    open_since: float | None = None
    episode: int = 0
    activity: float | None = None
    attempt: float | None = None
    deadline: float | None = None
    idle: bool = False
    seen: dict = field(default_factory=dict)
    provider_calls: int = 0
    idle_calls: int = 0
    text: str | None = None
    seq: int = 0


default_mode = mode_of(DEFAULT_RULES)


class Engine:
    """One stream's machine; `mode` says never_capture, redact or capture of a signal's context,
    `redact` gives a text without its secrets and flags of what they were."""

    def __init__(self, state: State | None = None, mode=default_mode, redact=redacted, idle: float = IDLE, debounce: float = DEBOUNCE, fallback: float = FALLBACK):
        self.s, self.mode, self.redact = state or State(), mode, redact
        self.idle, self.debounce, self.fallback = idle, debounce, fallback

    def feed(self, x: dict) -> list[dict]:
        out: list[dict] = []
        self.s.seq = x["seq"]
        if x["kind"] != "clipboard":  # a provider would read this until something else shows
            self.s.text = x["text"] if x["text"] is not None or x["kind"] == "app_change" else self.s.text
        getattr(self, "_" + x["kind"])(x, out)
        return out

    def due(self) -> float | None:
        """When the next timer is to fire: the idle bound, the debounce deadline, or the fallback capture."""
        s, times = self.s, []
        if s.idle or s.activity is None:
            return None
        times.append(s.activity + self.idle)
        if s.deadline is not None:
            times.append(s.deadline)
        elif s.open_since is not None and s.attempt is not None and s.activity > s.attempt:
            times.append(max(s.attempt + self.fallback, s.activity))
        return min(times)

    def advance(self, now: float) -> list[dict]:
        """What the timers due by now give, each at its own time; the text is the last that the context showed."""
        out: list[dict] = []
        while (at := self.due()) is not None and at <= now:
            self._tick({"seq": self.s.seq, "ts": at, "kind": "tick", "text": self.s.text}, out)
        return out

    def _emit(self, x: dict, out: list, kind: str, ts: float, text: str | None = None, flags: int = 0) -> None:
        here = {"bundle": self.s.bundle, "app": self.s.app, "title": self.s.title}
        title = PLACEHOLDER if self.s.title is not None and self.mode(here) == "redact" else self.s.title
        digest = hashlib.sha256(text.encode()).hexdigest() if text is not None else None
        out.append({"seq": x["seq"], "ts": ts, "kind": kind, "episode": self.s.episode, **here, "title": title, "text": text, "text_hash": digest, "redaction_flags": flags, "provider_calls": self.s.provider_calls, "idle_calls": self.s.idle_calls})

    def _same(self, x: dict) -> bool:
        return self.s.has_context and (self.s.bundle, self.s.title or "") == (x["bundle"], x["title"] or "")

    def _enter(self, x: dict) -> None:
        self.s.bundle, self.s.app, self.s.title, self.s.has_context = x["bundle"], x["app"], x["title"], True

    def _active(self, ts: float) -> None:
        self.s.activity, self.s.idle = ts, False

    def _open(self, x: dict, out: list) -> None:
        self.s.episode += 1
        self.s.open_since, self.s.seen = x["ts"], {}
        self._emit(x, out, "open", x["ts"])

    def _close(self, x: dict, out: list, ts: float) -> None:
        if self.s.open_since is not None:
            self._emit(x, out, "close", max(ts, self.s.open_since))
            self.s.open_since = None

    def _store(self, x: dict, out: list, kind: str, text: str, slot: str) -> None:
        text = PLACEHOLDER if self.mode(x) == "redact" else " ".join(text[:MAX_TEXT].split())
        if not text:
            return
        text, flags = self.redact(text)
        digest = hashlib.sha256(text.encode()).hexdigest()
        if self.s.seen.get(slot) == digest:
            self._emit(x, out, "skip", x["ts"], text, flags)
            return
        self.s.seen[slot] = digest
        self._emit(x, out, kind, x["ts"], text, flags)

    def _capture(self, x: dict, out: list) -> None:
        self.s.attempt = x["ts"]
        if self.mode(x) != "redact":
            self.s.provider_calls += 1
            self.s.idle_calls += int(self.s.idle)
        self._store(x, out, "screen", x["text"] or "", f"screen|{self.s.bundle}|{self.s.title or ''}")

    def _app_change(self, x: dict, out: list) -> None:
        self._active(x["ts"])
        if self.mode(x) == "never_capture":
            self.s.deadline = None
            self._close(x, out, x["ts"])
            self._enter(x)
            return
        if self._same(x):
            self._enter(x)
            if self.s.open_since is None:
                self._open(x, out)
                self._capture(x, out)
            return
        self.s.deadline = None
        self._close(x, out, x["ts"])
        self._enter(x)
        self._open(x, out)
        self._capture(x, out)

    def _text_signal(self, x: dict, out: list) -> None:
        if not self.s.idle and self._same(x) and self.s.open_since is not None:
            self.s.deadline = x["ts"] + self.debounce

    def _clipboard(self, x: dict, out: list) -> None:
        self._active(x["ts"])
        if self.mode(x) == "never_capture":
            return
        if self.s.open_since is None or not self._same(x):
            self._close(x, out, x["ts"])
            self._enter(x)
            self._open(x, out)
        self._store(x, out, "clipboard", x["text"] or "", f"clipboard|{x['bundle']}|{x['title'] or ''}")

    def _activity(self, x: dict, out: list) -> None:
        self._active(x["ts"])
        x = {**x, "bundle": self.s.bundle, "app": self.s.app, "title": self.s.title}
        if self.s.has_context and self.s.open_since is None and self.mode(x) != "never_capture":
            self._open(x, out)
            self._capture(x, out)

    def _tick(self, x: dict, out: list) -> None:
        x = {**x, "bundle": self.s.bundle, "app": self.s.app, "title": self.s.title}
        now, last = x["ts"], self.s.activity
        if not self.s.idle and last is not None and now - last >= self.idle:
            self.s.idle, self.s.deadline = True, None
            self._close(x, out, last)
            return
        if self.s.idle:
            return
        if self.s.deadline is not None:
            if now >= self.s.deadline:
                self.s.deadline = None
                self._capture(x, out)
        elif self.s.open_since is not None and self.s.attempt is not None and last is not None and last > self.s.attempt and now - self.s.attempt >= self.fallback:
            self._capture(x, out)

    def _finish(self, x: dict, out: list) -> None:
        self.s.deadline = None
        self._close(x, out, x["ts"])


def replay(signals: Iterable[dict], mode=default_mode, redact=redacted) -> tuple[list[dict], State]:
    """All output of a list of signals, and the last state."""
    e, out = Engine(mode=mode, redact=redact), []
    for x in signals:
        out += e.feed(x)
    return out, e.s


def folded(signals: DataFrame, by: str = "stream", mode=default_mode, redact=redacted, timers: bool = False, **bounds: float) -> DataFrame:
    """The engine over a finished table: each stream's signals pass through in order, none is held.

    timers: idle, debounce and fallback fire at their own times, those left at
    a stream's end too; else tick signals drive them. bounds: idle, debounce, fallback.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new = lambda: Engine(mode=mode, redact=redact, **bounds)
        key, e = None, new()
        for b in batches:
            rows = []
            for x in b.astype(object).where(b.notna(), None).to_dict("records"):
                if x[by] != key:
                    rows += [{"stream": key, **r} for r in (e.advance(float("inf")) if timers else ())]
                    key, e = x[by], new()
                rows += [{"stream": key, **r} for r in [*(e.advance(x["ts"]) if timers else ()), *e.feed(x)]]
            yield pd.DataFrame(rows, columns=OUT)
        yield pd.DataFrame([{"stream": key, **r} for r in (e.advance(float("inf")) if timers else ())], columns=OUT)

    ordered = signals.select(by, *SIGNAL_COLUMNS).repartition(by).sortWithinPartitions(by, "seq")
    return ordered.mapInPandas(run, OUT_SQL)


STATE_SQL = "json string"


def streamed(signals: DataFrame, by: str = "stream", mode=default_mode, redact=redacted) -> DataFrame:
    """The engine over a stream of signals: state per key, output in append mode.

    Rows of a micro-batch are taken in order of seq; a later batch must not
    bring smaller numbers. Ticks drive idle closing, as in the batch form.
    """
    import json

    import pandas as pd

    def step(key, batches, state):
        held = State(**json.loads(state.get[0])) if state.exists else State()
        e, rows = Engine(held, mode=mode, redact=redact), []
        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts).sort_values("seq")
            for x in b.astype(object).where(b.notna(), None).to_dict("records"):
                rows += [{"stream": key[0], **r} for r in e.feed(x)]
        state.update((json.dumps(asdict(e.s)),))
        yield pd.DataFrame(rows, columns=OUT)

    return signals.select(by, *SIGNAL_COLUMNS).groupBy(by).applyInPandasWithState(step, OUT_SQL, STATE_SQL, "append", "NoTimeout")


class CatalogSink:
    """A foreachBatch function that files episodes once they close.

    Engine rows wait in a staging table (under `staging`) until their episode's
    close row comes; then episode, events and chunks are ingested together into
    the shard of the episode's start. A batch reads what the one before left
    open, and leaves behind what is open after it: its cost follows the open
    episodes, not the history. A batch that runs again overwrites its own
    directory and its ingest is done once (by name and batch number), so a retry
    adds nothing twice. Episodes without events are dropped. A chunk that repeats
    one of its stream, of any batch before or its own, exactly or nearly, isn't
    stored; its event is.
    """

    def __init__(self, store, staging: str, name: str = "sink", merge_every: int = 32):
        from tidemark.operators.neardup import DupIndex

        self.store, self.staging, self.name, self.merge_every = store, staging, name, merge_every
        self.known = DupIndex(store.spark, f"{staging}/known")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from tidemark.operators.chunk import chunk_text
        from tidemark.schemas import DEFAULT_PROVENANCE

        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.staging}/batch={batch_id}")
        rows = spark.read.schema(OUT_SQL).parquet(f"{self.staging}/batch={batch_id}")
        if self.store.exists(f"{self.staging}/open={batch_id - 1}"):
            rows = rows.unionByName(spark.read.schema(OUT_SQL).parquet(f"{self.staging}/open={batch_id - 1}"))
        ended = rows.where("kind = 'close'").select("stream", "episode").distinct()
        rows.join(ended, ["stream", "episode"], "left_anti").write.mode("overwrite").parquet(f"{self.staging}/open={batch_id}")
        name = F.concat_ws("-", "stream", F.col("episode").cast("string"))
        rows = rows.withColumn("episode_id", name).withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
        closed = rows.where("kind = 'close'").select("episode_id", F.col("at").alias("ts_end"))
        events = rows.where(F.col("kind").isin("screen", "clipboard")).join(closed.select("episode_id"), "episode_id", "left_semi")
        events = events.select(F.concat_ws("-", "episode_id", F.col("seq").cast("string")).alias("id"), "episode_id", F.col("at").alias("ts"), F.col("kind").alias("type"), F.lit("ax").alias("source"), F.lit(1.0).alias("confidence"), F.col("text").alias("raw_text"), "text_hash", "redaction_flags", F.lit(DEFAULT_PROVENANCE).alias("provenance"))
        opened = rows.where("kind = 'open'").select("episode_id", F.col("at").alias("ts_start"), F.col("bundle").alias("bundle_id"), F.col("app").alias("app_name"), F.col("title").alias("window_title"))
        episodes = opened.join(closed, "episode_id").join(events.select("episode_id").distinct(), "episode_id", "left_semi").withColumnRenamed("episode_id", "id")
        chunks = chunk_text(events.select("id", "episode_id", "ts", "source", F.col("raw_text").alias("text")))
        chunks = chunks.select(F.concat_ws("-", "id", F.col("ordinal").cast("string")).alias("id"), "episode_id", F.col("id").alias("event_id"), F.col("chunk").alias("text"), "token_count", F.col("ts").alias("ts_capture"), "source")
        verdicts = self.known.judge(chunks.select("id", F.regexp_replace("episode_id", "-[^-]*$", "").alias("scope"), F.col("ts_capture").alias("at"), "text"), batch_id)
        chunks = chunks.join(verdicts.where("verdict = 'retained'").select("id"), "id", "left_semi")
        self.store.ingest(episodes, events, chunks, f"{self.name}-{batch_id}")
        if batch_id % self.merge_every == 0:
            self.known.compact(batch_id)
        for old in (f"batch={batch_id - 1}", f"open={batch_id - 2}"):
            self.store.delete(f"{self.staging}/{old}")
