"""Command line: version, simulate, search.

    python -m tidemark simulate
    python -m tidemark search --store file:///data/store "what did we decide"
"""

from __future__ import annotations

import argparse

VERSION = "0.1.0"


def simulate() -> int:
    """Replays a scripted workday and checks its counters."""
    from tidemark.streaming.engine import replay

    script = [
        (0, "app_change", "editor", "notes", "a plan"), (10, "text_signal", "editor", "notes", None), (13, "tick", None, None, "a plan with dates"), (15, "clipboard", "editor", "notes", "a date"),
        (60, "app_change", "mail", "outbox", "a letter"), (400, "tick", None, None, "a letter"), (450, "activity", None, None, "a letter"), (470, "finish", None, None, None),
    ]
    out, _ = replay({"seq": i, "ts": float(t), "kind": k, "bundle": b, "app": b, "title": title, "text": x} for i, (t, k, b, title, x) in enumerate(script))
    kinds = [r["kind"] for r in out]
    counted = {k: kinds.count(k) for k in ("open", "close", "screen", "clipboard", "skip")}
    good = counted == {"open": 3, "close": 3, "screen": 4, "clipboard": 1, "skip": 0}
    print(("simulate OK: " if good else "simulate FAILED: ") + str(counted))
    return 0 if good else 1


def search(root: str, text: str, limit: int) -> int:
    """Embeds what has no vector yet, searches, and prints the answer."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.operators import embed, retrieve, serve
    from tidemark.sources.store import Store

    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, root)
    store.upsert_vectors(embed.embed_backlog(store.read("chunks").withColumnRenamed("id", "chunk_id"), store.read("vectors")))
    found = store.search(retrieve.Query(text, limit=limit), query_vector=embed.query_vector(text))
    rows = serve.rendered(found.withColumn("q", F.lit(0)).withColumn("ts", F.date_format("ts_capture", "yyyy-MM-dd'T'HH:mm:ss'Z'")), ["q"]).collect()
    print(rows[0]["answer"] if rows else serve.NOTHING)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("simulate")
    s = sub.add_parser("search")
    s.add_argument("--store", required=True)
    s.add_argument("--limit", type=int, default=8)
    s.add_argument("text")
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    return simulate() if a.command == "simulate" else search(a.store, a.text, a.limit)


if __name__ == "__main__":
    raise SystemExit(main())
