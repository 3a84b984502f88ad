"""Table schemas and closed value sets. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = ("screen", "clipboard", "audio")
SOURCES = ("ax", "ocr", "audio")
PROVENANCE = ("untrusted_ambient", "user_input", "system")
DEFAULT_PROVENANCE = "untrusted_ambient"
#: Bits of redaction_flags.
API_KEY, PRIVATE_KEY, CREDIT_CARD, CUSTOM = 1, 2, 4, 8
SCHEMA_VERSION = 4


EPISODES = "id string, ts_start timestamp, ts_end timestamp, bundle_id string, app_name string, window_title string, url string, summary string, entity_keys array<string>, shard string"
EVENTS = "id string, episode_id string, ts timestamp, type string, source string, confidence double, raw_text string, text_hash string, redaction_flags int, provenance string, shard string"
CHUNKS = "id string, episode_id string, event_id string, text string, token_count int, ts_capture timestamp, ts_event timestamp, source string, model_id string, dim int, shard string"
VECTORS = "chunk_id string, model_id string, dim int, scale float, embedding array<tinyint>, shard string"
POSTINGS = "term string, block int, chunk_id string, len int, tf long, shard string"
MAXIMA = "term string, block int, n long, max_tf long, min_len int, shard string"
LENGTHS = "chunk_id string, len int, shard string"
EGRESS = "ts timestamp, process string, destination string, byte_count long, purpose string"
WRITES = "ts timestamp, draft_id string, destination string, external_key string, outcome string"
CONSENT = "ts timestamp, meeting_id string, decision string"
DRAFTS = "id string, recipe string, destination string, external_key string, payload string, status string, created_at timestamp"
SIGNALS = "seq long, ts double, kind string, bundle string, app string, title string, text string"
TABLES = {"episodes": EPISODES, "events": EVENTS, "chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "maxima": MAXIMA, "lengths": LENGTHS, "egress_ledger": EGRESS, "write_ledger": WRITES, "consent_log": CONSENT, "drafts": DRAFTS}
SHARDED = ("episodes", "events", "chunks", "vectors", "postings", "maxima", "lengths")
#: The columns that a sharded table's files are sorted by.
SORTED = {"episodes": ("ts_start",), "events": ("id",), "chunks": ("id",), "vectors": ("chunk_id",), "postings": ("term", "block", "chunk_id"), "maxima": ("term", "block"), "lengths": ("chunk_id",)}
#: Pages of postings are short, so that a reader of some blocks skips the others.
WRITTEN = {"postings": {"parquet.page.row.count.limit": "1024"}, "maxima": {"parquet.page.row.count.limit": "1024"}}
#: Schema version -> what it added.
VERSIONS = {1: ("episodes", "events", "chunks", "egress_ledger", "write_ledger", "consent_log"), 2: ("vectors", "drafts"), 3: ("postings", "lengths"), 4: ("maxima",)}


def struct(name: str) -> T.StructType:
    """The schema of a stored table."""
    return T.StructType.fromDDL(TABLES[name])
