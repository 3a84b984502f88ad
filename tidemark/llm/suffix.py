"""Suffix-array dedup: bytes covered by long strings that also start elsewhere.

The suffixes that can share so many bytes are brought together by anchors,
sorted within their buckets, and judged by longest-previous-factor arrays: the
common prefix with the previous or next smaller position in suffix order is the
longest earlier match (see repeats). With keep="first" the earliest copy stays
and later ones go; with keep="none" the factors of the reversed positions, the
longest later matches, count as well and all copies go. Strings are judged on
the input.

The report removes strings of LENGTH bytes. The same arrays also say which
bytes strings of PASSAGE bytes cover: some forty words, so that a repeated
passage of over fifty words shows in `n_passage` though it is too short to go.

Cases: a null text counts as empty and stays null in `deduplicated`; texts
shorter than the length lose nothing; a text of any length is cut into runs of
bounded size; rows that repeat doc_id and text get the same result; rows of one
doc_id with different texts are documents of their own, in order of the texts'
hashes; a null doc_id counts as the least; no rows give no rows; columns beyond
doc_id and text are carried through by `deduplicated`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import byte_values
from tidemark.llm.common import boxed, table, unboxed, utf8_column
from tidemark.llm.repeats import MOST, SPAN_SQL, Units, covered, identified, repeated_ranges

LENGTH, ANCHOR = 400, 100
#: Shorter strings that the report counts, and that the corpus pipeline removes, with their anchors.
PASSAGE, PASSAGE_ANCHOR = 200, 40


def split(data: np.ndarray, ends: np.ndarray):
    """Units of a text are its bytes."""
    return byte_values(False)[data], data, ends


BYTES = Units(split, np.uint8)


def ranged(docs: DataFrame, keep: str, length: int, anchor: int, most: int, floor: int | None = None) -> DataFrame:
    """identified docs plus ranges."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    d = identified(docs)
    found = repeated_ranges(d.select("key", "dig", "text"), BYTES, length, anchor, keep == "first", most=most, floor=floor)
    return d.join(found, ["key", "dig"], "left")


def removal_report(docs: DataFrame, keep: str = "none", length: int = LENGTH, passage: int = PASSAGE, anchor: int = PASSAGE_ANCHOR, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage (bytes in repeated strings of `passage` bytes) of every row."""

    def run(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            out = {c: [] for c in schema.names}
            out["doc_id"] = b.column("doc_id").to_pylist()
            for i, r in enumerate(b.column("ranges").to_pylist()):
                raw = data[ends[i] : ends[i + 1]]
                gone = covered(r, len(raw), length)
                kept = hashlib.sha256()
                at = 0
                for lo, hi in gone.tolist():
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int((gone[:, 1] - gone[:, 0]).sum()))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(kept.hexdigest())
                short = covered(r, len(raw), passage)
                out["n_passage"].append(int((short[:, 1] - short[:, 0]).sum()))
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage", pa.int64())])
    d = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep, length, anchor, most, passage)
    return d.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def without(raw: np.ndarray, gone: np.ndarray) -> bytes:
    """raw without the stretches; a character goes only as a whole."""
    inner = (raw & 0xC0) == 0x80
    parts, at = [], 0
    for lo, hi in gone.tolist():
        while lo < hi and inner[lo]:
            lo += 1
        while hi > lo and hi < len(raw) and inner[hi]:
            hi -= 1
        parts.append(raw[at:lo].tobytes())
        at = hi
    parts.append(raw[at:].tobytes())
    return b"".join(parts)


def deduplicated(docs: DataFrame, keep: str = "first", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """docs with the repeated strings cut from text; other columns stay."""

    @F.pandas_udf("string")
    def cut(text, ranges):
        import pandas as pd

        def one(t, r):
            if r is None:
                return t
            x = np.frombuffer(t.encode(), np.uint8)
            return without(x, covered(list(r), len(x), length)).decode()

        return pd.Series([one(t, r) for t, r in zip(text, ranges, strict=True)], dtype=object)

    box = boxed(docs, "doc_id", "text")
    d = ranged(box, keep, length, anchor, most)
    return unboxed(d.withColumn("text", cut("text", F.col("ranges").cast(SPAN_SQL))), docs.columns, text=F.when(F.col("row.text").isNotNull(), F.col("text")))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
