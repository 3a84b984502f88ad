"""Substring dedup of 20-word windows behind a count-min prefilter.

First pass: the anchors of all windows (see repeats; equal windows have equal
anchors) are counted in a count-min sketch (see sketch). A merged cell is at least
the count of each anchor in it, and an anchor's count at least that of each of its
windows, so an estimate below two proves a window unique. Second pass: only
windows estimated repeated are grouped exactly, by their words.

The sketch is sized by the corpus, some LOAD cells for each anchor, up to 2**BITS
cells a row. Beyond some 4 GB of text (CROWDED) it lets many unique windows
through; their anchors are then counted exactly before anything else is grouped.

Whole texts are shuffled only where they lose something. A Bloom filter of the
segments to compare says which ones a third pass cuts out where it reads them; one
of the documents with repeated windows says which texts meet their ranges. What
passes a filter by chance is a segment met by no other, a later place of one that
stands earlier too, or a text that finds no ranges.

Words are told apart by 64-bit hashes. A word goes if a window over it also
starts earlier: in a smaller doc_id, or in the same document before.

Cases: null and empty texts have no words; texts under 20 words lose none; a text
of any length is cut into runs of bounded size; rows that repeat doc_id and text
get the same result, none earlier than the other; rows of one doc_id with
different texts are documents of their own, in order of the texts' hashes; a null
doc_id counts as the least; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import words
from tidemark.llm.common import slabs, table, utf8_column
from tidemark.llm.repeats import MOST, SLAB, Units, covered, identified, pieces, repeated_ranges, runs, written
from tidemark.llm.sketch import CELLS_SQL, LEAST_BITS, all_set, cells, membership, packed, sized

WINDOW, ANCHOR = 20, 6
#: A text has an anchor in some so many bytes.
ANCHOR_BYTES = 48
#: Anchors a cell beyond which the sketch lets so many unique ones through that anchors are grouped exactly first.
CROWDED = 0.3


def split(data: np.ndarray, ends: np.ndarray):
    """Units of a text are its words, by hash."""
    first, _, _, h, _ = words(data, ends)
    return h, h, np.searchsorted(first, ends)


WORDS = Units(split, np.uint64)


def anchors_of(docs: DataFrame) -> float:
    """Some number of anchors in these documents, by their bytes."""
    return (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ANCHOR_BYTES


def merged_sketch(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = LEAST_BITS) -> list[np.ndarray]:
    """For each row of the sketch of the windows' anchors, a packed bit per cell: whether the merged count is two or more."""

    def anchors(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            for first, last in slabs(ends, SLAB):
                h, _, bounds = split(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
                for _, lo, hi, e in pieces(bounds, SLAB, window):
                    yield runs(h[lo:hi], e, window, anchor)[3]

    # Counts beyond two say nothing more: a third equal cell of a task goes.
    parts = docs.select("text").mapInArrow(lambda batches: cells(anchors(batches), bits, 2), CELLS_SQL)
    return packed(parts, bits, 2)


def estimated_repeated(sketch: list[np.ndarray], h: np.ndarray, bits: int) -> np.ndarray:
    return all_set(sketch, h, bits)


def removal_report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; bits: the sketch's size, else by the corpus."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = anchors_of(docs)
    bits = bits or sized(anchors)
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, window, anchor, bits))
    d = identified(docs)
    wanted = lambda h: estimated_repeated(sketch.value, h, bits)
    found = written(repeated_ranges(d.select("key", "dig", "text"), WORDS, window, anchor, True, wanted, most, sifted=anchors <= CROWDED * 2**bits), "ranges")
    touched = membership(found.select("key", "dig"), found.count())

    def sieve(batches, lose: bool):
        """The rows that may lose words, or the others."""
        for b in batches:
            may = touched(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "dig")))
            if (may == lose).any():
                yield b.filter(pa.array(may == lose))

    def run(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            out = {c: [] for c in schema.names}
            out["doc_id"] = b.column("doc_id").to_pylist()
            ranges = b.column("ranges").to_pylist()
            for lo_doc, hi_doc in slabs(ends, SLAB):
                base = ends[lo_doc]
                part = data[base : ends[hi_doc]]
                first, last, _, _, _ = words(part, ends[lo_doc : hi_doc + 1] - base)
                bounds = np.searchsorted(first, ends[lo_doc : hi_doc + 1] - base)
                raw = part.tobytes()
                for i in range(lo_doc, hi_doc):
                    f, t = first[bounds[i - lo_doc] : bounds[i - lo_doc + 1]], last[bounds[i - lo_doc] : bounds[i - lo_doc + 1]]
                    kept = np.ones(len(f), bool)
                    for lo, hi in covered(ranges[i], len(f), window).tolist():
                        kept[lo:hi] = False
                    text = b" ".join([raw[a:z] for a, z in zip(f[kept].tolist(), t[kept].tolist(), strict=True)])
                    out["n_words"].append(len(f))
                    out["n_removed"].append(int(len(f) - kept.sum()))
                    out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    # Texts that lose nothing are reported where they are read; only the others meet their ranges.
    d, result = d.select("key", "dig", "doc_id", "text"), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    whole = d.withColumn("ranges", F.lit(None).cast(found.schema["ranges"].dataType)).mapInArrow(lambda batches: run(sieve(batches, False)), result)
    met = d.mapInArrow(lambda batches: sieve(batches, True), "key long, dig long, doc_id long, text string").join(found, ["key", "dig"], "left")
    return met.select("doc_id", "text", "ranges").mapInArrow(run, result).unionByName(whole)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT *, CASE WHEN lead(i, 19) OVER (PARTITION BY rid ORDER BY i) IS NOT NULL
  THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS g FROM p),
e AS (SELECT rid, i, min(doc_id) OVER (PARTITION BY g) < doc_id OR min(i) OVER (PARTITION BY g, rid) < i AS hit FROM g WHERE g IS NOT NULL),
c AS (SELECT p.*, coalesce(bool_or(hit) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN e ON e.rid = p.rid AND e.i = p.i),
r AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (rid)
"""
