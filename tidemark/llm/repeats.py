"""Repeated strings of L units (bytes or words) in a corpus, without listing all windows.

1. Anchors. The least hash among the k-unit stretches of a window of `floor`
   units is its anchor. Neighbouring windows share anchors, so a text falls into
   runs of windows with one anchor; a run's segment is all that strings of L
   units from its windows cover (up to the text's end). Equal windows have equal
   anchors at equal offsets: they meet in the bucket of the anchor's hash h.
   A text has some 2 / (floor - k + 2) runs a unit.
2. Equal segments. Runs are grouped by (h, digest of the segment). What occurs
   twice is repeated as a whole: equal suffixes are one row with a counter.
3. Suffix order. Where a bucket holds different segments their units are fetched,
   once for each distinct segment, and suffixes sorted: those at the anchor
   first; those one unit further left follow by a stable sort on that unit. Each
   order has its array of longest common prefixes. From a suffix, the previous
   and the next one in order that stand at a smaller position have the longest
   earlier match: the greater of the two common prefixes is the suffix's longest
   previous factor. Factors of the reversed positions are the longest later
   matches. A factor of L units is a repeated string; `floor` asks for shorter
   ones too, from the same arrays.
   A bucket with more than `most` distinct segments isn't brought into a task:
   its windows are grouped by digest, in as many tasks as there are.
4. Ranges of repeated window starts go back to the documents.

Documents are rows (key, dig): their doc_id (null: the least long) and the
hash of their text. Rows that repeat both are occurrences of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import prefix, stretches
from tidemark.llm.common import bounded_batches, mixed, scratch, slabs, utf8_column
from tidemark.llm.sketch import membership

NONE = -(1 << 63)
SLAB = 1 << 18
PLACE = 28
#: Distinct segments of a bucket that one task may sort.
MOST = 40_000
BLOCK = 4096


def least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i : i + w]) for each i with a whole window, by prefix and suffix minima of blocks of w."""
    n = len(v)
    if n < w:
        return np.zeros(0, v.dtype)
    full = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    full[:n] = v
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(values: np.ndarray, ends: np.ndarray, length: int, k: int):
    """first window, number of windows, anchor, anchor hash and document of each run, in order.

    values holds a 64-bit value per unit and ends the documents' bounds.
    """
    n = len(values)
    z = np.zeros(0, np.int64)
    if n < length or n >= 1 << PLACE:
        if n >= 1 << PLACE:
            raise ValueError("slab too long")
        return z, z, z, np.zeros(0, np.uint64), z
    p = prefix(values)
    at = np.arange(n - k + 1)
    h = mixed(stretches(p, at, at + k))
    # The place in the low bits: the leftmost of equal hashes is the anchor.
    v = h >> np.uint64(PLACE) << np.uint64(PLACE) | at.astype(np.uint64)
    least = least_in_windows(v, length - k + 1)
    anchor = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    good = np.zeros(len(anchor), bool)
    sizes = np.diff(ends)
    for lo, size in zip(ends[:-1][sizes >= length], sizes[sizes >= length], strict=True):
        good[lo : lo + size - length + 1] = True
    i = np.flatnonzero(good)
    if not len(i):
        return z, z, z, np.zeros(0, np.uint64), z
    a = anchor[i]
    new = np.ones(len(i), bool)
    new[1:] = (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)
    start = np.flatnonzero(new)
    first = i[start]
    return first, np.diff(np.append(start, len(i))), a[start], h[a[start]], np.searchsorted(ends, first, "right") - 1


def pieces(ends: np.ndarray, most: int, length: int):
    """(document, from, to, bounds) stretches of a batch whose windows together are all windows, each once.

    Short documents go together; one of over `most` units comes in stretches that overlap by length - 1.
    """
    for first, last in slabs(ends, most):
        lo, hi = int(ends[first]), int(ends[last])
        if last == first + 1 and hi - lo > most + length:
            for at in range(lo, hi - length + 1, most):
                to = min(at + most + length - 1, hi)
                yield first, at, to, np.array([0, to - at])
        else:
            yield first, lo, hi, ends[first : last + 1] - lo


RUN = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("key", pa.int64()), ("dig", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("size", pa.int32()), ("reps", pa.int32())])
RUN_SQL = "h long, d long, key long, dig long, first long, n int, off int, size int, reps int"
SEGMENT = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("dig", pa.int64()), ("first", pa.int64()), ("segment", pa.binary())])
SEGMENT_SQL = "h long, d long, off int, n int, key long, dig long, first long, segment binary"


class Units:
    """What a text's units are: their values and how a segment is stored."""

    def __init__(self, split: Callable, dtype):
        self.split, self.dtype = split, np.dtype(dtype)

    def segment(self, store: np.ndarray, lo: int, hi: int) -> bytes:
        return store[lo:hi].tobytes()


def identified(docs: DataFrame) -> DataFrame:
    """docs plus key and dig."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))).withColumn("dig", F.xxhash64(text)).withColumn("text", text)


def run_table(docs: DataFrame, units: Units, length: int, k: int, wanted: Callable | None = None, floor: int | None = None, asked: Callable | None = None) -> DataFrame:
    """The runs of identified documents; wanted(h) says which anchor hashes to keep.

    asked(h, d, key, dig, first) says of which runs the segments are wanted instead, with their units, as `fetch` gives them.
    """
    floor = floor or length

    def run(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            key, dig = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "dig"))
            for lo_doc, hi_doc in slabs(ends, SLAB):
                values, store, bounds = units.split(data[ends[lo_doc] : ends[hi_doc]], ends[lo_doc : hi_doc + 1] - ends[lo_doc])
                whole, w = memoryview(store.tobytes()), units.dtype.itemsize
                for doc0, lo, hi, e in pieces(bounds, SLAB, floor):
                    first, n, a, h, doc = runs(values[lo:hi], e, floor, k)
                    if wanted is not None and len(h):
                        keep = wanted(h)
                        first, n, a, h, doc = first[keep], n[keep], a[keep], h[keep], doc[keep]
                    if not len(h):
                        continue
                    rows = doc + doc0
                    begin = first + lo
                    end = np.minimum(begin + n - 1 + length, bounds[rows + 1])
                    # Segments are told apart by their units and their number of windows.
                    d = [hashlib.blake2b(whole[f * w : t * w], digest_size=8, salt=m.to_bytes(16, "little")).digest() for f, t, m in zip(begin.tolist(), end.tolist(), n.tolist(), strict=True)]
                    d = np.frombuffer(b"".join(d), np.int64)
                    # A periodic text repeats one segment run by run: such a train of runs is one row.
                    new = np.ones(len(h), bool)
                    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + n[:-1]) | (n[1:] != n[:-1])
                    s = np.flatnonzero(new)
                    within, rows = begin - bounds[rows], rows + lo_doc
                    ints = lambda x: pa.array(x[s].astype(np.int32))  # noqa: B023, E731
                    if asked is not None:
                        s = s[asked(h[s].view(np.int64), d[s], key[rows[s]], dig[rows[s]], within[s])]
                        cut = pa.array([bytes(whole[f * w : t * w]) for f, t in zip(begin[s].tolist(), end[s].tolist(), strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(d[s]), ints(a - first), ints(n), pa.array(key[rows[s]]), pa.array(dig[rows[s]]), pa.array(within[s]), cut], schema=SEGMENT)
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(d[s]), pa.array(key[rows[s]]), pa.array(dig[rows[s]]), pa.array(within[s]), ints(n), ints(a - first), ints(end - begin), pa.array(np.diff(np.append(s, len(h))).astype(np.int32))], schema=RUN)

    return docs.select("key", "dig", "text").mapInArrow(run, RUN_SQL if asked is None else SEGMENT_SQL)


def longest_previous(place: np.ndarray, lcp: np.ndarray, floor: int) -> np.ndarray:
    """The longest common prefix of each suffix with one at a smaller place, 0 if below floor.

    The suffixes are in order and lcp[i] is the common prefix of i - 1 and i
    (lcp[0] = 0). The longest match with a smaller place is with the previous or
    the next smaller one in order. Both are found by jumps: from a neighbour of
    greater place the search goes on where that neighbour's search has come to.
    """
    best = np.zeros(len(place), lcp.dtype)
    for back in (False, True):
        p, common = (place[::-1], np.append(lcp[:1], lcp[:0:-1])) if back else (place, lcp.copy())
        to = np.arange(len(p)) - 1
        while len(i := np.flatnonzero((common >= floor) & (p[to] > p))):
            common[i], to[i] = np.minimum(common[i], common[to[i]]), to[to[i]]
        common = np.where(common >= floor, common, 0)
        best = np.maximum(best, common[::-1] if back else common)
    return best


def least_between(values: np.ndarray):
    """A function of a < b: the least of values[a:b], by the minima of stretches of powers of two."""
    tables = [values]
    while 2 << len(tables) - 1 <= len(values):
        last, half = tables[-1], 1 << len(tables) - 1
        tables.append(np.minimum(last[:-half], last[half:]))
    wide = np.zeros((len(tables), max(1, len(values))), values.dtype)
    for level, t in enumerate(tables):
        wide[level, : len(t)] = t

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(wide[level, a], wide[level, b - (1 << level)])

    return least


def resolve(bucket: np.ndarray, segments: list[np.ndarray], off: np.ndarray, n: np.ndarray, place: np.ndarray, length: int, earlier: bool, floor: int | None = None) -> list[list[tuple[int, int, int]]]:
    """For each segment, (reach, from, to) ranges of its windows whose longest match in another segment of its bucket
    is `reach` units or more, for reach = length and floor (earlier: at a smaller place).

    bucket: numbers, in order. off: the anchor's place in the segment. place: ranks of the segments' first occurrences.
    """
    rows, floor = len(segments), floor or length
    low = off - n + 1
    reach = np.minimum(np.array([len(s) for s in segments]) - off, length)
    right = np.zeros((rows, length), segments[0].dtype)
    left = np.zeros((rows, int(off.max()) if rows else 0), segments[0].dtype)
    for x, s in enumerate(segments):
        right[x, : reach[x]] = s[off[x] : off[x] + reach[x]]
        left[x, : off[x]] = s[: off[x]][::-1]
    # Of suffixes that are alike but for their ends the shorter comes first.
    names = [(int(b), r.tobytes(), int(z)) for b, r, z in zip(bucket, right, reach, strict=True)]
    order = np.array(sorted(range(rows), key=names.__getitem__))
    # Common prefix with the next suffix in order, no longer than either.
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(axis=1), length, same.argmin(axis=1)).astype(np.int32)
    common = np.minimum(common, np.minimum(reach[order[1:]], reach[order[:-1]]))
    least = least_between(common)
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    factors = np.zeros((rows, int(n.max()) if rows else 0), np.int32)
    cls = bucket[order].astype(np.int64)
    for o in range(left.shape[1] + 1):
        if o:
            there = off[order] >= o
            order, cls = order[there], cls[there]
            unit = left[order, o - 1]
            split = (cls[1:] == cls[:-1]) & (unit[1:] != unit[:-1])
            if split.any():
                by = np.lexsort((unit, cls))
                order, cls, unit = order[by], cls[by], unit[by]
                new = np.ones(len(order), np.int64)
                new[1:] = (cls[1:] != cls[:-1]) | (unit[1:] != unit[:-1])
                cls = np.cumsum(new)
        live = np.flatnonzero(low[order] <= o)
        x = order[live]
        if len(x) < 2:
            continue
        alike = np.flatnonzero(cls[live][1:] == cls[live][:-1])
        lcp = np.zeros(len(x), np.int32)
        lcp[alike + 1] = np.minimum(o + least(rank[x[alike]], rank[x[alike + 1]]), length)
        if lcp.max() < floor:
            continue
        found = longest_previous(place[x], lcp, floor)
        if not earlier:
            found = np.maximum(found, longest_previous(-place[x], lcp, floor))
        factors[x, off[x] - o] = found
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    for least_reach in {length, floor}:
        edge = np.diff(np.pad(factors >= least_reach, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        for (x, lo), hi in zip(np.argwhere(edge > 0).tolist(), np.nonzero(edge < 0)[1].tolist(), strict=True):
            out[x].append((least_reach, lo, hi))
    return out


SPAN = pa.list_(pa.struct([("reach", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))
SPAN_SQL = "array<struct<reach: int, lo: long, hi: long>>"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_ranges(docs: DataFrame, units: Units, length: int, k: int, first_stays: bool, wanted: Callable | None = None, most: int = MOST, floor: int | None = None, sifted: bool = False) -> DataFrame:
    """key, dig, ranges: (reach, lo, hi) for window starts [lo, hi) of each document whose next `reach` units occur elsewhere too.

    reach is length and, if another one is given, floor. first_stays: only those that occur earlier, by (doc_id, text hash, place).
    sifted: `wanted` lets few anchors through that occur once; counting them all again would move more than it spares.
    """
    floor = floor or length
    every = written(run_table(docs, units, length, k, wanted, floor), "runs")
    runs_ = every
    if not sifted:
        # What is grouped by an anchor is written before it is joined, so that an anchor of any frequency can be split in the join.
        often = written(every.groupBy("h").agg(F.sum("reps").alias("r")).where("r > 1").select("h"), "repeated-anchors")
        runs_ = written(every.join(often, "h"), "repeated-runs")
    distinct = runs_.groupBy("h", "d").agg(F.sum("reps").alias("count"), F.min(F.struct("key", "dig", "first")).alias("at"), *[F.min(c).alias(c) for c in ("n", "off", "size")])
    distinct = written(distinct, "segments")
    kinds = written(distinct.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "buckets")
    mixed_up = distinct.join(kinds, "h")
    fits = F.col("kinds") <= most
    large = not kinds.where(~fits).isEmpty()
    if wanted is None:
        found = resolved(fetch(docs, mixed_up.where(fits), units), units, length, first_stays, floor)
    else:
        # Cut out in another pass over the texts rather than fetched: no text is shuffled for a few of its segments.
        n = kinds.where(fits).agg(F.sum("kinds")).first()[0] or 0
        segments = run_table(docs, units, length, k, wanted, floor, membership(mixed_up.where(fits).select("h", "d", "at.*"), n))
        if large:  # one in `most` runs at most; what passes by chance must not bring a large bucket into a task
            segments = segments.join(F.broadcast(kinds.where(~fits).select("h")), "h", "left_anti").select(*SEGMENT.names)
        found = resolved(segments, units, length, first_stays, floor, ("key", "dig", "first"))
    if large:
        found = found.unionByName(by_digest(fetch(docs, mixed_up.where(~fits), units), units, length, first_stays, floor))
    spans = written(found, "spans")
    verdict = distinct.join(spans, ["h", "d"], "left").where("count > 1 OR spans IS NOT NULL").select("h", "d", "count", "at", "spans")
    placed = runs_.select("h", "d", "key", "dig", "first", "n", "size", "reps").join(verdict, ["h", "d"])
    begin, n = F.col("first"), F.col("n").cast("long")
    train = n * F.col("reps")
    own = F.transform(F.coalesce("spans", F.array().cast(SPAN_SQL)), lambda s: F.struct(s["reach"].alias("reach"), (begin + s["lo"]).alias("lo"), (begin + s["hi"]).alias("hi")))
    span = lambda reach, lo, hi: F.struct(F.lit(reach).alias("reach"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    # Windows near the text's end have no `length` units; a train of several runs has them all.
    long = F.when(F.col("reps") > 1, train).otherwise(F.least(n, F.greatest(F.col("size") - length + 1, F.lit(0))))
    all_of = lambda lo, to: F.filter(F.array(span(length, lo, to), *([span(floor, lo, begin + train)] if floor < length else [])), lambda s: s["lo"] < s["hi"])
    whole = all_of(begin, begin + long)
    if first_stays:
        is_first = F.col("at") == F.struct("key", "dig", "first")
        after = F.when(F.col("reps") > 1, F.concat(own, all_of(begin + n, begin + long))).otherwise(own)
        ranges = F.when(is_first, after).otherwise(whole)
    else:
        ranges = F.when(F.col("count") > 1, whole).otherwise(own)
    ranges = placed.select("key", "dig", F.explode(ranges).alias("r"))
    return ranges.groupBy("key", "dig").agg(F.collect_set("r").alias("ranges"))


def fetch(docs: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """h, d, off, n, key, dig, first, segment: the units of each distinct segment, from its first document."""
    asked = wanted.select("h", "d", "off", "n", "size", "at.*").groupBy("key", "dig").agg(F.collect_list(F.struct("h", "d", "off", "n", "size", "first")).alias("asked"))
    both = docs.select("key", "dig", "text").join(asked, ["key", "dig"])

    def cutout(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            key, dig, asked = (b.column(c).to_pylist() for c in ("key", "dig", "asked"))
            for i in range(b.num_rows):
                raw = data[ends[i] : ends[i + 1]]
                _, store, _ = units.split(raw, np.array([0, len(raw)]))
                out = [{**x, "key": key[i], "dig": dig[i], "segment": units.segment(store, x["first"], x["first"] + x["size"])} for x in asked[i]]
                yield pa.RecordBatch.from_pylist(out, SEGMENT)

    return both.mapInArrow(cutout, SEGMENT_SQL)


def resolved(fetched: DataFrame, units: Units, length: int, earlier: bool, floor: int, order: tuple[str, ...] = ()) -> DataFrame:
    """h, d, spans of the segments of buckets that fit a task; each bucket is sorted where it arrives.

    Of a segment given several times the first one counts, by `order`.
    """

    def run(batches):
        rows: list[dict] = []
        here: set[int] = set()

        def flush():
            names = {h: i for i, h in enumerate(dict.fromkeys(r["h"] for r in rows))}
            place = np.empty(len(rows), np.int64)
            place[sorted(range(len(rows)), key=lambda i: (rows[i]["key"], rows[i]["dig"], rows[i]["first"]))] = np.arange(len(rows))
            segments = [np.frombuffer(r["segment"], units.dtype) for r in rows]
            found = resolve(np.array([names[r["h"]] for r in rows]), segments, np.array([r["off"] for r in rows]), np.array([r["n"] for r in rows]), place, length, earlier, floor)
            out = [{"h": r["h"], "d": r["d"], "spans": [{"reach": t, "lo": a, "hi": b} for t, a, b in s]} for r, s in zip(rows, found, strict=True) if s]
            return pa.RecordBatch.from_pylist(out, schema)

        for b in batches:
            for r in b.to_pylist():
                if rows and r["h"] != rows[-1]["h"]:
                    here.clear()
                    if len(rows) >= BLOCK:
                        yield flush()
                        rows = []
                if r["d"] not in here:  # a document that stands in several rows gives its segments several times
                    here.add(r["d"])
                    rows.append(r)
        if rows:
            yield flush()

    schema = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("spans", SPAN)])
    return fetched.repartition("h").sortWithinPartitions("h", *order).mapInArrow(run, f"h long, d long, spans {SPAN_SQL}")


def by_digest(fetched: DataFrame, units: Units, length: int, earlier: bool, floor: int) -> DataFrame:
    """The same for buckets of any size: a row per window, grouped by the window's digest."""

    def run(batches):
        w = units.dtype.itemsize
        for b in batches:
            for r in b.to_pylist():
                raw = memoryview(r["segment"])
                for reach in {length, floor}:
                    m = min(r["n"], len(raw) // w - reach + 1)
                    if m > 0:
                        digests = [hashlib.blake2b(raw[t * w : (t + reach) * w], digest_size=16).digest() for t in range(m)]
                        yield pa.RecordBatch.from_pydict({"w": digests, "reach": [reach] * m, "t": list(range(m)), **{c: [r[c]] * m for c in ("h", "d", "key", "dig", "first")}}, schema)

    schema = pa.schema([("w", pa.binary()), ("reach", pa.int32()), ("t", pa.int64()), *[(c, pa.int64()) for c in ("h", "d", "key", "dig", "first")]])
    rows = fetched.dropDuplicates(["h", "d"]).mapInArrow(run, "w binary, reach int, t long, h long, d long, key long, dig long, first long")
    at = F.struct("key", "dig", "first")
    groups = rows.groupBy("h", "reach", "w").agg(F.count("*").alias("c"), F.min(at).alias("least")).where("c > 1")
    hit = rows.join(groups, ["h", "reach", "w"])
    if earlier:
        hit = hit.where(at != F.col("least"))
    return hit.groupBy("h", "d").agg(F.collect_list(F.struct("reach", F.col("t").alias("lo"), (F.col("t") + 1).alias("hi"))).alias("spans"))


def covered(ranges: list | None, size: int, length: int) -> np.ndarray:
    """Sorted disjoint [lo, hi) stretches of units that the strings of `length` units starting in the ranges cover, as rows."""
    r = np.array(sorted((x["lo"], x["hi"] - 1 + length) for x in (() if ranges is None else ranges) if x["reach"] == length), np.int64).reshape(-1, 2)
    if not len(r):
        return r
    top = np.maximum.accumulate(r[:, 1])
    new = np.ones(len(r), bool)
    new[1:] = r[1:, 0] > top[:-1]
    s = np.flatnonzero(new)
    return np.stack([r[s, 0], np.minimum(top[np.append(s[1:], len(r)) - 1], size)], axis=1)
