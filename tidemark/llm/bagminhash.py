"""Near-duplicates of whole documents by BagMinHash.

A document is the multiset of its five-word shingles. A shingle of weight w is
the interval [0, w), cut into dyadic layers [0,1), [1,2), [2,4), ...; each
layer of each shingle has a Poisson process of points (time, place in the
layer, component), seeded by shingle and layer alone. Component k of a
signature is the earliest point that fell to k and lies below w, so two
signatures agree in a component with the weighted Jaccard similarity of their
documents. Points come in order of time and stop when none can be earlier than
the latest component, which takes about m log m points a document.

Signatures are banded. In each bucket of a band the most central member (the
one whose buckets hold most) is its hub: members are compared with the hub
first. Where different components still meet in a bucket, its members' shingles
are brought together and every two members of different components are compared
there, each pair in the first bucket that it shares. A large bucket is dealt out
in blocks of bounded size, and each two blocks meet in a task; tasks give links
only, no pairs. So each two members of a bucket are compared, or are linked
without it. Pairs of very different sizes, and pairs whose whole signatures
agree in too few components (see `agree`), are left out first. Pairs are verified
by exact multiset overlap of the shingles; verified links give classes as
connected components.

Exact copies share one node, so a group of copies of any size costs a row of
numbers per copy. Work in a bucket is linear in its members where its hub links
them, and grows with the pairs of different components where it doesn't: a
comparison is then a count of common bits.

Cases: null texts, and texts without words, resemble nothing and are classes of their
own; a text of one to four words is one shingle; a text of any length is one bag,
of eight bytes a word; a null doc_id gets a null class and joins none; repeated
rows are rows of one class; rows of one doc_id with different texts belong to the
classes of their texts; no rows give no rows. Extra columns are ignored. class_id
is the least doc_id of the class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import BASE, windows, words
from tidemark.llm.common import bounded_batches, boxed, cut, mixed, scratch, slabs, table, unboxed, utf8_column

SHINGLE = 5
#: 32 bands of 4 rows: at similarity 0.8 all bands miss with probability 5e-8.
BANDS, ROWS = 32, 4
SLAB = 1 << 17
#: A block of a bucket has some so many members, and some so many shingles, at most.
BLOCK_ROWS, BLOCK_ITEMS = 1 << 12, 1 << 20
#: Pairs, and shingles of one side, that a task compares at once.
CHUNK = 1 << 13
#: Odds that a pair at the threshold agrees in too few components of the signature, as those of the bands to miss it.
MISS = 5e-8


def bag(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE):
    """doc, shingle hash and weight of each distinct shingle of each document, sorted."""
    _, _, doc, h, _ = words(data, ends)
    at, g = windows(h, doc, n)
    d = doc[at]
    size = np.bincount(doc, minlength=len(ends) - 1)
    for few in range(1, n):  # texts shorter than a shingle are one shingle
        own = size[doc] == few
        if own.any():
            at, s = windows(h[own], doc[own], few)
            d, g = np.append(d, doc[own][at]), np.append(g, mixed(s + np.uint64(few)))
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    return d[first], g[first], np.diff(np.append(first, len(g)))


def signatures(doc: np.ndarray, g: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m signature; all ones where a document has no shingle."""
    cells = [(doc, mixed(g), np.ones(len(g)), np.ones(len(g)))]
    layer, base = 1, 1
    while (some := weight > base).any():
        width = float(base)
        cells.append((doc[some], mixed(g[some] + np.uint64(layer * BASE % (1 << 64))), np.full(some.sum(), width), np.minimum(weight[some] - base, width)))
        layer, base = layer + 1, base * 2
    doc, seed, width, limit = (np.concatenate(x) for x in zip(*cells, strict=True))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_docs * m, none, np.uint64)
    t, steps, step = np.zeros(len(doc)), 0, 1
    while len(doc):
        nth = np.arange(steps + 1, steps + step + 1, dtype=np.uint64)[:, None] * np.uint64(BASE)
        h = mixed(seed[None, :] + nth)
        times = t + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width, axis=0)
        h = mixed(h)
        inside = (h >> np.uint64(11)).astype(np.float64) / (1 << 53) * width < limit
        # The order is that of time; the low bits name the point, so that rounding in the last place does not part equal points.
        value = times.view(np.uint64) & np.uint64(0xFFFFFFFFFFF00000) | h >> np.uint64(44)
        at = doc * m + (h % np.uint64(m)).astype(np.int64)
        np.minimum.at(sig, at[inside], value[inside])
        t = times[-1]
        latest = sig.reshape(n_docs, m).max(axis=1)
        go = t.view(np.uint64) < latest[doc]
        doc, seed, width, limit, t = doc[go], seed[go], width[go], limit[go], t[go]
        steps, step = steps + step, min(2 * step, 64)
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_docs x bands; a key names its band too."""
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands))
    for r in range(rows):
        key = mixed(key * np.uint64(BASE) + sig.reshape(len(sig), bands, rows)[:, :, r])
    return key


def agree(least: float, m: int) -> int:
    """Components that two signatures share at least, but with odds of MISS, where the similarity is `least`."""
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * least**k * (1 - least) ** (m - k)
        if below > MISS:
            return k
    return m


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest, band keys (null where there is no shingle) and a byte of each component, of rows with digest and text."""

    def run(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            ids, digest = b.column("doc_id"), b.column("digest")
            for first, last in slabs(ends, SLAB):
                doc, g, weight = bag(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
                sig = signatures(doc, g, weight, last - first, bands * rows)
                some = np.bincount(doc, minlength=last - first) > 0
                keys = band_keys(sig, bands, rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * (last - first) + 1, bands), pa.int32()), pa.array(keys.ravel()), mask=pa.array(~some))
                low = mixed(sig).astype(np.uint8)
                sketches = pa.array([row.tobytes() for row in low], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), digest.slice(first, last - first), lists, sketches], names=["doc_id", "digest", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, digest binary, keys array<long>, sketch binary")


def digest() -> Column:
    """By which texts are told apart."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def bags(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, size and items of the chosen (node, id, digest): a sorted 64-bit number for each shingle, repeats numbered."""

    def run(batches):
        for b in batches:
            data, ends = utf8_column(b, "text")
            node = b.column("node")
            for first, last in slabs(ends, SLAB):
                doc, g, weight = bag(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
                each = np.repeat(np.arange(len(g)), weight)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
                doc, item = doc[each], mixed(g[each] + nth.astype(np.uint64) * np.uint64(BASE))
                item = item[np.lexsort((item, doc))]
                size = np.bincount(doc, minlength=last - first)
                raw, at = item.tobytes(), np.concatenate(([0], np.cumsum(size))).tolist()
                held = pa.array([raw[8 * x : 8 * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([node.slice(first, last - first), pa.array(size, pa.int64()), held], names=["node", "size", "items"])

    wanted = chosen.select("node", F.col("id").alias("of"), F.col("digest").alias("of_digest"))
    held = docs.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("of")) & (F.col("digest") == F.col("of_digest")))
    return held.select("node", "text").mapInArrow(run, "node long, size long, items binary")


def alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures allow the similarity."""
    enough = agree(least, BANDS * ROWS)

    def run(batches):
        for b in batches:
            x, y = (utf8_column(b, c)[0].reshape(b.num_rows, -1) for c in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= enough)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    of = lambda node, sketch: nodes.select(F.col("node").alias(node), F.col("sketch").alias(sketch))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def overlaps(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multiset Jaccard similarity is `least` or more; held is a table of bags."""

    def run(batches):
        for b in batches:
            (x, xe), (y, ye) = ((d.view(np.uint64), e // 8) for d, e in (utf8_column(b, c) for c in ("x", "y")))
            keep = np.zeros(b.num_rows, bool)
            for first, last in slabs(xe + ye, SLAB):
                doc, item = (np.concatenate(z) for z in zip(*[(np.repeat(np.arange(last - first), np.diff(e[first : last + 1])), d[e[first] : e[last]]) for d, e in ((x, xe), (y, ye))], strict=True))
                order = np.lexsort((item, doc))
                doc, item = doc[order], item[order]
                shared = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (item[1:] == item[:-1])], minlength=last - first)
                keep[first:last] = similar(shared, np.bincount(doc, minlength=last - first), least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    of = lambda node, items: held.select(F.col("node").alias(node), F.col("items").alias(items))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(shared: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Whether bags of `total` shingles together, `shared` of them common, have a Jaccard similarity of `least`."""
    return shared >= least * (total - shared) - 1e-9


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node reachable, for each node that has a link.

    Labels take the least label among neighbours and then the label of their
    label, until none changes; distances halve or better with each round.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = cut(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "was"))
        changed = new.where("comp <> was").limit(1).count()
        label = new.select("node", "comp")
        if not changed:
            return label


def linked(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, comp) after new links between its nodes; comp stays the least node."""
    of = lambda x: label.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
    links = cut(links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    if links.isEmpty():
        return label
    moved = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return cut(label.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def near_components(docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """node, comp of every node: the least node that verified links reach."""
    spark = docs.sparkSession
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    # What is grouped by a bucket is written before it is joined, so that a bucket of any size can be split in the join.
    counts = cut(exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = exploded.join(counts, "key")
    central = members.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("central"))
    members = cut(members.join(central, F.col("node") == F.col("of")).select("key", "node", "central"))
    hubs = members.groupBy("key").agg(F.max(F.struct("central", (-F.col("node")).alias("least"))).alias("top"))
    hubs = cut(hubs.select("key", (-F.col("top.least")).alias("hub")))
    path = scratch(spark, "bags")
    bags(docs, nodes.join(members.select("node").distinct(), "node")).write.parquet(path)
    held = spark.read.schema("node long, size long, items binary").parquet(path)
    star = members.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    label = components(overlaps(cut(alike(star, nodes, least)), held, least))
    label = cut(nodes.select("node").join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
    placed = members.select("key", "node").join(label, "node").join(held.select("node", "size"), "node")
    sums = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("size")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_ITEMS)).cast("int")
    still = cut(sums.select("key", blocks.alias("blocks")))
    if still.isEmpty():
        return label
    dealt = placed.select("key", "node", "comp").join(still, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    signs = nodes.select("node", "keys", "sketch")
    beside = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    # First without the shingles: which members have a partner that the signatures allow at all.
    able = beside(dealt.join(signs, "node").join(held.select("node", "size"), "node")).mapInArrow(_by_blocks(_able, least), "key long, i int, j int, node long, comp long, own int")
    rows = beside(cut(able).join(signs, "node").join(held, "node"))
    return linked(label, rows.mapInArrow(_by_blocks(_links, least), "a long, b long"))


def _by_blocks(of, least: float):
    """Feeds `of` the rows of two blocks of a bucket, by size; they come one after the other."""

    def run(batches):
        held, at = [], None

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            return of(_Members(at, rows.take(pa.array(np.argsort(rows["size"].to_numpy(), kind="stable"))), least))

        for b in batches:
            names = list(zip(*(b.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            first = 0
            while first < len(names):
                last = first + 1
                while last < len(names) and names[last] == names[first]:
                    last += 1
                if names[first] != at and held:
                    yield done()
                    held = []
                at = names[first]
                held.append(b.slice(first, last - first))
                first = last
        if held:
            yield done()

    return run


class _Members:
    """Members of one or two blocks of a bucket, in order of size."""

    def __init__(self, at: tuple[int, int, int], rows: pa.Table, least: float):
        self.rows, self.least, self.across = rows, least, at[1] != at[2]
        self.node, comp, self.own, self.size = (rows[c].to_numpy() for c in ("node", "comp", "own", "size"))
        self.comp, n = comp.copy(), rows.num_rows
        self.keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(n, BANDS)
        self.sketch = utf8_column(rows, "sketch")[0].reshape(n, BANDS * ROWS)
        self.band = int(np.flatnonzero(self.keys[0] == at[0])[0])
        self.ends = np.concatenate(([0], np.cumsum(self.size)))
        # Bags of J >= least differ in size by that factor at most: a row's partners follow it up to `until`.
        self.until = np.searchsorted(self.size, self.size / least + 1e-9, "right")

    def pairs(self):
        """first and last of some rows, and (x, y) arrays: their partners in other components that the sizes and
        signatures allow and that share no earlier bucket. What is merged meanwhile is left out."""
        enough = agree(self.least, BANDS * ROWS)
        for first, last in ((x, min(x + 256, hi)) for lo, hi in slabs(self.ends, CHUNK) for x in range(lo, hi, 256)):
            some = np.arange(first, self.until[last - 1])
            able = (some > np.arange(first, last)[:, None]) & (some < self.until[first:last, None]) & (self.comp[first:last, None] != self.comp[some])
            if self.across:
                able &= self.own[first:last, None] != self.own[some]
            a, b = np.nonzero(able)
            for lo in range(0, len(a), CHUNK):
                x, y = a[lo : lo + CHUNK] + first, b[lo : lo + CHUNK] + first
                keep = ((self.sketch[x] == self.sketch[y]).sum(axis=1) >= enough) & (self.comp[x] != self.comp[y])
                x, y = x[keep], y[keep]
                keep = (self.keys[x] == self.keys[y]).argmax(axis=1) == self.band
                if keep.any():
                    yield first, last, x[keep], y[keep]


def _able(members: _Members) -> pa.RecordBatch:
    """The rows that are in some pair."""
    some = np.zeros(len(members.node), bool)
    for _, _, x, y in members.pairs():
        some[x] = some[y] = True
    rows = members.rows.select(["key", "i", "j", "node", "comp", "own"]).filter(pa.array(some)).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns], names=rows.column_names)


def _links(members: _Members) -> pa.RecordBatch:
    """Links (a, b) that join the components of similar members; no more than there are members."""
    data, _ = utf8_column(members.rows, "items")
    _, column, often = np.unique(data.view(np.uint64), return_inverse=True, return_counts=True)
    of, ends, comp, size = np.repeat(np.arange(len(members.node)), members.size), members.ends, members.comp, members.size
    found, bits, at = [], np.zeros((0, 1), np.uint64), None
    for first, last, x, y in members.pairs():
        if at != first:
            far = members.until[last - 1]
            here = slice(ends[first], ends[far])
            bits, at = _bits(column[here], of[here] - first, int(ends[last] - ends[first]), often, far - first), first
        step = max(1, (1 << 21) // bits.shape[1])
        for part in range(0, len(x), step):
            u, v = x[part : part + step], y[part : part + step]
            shared = np.bitwise_count(bits[u - first] & bits[v - first]).sum(axis=1, dtype=np.int64)
            ok = similar(shared, size[u] + size[v], members.least)
            for p, q in zip(u[ok].tolist(), v[ok].tolist(), strict=True):
                if comp[p] != comp[q]:
                    comp[comp == comp[q]] = comp[p]
                    found.append((members.node[p], members.node[q]))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bits(column: np.ndarray, row: np.ndarray, own: int, often: np.ndarray, rows: int) -> np.ndarray:
    """A row of bits for each member: which of the columns among the first `own` entries it has; columns met once don't count."""
    wanted = np.unique(column[:own][often[column[:own]] > 1])
    name = np.full(len(often), -1, np.int64)
    name[wanted] = np.arange(len(wanted))
    there = name[column]
    row, there = row[there >= 0], there[there >= 0]
    bits = np.zeros((rows, max(1, -(-len(wanted) // 64))), np.uint64)
    np.bitwise_or.at(bits, (row, there >> 6), np.uint64(1) << (there & 63).astype(np.uint64))
    return bits


def _classes(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, digest, able (has shingles and a doc_id) of every row; and digest, first, first_digest
    of every able digest: the least doc_id of its class, and which of that doc_id's texts."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest().alias("digest"))
    sigs = cut(signed(docs))
    rows = sigs.select("doc_id", "digest", (F.col("doc_id").isNotNull() & F.col("keys").isNotNull()).alias("able"))
    nodes = sigs.where(F.col("doc_id").isNotNull() & F.col("keys").isNotNull())
    nodes = nodes.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = cut(nodes.select("node", "digest", "id").join(near_components(docs, nodes, least), "node"))
    head = cut(placed.groupBy("comp").agg(F.min(F.struct("id", "digest")).alias("head")))
    return rows, placed.join(head, "comp").select("digest", F.col("head.id").alias("first"), F.col("head.digest").alias("first_digest"))


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id of every row; class_id is the least doc_id of the row's class."""
    rows, found = _classes(docs, least)
    named = rows.where("able").join(found, "digest").select("doc_id", F.col("first").alias("class_id"))
    return named.union(rows.where("NOT able").select("doc_id", F.col("doc_id").alias("class_id")))


def representatives(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One document of each class, that of the least doc_id and, among its texts, digest.

    Rows with null doc_id stay; so do rows without shingles, but for rows that repeat both doc_id and text.
    """
    rows, found = _classes(docs, least)
    heads = found.select(F.col("first").alias("doc_id"), F.col("first_digest").alias("digest")).distinct()
    kept = rows.where("able").join(heads, ["doc_id", "digest"]).unionByName(rows.where("NOT able AND doc_id IS NOT NULL"))
    kept = kept.groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.count("*").alias("times"))
    box = boxed(docs, "doc_id", "text").select("row", F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    joined = box.join(kept, (F.col("doc_id") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    single = joined.where("times = 1 OR doc_id IS NULL").select("row")
    # Rare rows that are all alike: only they are grouped with their texts.
    several = joined.where("times > 1").select("row", "of", "of_digest").dropDuplicates(["of", "of_digest"]).select("row")
    return unboxed(single.union(several), docs.columns)


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT doc_id, sum(c) AS t FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN t a ON a.doc_id = x JOIN t b ON b.doc_id = y WHERE 10 * o >= 8 * (a.t + b.t - o)),
n AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, n.y FROM reach JOIN n ON n.x = reach.b)
SELECT w.doc_id, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS class_id FROM w
"""
