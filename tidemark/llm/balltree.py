"""Hard negatives: exact inner-product search by ball trees, branch and bound.

Rows are dealt into cells by a small tree fitted on a bounded sample, and cells
into blocks of bounded size, so a hot cell is many blocks. Each block has a
ball tree of its own. A node's ball bounds the inner products of its rows with
an anchor from above and from below; a node is left out where its bounds miss
the score window, or lie strictly beneath the current k-th score (not at it,
since ties go to the smaller id), or where its labels rule it out.

The anchors are searched in their own block first. The k-th scores found there
go along with them to the other blocks, and the balls of the cells (bounded in
number) say which those are. Results of blocks meet by anchor; a task sends the
first k of an anchor's rows at most.

Scores are exact integers: floating-point products are used only where every
partial sum is an integer that the format holds, Python's integers elsewhere.

Cases: rows with a null label or vector, or a null or non-finite component,
take no part. Vectors of different lengths are filled up with zeros, so an empty
one scores 0. Rows that repeat a vec_id are rows of their own. A null vec_id is
no anchor and comes last among ties. A positive score of 0 has the window
[0, 0]; below 0 the window is empty. A score of
2**53 or more raises an error. No rows, no anchors or one label only give no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, table

#: Rows of the sample that the cells are fitted on, and cells at most.
FIT, CELLS = 4096, 256
#: Rows of a block and of a leaf at most, and bytes of a block's vectors as float64.
BLOCK, LEAF, BLOCK_BYTES = 32_768, 64, 1 << 25
POSITIVES, NEGATIVES = 5, 3

ROW_SQL = "cell int, salt int, away double, vec_id long, label long, vector binary"
TREE_SQL = "cell int, split int, dim int, vectors binary, ids array<long>, labels array<long>, order binary, centers binary, radii binary, lows binary, highs binary"
SLAB_SQL = "home_cell int, home_split int, dim int, places binary, anchors array<long>, anchor_labels array<long>, anchor_vectors binary, lo binary, hi binary, kth binary"
FOUND_SQL = "home_cell int, home_split int, place int, probe int, score long, vec_id long"


def _arrow(sql: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in sql.split(", "))])


ROW, TREE, SLAB, FOUND = map(_arrow, (ROW_SQL, TREE_SQL, SLAB_SQL, FOUND_SQL))


def packed(x: np.ndarray) -> bytes:
    """Integer vectors as bytes: two a component where that holds them all, else as float64, which holds floor(256 * x) exactly."""
    small = not x.size or np.abs(x).max() < 1 << 15
    return (b"s" + x.astype("<i2").tobytes()) if small else (b"d" + x.astype("<f8").tobytes())


def unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<f8", offset=1).astype(np.float64).reshape(n, dim)


class Products:
    """Inner products of two sets of integer vectors, in the cheapest format that is exact.

    Every partial sum lies within the product of the norms, so float32 serves
    below 2**24 and float64 below 2**53. Beyond, Python's integers tell whether
    a score itself stays below 2**53.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        top = max(1.0, np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0) * (1 + 1e-9))
        if top < 1 << 53:
            kind = np.float32 if top < 1 << 24 else np.float64
            self.a, self.b = a.astype(kind), b.astype(kind)
        else:
            whole = np.frompyfunc(int, 1, 1)
            self.a, self.b = whole(a), whole(b)
        self.exact = self.a.dtype != object

    def __call__(self, i: np.ndarray, rows: slice) -> np.ndarray:
        s = self.a[i] @ self.b[rows].T
        if self.exact:
            return s.astype(np.int64)
        if s.size and max(abs(int(s.max())), abs(int(s.min()))) >= 1 << 53:
            raise OverflowError("an inner product doesn't fit 53 bits")
        return s.astype(np.int64)


def halves(x: np.ndarray) -> np.ndarray:
    """The rows' order along the line through two far rows."""
    far = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    other = x[np.argmax(((x - far) ** 2).sum(1))]
    return np.argsort(x @ (far - other), kind="stable")


class BallTree:
    """A balanced tree over n rows: node i of level l holds rows [n*i >> l, n*(i+1) >> l) of the tree's order."""

    def __init__(self, x: np.ndarray, ids: list, labels: np.ndarray, order: np.ndarray, centers=None, radii=None, lows=None, highs=None):
        self.x, self.ids, self.labels, self.order, self.n = x, ids, labels, order, len(x)
        self.depth = max(0, int(np.ceil(np.log2(max(1, self.n) / LEAF))))
        self.centers, self.radii, self.lows, self.highs = centers, radii, lows, highs

    def rows(self, level: int, i: int) -> slice:
        return slice((self.n * i) >> level, (self.n * (i + 1)) >> level)

    @staticmethod
    def built(x: np.ndarray, ids: list, labels: np.ndarray) -> "BallTree":
        """ids may hold None; ties go by `order`: a row's place by id, None last."""
        order = np.empty(len(x), np.int64)
        order[sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(x))
        t = BallTree(x, ids, labels, order)
        at = np.arange(t.n)
        for level in range(t.depth):
            for i in range(1 << level):
                r = t.rows(level, i)
                if r.stop - r.start > 1:
                    at[r] = at[r][halves(x[at[r]])]
        t.x, t.ids, t.labels, t.order = x[at], [ids[i] for i in at], labels[at], order[at]
        balls = [t.rows(level, i) for level in range(t.depth + 1) for i in range(1 << level)]
        t.centers = np.array([t.x[r].mean(0) if r.stop > r.start else np.zeros(x.shape[1]) for r in balls]).reshape(len(balls), x.shape[1])
        t.radii = np.array([np.sqrt(((t.x[r] - c) ** 2).sum(1).max(initial=0)) for r, c in zip(balls, t.centers, strict=True)])
        t.lows = np.array([t.labels[r].min(initial=np.iinfo(np.int64).max) for r in balls])
        t.highs = np.array([t.labels[r].max(initial=np.iinfo(np.int64).min) for r in balls])
        return t

    def record(self, cell: int, split: int) -> dict:
        raw = {n: getattr(self, n).tobytes() for n in ("order", "centers", "radii", "lows", "highs")}
        return {"cell": cell, "split": split, "dim": self.x.shape[1], "vectors": packed(self.x), "ids": self.ids, "labels": self.labels.tolist(), **raw}

    @staticmethod
    def read(r: dict) -> "BallTree":
        whole = lambda n, kind: np.frombuffer(r[n], kind)
        balls = len(r["radii"]) // 8
        held = whole("centers", float).reshape(balls, r["dim"]), whole("radii", float), whole("lows", np.int64), whole("highs", np.int64)
        return BallTree(unpacked(r["vectors"], len(r["ids"]), r["dim"]), r["ids"], np.array(r["labels"], np.int64), whole("order", np.int64), *held)


def bounds(q: np.ndarray, norms: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector with any row of each ball, with room for rounding."""
    s, w = q @ centers.T, norms[:, None] * radii[None, :]
    room = 1e-9 * (norms[:, None] * (np.linalg.norm(centers, axis=1) + radii)[None, :]) + 1e-6
    return s - w - room, s + w + room


def wanted(least: np.ndarray, most: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Anchors by balls: does any probe's window meet the ball's bounds, at its k-th score or above it?"""
    out = np.zeros(least.shape, bool)
    for j in range(lo.shape[1]):
        out |= (most >= np.maximum(lo[:, j], kth[:, j])[:, None]) & (least <= hi[:, j, None])
    return out


class Best:
    """The first k (score falling, order rising) of each probe; kth is its k-th score, or what it was told at first."""

    def __init__(self, kth: np.ndarray, k: int):
        self.kth, self.k, self.shape = kth.copy(), k, kth.shape
        self.probe = self.score = self.order = self.row = np.zeros(0, np.int64)

    def add(self, probe: np.ndarray, score: np.ndarray, order: np.ndarray, row: np.ndarray) -> None:
        if not len(probe):
            return
        p, s, o, r = (np.concatenate(x) for x in ((self.probe, probe), (self.score, score), (self.order, order), (self.row, row)))
        by = np.lexsort((o, -s, p))
        p, s, o, r = p[by], s[by], o[by], r[by]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        rank = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)]))
        kept = rank < self.k
        self.probe, self.score, self.order, self.row = p[kept], s[kept], o[kept], r[kept]
        last = rank == self.k - 1
        flat = self.kth.reshape(-1)
        flat[p[last]] = np.maximum(flat[p[last]], s[last])


def searched(t: BallTree, q: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray, k: int, same: bool, own: np.ndarray | None = None) -> Best:
    """Each probe's first k rows of the tree: label as the anchor's (same) or another, lo <= score <= hi, not below kth.

    own: each anchor's row in the tree's order, which isn't taken.
    """
    best, norms, alive = Best(kth, k), np.linalg.norm(q, axis=1), np.ones((len(q), 1), bool)
    if not t.n or not len(q):
        return best
    at = 0
    for level in range(t.depth + 1):
        if level:
            alive = np.repeat(alive, 2, axis=1)
        n = 1 << level
        cols = np.flatnonzero(alive.any(0))
        balls = at + cols
        least, most = bounds(q, norms, t.centers[balls], t.radii[balls])
        low, high = t.lows[balls][None, :], t.highs[balls][None, :]
        fits = (low <= labels[:, None]) & (high >= labels[:, None]) if same else (low != labels[:, None]) | (high != labels[:, None])
        alive[:, cols] &= fits & wanted(least, most, lo, hi, kth)
        if not alive.any():
            return best
        at += n
    upper = np.full(alive.shape, -np.inf)
    upper[:, cols] = most
    lower = np.full(alive.shape, np.inf)
    lower[:, cols] = least
    products = Products(q, t.x)
    for leaf in np.argsort(-np.where(alive, upper, 0).sum(0) / np.maximum(1, alive.sum(0)), kind="stable"):
        i = np.flatnonzero(alive[:, leaf])
        if not len(i):
            continue
        i = i[wanted(lower[i, leaf : leaf + 1], upper[i, leaf : leaf + 1], lo[i], hi[i], best.kth[i])[:, 0]]
        if not len(i):
            continue
        r = t.rows(t.depth, leaf)
        s = products(i, r)
        ok = (t.labels[r][None, :] == labels[i, None]) == same
        if own is not None:
            ok &= np.arange(r.start, r.stop)[None, :] != own[i, None]
        for j in range(lo.shape[1]):
            a, b = np.nonzero(ok & (s >= np.maximum(lo[i, j], best.kth[i, j])[:, None]) & (s <= hi[i, j, None]))
            best.add(i[a] * lo.shape[1] + j, s[a, b], t.order[r][b], b + r.start)
    return best


def found(t: BallTree, best: Best, cell: int, split: int, places: np.ndarray) -> pa.RecordBatch:
    a, j = np.divmod(best.probe, max(1, best.shape[1]))
    n = len(a)
    cols = [np.full(n, cell, np.int32), np.full(n, split, np.int32), places[a].astype(np.int32), j.astype(np.int32), best.score.astype(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([t.ids[x] for x in best.row], pa.int64())], schema=FOUND)


class Cells:
    """A tree of halving planes fitted on a sample; its leaves are the cells. Rows of any number fall through it."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.centers = sample.shape[1], []
        self.root = self._split(sample, cells)

    def _split(self, x: np.ndarray, cells: int):
        if cells > 1 and len(x) > 1:
            by = halves(x)
            line = x[by[-1]] - x[by[0]]
            along = x @ line
            at = np.median(along)
            left = along <= at
            if left.any() and not left.all():
                return line, at, self._split(x[left], cells // 2), self._split(x[~left], cells - cells // 2)
        self.centers.append(x.mean(0) if len(x) else np.zeros(self.dim))
        return len(self.centers) - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, i = todo.pop()
            if not isinstance(node, tuple):
                out[i] = node
                continue
            left = x[i] @ node[0] <= node[1]
            todo += [(node[2], i[left]), (node[3], i[~left])]
        return out


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part, components as double."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """Labels moved on by one, modulo the number of classes, where vec_id is divisible by `every`."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of lists of doubles, filled up with zeros to dim."""
    ends = np.asarray(column.offsets)
    flat, size = np.asarray(column.values, float)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = np.floor(256 * flat)
    return out


class HardNegatives:
    """The search over one table. window: 50 <= 100 * negative / positive <= 95 as (50, 95)."""

    def __init__(self, rows: DataFrame, anchor_every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (50, 95), block_rows: int | None = None):
        self.spark: SparkSession = rows.sparkSession
        self.every, self.positives, self.negatives, self.window = anchor_every, positives, negatives, window
        n, dim = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.n, self.dim = n, max(0, dim or 0)
        # Small tables have small blocks, so that as many tasks find work; the rows found are the same.
        most = max(LEAF, min(BLOCK, BLOCK_BYTES // (8 * max(1, self.dim))))
        self.block_rows = block_rows or min(most, max(1024, n // 32))
        sample = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(max(1, min(FIT, (1 << 22) // max(1, self.dim)))).toArrow()
        self.cells = Cells(dense(sample.column(0).combine_chunks(), self.dim) if n else np.zeros((1, self.dim)), max(1, min(CELLS, n // self.block_rows)))
        self.blocks, self.slabs = self._built(rows)

    def _written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, f"hard-negatives-{label}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _built(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The blocks' trees, and the anchors of each block with what the block itself gives as positives."""
        cells, dim = self.cells, self.dim

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0
            for b in batches:
                x = dense(b.column("vector"), dim)
                cell = cells.of(x)
                away = np.sqrt(((x - np.array(cells.centers)[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
                salt = (np.arange(seen, seen + len(x)) * 2654435761 >> 7) & 0x3FFFFFFF
                seen += len(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(away), b.column("vec_id"), b.column("label"), pa.array([packed(v) for v in x], pa.binary())], schema=ROW)

        placed = self._written(rows.select("vec_id", "label", "vector").mapInArrow(place, ROW_SQL), "rows")
        held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a cell, CELLS at most
        self.splits = {r["cell"]: -(-r["n"] // self.block_rows) for r in held}
        self.radii = np.array([next((r["radius"] for r in held if r["cell"] == c), -1.0) for c in range(len(cells.centers))])
        many = F.element_at(F.create_map(*[F.lit(x) for p in self.splits.items() for x in p]), F.col("cell")) if self.splits else F.lit(1)
        dealt = placed.withColumn("split", (F.col("salt") % many).cast("int"))
        every, k = self.every, self.positives

        def build(key: tuple, group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            raw = group.column("vector").to_pylist()
            x = np.concatenate([unpacked(v, 1, dim) for v in raw])
            t = BallTree.built(x, group.column("vec_id").to_pylist(), group.column("label").to_numpy())
            at = np.array([i for i, v in enumerate(t.ids) if v is not None and v % every == 0], np.int64)
            lo, hi = np.full((len(at), 1), -np.inf), np.full((len(at), 1), np.inf)
            best = searched(t, t.x[at], t.labels[at], lo, hi, lo, k, True, at)
            cell, split = (v.as_py() for v in key)
            slab = {"home_cell": cell, "home_split": split, "places": at.astype(np.int32).tobytes(), "anchors": [t.ids[i] for i in at], "anchor_labels": t.labels[at].tolist(), "anchor_vectors": packed(t.x[at]), "lo": lo.tobytes(), "hi": hi.tobytes(), "kth": best.kth.tobytes()}
            here = found(t, best, cell, split, at)
            mine = [{n: v for n, v in zip(here.schema.names, r, strict=True)} for r in zip(*[c.to_pylist() for c in here.columns], strict=True)]
            return pa.Table.from_pylist([{**t.record(cell, split), **slab, "mine": mine}], schema=both)

        entry = pa.struct([(f.name, f.type) for f in FOUND])
        both = pa.schema([*TREE, *[f for f in SLAB if f.name != "dim"], pa.field("mine", pa.list_(entry))])
        sql = f"{TREE_SQL}, {SLAB_SQL.replace('dim int, ', '')}, mine array<struct<{FOUND_SQL.replace(' ', ':').replace(',:', ',')}>>"
        built = self._written(dealt.select("cell", "split", "vec_id", "label", "vector").groupBy("cell", "split").applyInArrow(build, sql), "blocks")
        self.here = built.select(F.explode("mine").alias("m")).select("m.*")
        return built.select(*TREE.names), built.select(*SLAB.names).where(F.size("anchors") > 0)

    def _pairs(self, slabs: DataFrame, same: bool) -> DataFrame:
        """Slabs with each block, other than their own, that the cells' balls don't rule out; only the anchors concerned go."""
        centers, radii, splits, dim = np.array(self.cells.centers), self.radii, self.splits, self.dim

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    q, (lo, hi, kth) = vectors_of(r), probes_of(r)
                    least, most = bounds(q, np.linalg.norm(q, axis=1), centers, np.maximum(radii, 0))
                    alive = wanted(least, most, lo, hi, kth)
                    for cell in np.flatnonzero(alive.any(0) & (radii >= 0)):
                        i = np.flatnonzero(alive[:, cell])
                        part = {
                            "home_cell": r["home_cell"], "home_split": r["home_split"], "dim": dim, "places": np.frombuffer(r["places"], np.int32)[i].tobytes(), "anchors": [r["anchors"][x] for x in i], "anchor_labels": [r["anchor_labels"][x] for x in i],
                            "anchor_vectors": packed(q[i]), "lo": lo[i].tobytes(), "hi": hi[i].tobytes(), "kth": kth[i].tobytes(), "cell": int(cell), "split": 0,
                        }
                        for split in range(splits[int(cell)]):
                            if (cell, split) != (r["home_cell"], r["home_split"]):
                                yield pa.RecordBatch.from_pylist([{**part, "split": split}], schema=pa.schema([*SLAB, ("cell", pa.int32()), ("split", pa.int32())]))

        routed = slabs.select(*SLAB.names).mapInArrow(route, f"{SLAB_SQL}, cell int, split int")
        return self._met(routed.drop("dim"), same)

    def _met(self, routed: DataFrame, same: bool) -> DataFrame:
        """Rows found by slabs, each in the block it is sent to. Pairs go to Python one by one."""
        k = self.positives if same else self.negatives

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                    t, (lo, hi, kth) = BallTree.read(r), probes_of(r)
                    best = searched(t, vectors_of(r), np.array(r["anchor_labels"], np.int64), lo, hi, kth, k, same)
                    yield found(t, best, r["home_cell"], r["home_split"], np.frombuffer(r["places"], np.int32))

        return routed.join(self.blocks, ["cell", "split"]).mapInArrow(search, FOUND_SQL)

    def _first(self, rows: DataFrame, k: int) -> DataFrame:
        w = W.partitionBy("home_cell", "home_split", "place", "probe").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def positive_rows(self) -> DataFrame:
        """Each anchor's first rows of its own label: home_cell, home_split, place, rank, vec_id, score."""
        return self._first(self.here.unionByName(self._pairs(self.slabs, True)), self.positives)

    def result(self) -> DataFrame:
        positives = self._written(self.positive_rows(), "positives")
        probes = self._written(self._probes(positives), "probes")
        # The anchors' own blocks first: what they give bounds the search in all others.
        at_home = probes.select(*[c for c in SLAB.names if c != "dim"], F.col("home_cell").alias("cell"), F.col("home_split").alias("split"))
        home = self._written(self._met(at_home, False), "home")
        kth = home.groupBy("home_cell", "home_split", "place", "probe").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= self.negatives)
        kth = kth.groupBy("home_cell", "home_split").agg(F.collect_list(F.struct("place", "probe", "s")).alias("known"))  # a block's anchors at most
        told = probes.join(kth, ["home_cell", "home_split"], "left").mapInArrow(with_kth, SLAB_SQL)
        hard = self._first(home.unionByName(self._pairs(told, False)), self.negatives)
        names = ["home_cell", "home_split", "place"]
        anchors = probes.select("home_cell", "home_split", F.explode(F.arrays_zip("place_list", "anchors")).alias("a")).select("home_cell", "home_split", F.col("a.place_list").alias("place"), F.col("a.anchors").alias("anchor_id"))
        of = positives.select(*names, (F.col("rank") - 1).alias("probe"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(of, [*names, "probe"]).join(anchors, names)
        return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

    def _probes(self, positives: DataFrame) -> DataFrame:
        """Slabs whose probes are the windows of each anchor's positives; anchors without any drop out."""
        low, high = self.window
        k = self.positives
        mine = positives.groupBy("home_cell", "home_split").agg(F.collect_list(F.struct("place", (F.col("rank") - 1).alias("probe"), "score")).alias("known"))  # a block's anchors at most

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    places = np.frombuffer(r["places"], np.int32)
                    row = {int(p): i for i, p in enumerate(places)}
                    lo, hi = np.full((len(places), k), np.inf), np.full((len(places), k), -np.inf)
                    for x in r.pop("known"):
                        s, at = x["score"], (row[x["place"]], x["probe"])
                        lo[at], hi[at] = -(-low * s // 100), high * s // 100
                    r |= {"lo": lo.tobytes(), "hi": hi.tobytes(), "kth": np.full(lo.shape, -np.inf).tobytes(), "place_list": places.tolist()}
                    yield pa.RecordBatch.from_pylist([r], schema=pa.schema([*SLAB, ("place_list", pa.list_(pa.int32()))]))

        return self.slabs.join(mine, ["home_cell", "home_split"]).select(*SLAB.names, "known").mapInArrow(windows, f"{SLAB_SQL}, place_list array<int>")


def vectors_of(r: dict) -> np.ndarray:
    return unpacked(r["anchor_vectors"], len(r["anchors"]), r["dim"])


def probes_of(r: dict) -> list[np.ndarray]:
    return [np.frombuffer(r[n], float).reshape(len(r["anchors"]), -1) for n in ("lo", "hi", "kth")]


def with_kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            lo, hi, kth = probes_of(r)
            kth, row = kth.copy(), {int(p): i for i, p in enumerate(np.frombuffer(r["places"], np.int32))}
            for x in r["known"] or ():
                kth[row[x["place"]], x["probe"]] = x["s"]
            yield pa.RecordBatch.from_pylist([{**{n: r[n] for n in SLAB.names}, "kth": kth.tobytes()}], schema=SLAB)


def hard_negatives(vectors: DataFrame, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors; options of HardNegatives."""
    return HardNegatives(relabelled(taking_part(vectors)), **options).result()


OP13_SQL = """
WITH r AS (
    SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
    SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same,
        coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.uid <> b.uid),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
    FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))
