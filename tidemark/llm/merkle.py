"""A Merkle manifest of a dataset: a root for each source, one for all, and every row's proof.

A leaf is a row's digest. Leaves of a source ascend by doc_id; runs of three
nodes (the last may be shorter) become their digest, level by level, until one is
left. The sources' roots, ordered by source, give the dataset's root likewise.

Leaves get their places by a range sort in two passes (counts of each part,
then offsets), and aligned blocks of 3**LEVELS leaves are a group each, so a hot
source is many groups. Each block's root comes from one treehash stack. The
blocks' roots are leaves of the next round, and so on; the paths of a round are
appended to those of the rounds below. Within a block, treehash stacks advance
the authentication path leaf by leaf: they hold the current runs of each level
and what the next runs need, a few nodes a level, and share a fixed number of
steps a leaf, the stack with the lowest tail first.

Cases: nulls have an encoding of their own. Rows that repeat a doc_id are
ordered by their leaves, rows that repeat altogether stand side by side. A null
doc_id comes first in its source, and its row is never tampered with. An empty
table gives no rows. Long texts are hashed where they are read; only digests
move on. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, table

#: Nodes of a run, and levels of a block: 3**8 = 6561 leaves.
ARITY, LEVELS = 3, 8

#: The siblings of one level, left and right of a path's node.
Level = tuple[list[str], list[str]]
PATH_SQL = "array<struct<left:array<string>,right:array<string>>>"
SIDE = pa.list_(pa.string())
PATH = pa.list_(pa.struct([("left", SIDE), ("right", SIDE)]))


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels between n nodes and the one above them all."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class Treehash:
    """Computes one node, a leaf a step, with a stack of one or two nodes a level."""

    def __init__(self, leaves: Sequence[str], height: int, index: int):
        self.leaves, self.height, self.stack = leaves, height, []
        self.next = index * ARITY**height
        self.end = min(len(leaves), self.next + ARITY**height)

    @property
    def open(self) -> bool:
        return self.next < self.end

    @property
    def tail(self) -> int:
        return self.stack[-1][0] if self.stack else self.height

    def _merge(self, height: int) -> None:
        """The nodes of this height at the stack's top become one above them."""
        i = len(self.stack)
        while i and self.stack[i - 1][0] == height:
            i -= 1
        self.stack[i:] = [(height + 1, digest([x for _, x in self.stack[i:]]))]

    def step(self) -> None:
        self.stack.append((0, self.leaves[self.next]))
        self.next += 1
        while len(self.stack) >= ARITY and self.stack[-ARITY][0] == self.stack[-1][0] and self.stack[-1][0] < self.height:
            self._merge(self.stack[-1][0])
        if not self.open:  # the last runs can be short
            while self.stack[-1][0] < self.height:
                self._merge(self.stack[-1][0])

    def value(self) -> str:
        while self.open:
            self.step()
        return self.stack[0][1]


def traversal(leaves: Sequence[str], levels: int) -> Iterator[list[Level]]:
    """Each leaf's siblings, level by level up to `levels`, from left to right in a run."""
    n = len(leaves)

    def run(h: int, r: int) -> list[Treehash | None]:
        """Stacks for the second and third node of a level's r-th run, where there are such."""
        return [Treehash(leaves, h, x) if x * ARITY**h < n else None for x in range(r * ARITY + 1, (r + 1) * ARITY)]

    held = [[None, *[t and t.value() for t in run(h, 0)]] for h in range(levels)]
    coming = [run(h, 1) for h in range(levels)]
    for i in range(n):
        at = [i // ARITY**h % ARITY for h in range(levels)]
        yield [(row[:d], [x for x in row[d + 1 :] if x is not None]) for row, d in zip(held, at, strict=True)]
        for _ in range(levels):
            least = min((t for two in coming for t in two if t is not None and t.open), key=lambda t: (t.tail, t.height), default=None)
            if least is None:
                break
            least.step()
        node = leaves[i]
        for h, d in enumerate(at):
            held[h][d] = node
            if d < ARITY - 1:
                break
            node = digest(held[h])
            held[h] = [None, *[t and t.value() for t in coming[h]]]
            coming[h] = run(h, i // ARITY ** (h + 1) + 2)


def folded(node: str, path: Sequence[Level]) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest([*left, node, *right])
    return node


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], encoded(text)).cast("binary"), 256)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, f"merkle-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `pos`, their place in their `tree` by `order`, and `n`, the tree's rows. Ties go as the rows are read."""
    spark = rows.sparkSession
    names, sql = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    order = (F.col("tree"), *order, F.monotonically_increasing_id())
    keyed = rows.withColumns({f"by_{i}": c for i, c in enumerate(order)})
    by = [F.col(f"by_{i}").asc_nulls_first() for i in range(len(order))]
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).select(*names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for t in b.column("tree").to_pylist():
                tree, k = t, k + 1 if t == tree else 0
                at.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*names, "part", "at"])

    found = _written(ranged.mapInArrow(numbered, f"{sql}, part int, at long"), "places")
    counts = found.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    whole = W.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("n"))
    return found.join(offsets, ["tree", "part"]).select(*names, (F.col("offset") + F.col("at")).alias("pos"), "n")


class Manifest:
    """Roots and upper paths of trees given as rows of (tree, pos, n, digest)."""

    def __init__(self, leaves: DataFrame, levels: int = LEVELS):
        self.levels, self.block = levels, ARITY**levels
        self.rounds: list[DataFrame] = []  # of each round above the first, a node's path within its block
        nodes, n = self._tops(leaves), -(-(leaves.agg(F.max("n")).first()[0] or 0) // self.block)
        while n > 1:
            nodes = _written(self._blocks(nodes, True), "round")
            self.rounds.append(nodes.select("tree", F.explode("paths").alias("p")).select("tree", F.col("p.pos").alias("pos"), F.col("p.path").alias("path")))
            nodes, n = nodes.drop("paths"), -(-n // self.block)
        self.roots = nodes.select("tree", "digest")

    def _tops(self, leaves: DataFrame) -> DataFrame:
        return _written(self._blocks(leaves, False), "blocks")

    def _blocks(self, nodes: DataFrame, paths: bool) -> DataFrame:
        """The node above each block: tree, pos, n, digest; with paths, those of the block's nodes."""
        levels, size = self.levels, self.block

        def top(key: tuple, group: pa.Table) -> pa.Table:
            tree, block = (k.as_py() for k in key)
            group = group.sort_by("pos")
            leaves, n = group.column("digest").to_pylist(), group.column("n")[0].as_py()
            h = min(levels, levels_of(n))
            out = {"tree": tree, "pos": block, "n": -(-n // size), "digest": Treehash(leaves, h, 0).value()}
            if paths:
                out["paths"] = [{"pos": p, "path": [{"left": a, "right": b} for a, b in path]} for p, path in zip(group.column("pos").to_pylist(), traversal(leaves, h), strict=True)]
            return pa.Table.from_pylist([out], schema=pa.schema(fields))

        fields = [("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]
        sql = "tree string, pos long, n long, digest string"
        if paths:
            fields.append(("paths", pa.list_(pa.struct([("pos", pa.int64()), ("path", PATH)]))))
            sql += f", paths array<struct<pos:bigint,path:{PATH_SQL}>>"
        own = nodes.select("tree", F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "n", "digest")
        return own.groupBy("tree", "block").applyInArrow(top, sql)

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, block, path of the first round's blocks; above: tree, path of the trees' roots."""
        path = above.withColumn("block", F.lit(0).cast("long"))
        for each in reversed(self.rounds):
            mine = each.withColumnRenamed("path", "own").withColumn("up", F.floor(F.col("pos") / self.block).cast("long"))
            path = mine.join(path.withColumnRenamed("block", "up"), ["tree", "up"]).select("tree", F.col("pos").alias("block"), F.concat("own", "path").alias("path"))
        return path


def manifest(docs: DataFrame, tampered: Column | None = None, where: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Where `where` holds, the leaf to be verified is taken from the text `tampered`.
    """
    leaf = leaf_of(F.col("text"))
    shown = leaf if tampered is None else F.when(F.coalesce(where, F.lit(False)), leaf_of(tampered)).otherwise(leaf)
    source = F.col("source").cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("tree"), "doc_id", leaf.alias("digest"), shown.alias("shown"))
    leaves = _written(placed(rows, F.col("doc_id"), F.col("digest")), "leaves")
    trees = Manifest(leaves, levels)
    # The sources' roots are one tree above.
    subroots = _written(placed(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), F.col("source")), "subroots")
    whole = Manifest(subroots, levels)
    size, empty = ARITY**levels, F.lit(None).cast(PATH_SQL)
    upper = whole.paths(whole.roots.select("tree", F.coalesce(empty, F.expr(f"cast(array() as {PATH_SQL})")).alias("path")))
    root = whole.roots.select(F.col("digest").alias("root"), F.lit("").alias("tree"))
    own = _authenticated(subroots.withColumnRenamed("source", "name"), upper.join(root, "tree"), levels, size)
    above = own.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    # Each block's path above it, and the roots that go with it.
    blocks = trees.paths(above.select("tree", "path")).join(above.select("tree", "subroot", "root"), "tree")
    return _verified(leaves, blocks, levels, size)


def _authenticated(leaves: DataFrame, blocks: DataFrame, levels: int, size: int) -> DataFrame:
    """name, digest, root and the whole path of each leaf of the tree of sources."""

    def authenticate(key: tuple, group: pa.Table, up: pa.Table) -> pa.Table:
        schema = pa.schema([("name", pa.string()), ("digest", pa.string()), ("root", pa.string()), ("path", PATH)])
        if not group.num_rows:
            return schema.empty_table()
        group, above = group.sort_by("pos"), up.to_pylist()[0]
        nodes, n = group.column("digest").to_pylist(), group.column("n")[0].as_py()
        paths = ([{"left": a, "right": b} for a, b in path] + above["path"] for path in traversal(nodes, min(levels, levels_of(n))))
        names = group.column("name").to_pylist()
        return pa.Table.from_pylist([{"name": s, "digest": d, "root": above["root"], "path": p} for s, d, p in zip(names, nodes, paths, strict=True)], schema=schema)

    own = leaves.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy("tree", "block")
    return own.cogroup(blocks.groupBy("tree", "block")).applyInArrow(authenticate, f"name string, digest string, root string, path {PATH_SQL}")


def _verified(leaves: DataFrame, blocks: DataFrame, levels: int, size: int) -> DataFrame:
    def verify(key: tuple, group: pa.Table, up: pa.Table) -> pa.Table:
        group, above = group.sort_by("pos"), up.to_pylist()[0]
        nodes, n = group.column("digest").to_pylist(), group.column("n")[0].as_py()
        upper = [(x["left"], x["right"]) for x in above["path"]]
        top = "".join(x for two in upper for side in two for x in side).encode()
        proofs, roots = [], []
        for path, shown in zip(traversal(nodes, min(levels, levels_of(n))), group.column("shown").to_pylist(), strict=True):
            proofs.append(hashlib.sha256("".join(x for two in path for side in two for x in side).encode() + top).hexdigest())
            roots.append(folded(folded(shown, path), upper))
        many = lambda x: pa.array([x] * len(nodes), pa.string())
        source = [t[1:] if t[0] == "1" else None for t in group.column("tree").to_pylist()]
        good = pa.array([r == above["root"] for r in roots], pa.bool_())
        cols = [group.column("doc_id"), pa.array(source, pa.string()), group.column("digest"), many(above["subroot"]), many(above["root"]), pa.array(proofs, pa.string()), pa.array(roots, pa.string()), good]
        return pa.table(cols, names=["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = leaves.schema["doc_id"].dataType.simpleString()
    own = leaves.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy("tree", "block")
    return own.cogroup(blocks.groupBy("tree", "block")).applyInArrow(verify, f"doc_id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_SQL_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
#: The unsigned CRC-32 of a decimal number, bit by bit.
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, sha256({_SQL_LEAF} || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        sha256({_SQL_LEAF} || coalesce(strlen(replace(text, chr(10), ''))::VARCHAR || ':' || replace(text, chr(10), ''), '-')) AS cut, coalesce({_SQL_CRC} % 2 = 0, false) AS tampered
    FROM documents),
leaves AS (
    SELECT row_number() OVER () AS id, doc_id, tree, leaf, CASE WHEN tampered THEN cut ELSE leaf END AS shown,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes AS (
    SELECT tree, 0 AS h, pos, n, leaf AS node FROM leaves
    UNION ALL
    SELECT tree, h + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, h, pos // 3, n),
subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 1000 AS h, pos, n, node FROM subroots
    UNION ALL
    SELECT h + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY h, pos // 3, n),
every AS (SELECT tree, h, pos, n, node FROM nodes UNION ALL SELECT NULL, h, pos, n, node FROM tops),
walk AS (
    SELECT id, tree, 0 AS h, pos, n, shown AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT w.id, any_value(w.tree), CASE WHEN any_value(w.n) > 1 THEN w.h + 1 ELSE 1000 END, any_value(CASE WHEN w.n > 1 THEN w.pos // 3 ELSE s.pos END),
        any_value(CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE s.n END), CASE WHEN any_value(w.n) > 1 THEN sha256(string_agg(CASE WHEN e.pos = w.pos THEN w.node ELSE e.node END, '' ORDER BY e.pos)) ELSE any_value(w.node) END,
        any_value(w.proof) || coalesce(string_agg(CASE WHEN e.pos <> w.pos THEN e.node END, '' ORDER BY e.pos), '')
    FROM walk w
    LEFT JOIN every e ON w.n > 1 AND e.h = w.h AND e.pos // 3 = w.pos // 3 AND (w.h >= 1000 OR e.tree = w.tree)
    LEFT JOIN subroots s ON w.n = 1 AND s.tree = w.tree
    WHERE w.n > 1 OR w.h < 1000 GROUP BY w.id, w.h)
SELECT l.doc_id, CASE WHEN l.tree <> '0' THEN l.tree[2:] END AS source, l.leaf, s.node AS subroot, r.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.node AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN walk w ON w.id = l.id AND w.h >= 1000 AND w.n = 1 JOIN tops r ON r.n = 1
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.regexp_replace("text", "\n", ""), even)
