"""Hashes counted in cells, added up over all tasks: a count-min sketch, or a Bloom filter.

Each row of a sketch deals hashes to 2**bits cells by a hash of its own. Tasks
write the cells that they met, block by block of 65,536; the blocks of all tasks
are added up. What leaves the cluster is one bit a cell, whether its count is
high enough: DEPTH * 2**bits bits, 64 MB at most, whatever the corpus. A hash
whose own count is high enough has all its bits set; others have them by chance,
the likelier the fuller the sketch, so what passes is settled exactly afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import mixed

#: Cells of a row are 2**LEAST_BITS to 2**BITS: LOAD for each hash.
LEAST_BITS, BITS, DEPTH, LOAD = 20, 28, 2, 8
FLUSH = 1 << 21

CELLS = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])
CELLS_SQL = "row int, block int, cells binary"


def sized(n: float) -> int:
    """Bits that number a row's cells in a sketch of n hashes."""
    return min(BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, LOAD * n)))))


def cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(h ^ np.uint64(0x5851F42D4C957F2D * (row + 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def cells(hashes: Iterable[np.ndarray], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """row, block, cells: what a task's hashes add to each block (two-byte cell numbers); of equal cells only `most` are told."""

    def flush():
        h = np.concatenate(held)
        for row in range(DEPTH):
            c = np.sort(cell(h, row, bits))
            c = c[np.concatenate((np.ones(min(most, len(c)), bool), c[most:] != c[:-most]))]
            block = c >> 16
            s = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            low = (c & 65535).astype(np.uint16)
            parts = [low[a:b].tobytes() for a, b in zip(s.tolist(), [*s[1:].tolist(), len(c)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row, np.int32)), pa.array(block[s].astype(np.int32)), pa.array(parts, pa.binary())], schema=CELLS)

    held, size = [], 0
    for h in hashes:
        held.append(h)
        size += len(h)
        if size >= FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def packed(parts: DataFrame, bits: int, least: int) -> list[np.ndarray]:
    """For each row of the sketch, a packed bit per cell: whether its count over all tasks is `least` (1 or 2) or more."""

    def add(batches):
        at, total = None, None

        def done():
            return {"row": at[0], "block": at[1], "bits": np.packbits(total >= least, bitorder="little").tobytes()}

        for b in batches:
            out = []
            for row, block, low in zip(*(b.column(c).to_pylist() for c in ("row", "block", "cells")), strict=True):
                if at != (row, block):
                    if at is not None:
                        out.append(done())
                    at, total = (row, block), np.zeros(65536, np.uint8)
                more = np.minimum(np.bincount(np.frombuffer(low, np.uint16), minlength=65536), 2).astype(np.uint8)
                total = np.minimum(total + more, 2)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])
    dealt = parts.repartition("row", "block").sortWithinPartitions("row", "block")
    sketch = [np.zeros(1 << bits - 3, np.uint8) for _ in range(DEPTH)]
    for r in dealt.mapInArrow(add, "row int, block int, bits binary").collect():  # DEPTH * 2**bits bits
        sketch[r["row"]][r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return sketch


def all_set(sketch: list[np.ndarray], h: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have the bits of all their cells set."""
    keep = np.ones(len(h), bool)
    for row, bit in enumerate(sketch):
        c = cell(h, row, bits)
        keep &= (bit[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
    return keep


def folded(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of long columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mixed(h ^ np.asarray(c, np.int64).view(np.uint64)) + np.uint64(1)
    return h


def membership(df: DataFrame, n: int) -> Callable[..., np.ndarray]:
    """A test of rows, by their columns, that is true of all n rows of df (long columns, no nulls) and of few others."""
    bits = sized(n)

    def run(batches):
        yield from cells((folded(*(c.to_numpy(zero_copy_only=False) for c in b.columns)) for b in batches), bits, 1)

    sketch = df.sparkSession.sparkContext.broadcast(packed(df.mapInArrow(run, CELLS_SQL), bits, 1))
    return lambda *columns: all_set(sketch.value, folded(*columns), bits)
