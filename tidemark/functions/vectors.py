"""Feature-hashed embeddings and int8 vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512


def bucket512(text: Column) -> Column:
    """FNV-1a-64 modulo 512: the low nine bits depend on themselves alone, so nine-bit steps give them."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(hexed) - 1, F.lit(1)), F.lit(2))
    byte = lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("int")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * 435).bitwiseAND(F.lit(511))
    return F.when(F.length(hexed) == 0, F.lit(293)).otherwise(F.aggregate(at, F.lit(293), step))


def features(text: Column) -> Column:
    """Words, and neighbouring words joined by U+001F; lower case, letters and digits only."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit("\u001f"), b))
    return F.concat(w, pairs)


def scaled(v: Column, factor: Column) -> Column:
    """v times factor; factor should be a column of its own, as a lambda computes it per element."""
    return F.transform(v, lambda x: x * factor)


def squared_length(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column that a lambda refers to would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quantize(df: DataFrame, column: str, dim: int) -> DataFrame:
    """df plus ints and scale: the first dim numbers as a unit vector in steps of scale, half away from zero.

    A zero vector stays zero, with scale 1.
    """

    def steps(u: Column, scale: Column) -> Column:
        ints = F.transform(u, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale).cast("int"))).cast("tinyint"))
        return F.struct(ints.alias("ints"), scale.cast("float").alias("scale"))

    most = lambda u: F.aggregate(u, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    unit = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
    of_unit = lambda u: let(most(u), lambda m: let(F.when(m > 0, m / 127).otherwise(F.lit(1.0)), lambda s: steps(u, s)))
    q = let(F.transform(F.slice(column, 1, dim), lambda x: x.cast("double")), lambda v: let(F.sqrt(squared_length(v)), lambda n: let(unit(v, n), of_unit)))
    return df.withColumn("_q", q).select(*df.columns, F.col("_q.ints").alias("ints"), F.col("_q.scale").alias("scale"))


def dequantized(ints: Column, scale: Column) -> Column:
    return F.transform(ints, lambda x: x * scale)


def int_dot(a: Column, b: Column) -> Column:
    """Exact sum of products of two int8 vectors; 0 where their lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))


def similarity(a: Column, scale_a: Column, b: Column, scale_b: Column) -> Column:
    return int_dot(a, b) * scale_a.cast("double") * scale_b.cast("double")
