"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated at random and replaced by its signs: one bit a
dimension, with the inner product of the vector and its code as a stored
correction factor. The code's inner product with another rotated vector, over
the factor, is an unbiased estimate of the cosine, with a confidence bound from
the factor. Only pairs whose bound reaches the threshold are computed exactly.

Candidates come from the same codes. Bits of several rotations are cut into
bands; vectors that agree in a band are compared. Bits of a band follow the
logarithm of the number of vectors, bands the recall asked for at the threshold
itself, so work grows with less than the square of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import block_pairs, bounded_batches, grouped, local_components, quoted, sized_broadcast, written
from papyra.llm.graph import components

THRESHOLD = 0.9
#: Share of the pairs at the threshold that bands must find; nearer pairs are found more surely.
RECALL = 0.998
#: Standard errors that an estimate may lie under the threshold before a pair is ruled out.
DEVIATIONS = 4.0
#: Vectors that share a band by chance, on average; and rows of a group before it is cut into blocks.
#: A group is compared by products of matrices, so large groups are cheap and fewer bands, hence fewer copies of a vector, give the recall.
CHANCE, BLOCK = 1024, 4096
#: Groups of more than a block whose sizes are broadcast; beyond, they are shuffled to.
MOST_HOT = 1_000_000
_SEED = 20_240_601


def plan(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands). Up to ``CHANCE`` vectors there is one group of all."""
    bits = max(0, math.ceil(math.log2(max(count, 1) / CHANCE)))
    if not bits:
        return 0, 1
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def rotation(dims: int, k: int) -> np.ndarray:
    """The ``k``-th random rotation of ``dims`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng((_SEED, dims, k)).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """Rotations of one number of dimensions, as many as the bands need."""

    def __init__(self, dims: int, bits: int, bands: int):
        self.dims, self.bits, self.bands = dims, bits, bands
        self.rotations = [rotation(dims, k) for k in range(max(1, -(-bits * bands // dims)))]

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """Row, sign of each direction of each rotation."""
        return np.concatenate([unit @ r.T for r in self.rotations], axis=1) > 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """Row, band -> the band's bits as a number (of 63 bits at most)."""
        out = np.zeros((len(signs), self.bands), np.int64)
        for k in range(self.bits):
            out = (out << 1) | signs[:, k : self.bits * self.bands : self.bits]
        return out

    def factor(self, unit: np.ndarray) -> np.ndarray:
        """The inner product of each vector with its own code."""
        return np.abs(unit @ self.rotations[0].T).sum(axis=1) / math.sqrt(self.dims)


def units(array: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit vectors in double precision, which rows they are, dimensions) for each number of dimensions in turn; rows that can't link are left out."""
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    flat = array.flatten()
    bad = pc.fill_null(pc.is_null(flat), True).to_numpy(zero_copy_only=False)
    values = np.where(bad, np.nan, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for dims in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        x = values[ends[rows][:, None] + np.arange(dims)]
        largest = np.abs(x).max(axis=1)
        fine = np.isfinite(largest) & (largest > 0)
        x, rows = x[fine] / largest[fine][:, None], rows[fine]
        yield x / np.linalg.norm(x, axis=1)[:, None], rows, dims


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for _, rows, _ in units(batch.column("vector")):
            good[rows] = True
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(good)], names=["id", "vector", "good"])


def _band(bits: int, bands: int, whole: bool = True):
    """A row for each band of each vector: with the code, its correction factor and the vector, or the keys alone."""
    made: dict[int, Codes] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                for unit, rows, dims in units(part.column("vector")):
                    codes = made.setdefault(dims, Codes(dims, bits, bands))
                    signs = codes.signs(unit)
                    keys = codes.keys(signs)
                    if whole:
                        own = part.take(pa.array(rows))
                        bits_of = np.packbits(signs, axis=1)
                        code = pa.array([x.tobytes() for x in bits_of], pa.binary())
                        factor = pa.array(codes.factor(unit).astype(np.float32))
                        rest = [own.column("id"), own.column("weight"), code, factor, own.column("vector")]
                    for b in range(bands):
                        head = [pa.array(np.full(len(rows), dims, np.int32)), pa.array(np.full(len(rows), b, np.int32)), pa.array(keys[:, b])]
                        yield pa.RecordBatch.from_arrays(head + rest if whole else head, names=["dims", "band", "key", "id", "weight", "code", "factor", "vector"][: 8 if whole else 3])

    return run


def _compare(bits: int, bands: int, threshold: float):
    made: dict[int, Codes] = {}

    def linked(codes: Codes, band: int, unit: np.ndarray, signs: np.ndarray, factor: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs at the threshold that share no earlier band."""
        d = codes.dims
        turned = (unit @ codes.rotations[0].T).astype(np.float32)
        code = np.where(signs[:, :d], 1, -1).astype(np.float32) / np.float32(math.sqrt(d))
        error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1)).astype(np.float32)
        keys = codes.keys(signs) if band else None
        bound = (threshold - DEVIATIONS * error - 1e-5) * factor.astype(np.float32)
        two = bool(half.any() and not half.all())
        # of two halves, each of one is compared to each of the other; else each to those after it
        low, high = (np.flatnonzero(~half), np.flatnonzero(half)) if two else (np.arange(len(unit)), np.arange(len(unit)))
        for i in range(0, len(low), 512):
            own = low[i : i + 512]
            other = high if two else high[i:]
            near = (code[own] @ turned[other].T) >= bound[own, None]
            near |= (turned[own] @ code[other].T) >= bound[None, other]
            xs, ys = np.nonzero(near if two else np.triu(near, 1))
            for k in range(0, len(xs), 20_000):
                x, y = own[xs[k : k + 20_000]], other[ys[k : k + 20_000]]
                if band:
                    fresh = ~(keys[x, :band] == keys[y, :band]).any(axis=1)
                    x, y = x[fresh], y[fresh]
                exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                if exact.any():
                    yield x[exact], y[exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["dims", "band", "key", "low", "high"]):
            n = batch.num_rows
            if n < 2:
                continue
            dims, band = batch.column("dims")[0].as_py(), batch.column("band")[0].as_py()
            codes = made.setdefault(dims, Codes(dims, bits, bands))
            unit = next(units(batch.column("vector")))[0]
            size = len(codes.rotations) * dims
            signs = np.unpackbits(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, :size].astype(bool)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            pairs = list(linked(codes, band, unit, signs, batch.column("factor").to_numpy(), half))
            if not pairs:
                continue
            x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            ids, weight = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            links = np.bincount(x, weight[y], minlength=n) + np.bincount(y, weight[x], minlength=n)
            label = local_components(n, x, y)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])], names=["id", "links", "to"])

    return run


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, n_links, component for each row of ``vectors``.

    Rows of equal vectors form a class; one row stands for it, with its size as
    weight, so a vector that a third of all rows share is compared once. In a
    group of a band, pairs are counted where they first agree and joined to
    local components; what leaves a group is a count and an edge for each
    row, never a pair list. Groups of many near copies are cut into blocks.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths. Rows of one id are
    rows of their own with a common component. A null id has links but no
    component (null). An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector"))
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.mapInArrow(_valid, f"id long, vector {kind}, good boolean").withColumns({"one": F.xxhash64("vector"), "two": F.xxhash64(F.lit(1), "vector"), "row": F.monotonically_increasing_id()})
    rows = written(rows, "vectors")
    good = rows.where("good")
    classes = written(good.groupBy("one", "two").agg(F.min("row").alias("row"), F.min("id").alias("first"), F.count("*").alias("weight")), "classes")
    count = classes.count()
    bits, bands = plan(count, threshold, recall)
    chosen = written(classes.select("row", "weight").join(good.select("row", "vector"), "row").select(F.col("row").alias("id"), "weight", "vector"), "chosen")
    keys = ["dims", "band", "key"]
    # only groups of more than a block need to be known before the vectors are dealt out: so those move once
    sizes = chosen.mapInArrow(_band(bits, bands, False), "dims int, band int, key long").groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    hot = written(sizes.where("blocks > 1"), "hot")
    parts = chosen.mapInArrow(_band(bits, bands), f"dims int, band int, key long, id long, weight long, code binary, factor float, vector {kind}")
    parts = parts.join(sized_broadcast(hot, MOST_HOT), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    parts = block_pairs(parts, "id").repartition(*keys, "low", "high").sortWithinPartitions(*keys, "low", "high")
    found = written(parts.mapInArrow(_compare(bits, bands, threshold), "id long, links long, to long"), "near")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    # a component's smallest row stands for it; its name is the smallest id of its classes
    known = classes.join(groups.withColumnRenamed("node", "row"), "row", "left").join(sums.withColumnRenamed("id", "row"), "row", "left")
    known = known.select("one", "two", "weight", "first", F.coalesce("component", "row").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    names = known.groupBy("component").agg(F.min("first").alias("name"))
    known = known.join(names, "component").select("one", "two", "name", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = good.select("id", "one", "two").join(known, ["one", "two"]).select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("name")).alias("component"))
    return out.union(rows.where("not good").select("id", F.lit(0).cast("long"), F.col("id")))


def digest(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    out = linked(vectors, **options)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
