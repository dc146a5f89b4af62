"""Vector code compression: product quantisation with codebook search by annular norm pruning.

Vectors become whole numbers, are cut into equal parts, and each part is
replaced by the index of the nearest entry of its codebook. Codebooks are
fitted by rounds of assignment and averaging; all of it is whole-number
arithmetic, so results don't depend on how rows are dealt out.

The nearest entry is found by norms: entries are sorted by length; an entry
nearer than the best one so far has a length within that distance of the
part's, which two binary searches turn into an interval, an annulus around the
origin. The entries of that interval, ends included, are compared exactly, and it
shrinks whenever a nearer one is found.

Tasks return a sum for each component of each entry, so what meets in a shuffle
and at the driver has the size of the codebooks, however many rows there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import bounded_batches, drop_written, quoted, sized_broadcast, written

#: Whole numbers to one, parts of a vector, entries of a codebook, rounds of fitting.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole numbers are below this, so that distances and sums are exact in 64 bits.
MOST = 1 << 27
#: Rows of a numpy pass.
ROWS = 4096
#: Labels whose sums are broadcast; more are joined by a shuffle.
MOST_LABELS = 200_000


def integers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): vectors as whole numbers, rounded down; rows whose vector is null or has null or non-finite components go.

    Raises an error where a component is too large for exact sums (``MOST`` / ``SCALE``).
    """
    e = quoted(vector)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    fits = ~F.exists(e, lambda x: F.abs(whole(x)) >= MOST)
    v = F.when(fits, F.transform(e, lambda x: whole(x).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is {MOST // SCALE} or more in size")).cast("array<int>"))
    return vectors.where(e.isNotNull() & ~F.exists(e, odd)).select(quoted(id_col).alias("vec_id"), quoted(label).alias("label"), v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, exact comparisons made) for each row of ``x``; ties go to the lower index."""
    norms = np.sqrt((book * book).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt((x * x).sum(axis=1))

    def distance(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x[rows] - book[entry]
        return (d * d).sum(axis=1)

    every = np.arange(len(x))
    first = np.minimum(np.searchsorted(norms, own), len(book) - 1)
    code = order[first]
    best = distance(every, code)
    low, high = np.empty(len(x), np.int64), np.empty(len(x), np.int64)

    def annulus(rows: np.ndarray) -> None:
        reach = np.sqrt(best[rows]) * (1 + 1e-9) + 1e-6  # inclusive, whatever roots are rounded to
        low[rows], high[rows] = np.searchsorted(norms, own[rows] - reach, "left"), np.searchsorted(norms, own[rows] + reach, "right")

    annulus(every)
    compared = len(x)
    # outwards from the part's own norm, so that the best distance soon is a short one
    for step in (s for k in range(1, len(book)) for s in (k, -k)):
        place = first + step
        rows = np.flatnonzero((low <= place) & (place < high))
        entry = order[place[rows]]
        d = distance(rows, entry)
        compared += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < code[rows]))
        rows = rows[better]
        best[rows], code[rows] = d[better], entry[better]
        annulus(rows)
    return code, best, compared


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the parts of each row."""
    width = x.shape[1] // len(books)
    found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, at, total) of all rows of a task: component sums, and counts at -1."""
    size = width // len(books)
    totals = np.zeros((len(books), len(books[0]), size + 1), np.int64)
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            x = matrix(batch.column("v").slice(begin, ROWS), width)
            codes, _ = assigned(x, books)
            for p in range(len(books)):
                by = np.argsort(codes[:, p], kind="stable")
                entries, starts = np.unique(codes[by, p], return_index=True)
                own = x[by, p * size : (p + 1) * size]
                totals[p, entries, 0] += np.diff([*starts, len(by)])
                totals[p, entries, 1:] += np.add.reduceat(own, starts, axis=0)
    part, entry, at = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(totals[part, entry, at])], ["part", "entry", "at", "total"])


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position, fitted on all rows of :func:`integers`.

    They start as the parts of the ``entries`` smallest vec_ids (null ids last, repeated ids by their vectors); an unused entry stays
    as it is. Vectors have the length of the longest, up to a multiple of ``parts``: shorter ones count as zeros there. No row gives no codebook.
    """
    bounded_batches(rows.sparkSession)
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return []
    width = -(-width // parts) * parts
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = matrix(pa.array([r["v"] for r in first], pa.list_(pa.int32())), width)
    size = width // parts
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]
    for _ in range(rounds):
        each = rows.select("v").mapInArrow(lambda batches, books=books: _sums(batches, books, width), "part int, entry int, at int, total long")
        totals = np.zeros((parts, len(first), size + 1), np.int64)
        for r in each.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect():
            totals[r["part"], r["entry"], r["at"] + 1] = r["total"]
        counts = totals[:, :, :1]
        books = [np.where(n > 0, t // np.maximum(n, 1), book) for n, t, book in zip(counts, totals[:, :, 1:], books, strict=True)]
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encoded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances summed over parts."""
    bounded_batches(rows.sparkSession)
    kind = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return rows.sparkSession.createDataFrame([], kind)
    width = books[0].shape[1] * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                own = batch.slice(begin, ROWS)
                codes, distances = assigned(matrix(own.column("v"), width), books)
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * len(books)
                code = [text[i : i + step] for i in range(0, len(text), step)]
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(distances.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, kind)


def decoded(codes: DataFrame, books: list[np.ndarray], code: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, as numbers of the vectors' own scale."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in entry)) for entry in book)) for book in books))
    index = lambda p: F.conv(F.substring(quoted(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*(F.get(F.get(entries, F.lit(p)), index(p)) for p in range(len(books))))))


def digest(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that is whole and finite.

    Null vectors and such with null or non-finite components are left out; empty vectors are all zeros. Repeated rows get
    a row each; null labels are one label; an empty table gives an empty result. Further columns are left alone.
    """
    rows = written(integers(vectors, id_col, vector, label), "integers")
    books = codebooks(rows)
    out = written(encoded(rows, books), "codes")
    drop_written(rows)
    sums = written(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = out.join(sized_broadcast(sums, MOST_LABELS), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
