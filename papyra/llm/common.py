"""Shared pieces of the training-data operators: shared-folder tables, bounded Arrow slices, byte-level tokenising and hashing."""

from __future__ import annotations

import atexit
import functools
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import importable

#: Text bytes that one numpy pass works on; a longer single text is taken alone.
SLICE_BYTES = 2 << 20
#: Bytes of one Arrow batch between the JVM and a Python worker.
ARROW_BYTES = 8 << 20
ARROW_ROWS = 4096

_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, a folder is chosen here: a temporary one if Spark
    runs in this process (tests), the warehouse on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="papyra-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _tables:
        spark, path = _tables.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, S110  the session may have ended before
            pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage in a way that survives lost executors. The files go
    when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/papyra-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    # the plan runs once, so its shuffle files can go as soon as the table is there
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._papyra_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that nothing will read again."""
    for path in (t._papyra_path for t in tables):
        for entry in [e for e in _tables if e[1] == path]:
            _remove(*entry)
            _tables.remove(entry)


def sized_broadcast(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (a written table) to be broadcast if it has at most so many rows, else to be joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB, so that a worker's memory doesn't follow the length of the texts."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until no column is called so, in either case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def any_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of a table and options that works on columns with dots in their names too, which Arrow steps can't take."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *others, **options) -> DataFrame:
        odd = [c for c in docs.columns if "." in c or "`" in c]
        new = dict(zip(odd, spare(docs.columns, *(c.replace(".", "_").replace("`", "_") for c in odd)), strict=True))
        options = {k: new.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        out = stage(docs.toDF(*(new.get(c, c) for c in docs.columns)) if odd else docs, *others, **options)
        back = {v: k for k, v in new.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns)) if odd else out

    return run


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``3 * most`` of ``rows`` by a hash of ``key``, all of them if there are fewer: what a first ``most`` in the order of that hash is picked from.

    Without it, every task would send ``most`` rows to the driver.
    """
    share = min(1.0, 3 * most / max(1, rows.count()))
    return rows if share == 1 else rows.where(F.xxhash64(key) < int((2 * share - 1) * 2**63))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a JSON literal, without an RDD of Python objects."""
    fields = [x.strip().split(" ", 1) for x in schema.split(", ")]
    text = json.dumps([dict(zip((name for name, _ in fields), r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{a}:{b}' for a, b in fields)}>>")))


# --- texts of an Arrow batch as bytes -------------------------------------------------


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array):
        return np.empty(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have ``most`` bytes at most, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin, size = np.cumsum(lengths), 0, len(lengths)
        while begin < size:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of equal ``keys`` (integers without nulls) in sorted batches; a run may cross batches."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, [batch.num_rows]]).tolist()
        if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in keys):
            yield whole()
            held = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield whole()
                held = []
    if held:
        yield whole()


def block_pairs(rows: DataFrame, id_col: str) -> DataFrame:
    """Each row of a group in the block pairs of its group: a group is cut into ``blocks`` (a column) by a hash of the id, and each pair of blocks (low, high) is a group; ``half`` tells its two blocks apart."""
    own = rows.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "half": F.col("own") > F.col("other")}).drop("own", "other", "blocks")


def blocked(rows: DataFrame, keys: list[str], id_col: str, most: int, weight: Column | None = None) -> DataFrame:
    """:func:`block_pairs` with blocks of about ``most`` in weight (rows)."""
    total = F.count("*") if weight is None else F.sum(weight)
    count = rows.groupBy(*keys).agg(F.ceil(total / most).cast("int").alias("blocks"))
    return block_pairs(rows.join(count, keys), id_col)


def local_components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches by the links (x, y)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


# --- words and their hashes -----------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


#: Lower-cases A to Z, nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased UTF-8.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_BYTE = _stream(256, 7)
_P = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8
_P_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            steps = np.full(n, p, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words:
    """The words of several texts: ``start`` and ``end`` bytes (``end`` is exclusive), ``hash`` (64 bits), and for each text the range ``first[i]:first[i + 1]`` of its words."""

    __slots__ = ("end", "first", "hash", "low", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        self.low = low = LOWER[data]
        inside = np.zeros(len(low) + 1, bool)
        inside[:-1] = letters[low]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        ends = inside[1:] < inside[:-1]
        heads = offsets[1:-1]
        heads = heads[(heads > 0) & (heads < len(low))]
        begins[heads] |= inside[heads]
        ends[heads - 1] |= inside[heads - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = word_hashes(low, self.start, self.end)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """A polynomial hash of each range, mixed with its length; memory follows ``block`` or the longest word."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        lo, hi = start[i], end[j - 1]
        power, inverse = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[low[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return _mixed(out)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words within one text, index of its first word)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    weights = _stream(n, 1000 + n) | np.uint64(1)
    total = hashes[:size] * weights[0]
    for k in range(1, n):
        total += hashes[k : k + size] * weights[k]
    at = np.arange(size)
    last = np.repeat(first[1:], np.diff(first))[:size]  # the end of the text that the first word is in
    keep = at + n <= last
    return _mixed(total[keep]), at[keep]


def char_at(data: np.ndarray, positions: np.ndarray, begin: int) -> np.ndarray:
    """Code points of ``data`` from byte ``begin`` up to each of the byte positions."""
    if not len(positions):
        return np.empty(0, np.int64)
    counts = np.zeros(int(positions.max()) - begin + 1, np.int64)
    np.cumsum((data[begin : begin + len(counts) - 1] & 0xC0) != 0x80, out=counts[1:])
    return counts[positions - begin]
