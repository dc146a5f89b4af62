"""Benchmark decontamination: broadcast hash set of normalised test n-grams, window scan, exact verification.

A benchmark up to ``BROADCAST_BYTES`` is one broadcast and one pass over the
documents without a shuffle. A larger one is cut into slices of that size, and
each is a job of its own that writes the hits of the documents that hit: so a
task has one Python worker and one hash set whatever the benchmark's size.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import ALNUM, Words, any_names, bounded_batches, drop_written, quoted, slices, spare, text_bytes, windows, written

#: Words of a window; a shorter item is one window of all its words.
WINDOW = 13
#: Benchmark text (bytes) in one broadcast hash set.
BROADCAST_BYTES = 8 << 20
#: Bits of the filter before the hash set: 32 for each window, within these powers of 2.
_LEAST_BITS, _MOST_BITS = 10, 22
#: Tables of hits that are read as one.
_TABLES = 32
_RANGES = "array<struct<begin:int,end:int>>"


def _slices(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """Groups of (item id, text) of ``most`` bytes each; the driver holds one group at a time."""
    group, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        group.append((item, text))
        size += 4 * len(text) + 64
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def hash_set(items: list[tuple[str | None, str]], window: int) -> dict[int, dict[bytes, list[str | None]]]:
    """Window length -> words of a window, joined by one space -> ids of the items it occurs in."""
    found: dict[int, dict[bytes, set]] = {}
    for item, text in items:
        words = Words(*text_bytes(pa.array([text], pa.large_string())), ALNUM)
        own = [words.word(i) for i in range(len(words.start))]
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            found.setdefault(n, {}).setdefault(b" ".join(own[i : i + n]), set()).add(item)
    return {n: {k: list(v) for k, v in x.items()} for n, x in found.items()}


class _Lookup:
    """The hash set as sorted window hashes behind a bit table."""

    def __init__(self, packed: bytes):
        self.exact = pickle.loads(packed)  # noqa: S301  made by this driver
        self.sorted, self.bits = {}, {}
        for n, texts in self.exact.items():
            joined = pa.array([k.decode("utf-8", "surrogateescape") for k in texts], pa.large_string())
            words = Words(*text_bytes(joined), ALNUM)
            hashes, _ = windows(words.hash, words.first, n)
            self.sorted[n] = np.sort(hashes)
            size = min(_MOST_BITS, max(_LEAST_BITS, (32 * len(hashes)).bit_length()))
            self.bits[n] = np.zeros(1 << size, bool)
            self.bits[n][hashes >> np.uint64(64 - size)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, list]]:
        """(first word, window length, items) of each verified occurrence."""
        for n, texts in self.exact.items():
            hashes, at = windows(words.hash, words.first, n)
            maybe = np.flatnonzero(self.bits[n][hashes >> np.uint64(65 - len(self.bits[n]).bit_length())])
            known = self.sorted[n]
            place = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            for i in at[maybe[known[place] == hashes[maybe]]].tolist():
                items = texts.get(b" ".join(words.word(j) for j in range(i, i + n)))
                if items:
                    yield i, n, items


def _found(words: Words, lookup: _Lookup) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set]]:
    """(word ranges, items) of each text that hits."""
    ranges: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set] = {}
    for i, n, ids in lookup.hits(words):
        d = int(np.searchsorted(words.first, i, side="right")) - 1
        begin = i - int(words.first[d])
        ranges.setdefault(d, []).append((begin, begin + n))
        items.setdefault(d, set()).update(ids)
    return {d: _merged(r) for d, r in ranges.items()}, items


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _range_array(ranges: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"begin": b, "end": e} for b, e in r] for r in ranges], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))


def _made(words: Words, ranges: list[list[tuple[int, int]]], items: list[set]) -> list[pa.Array]:
    return [
        pa.array(np.diff(words.first).astype(np.int64)), pa.array([sum(e - b for b, e in r) for r in ranges], pa.int64()), _range_array(ranges),
        pa.array([sorted(x, key=lambda i: (i is not None, i)) for x in items], pa.list_(pa.string())),
    ]


def _scan(packed, text_col: str, columns: list[str], made: list[str]):
    kept: list[_Lookup] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(_Lookup(packed.value))
        for batch in slices(batches, text_col):
            words = Words(*text_bytes(batch.column(text_col)), ALNUM)
            ranges, items = _found(words, kept[0])
            n = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *_made(words, [ranges.get(d, []) for d in n], [items.get(d, set()) for d in n])], names=columns + made)

    return run


def _hits(packed):
    """(row, ranges, items) of the documents that hit."""
    kept: list[_Lookup] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(_Lookup(packed.value))
        for batch in slices(batches):
            ranges, items = _found(Words(*text_bytes(batch.column("text")), ALNUM), kept[0])
            if ranges:
                at = sorted(ranges)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), _range_array([ranges[d] for d in at]), pa.array([list(items[d]) for d in at], pa.list_(pa.string()))], names=["row", "ranges", "items"])

    return run


def _gather(text_col: str, columns: list[str], made: list[str], all_ranges: str, all_items: str):
    """The hits of all slices, put together for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = Words(*text_bytes(batch.column(text_col)), ALNUM)
            ranges = [_merged([(r["begin"], r["end"]) for r in own or ()]) for own in batch.column(all_ranges).to_pylist()]
            items = [set(own or ()) for own in batch.column(all_items).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *_made(words, ranges, items)], names=columns + made)

    return run


@any_names
def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = BROADCAST_BYTES, made: tuple[str, ...] = ("_n_words", "_n_hit", "_ranges", "_items")) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit``, ``_ranges`` (word ranges that benchmark windows cover) and ``_items`` (ids of the items found).

    Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z
    lower-cased. A window is ``window`` consecutive words of an item, or the
    whole item if it is shorter. Each hash hit is verified on the words
    themselves.

    Null and empty texts have no words and hit nothing; an empty benchmark hits
    nothing; null and empty items have no window; items of a null id count as one item (null in
    ``_items``, no part of the digest's hash); items of one id are one item; repeated rows are judged each for itself;
    an empty table gives an empty result; texts are taken whole, a few MB or one text at a time. ``made`` names the
    new columns; columns of ``docs`` that are called so are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = list(made)
    own = [c for c in docs.columns if c not in made]
    out = docs.select(*map(quoted, own))
    schema = out.withColumns(dict(zip(made, [F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast(_RANGES), F.array().cast("array<string>")], strict=True))).schema
    groups = _slices(benchmark, item_col, item_text, slice_bytes)
    first, second = next(groups, []), next(groups, None)
    share = lambda group: spark.sparkContext.broadcast(pickle.dumps(hash_set(group, window)))
    if second is None:
        return out.mapInArrow(_scan(share(first), text_col, own, made), schema)
    row, all_ranges, all_items = spare([*own, *made], "row", "ranges", "items")
    rows = written(out.withColumn(row, F.monotonically_increasing_id()), "scanned")
    texts, hits = rows.select(F.col(row).alias("row"), quoted(text_col).alias("text")), []
    for group in itertools.chain([first, second], groups):
        packed = share(group)
        hits.append(written(texts.mapInArrow(_hits(packed), f"row long, ranges {_RANGES}, items array<string>"), "hits"))
        packed.destroy()
        if len(hits) == _TABLES:
            hits = [_together(hits)]
    found = functools.reduce(DataFrame.union, hits).groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("ranges")).alias(all_ranges), F.flatten(F.collect_list("items")).alias(all_items))
    return rows.join(found, row, "left").mapInArrow(_gather(text_col, own, made, all_ranges, all_items), schema)


def _together(hits: list[DataFrame]) -> DataFrame:
    out = written(functools.reduce(DataFrame.union, hits), "hits")
    drop_written(*hits)
    return out


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        ((F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))).alias("contaminated"),
    )


@any_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", share: float = 0.05, **options) -> DataFrame:
    """``docs`` without contaminated documents (``action="drop"``), or with the covered words cut out of them (``action="cut"``).

    A document is contaminated if benchmark windows cover at least one word
    and ``share`` of its words. The others stay as they are, null and empty texts included.
    """
    if action not in ("drop", "cut"):
        raise ValueError("action is 'drop' or 'cut'")
    made = spare(docs.columns, "n_words", "n_hit", "ranges", "items", "cut")
    found = scan(docs, benchmark, made=tuple(made[:4]), **options)
    bad = (F.col(made[1]) > 0) & (F.col(made[1]) >= share * F.col(made[0]))
    if action == "drop":
        return found.where(~bad).select(*map(quoted, docs.columns))
    text_col = options.get("text_col", "text")
    out = found.mapInArrow(_cut(text_col, found.columns, made[2], made[4]), found.withColumn(made[4], F.lit("").cast("string")).schema)
    return out.select(*(F.when(bad, F.col(made[4])).otherwise(quoted(c)).alias(c) if c == text_col else quoted(c) for c in docs.columns))


def _cut(text_col: str, columns: list[str], ranges: str, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            data, offsets = text_bytes(batch.column(text_col))
            words = Words(data, offsets, ALNUM)
            out = []
            for d, found in enumerate(batch.column(ranges).to_pylist()):
                at, parts, first = int(offsets[d]), [], int(words.first[d])
                for r in found or ():
                    parts.append(data[at : words.start[first + r["begin"]]].tobytes())
                    at = int(words.end[first + r["end"] - 1])
                parts.append(data[at : offsets[d + 1]].tobytes())
                out.append(b"".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*columns, cut])

    return run
