"""Vectors: cosine of arrays, hashed lexical vectors."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import rules, text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for null, empty, zero and differently long vectors."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def features(norm: Column) -> Column:
    """Words of two characters or more, and the 3-character pieces of those of four or more, repeats included."""
    words = F.filter(F.split(norm, " "), lambda w: F.length(w) > 1)
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.when(F.length(w) >= 4, text.trigrams(w)).otherwise(F.array().cast("array<string>")))))


def feature_hash(c: Column) -> Column:
    """48 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("long")


def hashed(docs, key: str, norm: Column, dims: int = rules.DIMENSIONS):
    """(key, dim, weight): signed feature counts in ``dims`` dimensions, without zeros; a text without features has no rows."""
    each = docs.select(key, F.explode(features(norm)).alias("feature"))
    h = feature_hash(F.col("feature"))
    each = each.select(key, h.alias("h")).select(key, F.pmod("h", F.lit(dims)).cast("int").alias("dim"), F.when(F.shiftright("h", 3).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1).alias("sign"))
    return each.groupBy(key, "dim").agg(F.sum("sign").alias("weight")).where("weight <> 0")


#: Words whose features a task remembers; texts and characters that are hashed at once.
_KNOWN, _TEXTS, _CHARACTERS = 200_000, 512, 1 << 20


def _code(feature: str, dims: int) -> int:
    """A feature as one number: its dimension, then its sign."""
    h = int.from_bytes(hashlib.sha256(feature.encode(errors="surrogatepass")).digest()[:6], "big")
    return h % dims * 2 + (h >> 3 & 1)


def _codes(features: list[str], dims: int) -> np.ndarray:
    """:func:`_code` of each feature."""
    head = b"".join([hashlib.sha256(f.encode(errors="surrogatepass")).digest()[:6] for f in features])
    h = np.frombuffer(head, np.uint8).reshape(-1, 6).astype(np.int64) @ (1 << np.arange(40, -8, -8))
    return (h % dims * 2 + (h >> 3 & 1)).astype(np.int32)


_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789_"


@functools.cache
def _plain_pieces(dims: int) -> np.ndarray:
    """The features of all pieces of three of ``_SIGNS``."""
    return np.array([_code(a + b + c, dims) for a in _SIGNS for b in _SIGNS for c in _SIGNS], np.int32)


_PLACE = np.zeros(256, np.int32)
_PLACE[[ord(c) for c in _SIGNS]] = np.arange(len(_SIGNS))


def _within(sizes: np.ndarray) -> np.ndarray:
    """Where the pieces of words begin that stand one after the other, ``sizes`` pieces each and two characters more."""
    return np.arange(sizes.sum()) + np.repeat(2 * np.arange(len(sizes)), sizes)


class _Known(dict):
    """Word -> its number; the features of words are hashed together, after they are first met. A word of one character has none."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims, self.met, self.pieces = dims, [], {}
        self.whole, self.starts, self.parts = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __missing__(self, word: str) -> int:
        self.met.append(word)
        self[word] = out = len(self)
        return out

    def _others(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """The features of the pieces of words, one word after the other. A piece is one number of three code points; each is hashed once."""
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        keys = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[_within(sizes)]
        own, at = np.unique(keys, return_inverse=True)
        known = own.tolist()
        new = [k for k in known if k not in self.pieces]
        if new:
            self.pieces.update(zip(new, _codes([chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in new], self.dims).tolist(), strict=True))
        return np.array([self.pieces[k] for k in known], np.int32)[at]

    def learn(self) -> None:
        """``whole``: the feature of each word as such, ``starts`` and ``parts``: those of its pieces."""
        met, self.met = self.met, []
        if not met:
            return
        length = np.array([len(w) for w in met], np.int64)
        whole = np.full(len(met), 2 * self.dims, np.int32)
        if (length > 1).any():
            whole[length > 1] = _codes([w for w in met if len(w) > 1], self.dims)
        sizes = np.where(length >= 4, length - 2, 0)
        parts = np.zeros(sizes.sum(), np.int32)
        plain, first = np.array([w.isascii() for w in met]), np.cumsum(sizes) - sizes
        for ascii_only in (True, False):
            own = np.flatnonzero((plain == ascii_only) & (sizes > 0))
            if not len(own):
                continue
            words, times = [met[k] for k in own], sizes[own]
            if ascii_only:
                c, n = _PLACE[np.frombuffer("".join(words).encode(), np.uint8)], len(_SIGNS)
                codes = _plain_pieces(self.dims)[((c[:-2] * n + c[1:-1]) * n + c[2:])[_within(times)]]
            else:
                codes = self._others(words, times)
            parts[np.arange(times.sum()) + np.repeat(first[own] - (np.cumsum(times) - times), times)] = codes
        self.whole, self.parts = np.concatenate([self.whole, whole]), np.concatenate([self.parts, parts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])


def _hasher(dims: int) -> Callable[[list[str]], pa.Array]:
    """Normalised texts -> their vectors, for one task. A word is hashed once a task, as long as a bounded number of them is known."""
    known = _Known(dims)

    def some(norms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The dimensions a text has, then those dimensions and their weights, text by text."""
        nonlocal known
        if len(known) > _KNOWN:
            known = _Known(dims)
        split = [t.split(" ") for t in norms]
        words = np.array([known[w] for own in split for w in own], np.int32)
        known.learn()
        size, row = 2 * dims + 2, np.repeat(np.arange(len(norms), dtype=np.int32), [len(x) for x in split])
        begins = known.starts[words]
        times = known.starts[words + 1] - begins
        # the pieces of each word, one after the other, in the row of its text
        at = np.arange(times.sum()) + np.repeat(begins - (np.cumsum(times) - times), times)
        counts = np.bincount(row * size + known.whole[words], minlength=size * len(norms)) + np.bincount(np.repeat(row * size, times) + known.parts[at], minlength=size * len(norms))
        counts = counts.reshape(len(norms), size)[:, : 2 * dims].reshape(len(norms), dims, 2)
        weights = counts[:, :, 1] - counts[:, :, 0]
        text_of, dim = np.nonzero(weights)
        return np.bincount(text_of, minlength=len(norms)), dim, weights[text_of, dim]

    def batch(norms: list[str]) -> pa.Array:
        parts, begin = [(np.zeros(0, np.int64),) * 3], 0
        while begin < len(norms):
            end, size = begin + 1, len(norms[begin])
            while end < len(norms) and end - begin < _TEXTS and size + len(norms[end]) <= _CHARACTERS:
                size, end = size + len(norms[end]), end + 1
            parts.append(some(norms[begin:end]))
            begin = end
        sizes, dim, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        flat = pa.StructArray.from_arrays([pa.array(dim.astype(np.int32)), pa.array(weight.astype(np.int64))], ["dim", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    return batch


_VECTOR = "array<struct<dim:int,weight:bigint>>"


def hashed_array(norm: Column, dims: int = rules.DIMENSIONS) -> Column:
    """:func:`hashed` of a text as array<struct<dim, weight>>, sorted by dim: by batch, without a shuffle."""
    of = _hasher(dims)

    def batch(column: pa.Array) -> pa.Array:
        return of([t or "" for t in column.to_pylist()])

    if (spark := SparkSession.getActiveSession()) is not None:
        importable(spark)
    return F.arrow_udf(batch, _VECTOR)(norm)


def seen(body: Column | str, dims: int = rules.DIMENSIONS) -> Column:
    """struct<norm, vec>: a text as :func:`papyra.functions.text.normalized` has it, and its hashed vector, in one pass by batch."""
    of = _hasher(dims)

    def batch(column: pa.Array) -> pa.Array:
        norms = [text.normal(t or "") for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(norms, pa.string()), of(norms)], ["norm", "vec"])

    if (spark := SparkSession.getActiveSession()) is not None:
        importable(spark)
    return F.arrow_udf(batch, f"struct<norm:string,vec:{_VECTOR}>")(F.col(body) if isinstance(body, str) else body)


def hashed_plain(question: str, dims: int = rules.DIMENSIONS) -> dict[int, int]:
    """:func:`hashed` of one text on the driver."""
    out: dict[int, int] = {}
    for w in (w for w in text.plain(question).split() if len(w) > 1):
        for f in [w, *((w[i : i + 3] for i in range(len(w) - 2)) if len(w) >= 4 else ())]:
            h = int(hashlib.sha256(f.encode()).hexdigest()[:12], 16)
            out[h % dims] = out.get(h % dims, 0) + (1 if h >> 3 & 1 else -1)
    return {d: w for d, w in out.items() if w}
