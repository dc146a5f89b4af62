"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import any_names, bounded_batches, by_hash, fold, quoted, slices, spare, text_bytes

#: Bytes of a chunk, and from one chunk to the next.
CHUNK, STEP = 512, 448
#: Bytes that a filter sees, bytes from one place to the next, numbers for each byte, filters.
WIDTH, STRIDE, DEPTH, FILTERS = 24, 8, 8, 32
#: The model is fitted on so many labelled texts at most, of so many characters each at most.
TRAIN_ROWS, TRAIN_CHARS = 2400, 40_000
THRESHOLD = 0.7
_PAD = 256


def chunk_bounds(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin and end of each chunk, first chunk of each text and the end). Each text has a chunk at least, and each byte is in one."""
    lengths = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-(lengths - CHUNK) // STEP) + 1))])
    text = np.repeat(np.arange(len(lengths)), np.diff(first))
    begin = offsets[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * STEP
    return begin, np.maximum(np.minimum(begin + CHUNK, offsets[1:][text]), begin), first


def cut_out(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of some chunks, padded."""
    at = begin[:, None] + np.arange(CHUNK)
    source = data if len(data) else np.zeros(1, np.uint8)
    return np.where(at < end[:, None], source[np.minimum(at, len(source) - 1)], np.int16(_PAD)).astype(np.int16)


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all chunks, padded; first chunk of each text and the end)."""
    begin, end, first = chunk_bounds(offsets)
    return cut_out(data, begin, end), first


class Network:
    """Byte embedding, filters, max-pooling within each chunk, then the largest and the mean pooled value of each filter over all chunks, combined by a logistic unit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (_PAD + 1, DEPTH)).astype(np.float32)
        kinds = [range(97, 123), range(65, 91), range(48, 58), [32], [10, 13, 9], [*map(ord, ".,;:'\"()-?")], [*map(ord, "#$%&*|!<>{}[]\\/=+@^~_`")], range(128, 256)]
        for k, kind in enumerate(kinds):
            self.embed[list(kind), k] += 1
        self.embed[_PAD] = 0
        self.filters = rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def places(self, chunks: np.ndarray) -> np.ndarray:
        x = self.embed[chunks].reshape(len(chunks), CHUNK * DEPTH)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DEPTH, axis=1)[:, :: STRIDE * DEPTH]
        return np.ascontiguousarray(view).reshape(-1, WIDTH * DEPTH)

    def pooled(self, chunks: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), step):
            part = chunks[i : i + step]
            out[i : i + step] = (self.places(part) @ self.filters).reshape(len(part), -1, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def combined(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(first)[:, None].astype(np.float32)
        return np.concatenate([np.maximum.reduceat(pooled, first[:-1]), np.add.reduceat(pooled, first[:-1]) / counts], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each whole text; a few hundred chunks at a time are cut out, so memory beside the text is what their pools take."""
        begin, end, first = chunk_bounds(offsets)
        pooled = np.empty((len(begin), FILTERS), np.float32)
        for i in range(0, len(begin), 256):
            pooled[i : i + 256] = self.pooled(cut_out(data, begin[i : i + 256], end[i : i + 256]))
        z = self.combined(pooled, first).astype(np.float64) @ self.out.astype(np.float64) + float(self.shift[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 48, rate: float = 4e-3, seed: int = 0) -> Network:
        """Adam on the cross-entropy; gradients reach a filter only through the places that won its pools."""
        rng, y_all = np.random.default_rng(seed), np.asarray(labels, np.float32)
        weight = np.ones(len(y_all), np.float32)
        params = {k: getattr(self, k) for k in ("embed", "filters", "bias", "out", "shift")}
        m, v, t = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                data = np.frombuffer(b"".join(texts[j] for j in own), np.uint8)
                chunks, first = chunked(data, np.concatenate([[0], np.cumsum([len(texts[j]) for j in own])]).astype(np.int64))
                grads = self._gradients(chunks, first, y_all[own], weight[own])
                t += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                self.embed[_PAD] = 0
        return self

    def _gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n, counts = len(y), np.diff(first)
        where = np.empty((len(chunks), FILTERS), np.int64)
        best = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), 256):
            all_places = (self.places(chunks[i : i + 256]) @ self.filters).reshape(-1, (CHUNK - WIDTH) // STRIDE + 1, FILTERS)
            where[i : i + 256] = all_places.argmax(axis=1)
            best[i : i + 256] = all_places.max(axis=1)
        pooled = np.maximum(best + self.bias, 0)
        h = self.combined(pooled, first)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.shift[0], -30, 30)))
        dz = (weight * (p - y) / n).astype(np.float32)
        dh = dz[:, None] * self.out
        text = np.repeat(np.arange(n), counts)
        top = (pooled == np.repeat(h[:, :FILTERS], counts, axis=0)).astype(np.float32)
        top /= np.maximum(np.repeat(np.add.reduceat(top, first[:-1]), counts, axis=0), 1)
        dp = top * dh[text, :FILTERS] + dh[text, FILTERS:] / counts[text][:, None]
        dp *= pooled > 0
        at = chunks[np.arange(len(chunks))[:, None, None], (where * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        d_filters = np.empty_like(self.filters)
        d_embed = np.zeros_like(self.embed)
        for f in range(FILTERS):
            d_filters[:, f] = dp[:, f] @ self.embed[at[:, f]].reshape(len(chunks), -1)
            each = dp[:, f, None] * self.filters[:, f][None, :]
            flat = at[:, f].ravel()
            for k in range(DEPTH):
                d_embed[:, k] += np.bincount(flat, each.reshape(len(chunks), WIDTH, DEPTH)[:, :, k].ravel(), minlength=_PAD + 1).astype(np.float32)
        return {"embed": d_embed, "filters": d_filters, "bias": dp.sum(axis=0), "out": dz @ h + 1e-4 * self.out, "shift": np.array([dz.sum()], np.float32)}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", trainable: Column | None = None, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Network | None:
    """A network fitted on a bounded sample: ``rows`` labelled texts in the order of a hash of the id, each of ``chars`` characters at most.

    Rows with a null label, id or text are left out; a repeated id takes its
    smallest label. Without a text of each class there is nothing to learn:
    the result is None.
    """
    trainable = F.lit(True) if trainable is None else trainable
    known = labels.where(F.col(label_col).isin(0, 1) & trainable).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    chosen = by_hash(known, "doc_id", 2 * rows).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(2 * rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text").between(1, chars))
    found = chosen.select("_h", "doc_id", "y", "text").orderBy("_h", "doc_id", "text").limit(rows).collect()
    if len({r.y for r in found}) < 2:
        return None
    return Network().fit([r.text.encode("utf-8", "replace") for r in found], [r.y for r in found])


def _score(packed, text_col: str, columns: list[str], score: str):
    kept: list[Network] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(pickle.loads(packed.value))  # noqa: S301  made by this driver
        for batch in slices(batches, text_col):
            scores = pa.array(kept[0].scores(*text_bytes(batch.column(text_col))), pa.float64())
            yield pa.RecordBatch.from_arrays([scores if c == score else batch.column(c) for c in columns], names=columns)

    return run


@any_names
def scored(docs: DataFrame, network: Network | None, text_col: str = "text", score: str = "_score") -> DataFrame:
    """``docs`` with ``_score`` (a column of that name is replaced), the probability of label 1 for each whole text.

    Null is scored as an empty text; a long text is read whole, some chunks at a time; repeated rows are scored each; an empty
    table gives an empty result. Without a network every score is 1.
    """
    bounded_batches(docs.sparkSession)
    out = docs.withColumn(score, F.lit(1.0))
    if network is None:
        return out
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(network))
    return out.mapInArrow(_score(packed, text_col, out.columns, score), out.schema)


def digest(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of ``THRESHOLD``); labels of the held-out fold aren't learned from.

    A null id is in no fold: it isn't held out, and isn't learned from.
    """
    out_fold = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    network = train(docs, labels, trainable=F.col("doc_id").isNotNull() & ~out_fold)
    return scored(docs.select("doc_id", "text"), network).select("doc_id", out_fold.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


@any_names
def accepted(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``docs`` without the texts that score under ``THRESHOLD``; the network is the one of :func:`digest`."""
    out_fold = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    network = train(docs, labels, trainable=F.col("doc_id").isNotNull() & ~out_fold)
    [score] = spare(docs.columns, "score")
    return scored(docs, network, score=score).where(F.col(score) >= THRESHOLD).select(*map(quoted, docs.columns))
