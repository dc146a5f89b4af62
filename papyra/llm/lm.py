"""LM scoring by deleted interpolation of word n-grams.

Unigram, bigram and trigram maximum-likelihood estimates and a uniform one are
mixed with weights that depend on how frequent the context is (that of the
trigram if it was seen, else that of the bigram); the weights are learned by
expectation-maximisation on a held-out part of the training documents.
Scores are deleted estimates too: the occurrences in a training document itself
are taken off the counts that it is scored by, so that training documents and
others are on one scale, and what was learned by heart is no merit.

Counts are exchanged as packed arrays. Documents are gathered in groups of
some MB; a group asks for the counts of its distinct n-grams, bucket by bucket of
their hashes, and contributes its own. A bucket adds up what all groups
contribute and answers each. Hence a frequent n-gram is one entry for each
group, no task holds more than a bucket or a group, and the model is
never in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import NOT_SPACE, Words, _mixed, bounded_batches, fold, grouped, slices, text_bytes, written

#: Text bytes of a group, and of the text that a bucket of n-gram hashes stands for on average.
GROUP_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: Folds: scored only, held out for the mixture weights; counts come from the others, and from the latter at the end.
FOLDS, SCORED, TUNED = 5, 1, 2
#: Context classes of each order, steps of the histogram for each factor of 2, rounds of the EM.
CLASSES, STEPS, ROUNDS = 32, 2, 200
_END = np.uint64(0xA5A5_5A5A_C3C3_3C3D)
#: Bits of the hash of a bigram or trigram beside those of its bucket.
_GRAM_BITS = 36
_KINDS = {"scored": 0, "tuned": 1, "counted": 2}


def _zip(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them all, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    raw = x.astype(f"u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(x: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[9:], int.from_bytes(x[1:9], "little"), codec="zstd", asbytes=True), f"u{x[0]}").astype(np.int64)


def _low_bytes(n: int) -> int:
    return max(0, _GRAM_BITS - max(n, 1).bit_length() + 1) // 8


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers of ``_GRAM_BITS`` bits: their low bytes, and the rest as a bit for each number after a gap of zeros for each step (Elias-Fano)."""
    n, low = len(values), _low_bytes(len(values))
    steps = np.zeros(n + (1 << (_GRAM_BITS - 8 * low)) if n else 0, np.uint8)
    steps[(values >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)] = 1
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + np.packbits(steps).tobytes()


def unpacked(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    """(the ``n`` numbers at the begin of ``raw``, bytes they take)."""
    if not n:
        return np.empty(0, np.uint64), 0
    low = _low_bytes(n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(raw, np.uint8, n * low).reshape(n, low)
    size = -(-(n + (1 << (_GRAM_BITS - 8 * low))) // 8)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size, n * low))) - np.arange(n)
    return out.view("<u8").ravel() | (steps.astype(np.uint64) << np.uint64(8 * low)), n * low + size


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of documents of one kind: (group, kind, documents as compressed Arrow)."""
    part, seq = TaskContext.get().partitionId(), 0
    held: dict[int, list[pa.RecordBatch]] = {}
    sizes: dict[int, int] = {}

    def flush(kind: int) -> pa.RecordBatch:
        nonlocal seq
        table = pa.Table.from_batches(held.pop(kind)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        seq += 1
        sizes.pop(kind)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([kind], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["g", "kind", "blob"])

    for batch in slices(batches):
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            own = batch.select(["id", "text"]).take(pa.array(np.flatnonzero(kinds == kind)))
            size = own.nbytes
            if sizes.get(kind, 0) and sizes[kind] + size > GROUP_BYTES:
                yield flush(kind)
            held.setdefault(kind, []).append(own)
            sizes[kind] = sizes.get(kind, 0) + size
    for kind in list(held):
        yield flush(kind)


class Group:
    """The tokens of a group's documents, its distinct n-grams of each order in the order of their hashes, and where each token's are.

    The first token of a document has the end token as its context and no
    trigram; ``at[2]`` is 0 there, which ``first`` marks.
    """

    def __init__(self, blob: bytes, bits: int):
        table = pa.ipc.open_stream(blob).read_all().combine_chunks()
        self.ids = table.column("id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        words = Words(*text_bytes(table.column("text")), NOT_SPACE)
        n = len(words.first) - 1
        self.ends = words.first[1:] + np.arange(n)  # the end token of each document
        tokens = np.empty(len(words.hash) + n, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.ends] = False
        tokens[inner] = words.hash
        tokens[~inner] = _END
        del words
        self.first = np.zeros(len(tokens), bool)
        self.first[np.concatenate([np.zeros(min(n, 1), np.int64), self.ends[:-1] + 1])] = True
        before = np.concatenate([[_END], tokens[:-1]]).astype(np.uint64)
        code = _mixed(tokens)
        pairs = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + code)
        triples = _mixed(np.concatenate([[_END], pairs[:-1]]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + code)
        cut = np.uint64(64 - bits - _GRAM_BITS)
        self.grams: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        for values in (tokens, pairs >> cut, (triples >> cut)[~self.first]):
            known, place = np.unique(values, return_inverse=True)
            self.grams.append(known)
            self.at.append(place.astype(np.int32))
        triple = np.zeros(len(tokens), np.int32)
        triple[~self.first] = self.at[2]
        self.at[2] = triple
        # the end token stands before each document; it is one of the words of any group
        self.before = np.concatenate([[np.searchsorted(self.grams[0], _END)], self.at[0][:-1]]).astype(np.int32)
        self.before_pair = np.concatenate([[0], self.at[1][:-1]]).astype(np.int32)
        self.bits = bits

    def counts(self) -> list[np.ndarray]:
        at = [*self.at[:2], self.at[2][~self.first]]
        return [np.bincount(x, minlength=len(u)) for x, u in zip(at, self.grams, strict=True)]

    def cuts(self) -> list[np.ndarray]:
        """Where each bucket's n-grams begin, for each order."""
        buckets = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        of_word = self.grams[0] >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(self.grams[0]), np.uint64)
        return [np.searchsorted(x, buckets) for x in (of_word, *(g >> np.uint64(_GRAM_BITS) for g in self.grams[1:]))]


def _ask(bits: int):
    low = np.uint64((1 << _GRAM_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("g", "kind", "blob")), strict=True):
                group = Group(blob, bits)
                counts, cuts = group.counts() if kind else None, group.cuts()
                buckets, blobs = [], []
                for b in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist():
                    own = [slice(c[b], c[b + 1]) for c in cuts]
                    grams = [x[i] for x, i in zip(group.grams, own, strict=True)]
                    tail = _zip(np.concatenate([c[i] for c, i in zip(counts, own, strict=True)])) if kind else b""
                    blobs.append(np.array([len(x) for x in grams], np.int64).tobytes() + grams[0].tobytes() + packed(grams[1] & low) + packed(grams[2] & low) + tail)
                    buckets.append(b)
                    if len(blobs) == 256:
                        yield _asked(buckets, g, kind, blobs)
                        buckets, blobs = [], []
                if blobs:
                    yield _asked(buckets, g, kind, blobs)

    return run


def _asked(buckets: list[int], g: int, kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([g] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "kind", "blob"])


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray | None], kinds: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each asker: the count of its n-grams in all training documents and, if it tunes the weights, that in those that don't; both counts of all)."""
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum([0, *map(len, hashes)])
    both = np.zeros((2, len(known)), np.int64)
    for k, (c, kind) in enumerate(zip(counts, kinds, strict=True)):
        if c is not None:
            own = place[ends[k] : ends[k + 1]]
            both[0, own] += c
            if kind == _KINDS["counted"]:
                both[1, own] += c
    return [both[: _views(kind), place[ends[k] : ends[k + 1]]] for k, kind in enumerate(kinds)], both


def _views(kind: int) -> int:
    return 2 if kind == _KINDS["tuned"] else 1


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in grouped(batches, ["bucket"]):
        kinds = batch.column("kind").to_pylist()
        grams: list[list[np.ndarray]] = [[], [], []]
        counts: list[list[np.ndarray | None]] = [[], [], []]
        for kind, blob in zip(kinds, batch.column("blob"), strict=True):
            raw = memoryview(blob.as_buffer())
            sizes = np.frombuffer(raw, np.int64, 3).tolist()
            grams[0].append(np.frombuffer(raw, np.uint64, sizes[0], 24))
            at = 24 + 8 * sizes[0]
            for k in (1, 2):
                own, took = unpacked(raw[at:], sizes[k])
                grams[k].append(own)
                at += took
            own = np.split(_unzip(bytes(raw[at:])), np.cumsum(sizes)[:2]) if kind else [None] * 3
            for k in range(3):
                counts[k].append(own[k])
        answers, totals = [], None
        for k in range(3):
            found, both = _summed(grams[k], counts[k], kinds)
            answers.append(found)
            totals = both if k == 0 else totals
            grams[k] = counts[k] = []
        blobs = [_zip(np.concatenate([x.ravel() for x in own])) for own in zip(*answers, strict=True)]
        n = batch.num_rows
        once = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("g"), batch.column("kind"), batch.column("bucket"), pa.array(blobs, pa.binary()), once(totals[0].sum()), once((totals[0] > 0).sum()), once(totals[1].sum())],
            names=["g", "kind", "bucket", "blob", "tokens", "distinct", "counted"],
        )


def _read(batch: pa.RecordBatch, bits: int) -> tuple[Group, list[np.ndarray]]:
    """(group, view and n-gram -> count, for each order) from the rows of a group: its documents first, then the answers by bucket."""
    blobs, views = batch.column("blob"), _views(batch.column("kind")[0].as_py())
    group = Group(blobs[0].as_py(), bits)
    cuts = group.cuts()
    out = [np.zeros((views, len(x)), np.int64) for x in group.grams]
    for k, b in enumerate(batch.column("bucket").to_pylist()[1:], 1):
        got, at = _unzip(blobs[k].as_py()), 0
        for x, c in zip(out, cuts, strict=True):
            size = int(c[b + 1] - c[b])
            x[:, c[b] : c[b + 1]] = got[at : at + views * size].reshape(views, size)
            at += views * size
    return group, out


def level(count: np.ndarray) -> np.ndarray:
    """The class of a context by its count: each of the smallest counts is its own, powers of 2 share one."""
    return np.minimum(np.where(count <= 4, count, 3 + np.log2(np.maximum(count - 1, 1)).astype(np.int64)), CLASSES - 1)


def _own(group: Group) -> list[np.ndarray]:
    """Of each token's n-gram, for each order: its occurrences in the token's own document."""
    lengths = np.diff(np.concatenate([[0], group.ends + 1]))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    out = []
    for at, grams in zip(group.at, group.grams, strict=True):
        at = np.where(group.first, len(grams), at) if grams is group.grams[2] else at
        _, place, n = np.unique(doc * (len(grams) + 1) + at, return_inverse=True, return_counts=True)
        out.append(n[place])
    return out


def _estimates(group: Group, counts: list[np.ndarray], tokens: int, deleted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context class, trigram, bigram and unigram estimate) of each token; ``counts``: of each order, in one view.

    ``deleted``: the occurrences in the token's own document are taken off.
    """
    word, pair = counts[0][group.at[0]], counts[1][group.at[1]]
    triple = counts[2][group.at[2]] if len(counts[2]) else np.zeros(len(word), np.int64)
    context, longer = counts[0][group.before], counts[1][group.before_pair]
    if deleted:
        own = _own(group)
        word, pair, triple = word - own[0], pair - own[1], triple - own[2]
        shifted = [np.concatenate([[1], x[:-1]]) for x in own]
        # the end token before a document is there once for the document itself
        context, longer = context - np.where(group.first, 1, shifted[0]), longer - shifted[1]
        lengths = np.diff(np.concatenate([[0], group.ends + 1]))
        tokens = np.maximum(tokens - np.repeat(lengths, lengths), 1)
    one = word / np.maximum(tokens, 1)
    two = np.minimum(np.where(context > 0, pair / np.maximum(context, 1), 0.0), 1.0)
    longer = np.where(group.first, 0, longer)
    three = np.minimum(np.where(longer > 0, triple / np.maximum(longer, 1), 0.0), 1.0)
    return np.where(longer > 0, CLASSES + level(longer), level(context)), three, two, one


def _tally(bits: int, tokens: int, distinct: int):
    """Histogram of the held-out tokens: context class and the estimates in steps of a factor 2 ** (1 / STEPS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["g"]):
            group, counts = _read(batch, bits)
            classes, *estimates = _estimates(group, [x[1] for x in counts], tokens)
            keys = classes.astype(np.int64)
            for x in estimates:
                keys = (keys << 12) | np.where(x > 0, np.rint(STEPS * np.log2(np.where(x > 0, x, 1) * (distinct + 1))).astype(np.int64) + 1024, 0)
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return run


def weights(cells: list[tuple[int, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Context class -> weights of the uniform, unigram, bigram and trigram estimates, from (key, count) cells of the histogram.

    Classes up to ``CLASSES`` are those of bigram contexts, without a trigram.
    Each class starts from the weights of all classes together, and counts as
    one token of those, so a class without held-out tokens has them too.
    """
    out = np.full((2 * CLASSES, 4), 1 / 4)
    if not cells:
        return out * [2, 2, 0, 0]
    key, n = np.array(cells, np.int64).T
    back = lambda s: np.where(s > 0, 2.0 ** ((s - 1024) / STEPS), 0.0)
    p = np.stack([np.ones(len(key)), *(back((key >> (12 * k)) & 0xFFF) for k in range(3))], axis=1)
    of = key >> 36

    def em(rows: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        w = start
        for _ in range(rounds):
            part = p[rows] * w
            part *= (n[rows] / part.sum(axis=1))[:, None]
            w = (part.sum(axis=0) + prior * start) / (n[rows].sum() + prior)
        return w

    common = em(np.arange(len(key)), out[0].copy(), 0.0)
    for c in range(2 * CLASSES):
        start = common * (1, 1, c % CLASSES > 0, c >= CLASSES)
        start /= start.sum()
        rows = np.flatnonzero(of == c)
        out[c] = em(rows, start, 1.0) if len(rows) else start
    return out


def _score(bits: int, tokens: int, distinct: int, mix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["g"]):
            group, counts = _read(batch, bits)
            if not len(group.ends):
                continue
            counts = [x[0] for x in counts]
            classes, three, two, one = _estimates(group, counts, tokens, batch.column("kind")[0].as_py() != _KINDS["scored"])
            w = mix[classes]
            score = np.log10(w[:, 0] / (distinct + 1) + w[:, 1] * one + w[:, 2] * two + w[:, 3] * three)
            base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (distinct + 1)))[group.at[0]]
            known = (counts[0] > 0)[group.at[0]]
            begin = np.concatenate([[0], group.ends[:-1] + 1])
            sums = [np.add.reduceat(x, begin) for x in (known.astype(np.int64), base, score)]
            yield pa.RecordBatch.from_arrays([group.ids, pa.array(group.ends - begin + 1), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, scored_fold: int = SCORED, tuned_fold: int = TUNED) -> tuple[DataFrame, int]:
    """(id, n_tokens, n_known, base_score, score for each row of ``docs``; tokens of the training documents).

    Training documents are those outside ``scored_fold``. Null and empty
    texts are an end token alone. Documents of a null id are in no fold and
    learned from. ``score`` is the log10 probability of the text by the model of
    all training documents but the text itself. Repeated rows count and are scored each. A text longer than a
    group is a group of its own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    number = fold(F.col(id_col), folds)
    kind = F.when(number == scored_fold, 0).when(number == tuned_fold, 1).otherwise(2)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))
    groups = written(rows.mapInArrow(_pack, "g long, kind int, blob binary"), "lm-groups")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    asked = groups.mapInArrow(_ask(bits), "bucket long, g long, kind int, blob binary").repartition("bucket").sortWithinPartitions("bucket", "g")
    answers = written(asked.mapInArrow(_answer, "g long, kind int, bucket long, blob binary, tokens long, distinct long, counted long"), "lm-counts")
    total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "counted"))).first()
    both = groups.select("g", "kind", F.lit(-1).cast("long").alias("bucket"), "blob").union(answers.select("g", "kind", "bucket", "blob"))
    met = lambda x: x.repartition("g").sortWithinPartitions("g", "bucket")
    cells = met(both.where("kind = 1")).mapInArrow(_tally(bits, total["counted"], total["distinct"]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    mix = weights(sorted((r["key"], r["n"]) for r in cells))
    out = met(both).mapInArrow(_score(bits, total["tokens"], total["distinct"], mix), "id long, n_tokens long, n_known long, base_score double, score double")
    return out, total["tokens"]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    out, tokens = scored(docs)
    held = F.coalesce(fold(F.col("id"), FOLDS) == SCORED, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
