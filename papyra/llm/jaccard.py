"""Set-similarity join on word n-grams by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut
into fragments, so that each set falls into one segment a fragment:

* Candidates. A pair of Jaccard >= p/q has a symmetric difference of at most
  (n + m)(q - p)/(q + p) n-grams. Cut into that many fragments and two more, at
  least two segments of the pair are identical. Each segment is one
  64-bit signature; sets that share a signature are candidates. Equal sets are
  linked by a hash of the whole, and only the first in each task gives signatures.
* Verification. The sets of candidates are cut into a fixed number of coarse
  fragments, the overlap of each pair is counted in each fragment
  separately, and the counts are summed per pair.

Fragments depend on a size class. A class spans the sizes of ratio p/q, so
that pairs lie in the same or in neighbouring classes; each set gives signatures
for its own class and for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.common import NOT_SPACE, Words, _mixed, any_names, block_pairs, blocked, bounded_batches, drop_written, grouped, local_components, quoted, sized_broadcast, slices, spare, text_bytes, windows, written
from papyra.llm.graph import components

#: Words of an n-gram, and the least Jaccard similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 3, 90, 100
#: Sets of a signature that are compared in one group, before it is cut into blocks.
BLOCK = 1024
#: Ids of documents to read again that are broadcast; beyond, the texts are shuffled to them.
MOST_BROADCAST = 4_000_000
#: N-grams of the sets in one block of a group whose overlaps are counted, and n-grams of a fragment there.
BLOCK_GRAMS, FRAGMENT = 200_000, 2048
#: Fragments of the verification, as a power of 2.
COARSE_BITS = 4
#: Stands for an empty segment.
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def size_classes(up_to: int, p: int, q: int) -> np.ndarray:
    """Least size of each class up to one that holds ``up_to``, and the one after."""
    least = [1]
    while least[-1] <= up_to:
        least.append(least[-1] * q // p + 1)
    least.append(least[-1] * q // p + 1)
    return np.array(least)


class Segments:
    """Signatures of sets for the scheme of each size class."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.least = p, q, size_classes(1 << 12, p, q)

    def cover(self, size: int) -> None:
        if size >= self.least[-3]:
            self.least = size_classes(2 * size, self.p, self.q)

    def fragments(self, scheme: int) -> int:
        """Two more than the largest symmetric difference of a pair in the scheme."""
        most = int(self.least[scheme + 1]) - 1
        return 2 * most * (self.q - self.p) // (self.q + self.p) + 2

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """``grams``: sorted distinct hashes of one set."""
        n = len(grams)
        if not n:
            return np.empty(0, np.uint64)
        self.cover(n)
        own = int(np.searchsorted(self.least, n, side="right")) - 1
        out = []
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(grams), out=sums[1:])
        high = (grams >> np.uint64(32)).astype(np.uint64)
        for scheme in (own, own + 1):
            count = self.fragments(scheme)
            cut = ((high * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(cut, np.arange(count + 1))
            full = ends[1:] > ends[:-1]
            body = sums[ends[1:]] - sums[ends[:-1]]
            if count - full.sum() >= 2:  # else an empty segment can't be all that a pair shares
                body[~full], full = _EMPTY, np.ones(count, bool)
            salt = (np.uint64(scheme) << np.uint64(40)) + np.arange(count, dtype=np.uint64)
            out.append(_mixed(body ^ _mixed(salt + np.uint64(1)))[full])
        return np.concatenate(out)


def gram_sets(data: np.ndarray, offsets: np.ndarray, words_in_gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one n-gram of all its words."""
    words = Words(data, offsets, NOT_SPACE)
    grams, at = windows(words.hash, words.first, words_in_gram)
    cuts = np.searchsorted(at, words.first)
    counts = np.diff(words.first)
    for d in range(len(counts)):
        if counts[d] >= words_in_gram:
            own = np.sort(grams[cuts[d] : cuts[d + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif counts[d]:
            yield windows(words.hash[words.first[d] : words.first[d + 1]], np.array([0, counts[d]]), int(counts[d]))[0]
        else:
            yield np.empty(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(parts) if parts else np.empty(0, np.uint64))))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parity of each bucket of the set, a bit a bucket, one to two for each n-gram: sets that share little differ in twice as many bits as links may.

    Two sets differ in at least as many n-grams as their sketches in bits; half a
    sketch xor the other half is the sketch of half the length.
    """
    length = 1 << max(0, len(grams).bit_length() - 6)
    bit = _mixed(grams ^ _EMPTY) & np.uint64(64 * length - 1)
    odd = (np.bincount(bit.astype(np.int64), minlength=64 * length) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _distance(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, at the length of the shorter; lengths differ by a factor of 2 at most."""
    n = F.least(F.size(x), F.size(y))
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = lambda z: F.when(F.size(z) > n, F.zip_with(F.slice(z, F.lit(1), n), F.slice(z, n + 1, n), xor)).otherwise(z)
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def _seen(seen: dict[tuple[int, int], int], node: int | None, grams: np.ndarray) -> int | None:
    """The first node of the task with this set; None for a null id or an empty set."""
    if node is None or not len(grams):
        return None
    return seen.setdefault((len(grams), int(_whole(grams))), node)


def _facts(n: int):
    """Size, hash and sketch of each set, and the first node of the task that has the same set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in slices(batches):
            sizes, sums, sketches, first = [], [], [], []
            for node, grams in zip(batch.column("node").to_pylist(), gram_sets(*text_bytes(batch.column("text")), n), strict=True):
                sizes.append(len(grams))
                sums.append(_whole(grams))
                sketches.append(sketch(grams) if len(grams) else grams)
                first.append(_seen(seen, node, grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sizes, pa.int64()), pa.array(_signed(np.array(sums, np.uint64))), _lists(sketches), pa.array(first, pa.int64())],
                names=["node", "size", "whole", "sketch", "first"],
            )

    return run


def _sign(n: int, p: int, q: int):
    """(node, signature) of the first of each set in the task."""
    made = Segments(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in slices(batches):
            nodes, parts = [], []
            for node, grams in zip(batch.column("node").to_pylist(), gram_sets(*text_bytes(batch.column("text")), n), strict=True):
                known = len(seen)
                _seen(seen, node, grams)
                if len(seen) > known:
                    nodes.append(node)
                    parts.append(made.signatures(grams))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, [len(x) for x in parts])), pa.array(_signed(np.concatenate(parts)))], names=["node", "signature"])

    return run


def _whole(grams: np.ndarray) -> np.uint64:
    return np.bitwise_xor.reduce(_mixed(grams)) if len(grams) else np.uint64(0)


def _cut_sets(n: int):
    bounds = (np.arange(1, 1 << COARSE_BITS, dtype=np.uint64)) << np.uint64(64 - COARSE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, wholes, fragments, parts = [], [], [], []
            for node, grams in zip(batch.column("node").to_pylist(), gram_sets(*text_bytes(batch.column("text")), n), strict=True):
                whole = _whole(grams)
                for f, part in enumerate(np.split(grams, np.searchsorted(grams, bounds))):
                    if len(part):
                        ids.append(node)
                        wholes.append(whole)
                        fragments.append(f)
                        parts.append(part)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_signed(np.array(wholes, np.uint64))), pa.array(fragments, pa.int32()), _lists(parts)], names=["node", "whole", "fragment", "grams"])

    return run


_PAIR = ["a", "whole_a", "size_a", "b", "whole_b", "size_b"]


def _verified(pairs: DataFrame, docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Those of ``pairs`` that reach the similarity: the overlap is counted fragment by fragment and summed."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    some = docs.join(sized_broadcast(written(nodes, "nodes"), MOST_BROADCAST), "node", "left_semi")
    cut = some.mapInArrow(_cut_sets(n), "node long, whole long, fragment int, grams array<long>")
    side = lambda x: cut.select(F.col("node").alias(x), F.col("whole").alias(f"whole_{x}"), "fragment", F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(side("a"), ["a", "whole_a"]).join(side("b"), ["b", "whole_b", "fragment"])
    part = both.select(*_PAIR, "fragment", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    # the same text under the same id twice gives equal rows here: they count once
    total = part.groupBy(*_PAIR, "fragment").agg(F.max("overlap").alias("overlap")).groupBy(*_PAIR).agg(F.sum("overlap").alias("overlap"))
    return total.where(q * F.col("overlap") >= p * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).select("a", "b")


def _near(p: int, q: int):
    """Within one block pair of one signature: pairs across components whose sizes and sketches don't rule them out, as an edge from each set in one to the first set it reaches."""

    def matches(rows: dict[str, np.ndarray], sketches: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length = min(map(len, sketches))
        bits = np.empty((len(sketches), length), np.uint64)
        for k, x in enumerate(sketches):
            while len(x) > length:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            bits[k] = x
        size, component, half = rows["size"], rows["component"], rows["half"]
        for i in range(0, len(bits), 256):
            j = slice(i, i + 256)
            apart = np.zeros((len(bits[j]), len(bits)), np.int64)
            for w in range(length):
                apart += np.bitwise_count(bits[j, w][:, None] ^ bits[:, w][None, :])
            a, b = size[j][:, None], size[None, :]
            near = ((q + p) * apart <= (q - p) * (a + b)) & (q * np.minimum(a, b) >= p * np.maximum(a, b)) & (component[j][:, None] != component[None, :])
            near &= (half[j][:, None] != half[None, :]) if half.any() and not half.all() else np.arange(len(bits))[j][:, None] < np.arange(len(bits))[None, :]
            x, y = np.nonzero(near)
            if len(x):
                yield x + i, y

    names = ["node", "size", "component", "half"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["signature", "low", "high"]):
            if batch.num_rows < 2:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            column = batch.column("sketch")
            values, ends = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
            found = list(matches(rows, [values[ends[k] : ends[k + 1]] for k in range(batch.num_rows)]))
            if found:
                yield _edges(rows["node"], np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))

    return run


def _edges(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    label = local_components(len(nodes), x, y)
    some = np.unique(np.concatenate([x, y]))
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[some]]), pa.array(nodes[some])], names=["a", "b"])


def _overlaps(p: int, q: int):
    """Within one block pair of a group: the overlaps of all pairs across components are counted in each fragment of the global order and summed; links leave as edges of the local components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ["group", "low", "high"]):
            n = batch.num_rows
            node, size, component, half = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "component", "half"))
            if n < 2 or (component == component[0]).all():
                continue
            column = batch.column("grams")
            values = column.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(n), pc.list_value_length(column).to_numpy())
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            heads = np.concatenate([[True], values[1:] != values[:-1]])
            gram = np.cumsum(heads) - 1
            often = np.bincount(gram) > 1
            number = np.cumsum(often) - 1
            keep = often[gram]
            gram, owner = number[gram[keep]], owner[keep]
            overlap = np.zeros((n, n), np.float32)
            cuts = np.searchsorted(gram, np.arange(0, int(often.sum()) + FRAGMENT, FRAGMENT))
            for k, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = np.zeros((n, FRAGMENT), np.float32)
                part[owner[begin:end], gram[begin:end] - k * FRAGMENT] = 1
                overlap += part @ part.T
            linked = q * overlap >= p * (size[:, None] + size[None, :] - overlap)
            linked &= component[:, None] != component[None, :]
            linked &= half[:, None] != half[None, :] if half.any() and not half.all() else True
            x, y = np.nonzero(np.triu(linked, 1))
            if len(x):
                yield _edges(node, x, y)

    return run


def _gram_lists(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(gram_sets(*text_bytes(batch.column("text")), n))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_signed(np.array([_whole(x) for x in sets], np.uint64))), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["node", "whole", "size", "grams"])

    return run


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[DataFrame, DataFrame]:
    """(set sizes: node, size; components: node, component of each linked node).

    No link that matters for a component is lost: equal sets are linked; within the sets of a
    signature the smallest id is a centre, and each set is compared to the centre
    it shares most with; then, in signatures whose sets aren't all in one
    component yet, every pair across components is looked at. Sizes and
    sketches, which never rule out a link, leave groups of sets that are close;
    within those, overlaps of all pairs across components are counted. Copies
    of a centre end after the first step, and pairs are never listed: what
    leaves a group is an edge for each set.

    Texts are read twice rather than keeping their signatures. Those are shuffled once, as
    two numbers a row that are sorted, not gathered; a set that a third of all
    rows have is a row for each task by then.
    """
    p, q = numerator, denominator
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(quoted(id_col).cast("long").alias("node"), quoted(text_col).alias("text"))
    sets = written(docs.mapInArrow(_facts(words), "node long, size long, whole long, sketch array<long>, first long"), "sets")
    # equal sets: within a task by their first node, among tasks by those
    firsts = sets.where("node = first").select("node", "size", "whole").distinct()
    classes = firsts.groupBy("size", "whole").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = sets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    copies = copies.union(firsts.join(classes, ["size", "whole"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    each = docs.mapInArrow(_sign(words, p, q), "node long, signature long")
    order = Window.partitionBy("signature").orderBy("node")
    each = each.select("signature", "node", F.first("node").over(order).alias("first"), F.lead("node").over(order).alias("next"))
    held = written(each.where((F.col("first") != F.col("node")) | (F.col("next") != F.col("node"))).select("signature", "node", "first"), "shared")
    facts = sets.where("node is not null").select("node", "size", "whole", "sketch").dropDuplicates(["node", "whole"])
    side = lambda x: facts.select(F.col("node").alias(x), F.col("whole").alias(f"whole_{x}"), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    star = held.where("node <> first").groupBy("first", "node").agg(F.count("*").alias("n"))
    star = star.groupBy("node").agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("first"))
    star = star.select(F.col("first").alias("a"), F.col("node").alias("b")).join(side("a"), "a").join(side("b"), "b")
    star = star.where(q * F.least("size_a", "size_b") >= p * F.greatest("size_a", "size_b"))
    star = star.where((q + p) * _distance(F.col("sketch_a"), F.col("sketch_b")) <= (q - p) * (F.col("size_a") + F.col("size_b")))
    star = written(star.select(*_PAIR), "star")
    same = (F.col("size_a") == F.col("size_b")) & (F.col("whole_a") == F.col("whole_b"))
    found = written(_verified(star.where(~same), docs, words, p, q).union(star.where(same).select("a", "b")).union(copies), "links")
    groups = written(components(found), "groups")
    # what is left: signatures whose sets are in more than one component. Merge joins, as all of these sides grow with the input
    rest = held.select("signature", "node").join(groups.hint("merge"), "node", "left").select("signature", "node", F.coalesce("component", "node").alias("component"))
    rest_held = rest = written(rest, "rest")
    mixed = rest.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rest = rest.join(mixed.where("low < high").select("signature", "blocks").hint("merge"), "signature").join(facts.drop("whole").hint("merge"), "node")
    keys = ["signature", "low", "high"]
    rest = block_pairs(rest, "node").select(*keys, "half", "node", "size", "component", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    near = written(components(rest.mapInArrow(_near(p, q), "a long, b long")), "near")
    some = docs.join(sized_broadcast(near.select("node"), MOST_BROADCAST), "node", "left_semi")
    some = some.mapInArrow(_gram_lists(words), "node long, whole long, size long, grams array<long>")
    some = some.join(near.withColumnRenamed("component", "group"), "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = ["group", "low", "high"]
    near_sets = written(some, "near-sets")
    some = blocked(near_sets, ["group"], "node", BLOCK_GRAMS, F.col("size") + 200).repartition(*keys).sortWithinPartitions(*keys)
    more = written(some.mapInArrow(_overlaps(p, q), "a long, b long"), "more")
    sizes = written(sets.select("node", "size"), "sizes")
    drop_written(sets, held, star, found, rest_held, near, near_sets)
    if more.limit(1).count():
        groups = written(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "groups")
    return sizes, groups


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of ``docs``.

    Null and empty texts have an empty set and link with nothing. A null id
    has no component: its component_id is null. Rows of the same id are one node
    that has the links of each. Texts are read whole, in numpy passes of a few MB
    or of one text. An empty table gives an empty result.
    """
    sets, groups = linked(docs, **options)
    return sets.join(groups, "node", "left").select(F.col("node").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


@any_names
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the smallest; rows of a null id and documents without words stay.

    Repeated rows of the same id and text are one document, of which one row
    stays. Different texts of one id are one node: they stay or go together.
    Of ids that tie in nothing but their text the smallest stays; an empty table gives an empty result.
    """
    _, groups = linked(docs, id_col=id_col, text_col=text_col, **options)
    out, twice = spare(docs.columns, "gone", "again")
    doc, text = quoted(id_col), quoted(text_col)
    gone = groups.where("node <> component").select(F.col("node").alias(out)).distinct()
    kept = docs.join(gone, doc == F.col(out), "left_anti")
    held = doc.isNotNull() & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = written(docs.where(held).groupBy(doc.alias(twice)).agg(F.count("*").alias("n")).where("n > 1").select(twice), "repeated")
    if not again.limit(1).count():
        return kept
    # only the few rows of repeated ids meet by their texts
    marked = kept.join(sized_broadcast(again, MOST_BROADCAST), doc == F.col(twice), "left")
    once = marked.where(held & F.col(twice).isNotNull()).dropDuplicates([id_col, text_col])
    return marked.where(~held | F.col(twice).isNull()).union(once).drop(twice)
