"""A stored inverted index: postings dealt out by term, so that a question reads its own terms' files only.

Tables (see :mod:`papyra.tables`): ``postings``, blocks of (term, chunk_id, tf, dl, doc_type)
sorted by term within a bucket: a row has the chunks of a term and a type that one task met together, as arrays beside each other, so that
a posting costs a few numbers and not a row, and their number and sum (df, cf), so that counts read no arrays; ``terms`` (term, df, cf); ``corpus`` (n_chunks,
n_words). A change of documents appends to each: postings of new chunks, marks
(tf 0) for chunks that go, and differences of the counts. What was said last of a
term in a chunk holds. :func:`compact` puts everything into one state again.

BM25 needs the whole corpus' counts, which are read from ``terms`` and
``corpus``: a few rows, whatever the size of the archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import text
from papyra.operators import chunk, index
from papyra.tables import Change, Tables

POSTINGS = "term string, chunk_id string, tf int, dl int, doc_type string"
BLOCKS = "term string, doc_type string, df long, cf long, chunk_id array<string>, tf array<int>, dl array<int>"
#: Words or postings that a task holds before it writes them as blocks, and postings that a batch of blocks has, about.
HELD, AT_ONCE = 1 << 22, 1 << 16
_LISTS = ["chunk_id", "tf", "dl"]
_SCHEMA = pa.schema([("term", pa.string()), ("doc_type", pa.string()), ("df", pa.int64()), ("cf", pa.int64()), ("chunk_id", pa.list_(pa.string())), ("tf", pa.list_(pa.int32())), ("dl", pa.list_(pa.int32()))])
#: Bytes of chunks or documents that are looked at together, about.
_SOME = 1 << 20


def _lists(terms: pa.Array, types: pa.Array, sizes: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Postings that are sorted by term and type, ``sizes`` of each, as blocks."""
    starts, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
    while begin < len(terms):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + AT_ONCE, "right")) - 1)
        own = rows.slice(starts[begin], starts[end] - starts[begin]).combine_chunks()
        at = starts[begin : end + 1] - starts[begin]
        counts = [pa.array(np.diff(at)), pa.array(np.add.reduceat(own.column("tf").to_numpy().astype(np.int64), at[:-1]))]
        offsets = pa.array(at.astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, own.column(c).combine_chunks()) for c in _LISTS)
        yield pa.RecordBatch.from_arrays([terms.slice(begin, end - begin), types.slice(begin, end - begin), *counts, *lists], ["term", "doc_type", "df", "cf", *_LISTS])
        begin = end


def _named(group: np.ndarray, terms: pa.Array, types: pa.Array, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """:func:`_lists` of postings sorted by ``group``, which numbers each term's types."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    own = group[first]
    yield from _lists(terms.take(pa.array(own // len(types))), types.take(pa.array(own % len(types))), np.diff(first, append=len(group)), rows)


#: Of each chunk: its id, its type, and its index words with single spaces between them, with how often each such text counts.
_Spoken = tuple[str | None, str | None, list[tuple[str, int]]]


def _seen(norm: str, body: str) -> list[tuple[str, int]]:
    """The index words of a text and its normalised form: where normalising changes no word, the text has those of its normalised form."""
    own = text.indexed_in(norm)
    return [(own, 2)] if text.folded(body) else [(own, 1), (" ".join(text.index_words(body)), 1)]


def _spoken(batch: pa.RecordBatch) -> Iterator[_Spoken]:
    """The chunks of a batch: of those with their words, of chunks as they are stored, or of documents that are cut here."""
    own = [batch.column(c).to_pylist() for c in batch.schema.names]
    if "words" in batch.schema.names:
        for key, kind, words in zip(*own, strict=True):
            yield key, kind, [(" ".join(words or []), 1)]
    elif "norm" in batch.schema.names:
        for key, kind, title, body, norm in zip(*own, strict=True):
            yield key, kind, [(" ".join(text.index_words(title or "")), 1), *_seen(norm or "", body or "")]
    else:
        for (key, kind, title, _), bodies in zip(zip(*own, strict=True), chunk.cut(own[3]), strict=True):
            named = (" ".join(text.index_words(title or "")), 1)
            for k, body in enumerate(bodies):
                yield f"{key}{k}", kind, [named, *_seen(text.normal(body), body)]


def _numbered(spoken: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts as numbers, the text of each, and what the numbers stand for: words without accents."""
    split = pc.split_pattern(pa.array(spoken, pa.large_string()), " ")
    words = split.flatten().dictionary_encode()
    number, owner = words.indices.to_numpy(), np.repeat(np.arange(len(spoken)), split.value_lengths().to_numpy())
    known = words.dictionary
    some = pc.binary_length(known).to_numpy() > 0
    if not some.all():
        own = some[number]
        number, owner = number[own], owner[own]
    accented = pc.invert(pc.string_is_ascii(known))
    if pc.any(accented).as_py():
        bare = pc.replace_with_mask(known, accented, pa.array([text.without_accents(w) for w in known.filter(accented).to_pylist()], known.type)).dictionary_encode()
        number, known = bare.indices.to_numpy()[number], bare.dictionary
    return number.astype(np.int64), owner, known.cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, or documents, as blocks of postings: words are numbered and counted by sorting numbers, some millions at once. Chunks of documents are counted by blocks of no term."""

    def made() -> Iterator[pa.RecordBatch]:
        if cuts:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(["", None, len(chunk_ids), 0, [], [], []], _SCHEMA, strict=True)], _SCHEMA)
        number, text_of, terms = _numbered(spoken)
        if not len(number):
            return
        chunk_of, weight = np.array(owner, np.int64)[text_of], np.array(weights, np.int64)[text_of]
        dl = np.bincount(chunk_of, weight, len(chunk_ids)).astype(np.int32)
        kinds = pa.array(types, pa.string()).dictionary_encode(null_encoding="encode")
        kind = kinds.indices.to_numpy().astype(np.int64)
        # one number for a word in a chunk; how often it counts, which is 1 or 2, is its last bit
        key = ((number * len(kinds.dictionary) + kind[chunk_of]) * len(chunk_ids) + chunk_of) * 2 + (weight - 1)
        key.sort()
        weight, key = (key & 1) + 1, key >> 1
        first = np.flatnonzero(np.diff(key, prepend=-1))
        group, chunk_of = np.divmod(key[first], len(chunk_ids))
        tf = np.add.reduceat(weight, first)
        rows = pa.table([pa.array(chunk_ids, pa.string()).take(pa.array(chunk_of)), pa.array(tf.astype(np.int32)), pa.array(dl[chunk_of])], _LISTS)
        yield from _named(group, terms, kinds.dictionary, rows)

    cuts, spoken, owner, weights, chunk_ids, types, held = False, [], [], [], [], [], 0
    for whole in batches:
        cuts = "body" in whole.schema.names
        for batch in _parts(whole):
            for key, kind, own in _spoken(batch):
                for words, times in own:
                    spoken.append(words)
                    owner.append(len(chunk_ids))
                    weights.append(times)
                    held += words.count(" ") + 1
                chunk_ids.append(key)
                types.append(kind)
                if held >= HELD:
                    yield from made()
                    spoken, owner, weights, chunk_ids, types, held = [], [], [], [], [], 0
    if chunk_ids:
        yield from made()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``_SOME`` bytes of a batch."""
    step = max(1, min(500, batch.num_rows * _SOME // max(1, batch.nbytes)))
    for begin in range(0, batch.num_rows, step):
        yield batch.slice(begin, step)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, a row each, as blocks of those that are held together."""
    held, size = [], 0

    def made() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        term, kind = (pc.dictionary_encode(table.column(c), null_encoding="encode").combine_chunks() for c in ("term", "doc_type"))
        group = term.indices.to_numpy().astype(np.int64) * len(kind.dictionary) + kind.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        yield from _named(group[order], term.dictionary, kind.dictionary, table.select(_LISTS).take(pa.array(order)))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= HELD // 4:
            yield from made()
            held, size = [], 0
    if held:
        yield from made()


def _read(chunks: DataFrame, key: str) -> DataFrame:
    importable(chunks.sparkSession)
    return chunks.select(F.col(key).alias("chunk_id"), "doc_type", *(["words"] if "words" in chunks.columns else ["title", "text", "norm"]))


def blocks(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, chunk_id, tf, dl, doc_type) of chunks in blocks, counted within each chunk by batch: nothing is shuffled."""
    return _read(chunks, key).mapInArrow(_counted, BLOCKS)


def blocks_of_documents(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`blocks` of the chunks of documents, as :func:`papyra.operators.retrieve.chunked` has them: cut and counted in one pass, so that chunks are no rows in between."""
    importable(documents.sparkSession)
    begin = F.concat(F.concat_ws(":", key, F.lit(1)), F.lit(":")).alias("chunk_id")
    return documents.select(begin, "doc_type", "title", F.make_valid_utf8(text.text_of("text")).alias("body")).mapInArrow(_counted, BLOCKS)


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """:func:`blocks` as a row each."""
    return _single(blocks(chunks, key))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Postings as blocks, dealt out by term first."""
    importable(rows.sparkSession)
    return rows.select("term", "chunk_id", "tf", "dl", "doc_type").repartition("term").mapInArrow(_grouped, BLOCKS)


def _single(held: DataFrame) -> DataFrame:
    """Blocks as postings."""
    if held.schema["tf"].dataType.typeName() != "array":
        raise ValueError("this index was stored with a row a posting: make it anew (Archive.rebuild)")
    other = [c for c in held.columns if c not in ("term", "doc_type", "df", "cf", *_LISTS)]
    return held.select("term", "doc_type", *other, F.inline(F.arrays_zip(*_LISTS))).select("term", *_LISTS, "doc_type", *other)


def _appended(change: Change, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of chunks that aren't indexed yet and the counts of their terms, as written."""
    new = change.append("postings", "term", made, sort=["term"])
    return new, change.append("terms", "term", new.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), sort=["term"])


def _summed(sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """The corpus of ``sizes`` (n: chunks) and the words that ``counts`` has."""
    both = sizes.select(F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("w")).union(counts.select(F.lit(0).cast("long"), F.col("cf")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_words")).select(F.lit("all").alias("corpus"), "n_chunks", "n_words")


def add_documents(change: Change, documents: DataFrame, key: str = "doc_id") -> None:
    """Index the chunks of ``documents`` (``key``, title, text, doc_type), none of which is indexed yet, whether or not the chunks themselves are stored."""
    new, counts = _appended(change, blocks_of_documents(documents, key))
    change.append("corpus", "corpus", _summed(new.where("term = ''").select(F.col("df").alias("n")), counts))


def add(change: Change, chunks: DataFrame, gone: DataFrame | None = None) -> None:
    """Index ``chunks`` and take ``gone``, chunks as they were stored, out: in the same change as the chunks themselves.

    A chunk of one id that is in both is indexed as the new one says.
    """
    if gone is None:
        _, counts = _appended(change, blocks(chunks))
        sums = _summed(chunks.select(F.lit(1).alias("n")), counts)
    else:
        signed = postings(chunks).withColumn("sign", F.lit(1)).unionByName(postings(gone).withColumn("sign", F.lit(-1)))
        # of one chunk's old and new postings the new one stays; a term that it has lost is marked
        last = signed.groupBy("term", "chunk_id").agg(F.max_by(F.struct("tf", "dl", "doc_type", "sign"), "sign").alias("r"))
        marked = last.select("term", "chunk_id", F.when(F.col("r.sign") > 0, F.col("r.tf")).otherwise(0).alias("tf"), "r.dl", "r.doc_type")
        change.append("postings", "term", _in_blocks(marked), sort=["term"])
        sums = _sums(chunks, 1).unionByName(_sums(gone, -1))
        counts = signed.groupBy("term").agg(F.sum("sign").alias("df"), F.sum(F.col("tf").cast("long") * F.col("sign")).alias("cf"))
        change.append("terms", "term", counts.where("df <> 0 or cf <> 0"), sort=["term"])
    change.append("corpus", "corpus", sums)


def _sums(chunks: DataFrame, sign: int) -> DataFrame:
    sums = index.with_words(chunks).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0)).alias("w"))
    return sums.select(F.lit("all").alias("corpus"), (F.col("n") * sign).alias("n_chunks"), (F.col("w") * sign).alias("n_words"))


class Inverted:
    """The stored index of a folder of tables."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def _asked(self, name: str, terms: list[str], changes: bool) -> DataFrame:
        return self.tables.read(name, self.tables.buckets_of(name, terms), changes).where(F.col("term").isin(*terms))

    def hits(self, terms: list[str]) -> DataFrame:
        """(term, chunk_id, tf, dl, doc_type) of the given terms: only their buckets' files are read, and of those the row groups that can hold a term."""
        if not terms:
            return self.tables.spark.createDataFrame([], POSTINGS)
        return _last(self._asked("postings", terms, True), self.tables, "postings")

    def counts(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df, cf) of the given terms, or of all."""
        rows = self.tables.read("terms") if terms is None else self._asked("terms", terms, False) if terms else self.tables.spark.createDataFrame([], "term string, df long, cf long")
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def corpus(self) -> tuple[int, int]:
        """(chunks, words) of the corpus."""
        r = self.tables.read("corpus").agg(F.sum("n_chunks"), F.sum("n_words")).first()
        return r[0] or 0, r[1] or 0

    def parts(self, terms: list[str]) -> DataFrame:
        """(term, chunk_id, doc_type, part): what each term of a chunk adds to its BM25 score."""
        n_chunks, n_words = self.corpus()
        hits = self.hits(terms).join(F.broadcast(self.counts(terms)), "term")  # a row for each term of the questions
        return hits.select("term", "chunk_id", "doc_type", bm25_part(F.col("tf"), F.col("dl"), F.col("df"), n_chunks, n_words).alias("part"))

    def bm25(self, terms: list[str], doc_type: str | None = None) -> DataFrame:
        """(chunk_id, bm25) of the chunks with one of the terms. The type restricts the result, not the counts."""
        rows = self.parts(terms)
        rows = rows.where(F.col("doc_type") == doc_type) if doc_type else rows
        return rows.groupBy("chunk_id").agg(F.round(F.sum("part"), 12).alias("bm25"))

    def compact(self) -> None:
        """One file set for each bucket, without marks."""
        t = self.tables
        with t.change() as change:
            change.replace("postings", "term", _in_blocks(_last(t.read("postings", changes=True), t, "postings")), sort=["term"])
            change.replace("terms", "term", self.counts(), sort=["term"])
            n_chunks, n_words = self.corpus()
            change.replace("corpus", "corpus", t.spark.createDataFrame([("all", n_chunks, n_words)], "corpus string, n_chunks long, n_words long"))

    def changes(self) -> int:
        """Changes that a bucket's postings are spread over, at most."""
        return max((len(x) for x in self.tables.manifest()["tables"]["postings"]["files"].values()), default=0)


def bm25_part(tf: Column, dl: Column, df: Column, n_chunks: int, n_words: int) -> Column:
    idf = F.greatest(F.log((F.lit(n_chunks) - df + 0.5) / (df + 0.5)), F.lit(index.LEAST_IDF))
    length = dl / (F.lit(n_words) / F.lit(n_chunks or 1))
    return idf * tf * (index.K1 + 1) / (tf + index.K1 * ((1 - index.B) + index.B * length))


def _last(rows: DataFrame, tables: Tables, name: str) -> DataFrame:
    """What was said last of each term in a chunk, a row each; where no bucket has two changes, that is all there is."""
    rows = _single(rows)
    plain = ["term", "chunk_id", "tf", "dl", "doc_type"]
    if all(len(x) < 2 for x in tables.manifest()["tables"][name]["files"].values()):
        return rows.select(*plain).where("tf > 0")
    last = rows.groupBy("term", "chunk_id").agg(F.max_by(F.struct("tf", "dl", "doc_type"), "at").alias("r"))
    return last.select("term", "chunk_id", "r.*").where("tf > 0")
