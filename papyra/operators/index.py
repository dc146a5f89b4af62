"""Inverted index and hashed vectors of chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import rules, text, vectors

#: BM25 constants: saturation, length part, least weight of a very common term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def indexed_text():
    """What the index sees of a chunk: title, text and normalised text, all counted."""
    return F.concat_ws(" ", "title", "text", "norm")


def with_words(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``words``, what the inverted index sees of them; those that have the column keep it."""
    return chunks if "words" in chunks.columns else chunks.withColumn("words", text.index_tokens(indexed_text()))


def indexed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with what retrieval reads: ``words`` of the inverted index and ``vec``, the hashed vector as array<struct<dim, weight>>. Built once, when chunks are stored, within the row."""
    return with_words(chunks).withColumn("vec", vectors.hashed_array(F.col("norm")))


def postings(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, key, tf, dl): counts within each chunk, so that a frequent term meets as one row a chunk."""
    words = rows.select(key, F.size("words").alias("dl"), F.explode("words").alias("term"))
    return words.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: chunks and words, over all chunks before any filter."""
    return rows.agg(F.count("*").alias("n_chunks"), F.sum(F.size("words")).alias("n_words"))


def matched(rows: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, dl, term, tf) for the given terms only, counted within each row: other words never leave it."""
    own = rows.select(key, F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("w")).where(F.size("w") > 0)
    tf = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda w: w == t)).alias("tf")))
    return own.select(key, "dl", F.inline(tf))


def bm25(rows: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, bm25) of the chunks with one of the terms.

    Corpus statistics are one row, the terms' document counts a row for each
    term; both are broadcast, and their size follows the question alone.
    """
    hits = matched(rows, terms, key)
    counts = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(counts), "term").crossJoin(F.broadcast(corpus_stats(rows)))
    idf = F.greatest(F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    length = F.col("dl") / (F.col("n_words") / F.col("n_chunks"))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * length))
    # rounded, so that equal chunks tie whatever the order of their sums
    return joined.groupBy(key).agg(F.round(F.sum(part), 12).alias("bm25"))


def _dots(vec: str, asked: dict[int, int], dims: int) -> Column:
    """struct<dot, len>: the products of stored vectors with the asked one and with themselves, by batch; whole numbers, so sums are exact in any order."""
    q = np.array([asked.get(d, 0) for d in range(dims)], np.int64)

    def batch(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        dim, weight = (pc.struct_field(flat, [k]).to_numpy(zero_copy_only=False) for k in (0, 1))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        begins = np.concatenate([[0], ends])[:-1]

        def of(x: np.ndarray) -> pa.Array:
            total = np.concatenate([[0], np.cumsum(x)])
            return pa.array((total[ends] - total[begins]).astype(np.int64))

        return pa.StructArray.from_arrays([of(q[dim] * weight), of(weight * weight)], ["dot", "len"])

    if (spark := SparkSession.getActiveSession()) is not None:
        importable(spark)
    return F.arrow_udf(batch, "struct<dot:bigint,len:bigint>")(vec)


def vector_hits(rows: DataFrame, question: str, least: float = 0.18, key: str = "chunk_id", dims: int = rules.DIMENSIONS) -> DataFrame:
    """(key, sim) of chunks whose hashed vector is nearer to the question's than ``least``; the question's goes to the tasks, so no chunk is shuffled."""
    own = vectors.hashed_plain(question, dims)
    size = float(sum(w * w for w in own.values()) or 1)
    sums = rows.where(F.size("vec") > 0).select(key, _dots("vec", own, dims).alias("s"))
    return sums.select(key, (F.col("s.dot") / (F.sqrt("s.len") * F.sqrt(F.lit(size)))).alias("sim")).where(F.col("sim") > least)
