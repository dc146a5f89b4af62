"""Hybrid retrieval: inverted index and vectors, fused, reranked and cut to the best.

Chunks have chunk_id, document_id, page, chunk_index, title, text, norm,
doc_type and vec, without a stored index words too, and, where a question asks for the latest, updated_at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import rules, text, vectors
from papyra.operators import chunk, index
from papyra.operators.inverted import Inverted
from papyra.plans import question as questions

AMOUNT, DATE = "(?i)" + rules.AMOUNT_SIGN, "(?i)" + rules.DATE_SIGN


def fused(words: DataFrame, near: DataFrame, key: str | list[str] = "chunk_id") -> DataFrame:
    """(key, score, retrieval): scores of both candidate lists are added."""
    both = words.join(near.withColumnRenamed("score", "near"), key, "full_outer")
    how = F.when(F.col("near").isNull(), "bm25").when(F.col("score").isNull(), "vector").otherwise("bm25+vector")
    return both.select(*([key] if isinstance(key, str) else key), (F.coalesce("score", F.lit(0.0)) + F.coalesce("near", F.lit(0.0))).alias("score"), how.alias("retrieval"))


def reranked(candidates: DataFrame, plan: questions.Plan) -> DataFrame:
    """The score with points for the question's words, the type, the field and the order it asks for."""
    score = F.col("score") + F.least(F.lit(3.0), text.lexical_score(F.col("norm"), plan.terms) * 0.08)
    if plan.doc_type:
        score = score + F.when(F.col("doc_type") == plan.doc_type, 1.2).otherwise(0.0)
    if plan.field == "amount":
        score = score + F.when(F.col("text").rlike(AMOUNT), 0.9).otherwise(0.0)
    if plan.field == "date":
        score = score + F.when(F.col("text").rlike(DATE), 0.7).otherwise(0.0)
    if plan.sort == "latest" and "updated_at" in candidates.columns:
        score = score + F.when(F.col("updated_at").isNotNull(), 0.15).otherwise(0.0)
    return candidates.withColumn("score", F.round(score, 9))


def reordered(ranked: DataFrame, order: DataFrame | None, limit: int) -> DataFrame:
    """The first ``limit`` rows of ``ranked`` (chunk_id, score, ...) in an order from outside: ``order`` (chunk_id, place), from any ranker.

    Listed chunks come first, by place; unlisted ones follow in their own order. Places that repeat count once, at the first. An empty order, or none, is the
    identity, so that a ranker that fails changes nothing. ``rank`` tells the order of what is returned.
    """
    size = max(1, min(limit, rules.RESULTS))
    if order is None:
        own = ranked.withColumn("_place", F.lit(None).cast("long"))
    else:
        places = order.where("place is not null").groupBy("chunk_id").agg(F.min("place").cast("long").alias("_place"))
        own = ranked.join(F.broadcast(places), "chunk_id", "left")  # a ranker orders what it was shown: two lists of candidates at most
    best = own.orderBy(F.asc_nulls_last("_place"), F.desc("score"), "chunk_id").limit(size)
    by = Window.orderBy(F.asc_nulls_last("_place"), F.desc("score"), "chunk_id")  # RESULTS rows at most
    return best.withColumn("rank", F.row_number().over(by)).drop("_place")


def supported(answer: Column | str, excerpts: Column | str, least: float = 0.6) -> Column:
    """Whether an answer rests on its sources: the share of its words of four letters or more, and of its numbers, that occur in the excerpts. An answer without any is supported."""
    told = lambda c: F.split(text.normalized(c), " ")
    weighty = F.filter(F.array_distinct(told(answer)), lambda w: (F.length(w) > 3) | w.rlike(r"\p{Nd}"))
    found = F.array_intersect(weighty, told(excerpts))
    return (F.size(weighty) == 0) | (F.size(found) >= least * F.size(weighty))


def candidates(chunks: DataFrame, question: str, plan: questions.Plan, most: int = rules.CANDIDATES, stored: Inverted | None = None, near: DataFrame | None = None) -> DataFrame:
    """The best ``most`` chunks of each index, fused. Statistics of the index are those of all chunks; the type restricts the lists.

    With a ``stored`` inverted index the chunks' words aren't read. ``near`` (chunk_id, score) takes the place of the hashed vectors' list: hits of another model.
    """
    some = chunks.where(F.col("doc_type") == plan.doc_type) if plan.doc_type else chunks
    terms = questions.index_terms(plan.terms)
    if stored:
        scores = stored.bm25(terms, plan.doc_type)
    else:
        scores = index.bm25(chunks, terms)
        scores = scores.join(some.select("chunk_id"), "chunk_id", "left_semi") if plan.doc_type else scores
    words = scores.orderBy(F.desc("bm25"), "chunk_id").limit(most).select("chunk_id", (2.0 + F.greatest(F.col("bm25"), F.lit(0.0))).alias("score"))
    if near is None:
        near = index.vector_hits(some, question).orderBy(F.desc("sim"), "chunk_id").limit(most).select("chunk_id", (1.5 + 3.0 * F.col("sim")).alias("score"))
    elif plan.doc_type:
        near = near.join(some.select("chunk_id"), "chunk_id", "left_semi")
    return fused(words, near)


def lexical(chunks: DataFrame, plan: questions.Plan) -> DataFrame:
    """What is left when both indexes find nothing: points for the question's words."""
    some = chunks.where(F.col("doc_type") == plan.doc_type) if plan.doc_type else chunks
    return some.select("chunk_id", (text.lexical_score(F.col("norm"), plan.terms) / 5.0).alias("score"), F.lit("lexical").alias("retrieval")).where("score > 0")


def hybrid(chunks: DataFrame, question: str, limit: int = 8, doc_type: str | None = None, stored: Inverted | None = None, near: DataFrame | None = None, ranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best chunks for a question, at most ``RESULTS``, with score and how they were found; ties go to the smaller chunk_id.

    If neither index has a candidate, chunks are scored by the question's words. A ``ranker`` gets the reranked chunks and returns (chunk_id, place); see :func:`reordered`.
    """
    own = questions.plan(question)
    plan = questions.Plan(doc_type or own.doc_type, own.field, own.sort, own.terms)
    # two lists of CANDIDATES rows at most: kept on the driver, so that they are found once
    some = candidates(chunks, question, plan, stored=stored, near=near)
    rows = some.collect()
    if rows:
        found = F.broadcast(chunks.sparkSession.createDataFrame(rows, some.schema))
    else:
        found = lexical(chunks, plan)
    ranked = reranked(chunks.join(found, "chunk_id"), plan)
    if ranker:
        return reordered(ranked, ranker(ranked.orderBy(F.desc("score"), "chunk_id").limit(rules.RESULTS)), limit)
    return ranked.orderBy(F.desc("score"), "chunk_id").limit(max(1, min(limit, rules.RESULTS)))


def best_chunks(found: DataFrame) -> DataFrame:
    """The best chunk of each document."""
    first = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def search(chunks: DataFrame, documents: DataFrame, question: str, limit: int = 20, doc_type: str | None = None, language: str | None = None, stored: Inverted | None = None, near: DataFrame | None = None) -> DataFrame:
    """(document_id, title, score, retrieval, snippet), best first. The language restricts what the limit has left."""
    found = best_chunks(hybrid(chunks, question, max(30, 3 * limit), doc_type, stored, near)).orderBy(F.desc("score"), "chunk_id").limit(max(1, min(limit, 100)))
    if language:
        found = found.join(documents.select(F.col("document_id"), "language"), "document_id").where(F.contains(F.col("language"), F.lit(language)))
    return found.select("document_id", "title", "score", "retrieval", text.snippet("text", text.terms_of(question)).alias("snippet")).orderBy(F.desc("score"), "document_id")


def sources(found: DataFrame, limit: int = 12) -> DataFrame:
    """Numbered sources of an answer."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # RESULTS rows at most
    top = found.orderBy(F.desc("score"), "chunk_id").limit(limit)
    return top.select(place.cast("int").alias("source"), "document_id", "title", "page", F.substring("text", 1, 650).alias("snippet"), "score", "retrieval")


def extractive_answer(found: DataFrame, question: str, limit: int = 4) -> DataFrame:
    """One row: the best excerpts as a numbered list, in the question's language."""
    arabic = any("؀" <= c <= "ۿ" for c in question)
    intro, page = ("أقرب النتائج من الأرشيف:", "صفحة") if arabic else ("Closest matches from your archive:", "page")
    top = found.orderBy(F.desc("score"), "chunk_id").limit(limit)
    line = lambda r: F.concat(F.lit("["), r["n"].cast("string"), F.lit("] "), r["title"], F.lit(f" - {page} "), r["page"].cast("string"), F.lit(": "), F.substring(r["text"], 1, 360), F.lit("..."))
    rows = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct("n", "title", "page", "text"))).alias("rows"))
    return gathered.select(F.concat_ws("\n", F.lit(intro), F.transform("rows", line)).alias("answer"))


def chunked(documents: DataFrame, key: str = "doc_id", page_col: str | None = None) -> DataFrame:
    """The chunks of documents as an archive stores them: ids that are the same in each run, titles, types and hashed vectors; their words are in the stored index. Nothing is shuffled."""
    each = chunk.chunks(documents, key, page_col=page_col, keep=["title", "doc_type", "updated_at"])
    ids = F.concat_ws(":", key, "page", "chunk_index").alias("chunk_id")
    rows = each.select(F.col(key).alias("document_id"), ids, "page", "chunk_index", "text", "token_count", vectors.seen("text").alias("seen"), "title", "doc_type", "updated_at")
    return rows.select("document_id", "chunk_id", "page", "chunk_index", "text", "token_count", "seen.norm", "title", "doc_type", "updated_at", "seen.vec")


def with_ids(chunks: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks that have been made already, with what their documents say and their index ``words``, for retrieval without a stored index."""
    ids = F.concat_ws(":", key, "page", "chunk_index").alias("chunk_id")
    own = documents.select(F.col(key), "title", "doc_type", "updated_at")
    rows = chunks.select(ids, F.col(key), "page", "chunk_index", "text", "token_count", text.normalized("text").alias("norm")).join(own, key)
    return index.indexed(rows).withColumnRenamed(key, "document_id")


def highlighted(words: DataFrame, question: str) -> DataFrame:
    """``words`` (document_id, page, position, t) that a search term is in, or that are in a search term."""
    terms = text.terms_of(question)
    w = text.normalized("t")
    inside: Column = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(w, t) | ((F.length(w) > 2) & F.contains(t, w)))
    return words.where((w != "") & inside)
