"""Hybrid retrieval for a table of questions at once.

It gives for each question what :func:`papyra.operators.retrieve.hybrid` gives for
one. Questions are taken in blocks of a bounded number; a block's plans,
terms and vectors go to the tasks, and postings and chunks are read once for all
of them. Each task keeps the best rows of a question as it reads, so that what is
shuffled is a list a question and task and not a row for each question and chunk;
lists are merged by aggregates of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import importable
from papyra.functions import rules, text, vectors
from papyra.operators import evaluate, retrieve
from papyra.operators.inverted import Inverted
from papyra.plans import question as questions
from papyra.tables import written

#: Questions of one block, about, and chunks whose scores for all of them are held at once.
MOST_QUESTIONS, CHUNKS = 2000, 1024
#: Parts that a question's lists are merged in before they meet.
PARTS = 16
LEAST_SIMILARITY = 0.18
_FOUND = "q int, chunk_id string, value double"


def asked(cases: DataFrame, key: str = "id", question: str = "question", typed: bool = True) -> DataFrame:
    """(id, question, norm, plan, search) of each question: its plan, and the words that search the inverted index. ``typed`` questions ask for documents of the type that their words name."""
    planned = questions.planned(cases.select(F.col(key).alias("id"), text.text_of(question).alias("question")))
    if not typed:
        planned = planned.withColumn("plan", F.col("plan").withField("doc_type", F.lit(None).cast("string")))
    some = F.filter(F.slice("plan.terms", 1, 12), lambda t: F.length(t) >= 2)
    return planned.withColumns({"norm": text.normalized("question"), "search": F.array_distinct(F.flatten(F.transform(some, text.index_tokens)))})


class _Best:
    """The best ``most`` chunks of each of ``size`` questions among what has been added; ties go to the smaller chunk_id."""

    def __init__(self, size: int, most: int):
        self.most, self.least = most, np.full(size, -np.inf)
        self.rows, self.held = [], 0

    def add(self, values: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """``values``: a row for each chunk, a column for each question."""
        chunk, q = np.nonzero(allowed & (values >= self.least))
        if len(q):
            self.rows.append(pd.DataFrame({"q": q, "value": values[chunk, q], "chunk_id": ids[chunk]}))
            self.held += len(q)
        if self.held > 4 * self.most * len(self.least):
            self._cut()

    def _cut(self) -> pd.DataFrame:
        if not self.rows:
            return pd.DataFrame({"q": [], "value": [], "chunk_id": []})
        every = pd.concat(self.rows).sort_values(["q", "value", "chunk_id"], ascending=[True, False, True])
        kept = every.groupby("q", sort=False).head(self.most)
        place = kept.groupby("q", sort=False).cumcount()
        full = kept[place == self.most - 1]
        self.least[full["q"].to_numpy(np.int64)] = full["value"].to_numpy()
        self.rows, self.held = [kept], 0
        return kept

    def batch(self) -> pa.RecordBatch:
        kept = self._cut()
        return pa.RecordBatch.from_arrays([pa.array(kept["q"].to_numpy(np.int32)), pa.array(kept["chunk_id"].tolist(), pa.string()), pa.array(kept["value"].to_numpy(np.float64))], ["q", "chunk_id", "value"])


def _types(column: pa.Array, wanted: list[str | None]) -> np.ndarray:
    """Which chunks (rows) are of the type that each question (column) asks for."""
    own, wish = np.array(column.to_pylist(), object), np.array(wanted, object)
    return np.equal(wish, None)[None, :] | (own[:, None] == wish[None, :])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches as tables that end with a run of equal keys and have about ``CHUNKS`` of them at most."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
        if not table.num_rows:
            continue
        codes = pc.dictionary_encode(table.column(key)).combine_chunks().indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        begin = 0
        for end in [*starts[CHUNKS::CHUNKS].tolist(), int(starts[-1])]:
            if end > begin:
                yield table.slice(begin, end - begin)
                begin = end
        left = table.slice(begin)
    if left is not None and left.num_rows:
        yield left


def _by_words(batches: Iterator[pa.RecordBatch], terms: list[list[str]], types: list[str | None], most: int) -> Iterator[pa.RecordBatch]:
    """BM25 sums of the questions' terms, from rows sorted by chunk."""
    place = {t: k for k, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
    asks = [[] for _ in place]
    for q, own in enumerate(terms):
        for t in own:
            asks[place[t]].append(q)
    size, first = np.array([len(x) for x in asks]), np.cumsum([0, *(len(x) for x in asks)])
    flat = np.array([q for x in asks for q in x], np.int64)
    best = _Best(len(terms), most)
    for table in _runs(batches, "chunk_id"):
        chunk = pc.dictionary_encode(table.column("chunk_id")).combine_chunks()
        term = pc.dictionary_encode(table.column("term")).combine_chunks()
        t = np.array([place[x] for x in term.dictionary.to_pylist()])[term.indices.to_numpy()]
        n, code = len(chunk.dictionary), chunk.indices.to_numpy().astype(np.int64)
        times = size[t]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q = flat[np.repeat(first[t], times) + within]
        sums = np.bincount(np.repeat(code, times) * len(terms) + q, np.repeat(table.column("part").to_numpy(), times), n * len(terms)).reshape(n, len(terms))
        opens = np.flatnonzero(np.diff(code, prepend=-1))
        best.add(np.round(sums, 12), np.array(chunk.dictionary.to_pylist(), object), (sums > 0) & _types(table.column("doc_type").take(pa.array(opens)), types))
    yield best.batch()


def _by_vectors(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, types: list[str | None], most: int) -> Iterator[pa.RecordBatch]:
    """Cosines of hashed vectors with those of the questions (columns of ``matrix``); sums of whole numbers, so exact."""
    length = np.sqrt(np.maximum((matrix * matrix).sum(axis=0), 1))
    best = _Best(matrix.shape[1], most)
    for whole in batches:
        for begin in range(0, whole.num_rows, CHUNKS):
            batch = whole.slice(begin, CHUNKS)
            vec = batch.column("vec")
            flat, n = vec.flatten(), vec.value_lengths().to_numpy(zero_copy_only=False)
            dense = np.zeros((len(n), matrix.shape[0]))
            dense[np.repeat(np.arange(len(n)), n), flat.field("dim").to_numpy()] = flat.field("weight").to_numpy()
            near = (dense @ matrix) / (np.sqrt((dense * dense).sum(axis=1))[:, None] * length[None, :])
            best.add(near, np.array(batch.column("chunk_id").to_pylist(), object), (near > LEAST_SIMILARITY) & _types(batch.column("doc_type"), types))
    yield best.batch()


def best_of(rows: DataFrame, most: int) -> DataFrame:
    """Of (q, chunk_id, value) the best ``most`` of each question: lists are merged in parts first, so none gets longer than its tasks' lists are together."""

    def cut(df: DataFrame, *keys: str) -> DataFrame:
        gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("less"), "chunk_id"))).alias("x"))
        return gathered.select(*keys, F.inline(F.slice("x", 1, most))).withColumn("value", -F.col("less")).drop("less")

    parts = cut(rows.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS))), "q", "part")
    return cut(parts, "q").select("q", "chunk_id", "value")


def _points(norm: Column, terms: Column) -> Column:
    """:func:`papyra.functions.text.lexical_score` for terms in a column."""

    def each(words: Column) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > 3)

        def add(s: Column, t: Column) -> Column:
            times = ((F.length(norm) - F.length(F.replace(norm, t, F.lit("")))) / F.length(t)).cast("int")
            alike = (F.length(t) > 3) & F.exists(longer, lambda w: F.startswith(w, t) | F.startswith(t, w))
            return s + F.when(F.array_contains(words, t), 4).otherwise(0) + times + alike.cast("int")

        return F.aggregate(terms, F.lit(0), add)

    return text.let(F.array_distinct(F.split(norm, " ")), each)


def _reranked(rows: DataFrame) -> DataFrame:
    """:func:`papyra.operators.retrieve.reranked` for plans in a column."""
    plan = lambda name: F.col(f"plan.{name}")
    score = F.col("score") + F.least(F.lit(3.0), _points(F.col("norm"), plan("terms")) * 0.08)
    score = score + F.when(F.col("doc_type") == plan("doc_type"), 1.2).otherwise(0.0)
    score = score + F.when((plan("field") == "amount") & F.col("text").rlike(retrieve.AMOUNT), 0.9).otherwise(0.0)
    score = score + F.when((plan("field") == "date") & F.col("text").rlike(retrieve.DATE), 0.7).otherwise(0.0)
    if "updated_at" in rows.columns:
        score = score + F.when((plan("sort") == "latest") & F.col("updated_at").isNotNull(), 0.15).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 9))


def _block(block: DataFrame, chunks: DataFrame, stored: Inverted, limit: int, most: int) -> DataFrame:
    spark = chunks.sparkSession
    schema = block.schema
    rows = block.collect()
    known = F.broadcast(spark.createDataFrame([(q, *r) for q, r in enumerate(rows)], f"q int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}"))
    terms, types = [r["search"] for r in rows], [r["plan"]["doc_type"] for r in rows]
    matrix = np.zeros((rules.DIMENSIONS, len(rows)))
    for r in vectors.hashed(known, "q", F.col("norm")).collect():
        matrix[r["dim"], r["q"]] = r["weight"]
    parts = stored.parts(sorted({t for own in terms for t in own})).repartition("chunk_id").sortWithinPartitions("chunk_id", "term")  # equal chunks get equal sums
    words = best_of(parts.mapInArrow(lambda b: _by_words(b, terms, types, most), _FOUND), most)
    near = chunks.where(F.size("vec") > 0).select("chunk_id", "doc_type", "vec").mapInArrow(lambda b: _by_vectors(b, matrix, types, most), _FOUND)
    near = best_of(near, most)
    both = retrieve.fused(words.select("q", "chunk_id", (2.0 + F.col("value")).alias("score")), near.select("q", "chunk_id", (1.5 + 3.0 * F.col("value")).alias("score")), ["q", "chunk_id"])
    found = written(both, "found")
    out = chunks.join(F.broadcast(found), "chunk_id")  # two lists of ``most`` rows a question
    missed = known.join(found.select("q").distinct(), "q", "left_anti")
    if missed.limit(1).count():
        # neither index has anything for these few questions: points for their words, the best of each task before they meet
        each = chunks.crossJoin(F.broadcast(missed.select("q", "plan"))).where(F.col("plan.doc_type").isNull() | (F.col("plan.doc_type") == F.col("doc_type")))
        scored = each.withColumn("score", _points(F.col("norm"), F.col("plan.terms")) / 5.0).where("score > 0")
        top = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id"))).where(F.col("n") <= most)
        out = out.unionByName(top.select(*chunks.columns, "q", "score", F.lit("lexical").alias("retrieval")).select(*out.columns))
    ranked = _reranked(out.join(known.select("q", "id", "plan"), "q"))
    columns = [c for c in ("chunk_id", "document_id", "title", "page", "text", "score", "retrieval") if c in ranked.columns]
    gathered = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_less"), *columns))).alias("x"))
    return gathered.select("id", F.posexplode(F.slice("x", 1, max(1, min(limit, rules.RESULTS)))).alias("place", "r")).select("id", (F.col("place") + 1).alias("place"), *(F.col(f"r.{c}") for c in columns))


def hybrid(cases: DataFrame, chunks: DataFrame, stored: Inverted, limit: int = 8, key: str = "id", question: str = "question", most: int = rules.CANDIDATES, typed: bool = True) -> DataFrame:
    """(id, place, chunk_id, document_id, title, page, text, score, retrieval): the best chunks of each question, best first.

    Ids are distinct. A null question is an empty one; one that nothing is found for has no rows. Questions that aren't ``typed``, such as
    passages of text, are looked for in documents of all types, whatever their words.
    """
    importable(chunks.sparkSession)
    own = asked(cases, key, question, typed)
    blocks = max(1, -(-own.count() // MOST_QUESTIONS))
    out = None
    for b in range(blocks):
        part = _block(own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), chunks, stored, limit, most)
        out = part if out is None else out.unionByName(part)
    return out


def answers(cases: DataFrame, found: DataFrame, key: str = "id", question: str = "question", limit: int = 4) -> DataFrame:
    """(id, answer): the best excerpts of each question as a numbered list, in its language; without any, the introduction alone."""
    arabic = text.has_arabic("question")
    page = F.when(arabic, "صفحة").otherwise("page")
    intro = F.when(arabic, "أقرب النتائج من الأرشيف:").otherwise("Closest matches from your archive:")
    top = found.where(F.col("place") <= limit).groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("place", "title", "page", "text"))).alias("rows"))
    own = cases.select(F.col(key).alias("id"), text.text_of(question).alias("question")).join(top, F.col("id") == F.col("_id"), "left")
    line = lambda r: F.concat(F.lit("["), r["place"].cast("string"), F.lit("] "), r["title"], F.lit(" - "), page, F.lit(" "), r["page"].cast("string"), F.lit(": "), F.substring(r["text"], 1, 360), F.lit("..."))
    return own.select("id", F.concat_ws("\n", intro, F.transform("rows", line)).alias("answer"))


def evaluated(cases: DataFrame, chunks: DataFrame, stored: Inverted, limit: int = 8, typed: bool = True) -> DataFrame:
    """(id, expected_ok, cite_ok, pass) of cases (id, question, expected, must_cite), each answered by retrieval, all at once."""
    found = written(hybrid(cases, chunks, stored, limit, typed=typed), "answers")
    return evaluate.judged(cases, answers(cases, found), found.select("id", F.col("title").alias("cited")))
