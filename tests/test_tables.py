"""Tables that change together, the stored inverted index, and many questions at once."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.archive import Archive
from papyra.operators import chunk, index, inverted, many, retrieve
from papyra.plans import question as questions
from papyra.tables import Conflict, Tables

WORDS = "river stone green house rent amount total paper window market the of and invoice passport expiry".split()


def rows(spark, ids, word="x"):
    return spark.createDataFrame([(i, f"{word}{i}") for i in ids], "id long, v string")


def contents(t, name):
    return sorted((r["id"], r["v"]) for r in t.read(name).collect())


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_a_change_leaves_other_buckets_alone(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), buckets=8)
    with t.change() as c:
        written = c.replace("a", "id", rows(spark, range(50)))
        assert written.count() == 50 and not t.exists("a")  # not before the end
    before = files(tmp_path / "t")
    touched = t.buckets_of("a", rows(spark, [7]))
    assert touched == t.buckets_of("a", [7]) and len(touched) == 1
    with t.change() as c:
        old = t.read("a", touched)
        c.replace("a", "id", old.where("id <> 7").union(rows(spark, [7], "y")), touched)
    assert contents(t, "a") == sorted([(i, f"x{i}") for i in range(50) if i != 7] + [(7, "y7")])
    after = files(tmp_path / "t")
    new = after - before
    assert before <= after and new and all(f.startswith(f"a/bucket={touched[0]}/") for f in new)
    # only the bucket's files are listed and read
    one = t.read("a", touched)
    assert len(one.inputFiles()) == len(new) and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="other buckets"), t.change() as c:
        c.replace("a", "id", rows(spark, range(50)), touched)


def test_a_failed_change_is_none(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), buckets=4)
    with t.change() as c:
        c.replace("a", "id", rows(spark, range(9)))
        c.replace("b", "id", rows(spark, range(9)))
    with pytest.raises(RuntimeError, match="between"), t.change() as c:
        c.replace("a", "id", rows(spark, range(3), "new"))
        raise RuntimeError("between two tables")
    assert contents(t, "a") == contents(t, "b") == [(i, f"x{i}") for i in range(9)]
    # a manifest that was being written when its writer died is no state, and doesn't stop the next writer
    (tmp_path / "t" / "_manifests" / "2.json").write_text('{"number": 2, "ta')
    assert contents(t, "a") == [(i, f"x{i}") for i in range(9)]
    with t.change() as c:
        c.append("a", "id", rows(spark, [100]))
    assert len(contents(t, "a")) == 10 and t.manifest()["number"] == 2
    strays = files(tmp_path / "t")
    assert t.vacuum(kept=1) > 0
    assert files(tmp_path / "t") < strays and len(contents(t, "a")) == 10 and len(contents(t, "b")) == 9


def test_of_two_writers_the_second_fails(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), buckets=2)
    with pytest.raises(Conflict), t.change() as slow:
        slow.replace("a", "id", rows(spark, [1]))
        with t.change() as quick:
            quick.replace("a", "id", rows(spark, [2]))
    assert contents(t, "a") == [(2, "x2")]


def test_old_states_go_by_themselves(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), buckets=1, kept=2)
    for k in range(5):
        with t.change() as c:
            c.replace("a", "id", rows(spark, [k]))
    assert contents(t, "a") == [(4, "x4")] and len(list((tmp_path / "t" / "a" / "bucket=0").glob("at=*"))) == 2
    with t.change() as c:
        c.replace("a", "id", rows(spark, []))
    assert contents(t, "a") == [] and t.read("a").columns == ["id", "v"]


def documents(spark, seed, ids):
    rng = random.Random(seed)
    data = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 30, 400]))), f"Paper {i}", ["general", "invoice", "id"][i % 3]) for i in ids]
    return spark.createDataFrame(data, "doc_id long, text string, title string, doc_type string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))


def chunked(spark, seed, ids):
    docs = documents(spark, seed, ids)
    return retrieve.with_ids(chunk.chunks(docs, "doc_id"), docs)


def scores(df):
    return {r["chunk_id"]: round(r["bm25"], 9) for r in df.collect()}


def test_the_stored_index_is_read_by_term_and_follows_changes(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), buckets=16)
    own = inverted.Inverted(t)
    with t.change() as c:
        inverted.add(c, c.replace("chunks", "document_id", chunked(spark, 1, range(40))))
    terms = ["river", "passport", "nowhere"]
    hits = own.hits(terms)
    read = {f.partition("bucket=")[2].partition("/")[0] for f in hits.inputFiles()}
    every = {str(p).partition("bucket=")[2].partition("/")[0] for p in (tmp_path / "t" / "postings").rglob("*.parquet")}
    assert read <= set(map(str, t.buckets_of("postings", terms))) and len(read) <= 3 < len(every)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#", plan) and re.search(r"PushedFilters: \[[^]]*In\(term", plan)
    assert scores(own.bm25(terms)) == scores(index.bm25(t.read("chunks"), terms))
    assert own.bm25([]).count() == 0 and own.bm25(["nowhere"]).count() == 0
    # some documents change, some go, some come: marks and differences give what a new index gives
    for step, (gone, new) in enumerate([([3, 4], [3]), ([5], []), ([], [50, 51]), ([3, 50], [3, 4])]):
        ids = spark.createDataFrame([(i,) for i in {*gone, *new}], "document_id long")
        touched = t.buckets_of("chunks", ids)
        with t.change() as c:
            old = t.read("chunks", touched)
            made = chunked(spark, 10 + step, new) if new else old.limit(0)
            now = c.replace("chunks", "document_id", old.join(ids, "document_id", "left_anti").unionByName(made.select(*old.columns)), touched)
            inverted.add(c, now.join(ids, "document_id", "left_semi"), old.join(ids, "document_id", "left_semi"))
        chunks = t.read("chunks")
        assert scores(own.bm25(terms)) == scores(index.bm25(chunks, terms))
        assert own.corpus() == tuple(index.corpus_stats(chunks).first())
        assert {(r["term"], r["df"], r["cf"]) for r in own.counts().collect()} == {tuple(r) for r in index.postings(chunks).groupBy("term").agg(F.count("*"), F.sum("tf")).collect()}
    assert own.changes() > 1
    before = scores(own.bm25(terms))
    own.compact()
    assert own.changes() == 1 and scores(own.bm25(terms)) == before
    assert set(scores(own.bm25(terms, "invoice"))) == {r["chunk_id"] for r in chunks.where("doc_type = 'invoice'").collect()} & set(before)


QUESTIONS = ["river stone house", "latest invoice total amount", "passport expiry date", None, "zzz qqq", "عقد", "rive"]


@pytest.mark.parametrize("most", [2000, 3])
def test_many_questions_give_what_each_gives(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(many, "MOST_QUESTIONS", most)
    monkeypatch.setattr(many, "CHUNKS", 7)
    t = Tables(spark, str(tmp_path / "t"), buckets=4)
    own = inverted.Inverted(t)
    with t.change() as c:
        inverted.add(c, c.replace("chunks", "document_id", chunked(spark, 2, range(60))))
    chunks = t.read("chunks").repartition(3)
    cases = spark.createDataFrame([(k, q) for k, q in enumerate(QUESTIONS)], "id long, question string")
    found = many.hybrid(cases, chunks, own, most=10).cache()
    out = {k: [] for k in range(len(QUESTIONS))}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["place"])):
        out[r["id"]].append((r["chunk_id"], round(r["score"], 6), r["retrieval"]))
    monkeypatch.setattr("papyra.functions.rules.CANDIDATES", 10)
    for k, q in enumerate(QUESTIONS):
        plan = questions.plan(q or "")
        some = retrieve.candidates(chunks, q or "", plan, 10, own)
        some = some if some.count() else retrieve.lexical(chunks, plan)
        one = retrieve.reranked(chunks.join(some, "chunk_id"), plan).orderBy(F.desc("score"), "chunk_id").limit(8)
        assert out[k] == [(r["chunk_id"], round(r["score"], 6), r["retrieval"]) for r in one.collect()], q
    assert not out[3] and not out[4] and out[6]
    answers = {r["id"]: r["answer"] for r in many.answers(cases, found).collect()}
    assert answers[3] == "Closest matches from your archive:" and answers[5].startswith("أقرب") and answers[0].split("\n")[1].startswith("[1] Paper")


def test_the_best_of_a_task_are_few_and_exact():
    rng = np.random.default_rng(3)
    best, rows_ = many._Best(4, 5), []
    for b in range(30):
        values = rng.integers(0, 12, (50, 4)).astype(float)
        ids = np.array([f"c{b:02}:{k:02}" for k in range(50)], object)
        best.add(values, ids, values > 1)
        assert best.held <= 4 * 5 * 4 + 200
        rows_ += [(q, -v, i) for i, own in zip(ids, values, strict=True) for q, v in enumerate(own) if v > 1]
    out = best.batch().to_pydict()
    want = [r for q in range(4) for r in sorted(x for x in rows_ if x[0] == q)[:5]]
    assert sorted(zip(out["q"], [-v for v in out["value"]], out["chunk_id"], strict=True)) == sorted(want)


def test_an_archive_changes_its_own_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"n{k}.txt").write_text(f"Paper {k} of the river house\nInvoice total AED {k}00\n")
    a = Archive(spark, str(tmp_path / "archive"), buckets=8)
    a.ingest(str(tmp_path / "in"))
    before = {n: files(tmp_path / "archive" / n) for n in ("documents", "chunks")}
    one = a.read("documents").where("name = 'n7.txt'").first()["doc_id"]
    a.correct_text(one, "A passport without a river")
    for n, old in before.items():
        now = files(tmp_path / "archive" / n)
        assert old <= now and len({f.partition("/")[0] for f in now - old}) == 1
    assert a.search("passport").first()["document_id"] == one
    assert scores(a.index.bm25(["river", "paper"])) == scores(index.bm25(index.with_words(a.read("chunks")), ["river", "paper"]))
    a.delete([one])
    assert scores(a.index.bm25(["river"])) == scores(index.bm25(index.with_words(a.read("chunks")), ["river"])) and a.search("passport").count() == 0
    a.compact()
    a.rebuild()
    assert a.index.changes() == 1 and a.index.corpus()[0] == 29
    a.add_eval_case("river house paper 3", "Invoice total", "n")
    a.add_eval_case("river house", "no such answer")
    results, score = a.evaluate()
    assert {r["id"]: r["pass"] for r in results.collect()} == {1: True, 2: False} and score.first()["total"] == 2
