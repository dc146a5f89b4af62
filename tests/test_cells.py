"""Vectors by model, in cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.archive import HASHED, Archive, Model
from papyra.operators import cells
from papyra.tables import Tables


def clusters(n, dims=16, groups=20, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    return [(str(i), i, [float(x) for x in middle[i % groups] + rng.normal(scale=0.25, size=dims)], None) for i in range(n)]


def stored(spark, tmp_path, **models):
    t = Tables(spark, str(tmp_path / "t"), buckets=32)
    own = cells.Cells(t)
    for model, data in models.items():
        rows = spark.createDataFrame(data, "id string, content long, vector array<double>, error string").repartition(3)
        with t.change() as c:
            own.add(c, model, rows, own.fit(c, model, rows))
    return own


def test_a_probe_finds_what_all_cells_have(spark, tmp_path):
    data = clusters(1500)
    own = stored(spark, tmp_path, some=data)
    assert own.models() == ["some"] and 20 < len(own.centroids("some")) == 39
    hit = total = 0
    for k in range(0, 1500, 400):
        q = data[k][2]
        exact = own.similar("some", q, None)
        assert exact.count() == 1500
        best = lambda df: {r["id"] for r in df.orderBy(F.desc("similarity"), "id").limit(20).collect()}
        want = best(exact)
        x = np.array([v for _, _, v, _ in data])
        plain = x @ np.array(q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        assert want == {data[i][0] for i in sorted(range(1500), key=lambda i: (-plain[i], data[i][0]))[:20]}
        hit, total = hit + len(want & best(own.similar("some", q))), total + 20
    assert hit / total >= 0.9
    # cells that aren't probed aren't read
    probed = own.similar("some", q, 2)
    assert {r["cell"] for r in own.rows("some", own.probed("some", q, 2)).select("cell").distinct().collect()} == set(own.probed("some", q, 2))
    assert len({f.partition("bucket=")[2].partition("/")[0] for f in probed.inputFiles()}) <= 2 < len(own.similar("some", q, None).inputFiles())


def test_models_are_never_compared(spark, tmp_path):
    same = [1.0] + [0.0] * 15
    one, two = [*clusters(60), ("a", 1, same, None)], [*clusters(60, dims=8, seed=2), ("b", 1, [0.0] * 8, None), ("c", 2, None, "time out"), ("d", 3, [1.0], None), ("e", 4, [], None)]
    own = stored(spark, tmp_path, **{"local-hash-384": one, "multilingual-e5-small": two})
    assert own.similar("local-hash-384", same, None).where("id in ('b', 'c', 'd', 'e')").count() == 0
    assert own.similar("multilingual-e5-small", same, None).count() == 0  # another size: nothing to compare
    assert own.similar("unknown", same, None).count() == 0
    bad = {(r["id"], r["model"], r["dims"]) for r in own.tables.read("vectors").where("dims = 0").collect()}
    assert bad == {("c", "embedding-error:time out", 0), ("d", "embedding-error:no vector", 0), ("e", "embedding-error:no vector", 0)}
    live = spark.createDataFrame([("a", 1)], "chunk_id string, content long")
    assert [(r["chunk_id"], round(r["score"], 6)) for r in own.hits("local-hash-384", same, live, None).collect()] == [("a", 4.5)]
    changed = spark.createDataFrame([("a", 2)], "chunk_id string, content long")
    assert own.hits("local-hash-384", same, changed, None).count() == 0 and own.missing("local-hash-384", changed).count() == 1
    assert (cells.least("multilingual-e5-small"), cells.least("local-hash-384"), cells.least("other")) == (0.78, 0.18, 0.12)
    with own.tables.change() as c:
        own.pruned(c, live)
    assert [r["id"] for r in own.tables.read("vectors").collect()] == ["a"]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def counts(text):
    return [float(text.lower().count(c)) for c in LETTERS]


def letters(df):
    low = F.lower("text")
    vector = F.array(*((F.length(low) - F.length(F.translate(low, c, ""))).cast("double") for c in LETTERS))
    failed = F.contains("text", F.lit("unreadable"))
    return df.select("id", F.when(~failed, vector).alias("vector"), F.when(failed, "refused").alias("error"))


def test_an_archive_embeds_what_is_missing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, word in enumerate(["zebra zoo", "banana band", "kick kayak", "unreadable"]):
        (tmp_path / "in" / f"n{k}.txt").write_text(f"{word} {word} {word}")
    a = Archive(spark, str(tmp_path / "archive"), buckets=4, model=Model("letters", letters, counts))
    a.ingest(str(tmp_path / "in"))
    assert a.active_model() == HASHED
    assert a.embed(cells=2) == 4 and a.active_model() == "letters"
    assert a.embed() == 1  # the failed one is tried again
    first = a.search("zzz ooo", exact=True).first()
    assert first["retrieval"] == "vector" and "zebra" in first["snippet"]
    zebra = a.read("documents").where("name = 'n0.txt'").first()["doc_id"]
    a.correct_text(zebra, "quiet queen quits")
    assert "zebra" not in str(a.search("zzz ooo", exact=True).collect())
    assert a.embed() == 2
    assert a.search("qqqq uuu ii", exact=True).first()["document_id"] == zebra
    a.prune_vectors()
    assert a.tables.read("vectors").where("dims > 0").count() == 3
    with pytest.raises(ValueError, match="no model"):
        Archive(spark, str(tmp_path / "archive")).embed()
