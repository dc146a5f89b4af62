import pytest
from pyspark.sql import functions as F

from papyra.functions import extract, text, vectors
from papyra.operators import chunk, filing, index, ocr, retrieve, store
from papyra.plans import question as questions


def one(spark, value, expression, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expression).first()[0]


@pytest.mark.parametrize(
    ("raw", "norm"),
    [
        ("إأآٱ", "اااا"), ("مستشفى", "مستشفي"), ("مؤسسة", "موسسه"), ("مسائل", "مسايل"), ("عَقْدٌ", "عقد"), ("كتـاب؟", "كت اب"), ("Hello, WORLD_1!", "hello world_1"), (None, ""), ("  ", ""), ("É-ñ", "é ñ"),
    ],
)
def test_normalized(spark, raw, norm):
    assert one(spark, raw, text.normalized("x")) == norm
    assert one(spark, raw, text.normalized("x", fold=True)) == norm == text.plain(raw)


def test_folding_of_presentation_forms(spark):
    assert one(spark, "ﻻ", text.normalized("x", fold=True)) == "لا" == text.plain("ﻻ")


@pytest.mark.parametrize(("raw", "digits"), [("٩٥٠", "950"), ("۱۲۳", "123"), ("١٫٥ و ١٬٠٠٠", "1.5 و 1,000")])
def test_digits(spark, raw, digits):
    assert one(spark, raw, text.ascii_digits("x")) == digits


@pytest.mark.parametrize(
    ("norm", "keyword", "hit"),
    [
        ("المعقد", "عقد", False), ("العقد", "عقد", True), ("بالعقد الان", "عقد", True), ("وعقد", "عقد", True), ("due or expiry_date", "du", False), ("pay the amount due now", "amount due", True), ("amount overdue", "amount due", False),
        ("", "x", False), ("والعقد", "عقد", True), ("طبيب", "طبي", False), ("e mail", "e&", True),
    ],
)
def test_keywords(spark, norm, keyword, hit):
    assert one(spark, norm, text.has_keyword(F.col("x"), keyword)) is hit
    assert questions._has(norm, keyword) is hit


def test_quality_and_garbling(spark):
    rows = [("", "empty", True), ("two words", "poor", False), ("??????????", "poor", True), ("A clean English sentence with several words.", "good", False), ("هذا نص عربي واضح فيه كلمات كثيره", "good", False), ("αβ", "poor", True), ("êêêêêêêêêêêêêêêêêêêê", "poor", True)]
    df = spark.createDataFrame(rows, "x string, label string, garbled boolean")
    for r in df.select("x", "label", "garbled", text.quality("x")["label"].alias("own"), text.garbled("x").alias("bad")).collect():
        assert (r.own, r.bad) == (r.label, r.garbled), r.x


def test_query_terms(spark):
    for q in ("كم قيمة اخر فاتورة", "The TOTAL of the bill", "", "والعقد"):
        assert one(spark, q, text.query_terms("x")) == text.terms_of(q)
    assert "invoice" in text.terms_of("فاتورة")


@pytest.mark.parametrize(
    ("q", "plan"),
    [("كم قيمة اخر فاتورة كهرباء", ("invoice", "amount", "latest")), ("passport expiry", ("id", "date", None)), ("rent amount and date", ("contract", "amount", None)), ("hello", (None, None, None))],
)
def test_plans(spark, q, plan):
    p = questions.plan(q)
    assert (p.doc_type, p.field, p.sort) == plan
    r = questions.planned(spark.createDataFrame([(q,)], "question string")).first()["plan"]
    assert (r.doc_type, r.field, r.sort) == plan and r.terms == p.terms


CASES = [
    ("Application form for an Emirates ID", "form"), ("Passport no 1", "id"), ("Bank statement\nclosing balance", "bank"), ("Certificate of degree", "certificate"), ("Receipt for rent lease", "receipt"), ("Lease contract between the parties, medical insurance", "contract"),
    ("Hospital report", "medical"), ("court case", "legal"), ("Invoice total AED 5", "invoice"), ("news of today", "news"), ("nothing", "general"), ("\n".join(f"Article {i} text" for i in range(13)), "legal"),
    ("Employee contract\n" + "\n".join(f"Article {i} text" for i in range(13)), "contract"), ("سند قبض", "receipt"), ("عقد ايجار", "contract"), ("Federal Law about hospitals", "legal"),
]


def test_types(spark):
    df = spark.createDataFrame([(t, "scan.pdf", k) for t, k in CASES], "text string, name string, kind string")
    for r in extract.with_metadata(df).collect():
        assert r.doc_type == r.kind, r.text


def test_digits_of_another_script(spark):
    """Laws number their articles, and texts their amounts and dates, in digits of their own script."""
    law = "\n".join(f"المادة ({d}) نص" for d in "١٢٣٤٥٦٧٨٩٠١٢٣")
    r = extract.with_metadata(spark.createDataFrame([(law, "x.pdf"), ("٢٠٢٤/٠٥/٠١\nشركة النور\nنص", "y.pdf")], "text string, name string")).collect()
    assert r[0].doc_type == "legal" and r[1].company == "شركة النور" and r[1].doc_type == "general"
    df = spark.createDataFrame([("a", "المجموع ٥٠٠", 1.0), ("b", "٥٠٠", 1.0), ("c", "نص", 1.0)], "chunk_id string, text string, score double").withColumns({"norm": F.lit("x"), "doc_type": F.lit("general")})
    points = {r.chunk_id: r.score for r in retrieve.reranked(df, questions.Plan(None, "amount", None, ["zz"])).collect()}
    assert points == {"a": 1.9, "b": 1.9, "c": 1.0}
    df = df.withColumn("text", F.when(F.col("chunk_id") == "a", "١٢/٣").otherwise(F.col("text")))
    assert {r.chunk_id: r.score for r in retrieve.reranked(df, questions.Plan(None, "date", None, ["zz"])).collect()} == {"a": 1.7, "b": 1.0, "c": 1.0}


def test_fields(spark):
    body = "Acme LLC\nInvoice No: INV-7/A\nDue date: 3/7/2026\nPaid AED 1,250.50 and 99 USD\nTotal due: 1,349.50\nVAT no: 123456789012\nIBAN: AE07 0331 2345 6789\n"
    r = extract.with_metadata(spark.createDataFrame([(body, "my_file-1.pdf")], "text string, name string")).first()
    f = r.fields
    assert (f.invoice_number, f.currency, f.total, f.vat_number) == ("INV-7/A", "AED", "1,349.50", "123456789012")
    assert f.amounts_found == ["1,250.50", "99"] and r.amount == "1,250.50" and r.date_guess == "3/7/2026"
    assert f.iban.startswith("AE070331") and r.title == "My File 1" and r.company == "Acme LLC"
    assert r.summary.startswith("Bank document from Acme LLC (date: 3/7/2026, amount: 1,250.50, language: English). Acme LLC Invoice")


def test_a_law_takes_its_newest_year(spark):
    df = spark.createDataFrame([("Federal Decree Law No. 45 of 2021\nreplacing Law No. 1 of 2006 and of 1999", "x.pdf")], "text string, name string")
    r = extract.with_metadata(df, year=2026).first()
    assert r.date_guess == "2021" and r.title.startswith("Federal Decree Law No. 45")


@pytest.mark.parametrize(("guess", "ym"), [("2021", "2021-01"), ("2026-7-3", "2026-07"), ("3/7/2026", "2026-07"), ("5 March 2024", "2024-03"), ("1446-01-02", "1970-01"), (None, "1970-01")])
def test_year_month(spark, guess, ym):
    assert one(spark, guess, extract.year_month("x", F.lit(0))) == ym


def test_file_names(spark):
    for raw, name in (("a b/c:d", "a_b_c_d"), ("__x.-", "x"), ("", "document"), ("عقـد ١", "عقد_١"), (None, "document")):
        assert one(spark, raw, text.file_name("x")) == name


def plain_chunks(blocks, most=700, overlap=90):
    count = lambda t: (lambda n: max(1, int(n * 1.25)) if n else 0)(len(t.split()))
    out, held = [], []
    for b in blocks:
        n = count(b)
        if held and sum(map(count, held)) + n > most:
            out.append("\n".join(held))
            k = 0
            while k < len(held) and sum(count(x) for x in held[len(held) - k - 1 :]) <= overlap:
                k += 1
            held = held[len(held) - k :]
        if n > most:
            words = b.split()
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most - overlap)]
            held = []
        else:
            held.append(b)
    return [*out, "\n".join(held)] if held else out


@pytest.mark.parametrize("sizes", [[5], [100] * 20, [10, 800, 20], [600, 30, 30, 500, 2000, 4], [555] * 3, [1] * 900, [561], [700, 1]])
def test_chunks(spark, sizes):
    blocks = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(1, "\n\n".join(blocks)), (2, None), (3, " \n ")], "id long, text string")
    out = chunk.chunks(df, "id").orderBy("chunk_index").collect()
    assert [r.text for r in out] == plain_chunks(blocks)
    assert [r.chunk_index for r in out] == list(range(len(out))) and {r.id for r in out} == {1}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine("a", "b")).collect()] == [0.707107, 0, 0, 0, 0]


def test_hashed_vectors_on_both_sides(spark):
    body = "the rent of the house was due ايجار"
    df = spark.createDataFrame([(1, body)], "id long, text string")
    assert {r.dim: r.weight for r in vectors.hashed(df, "id", text.normalized("text")).collect()} == vectors.hashed_plain(body)


def test_bm25_matches_the_full_text_engine(spark):
    import sqlite3

    rows = [("1", "t one", "the rent of the house"), ("2", "t two", "rent rent lease"), ("3", "x", "nothing else"), ("4", "rent", "house house house été"), ("5", "y", "of of of"), ("6", "z", "last one ETE")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, text, norm)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(i, t, x, text.plain(x)) for i, t, x in rows])
    df = spark.createDataFrame(rows, "chunk_id string, title string, text string").withColumn("norm", text.normalized("text"))
    for terms in (["rent"], ["rent", "house"], ["ete", "lease"], ["of"]):
        expected = {i: -s for i, s in db.execute(f"SELECT id, bm25(f) FROM f WHERE f MATCH '{' OR '.join(terms)}'")}
        own = {r.chunk_id: r.bm25 for r in index.bm25(index.indexed(df), terms).collect()}
        assert own == pytest.approx(expected, abs=1e-12)


def archive_rows(spark):
    rows = [(1, "Lease", "contract", "The rent is AED 5000 due 2024-05-01"), (2, "Bill", "invoice", "Invoice total amount AED 120"), (3, "Memo", "general", "the green river runs past the stone bridge"), (4, "Copy", "general", "the green river and the green hill")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, doc_type string, text string").withColumn("updated_at", F.current_timestamp())
    return docs, retrieve.with_ids(chunk.chunks(docs, "doc_id"), docs)


def test_hybrid_search(spark):
    docs, chunks = archive_rows(spark)
    top = retrieve.hybrid(chunks, "green river").collect()
    assert [r.document_id for r in top[:2]] == [4, 3] or [r.document_id for r in top[:2]] == [3, 4]
    assert [r.document_id for r in retrieve.hybrid(chunks, "what is the invoice amount").collect()] == [2]
    assert retrieve.hybrid(chunks, "zzz qqq").count() == 0
    found = retrieve.search(chunks, docs.select(F.col("doc_id").alias("document_id"), F.lit("English").alias("language")), "green river", language="English").collect()
    assert {r.document_id for r in found} == {3, 4} and "green river" in found[0].snippet
    assert retrieve.search(chunks, docs.select(F.col("doc_id").alias("document_id"), F.lit("English").alias("language")), "green river", language="english").count() == 0
    answer = retrieve.extractive_answer(retrieve.hybrid(chunks, "green river"), "green river").first()[0]
    assert answer.startswith("Closest matches from your archive:\n[1] ") and " - page 1: the green river" in answer
    assert [r.source for r in retrieve.sources(retrieve.hybrid(chunks, "green river")).collect()] == [1, 2]


def test_fallback_to_words(spark):
    _, chunks = archive_rows(spark)
    plan = questions.Plan(terms=["greener"])
    assert {r.chunk_id for r in retrieve.lexical(chunks, plan).collect()} == {"3:1:0", "4:1:0"}


def test_filing(spark):
    rows = [(i, "Acme & Co", "invoice", "t", "DEWA electricity", "2024-05-01", f"f{i}.pdf") for i in range(3)] + [(3, "Once", "invoice", "t", "", None, "g.PDF"), (4, None, "form", "t", "", "2020", "h"), (5, "x", "legal", "Federal Law No. 45", "", "2021", "l.pdf")]
    df = spark.createDataFrame(rows, "doc_id long, company string, doc_type string, title string, norm string, date_guess string, name string").withColumns({"summary": F.lit(""), "mtime": F.lit(0)})
    out = {r.doc_id: r.relative for r in filing.planned(df).collect()}
    assert out[0] == "Bills/Utility/Acme_Co/bill_Acme_Co_2024-05.pdf" and out[3] == "Bills/General/bill_Once_1970-01.pdf"
    assert out[4] == "Other/2020/doc_unknown_2020-01" and out[5] == "Legal/Federal Laws/2021/law_Federal_Law_No._45_2021.pdf"
    plan = filing.planned(df).withColumn("sha256", F.when(F.col("doc_id") == 2, "s0").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))))
    moved = {r.doc_id: (r.target.rpartition("/")[2], r.action) for r in filing.without_collisions(plan).collect()}
    assert [moved[i] for i in range(3)] == [("bill_Acme_Co_2024-05.pdf", "copy"), ("bill_Acme_Co_2024-05-2.pdf", "copy"), ("bill_Acme_Co_2024-05.pdf", "already-exists")]
    assert {r.folder: r.n for r in filing.tree(filing.planned(df)).collect()}["Bills/Utility/Acme_Co"] == 3


def test_store(spark):
    known = spark.createDataFrame([("/a", "1", 1.0, "indexed"), ("/b", "2", 1.0, "duplicate"), ("/c", "3", 1.0, "indexed")], "path string, sha256 string, mtime double, status string")
    scan = spark.createDataFrame([("/a", "1", 1.0), ("/c", "9", 2.0), ("/d", "1", 5.0), ("/e", "2", 5.0), ("/f", "7", 5.0), ("/g", "7", 5.0)], "path string, sha256 string, mtime double")
    out = {r.path: r.status for r in store.new_files(scan, known).collect()}
    assert out == {"/a": "unchanged", "/c": "new", "/d": "duplicate", "/e": "new", "/f": "new", "/g": "duplicate"}
    old = spark.createDataFrame([("/a", 1, 10, 5), ("/b", 2, 10, 5)], "path string, v int, updated_at int, created_at int")
    new = spark.createDataFrame([("/a", 3, 20, 20), ("/c", 4, 20, 20)], "path string, v int, updated_at int, created_at int")
    assert sorted(map(tuple, store.upserted(old, new).collect())) == [("/a", 3, 20, 5), ("/b", 2, 10, 5), ("/c", 4, 20, 20)]
    ids = spark.createDataFrame([(2,), (2,)], "id long")
    assert store.deleted(spark.createDataFrame([(1,), (2,), (3,)], "document_id long"), ids).count() == 2


@pytest.mark.parametrize("most", [10, 0])
def test_folder_defaults(spark, most):
    docs = spark.createDataFrame([("/A/b/x",), ("/a/bc/x",), ("/z",), ("/a/q",)], "path string")
    folders = spark.createDataFrame([("/a/b", "deep"), ("/a", "top"), ("/Z", None), ("/a/", "")], "path string, default_type string")
    out = {r.path: r.default_type for r in store.folder_defaults(docs, folders, most_folders=most).collect()}
    assert out == {"/A/b/x": "deep", "/a/bc/x": "deep", "/z": None, "/a/q": "top"}


def test_engine_choice(spark):
    clean = "A clean page of text with many readable words on it."
    rows = [(1, 0, "tesseract:conf90", clean), (1, 1, "azure", clean * 2), (2, 0, "tesseract:conf30", clean), (2, 1, "ollama", ""), (2, 2, "azure", "Another clean page of text, less of it."), (3, 0, "tesseract", ""), (4, 0, "tesseract", ""), (4, 1, "ollama", "x")]
    out = {r.page_id: r.engine for r in ocr.chosen(spark.createDataFrame(rows, "page_id int, place int, engine string, text string")).collect()}
    assert out == {1: "tesseract:conf90", 2: "azure:fallback-from-tesseract:conf30", 3: "tesseract", 4: "ollama:fallback-from-tesseract"}


def test_highlights(spark):
    words = spark.createDataFrame([(1, 0, "Rental"), (1, 1, "of"), (1, 2, "ren"), (1, 3, "x")], "document_id int, position int, t string")
    assert [r.position for r in retrieve.highlighted(words, "the rent").collect()] == [0, 2]


GOOD = "A clean English sentence with several words in it."


def grid(spark, rows):
    df = spark.createDataFrame([(p, a, k, "v", "eng", "3", t, None if w is None else [(x, c) for x, c in w]) for p, a, k, t, w in rows], "page_id long, angle int, step int, variant string, languages string, mode string, text string, words array<struct<t:string,conf:int>>")
    return {r.page_id: (r.engine, r.text, r.words and len(r.words)) for r in ocr.grid_choice(df.repartition(3)).collect()}


def test_a_grid_of_readings_ends_early(spark):
    sure, unsure = [("a", 90), ("b", 61), (" ", 10), ("c", -1)], [("a", 30)]
    out = grid(spark, [
        (1, 0, 0, "two ?? words", sure), (1, 0, 1, GOOD, sure), (1, 0, 2, GOOD + " And much more of it.", sure),  # ended by the second
        (2, 0, 0, GOOD, unsure), (2, 0, 1, GOOD + " And much more of it.", unsure), (2, 0, 2, GOOD, sure),  # never sure: the most points
        (3, 0, 0, "? ?", unsure), (3, 90, 0, GOOD, sure), (3, 180, 0, GOOD, sure),  # turned: its boxes go
        (4, 0, 0, GOOD, [("a", 55)]), (4, 90, 0, GOOD + " And more.", sure),  # not doubtful
        (5, 0, 0, "", []), (5, 0, 1, None, None), (6, 0, 0, "xyz", unsure), (6, 90, 0, GOOD, [("a", 39)]), (7, 0, 0, GOOD, None), (8, 90, 0, GOOD, None),
    ])
    assert out[1] == ("tesseract:eng:psm3:v:conf75", GOOD, 4)
    assert out[2] == ("tesseract:eng:psm3:v:conf30", GOOD + " And much more of it.", 1)
    assert out[3] == ("tesseract:eng:psm3:v:rot90:conf75", GOOD, None)
    assert out[4] == ("tesseract:eng:psm3:v:conf55", GOOD, 1)
    assert out[5] == ("tesseract-no-text", "", None)
    assert out[6][0].endswith("v:conf30") and out[7] == ("tesseract:eng:psm3:v", GOOD, None) and out[8][0].endswith(":rot90")


def test_language_attempts(spark):
    df = spark.createDataFrame([(["eng", "osd"],), (["ara", "eng"],), (["ara"],), ([],), (["deu"],)], "have array<string>")
    assert [r[0] for r in df.select(ocr.attempts(F.col("have"))).collect()] == [["eng"], ["ara+eng", "eng+ara", "ara", "eng"], ["ara"], ["eng"], ["eng"]]


def test_an_order_from_outside(spark):
    ranked = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "chunk_id string, score double")
    ids = lambda order, n=9: [r.chunk_id for r in sorted(retrieve.reordered(ranked, order and spark.createDataFrame(order, "chunk_id string, place int"), n).collect(), key=lambda r: r["rank"])]
    assert ids(None) == ["a", "b", "c", "d"] and ids([("d", 1), ("b", 2), ("d", 9), ("z", 0), ("a", None)]) == ["d", "b", "a", "c"] and ids([("d", 1)], 2) == ["d", "a"]
    nothing = retrieve.reordered(ranked, spark.createDataFrame([], "chunk_id string, place int"), 9)
    assert [r.chunk_id for r in sorted(nothing.collect(), key=lambda r: r["rank"])] == ["a", "b", "c", "d"]
    told = spark.createDataFrame([("Rent is AED 500", "the rent: 500 aed"), ("Rent is AED 900", "the rent: 500 aed"), ("", "x"), (None, None)], "answer string, source string")
    assert [r[0] for r in told.select(retrieve.supported("answer", "source")).collect()] == [True, False, True, True]
