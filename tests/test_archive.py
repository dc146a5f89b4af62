import io
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.archive import Archive
from papyra.sources import files
from papyra.streaming import watch


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Lease contract</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Rent</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>AED 500</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
XLSX = zipped(
    xl__workbook_xml='<workbook><sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>Shared</t></si></sst>",
    xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c/><c><v>12</v></c></row><row><c/></row></sheetData></worksheet>', xl__worksheets__sheet2_xml="<worksheet><sheetData/></worksheet>",
)
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = zipped(ppt__slides__slide2_xml=f"<sld {A}><a:p><a:r><a:t>Second</a:t></a:r></a:p></sld>", ppt__slides__slide1_xml=f"<sld {A}><a:p><a:r><a:t>First</a:t></a:r></a:p></sld>")


def test_readers():
    assert files.word_pages(DOCX) == ["Lease contract\nRent | AED 500"]
    assert files.excel_pages(XLSX) == ["Sheet: One\nShared | 12", "Sheet: Two"]
    assert files.slide_pages(PPTX) == ["Slide 1\nFirst", "Slide 2\nSecond"]
    assert files.rtf_text(r"{\rtf1\ansi Hello \b bold\b0  caf\'e9}") == "Hello bold café"
    assert files.text_pages("عقد".encode("cp1256")) == ["عقد"] and files.text_pages("﻿é".encode()) == ["é"]


R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_sheets_and_slides_by_relation():
    """A sheet was deleted and the order changed: file numbers say nothing."""
    book = zipped(
        xl__workbook_xml=f'<workbook {R}><sheets><sheet name="Last" r:id="rId9"/><sheet name="First" r:id="rId2"/></sheets></workbook>',
        **{"xl___rels__workbook_xml.rels": '<Relationships><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet7.xml"/></Relationships>'},
        xl__worksheets__sheet1_xml='<worksheet><row><c><v>1</v></c></row></worksheet>', xl__worksheets__sheet7_xml='<worksheet><row><c><v>7</v></c></row></worksheet>',
    )
    book = renamed(book, "xl/workbook.xml.rels", "xl/_rels/workbook.xml.rels")
    assert files.excel_pages(book) == ["Sheet: Last\n7", "Sheet: First\n1"]
    deck = zipped(
        ppt__presentation_xml=f'<p {R}><sldIdLst><sldId r:id="b"/><sldId r:id="a"/></sldIdLst></p>', **{"rels.rels": '<Relationships><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="slides/slide2.xml"/></Relationships>'},
        ppt__slides__slide2_xml=f"<sld {A}><a:p><a:r><a:t>Second</a:t></a:r></a:p></sld>", ppt__slides__slide1_xml=f"<sld {A}><a:p><a:r><a:t>First</a:t></a:r></a:p></sld>",
    )
    assert files.slide_pages(renamed(deck, "rels.rels", "ppt/_rels/presentation.xml.rels")) == ["Slide 1\nSecond", "Slide 2\nFirst"]


def renamed(content, old, new):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(new if n == old or n.endswith(".rels") else n, a.read(n))
    return out.getvalue()


def test_rich_text():
    assert files.rtf_text(r"{\rtf1\ansi\ansicpg1256{\fonttbl{\f0 Arial;}}{\*\generator x;}\uc1 a\u1593?b \'da\'de\'cf\par next \{x\}}") == "aعb عقد next {x}"
    assert files.safe_name("../a/b\\c?d*.pdf") == "c_d_.pdf" and files.safe_name("../..") == "file"


def test_archive_of_its_own_files(spark, tmp_path):
    fill(tmp_path / "in")
    a = Archive(spark, str(tmp_path / "archive"))
    a.ingest(str(tmp_path / "in"), file_base=str(tmp_path / "filed"))
    assert sum(p.is_file() and not p.name.startswith(".") for p in (tmp_path / "filed").rglob("*")) == 5
    kept = {r["chunk_id"]: r["updated_at"] for r in a.read("chunks").collect()}
    a.upload("../no te?.txt", "Rent ﻋﻘﺪ of the ﬁne house".encode())
    new = a.read("documents").where("name like '%_no te_.txt'").first()
    assert a.document(new["doc_id"]).count() == 1 and new["doc_id"] in {r["document_id"] for r in a.search("عقد").collect()}
    # chunks of other documents are the ones that were there
    now = {r["chunk_id"]: r["updated_at"] for r in a.read("chunks").where(F.col("document_id") != new["doc_id"]).collect()}
    assert now == kept
    before = a.read("chunks").count()
    a.reindex([new["doc_id"]])
    assert a.read("chunks").count() == before
    s = a.status().first()
    assert (s["documents"], s["chunks"], s["fts_rows"], s["embeddings"], s["folders"], s["needs_review"]) == (6, before, before, before, 0, 2)
    assert a.export().columns[:3] == ["doc_id", "title", "doc_type"] and len(a.export().columns) == 17
    a.add_eval_case("x")
    a.remove_eval_case(1)
    assert a.eval_cases().count() == 0
    lease = a.read("documents").where("name = 'lease.docx'").first()
    assert a.delete([new["doc_id"], lease["doc_id"]], remove_files=True) == 1 and (tmp_path / "in" / "lease.docx").exists()
    assert not a.owns(f"{a.folder}/files/../x") and a.delete(everything=True) == 0 and a.read("documents").count() == 0


def test_unchanged_files_are_listed_and_not_read(spark, tmp_path, monkeypatch):
    import os

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"n{k}.txt").write_text(f"paper {k}")
    a = Archive(spark, str(tmp_path / "archive"), buckets=2)
    a.ingest(str(tmp_path / "in"))
    # other words under the same time and length: only who reads them can tell
    times = os.stat(tmp_path / "in" / "n0.txt").st_mtime_ns
    (tmp_path / "in" / "n0.txt").write_text("river 0")
    os.utime(tmp_path / "in" / "n0.txt", ns=(times, times))
    (tmp_path / "in" / "n1.txt").write_text("river and house")
    (tmp_path / "in" / "n3.txt").write_text("paper 2")
    assert {r["status"]: r["n"] for r in a.ingest(str(tmp_path / "in")).collect()} == {"unchanged": 2, "new": 1, "duplicate": 1}
    assert sorted(r["text"] for r in a.read("documents").collect()) == ["paper 0", "paper 2", "river and house"]
    monkeypatch.setattr(files, "MOST_PATHS", 1)
    names = lambda df: {r["path"].rpartition("/")[2] for r in df.select("path").collect()}
    assert names(files.changed(spark, str(tmp_path / "in"), a.read("documents").where("name = 'n0.txt'"))) == {"n1.txt", "n2.txt", "n3.txt"}
    assert {r["status"]: r["n"] for r in a.ingest(str(tmp_path / "in"), force=True).collect()} == {"new": 4}


def test_pages_and_their_words_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sheet.xlsx").write_bytes(renamed(zipped(
        xl__workbook_xml='<workbook><sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>',
        xl__worksheets__sheet1_xml='<worksheet><row><c><v>12</v></c></row></worksheet>', xl__worksheets__sheet2_xml='<worksheet><row><c><v>river 34</v></c></row></worksheet>',
    ), "none", "none"))
    a = Archive(spark, str(tmp_path / "archive"), buckets=2)
    a.ingest(str(tmp_path / "in"))
    one = a.read("documents").first()["doc_id"]
    assert [(r["page"], r["text"]) for r in a.pages(one).collect()] == [(1, "Sheet: One\n12"), (2, "Sheet: Two\nriver 34")]
    assert [(r["page"], r["chunk_index"], r["chunk_id"]) for r in a.chunks(one).collect()] == [(1, 0, f"{one}:1:0"), (2, 0, f"{one}:2:0")]
    assert [(r["page"], r["position"], r["t"], r["x0"]) for r in a.highlight(one, "river").collect()] == [(2, 2, "river", None)]
    assert a.ask("river")[1].first()["page"] == 2
    # another engine, that knows where its words are
    a.reocr(one, lambda b: [("green river", [{"t": "green", "x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": 0.4}, {"t": "river", "x0": 0.5, "y0": 0.2, "x1": 0.7, "y1": 0.4}])])
    assert [tuple(r)[1:] for r in a.highlight(one, "river").collect()] == [(1, 1, "river", 0.5, 0.2, 0.7, 0.4)]
    assert a.pages(one).count() == a.chunks(one).count() == 1 and a.index.corpus()[0] == 1
    a.delete([one])
    assert a.read("pages").count() == 0


def test_uploads_of_known_and_of_unsupported_files(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "archive"), buckets=2)
    assert {r["status"]: r["n"] for r in a.upload("a.txt", b"Same words").collect()} == {"new": 1}
    assert {r["status"]: r["n"] for r in a.upload("b.txt", b"Same words").collect()} == {"new": 1}
    assert {r["status"]: r["n"] for r in a.upload("c.exe", b"MZ").collect()} == {"skipped": 1} and a.read("documents").count() == 2
    assert not list((tmp_path / "archive" / "files").glob("*.exe")) and {r["status"] for r in a.read("documents").collect()} == {"indexed"}


def test_flat_scan_reads_one_folder(spark, tmp_path):
    fill(tmp_path / "sub")
    names = {r["path"].rpartition("/")[2] for r in files.scan(spark, str(tmp_path / "sub"), recursive=False).select("path").collect()}
    assert names == {"lease.docx", "sheet.xlsx", "broken.docx", "scan.png"}


def fill(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / "lease.docx").write_bytes(DOCX)
    (folder / "sheet.xlsx").write_bytes(XLSX)
    (folder / "sub" / "invoice_1.txt").write_text("Firm A\nInvoice no: 17\nTotal: AED 120.50\n")
    (folder / "sub" / "copy.txt").write_text("Firm A\nInvoice no: 17\nTotal: AED 120.50\n")
    (folder / "broken.docx").write_bytes(b"no zip")
    (folder / "scan.png").write_bytes(b"\x89PNG")
    (folder / "skip.exe").write_bytes(b"x")


def test_archive(spark, tmp_path):
    fill(tmp_path / "in")
    a = Archive(spark, str(tmp_path / "archive"))
    assert {r["status"]: r["n"] for r in a.ingest(str(tmp_path / "in")).collect()} == {"new": 5, "duplicate": 1}
    docs = {r["name"]: r for r in a.read("documents").collect()}
    assert docs["lease.docx"]["doc_type"] == "contract" and docs["scan.png"]["status"] == "needs_ocr" and docs["broken.docx"]["engine"].startswith("word:error")
    assert {r["status"]: r["n"] for r in a.ingest(str(tmp_path / "in")).collect()}["unchanged"] == 5
    assert a.search("invoice total").first()["title"] in ("Invoice 1", "Copy")
    answer, sources = a.ask("lease rent amount")
    assert "Lease" in answer and sources.first()["source"] == 1
    assert a.status().first()["documents"] == 5 and a.documents(limit=2).count() == 2 and a.export().count() == 5
    assert a.filing_plan().where("doc_type = 'contract'").first()["target"].startswith("Contracts/")
    lease = docs["lease.docx"]["doc_id"]
    a.correct_text(lease, "Passport of the bearer")
    assert a.read("documents").where(F.col("doc_id") == lease).first()["doc_type"] == "id"
    a.reclassify()
    assert a.highlight(lease, "bearer").first()["t"] == "bearer"
    assert a.file(str(tmp_path / "filed")) == [("copied", 5)] and a.file(str(tmp_path / "filed")) == [("already-exists", 5)]
    a.add_eval_case("invoice total", "120.50", "Invoice")
    a.add_eval_case("invoice total", "no such answer")
    results, score = a.evaluate()
    assert tuple(score.first()) in {(2, 1, 0.5), (2, 0, 0.0)} and results.count() == 2
    a.delete([lease])
    assert a.read("documents").count() == 4 and a.read("chunks").where(F.col("document_id") == lease).count() == 0
    assert a.search("").count() == 4


def test_watch(spark, tmp_path):
    fill(tmp_path / "in")
    seen = []
    run = lambda: watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), seconds=None, index=lambda df: seen.append(df.count())).awaitTermination()
    run()
    (tmp_path / "in" / "late.txt").write_text("Late news article")
    (tmp_path / "in" / "late2.txt").write_text("Firm A\nInvoice no: 17\nTotal: AED 120.50\n")
    run()
    rows = {r["path"].rpartition("/")[2]: r["status"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert rows["late.txt"] == "indexed" and rows["late2.txt"] == "duplicate" and rows["scan.png"] == "needs_ocr"
    assert sorted(v for k, v in rows.items() if k in ("copy.txt", "invoice_1.txt")) == ["duplicate", "indexed"] and seen == [6, 2]


def test_backfill(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) chunk_id", "concat('text ', id) text").write.parquet(str(tmp_path / "chunks"))
    watch.backfill(spark, str(tmp_path / "chunks"), str(tmp_path / "out"), str(tmp_path / "c"), lambda df: df.withColumn("n", F.length("text"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_folder_settings(spark, tmp_path):
    fill(tmp_path / "in")
    a = Archive(spark, str(tmp_path / "archive"))
    a.add_folder(str(tmp_path / "in"), default_type="news")
    a.add_folder(str(tmp_path / "in" / "sub"), watch=True, default_type="legal")
    a.add_folder(str(tmp_path / "in" / "sub"), default_type="medical")
    a.add_folder("/gone")
    a.remove_folder("/gone")
    assert {r["path"].rpartition("/")[2]: (r["watch"], r["default_type"]) for r in a.folders().collect()} == {"in": (False, "news"), "sub": (False, "medical")}
    a.ingest(str(tmp_path / "in"))
    kinds = {r["name"]: r["doc_type"] for r in a.read("documents").collect()}
    assert kinds["lease.docx"] == "news" and "medical" in (kinds.get("invoice_1.txt"), kinds.get("copy.txt"))


def test_moving_and_pruning(spark, tmp_path):
    from papyra.operators import apply

    (tmp_path / "in" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "er" / "x.txt").write_text("x")
    rows = [(f"file:{tmp_path}/in/deep/er/x.txt", "a/x.txt", "copy"), (f"{tmp_path}/none", "a/y.txt", "copy"), (f"{tmp_path}/out/a/z", "a/z", "copy"), (f"{tmp_path}/out/b", "c", "copy")]
    plan = spark.createDataFrame(rows, "path string, target string, action string")
    done = [s for _, s, _ in apply.carried_out(spark, plan, f"{tmp_path}/out", "move")]
    assert done[0] == "moved" and done[1].startswith("error") and done[2] == "already-filed"
    assert [s for _, s, _ in apply.carried_out(spark, plan, f"{tmp_path}/out", "auto")][3] == "inside-archive"
    assert apply.Files(spark, str(tmp_path)).prune(f"{tmp_path}/in") == 2


def test_watched_folders_and_their_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "in" / "a.txt").write_text("river paper")
    (tmp_path / "other" / "b.txt").write_text("not watched")
    a = Archive(spark, str(tmp_path / "archive"), buckets=2)
    a.add_folder(str(tmp_path / "in"), watch=True)
    a.add_folder(str(tmp_path / "other"))

    def run():
        streams = a.watch(str(tmp_path / "checkpoint"), seconds=None)
        assert len(streams) == 1
        streams[0].awaitTermination()

    run()
    (tmp_path / "in" / "c.txt").write_text("river paper")
    (tmp_path / "in" / "d.txt").write_text("green house")
    run()
    run()  # nothing has arrived
    assert {r["name"]: r["text"] for r in a.read("documents").collect()} == {"a.txt": "river paper", "d.txt": "green house"}
    done = a.progress().collect()
    assert [(r["state"], r["counts"]) for r in done] == [("finished", {"duplicate": 1, "new": 1}), ("finished", {"new": 1})] and "in#" in done[0]["source"]
    with pytest.raises(ValueError, match="broken"), a._told("somewhere"):
        assert a.progress().first()["state"] == "running"
        raise ValueError("broken")
    last = a.progress().first()
    assert (last["source"], last["state"], last["error"]) == ("somewhere", "failed", "ValueError: broken")
