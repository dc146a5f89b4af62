"""The archive as one object: tables in a folder, and what can be asked of them."""

from __future__ import annotations

import dataclasses
import os
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.functions import extract, text
from papyra.operators import apply, cells, evaluate, filing, index, inverted, many, retrieve, store
from papyra.plans.question import plan
from papyra.sources import files
from papyra.streaming import watch as watching
from papyra.tables import Change, Tables, written

#: The model of the vectors that chunks have of themselves.
HASHED = "local-hash-384"
#: What the tables are dealt into buckets by. Documents and chunks share their buckets.
_KEYS = {"documents": "doc_id", "pages": "doc_id", "chunks": "document_id", "folders": "path", "eval_cases": "id"}


@dataclasses.dataclass(frozen=True)
class Model:
    """An embedding model: its name, how a table (id, text) becomes (id, vector, error), and how one question becomes a vector."""

    name: str
    passages: Callable[[DataFrame], DataFrame]
    question: Callable[[str], list[float]]


class Archive:
    """Documents, their chunks and the inverted index as tables below ``folder`` (see :mod:`papyra.tables`).

    A change of some documents writes the buckets they are in and appends to the
    index; documents, chunks and index become visible together, or not at all.
    ``buckets`` holds for a new archive.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, model: Model | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = Tables(spark, folder, buckets)
        self.index, self.cells = inverted.Inverted(self.tables), cells.Cells(self.tables)
        self.model = model
        self._turn = threading.RLock()

    def _fs(self, path: str):
        return self.tables._fs(path)

    def read(self, table: str) -> DataFrame:
        return self.tables.read(table)

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """New contents of a whole table."""
        with self.tables.change() as change:
            change.replace(table, _KEYS[table], rows)
        return self.read(table)

    def exists(self) -> bool:
        return self.tables.exists("documents")

    def ingest(self, source: str, force: bool = False, file_base: str | None = None) -> DataFrame:
        """Index the files below a folder; returns the number of files by status. With ``file_base``, new documents are filed below it, if they aren't there."""
        old = self.read("documents").select("path") if self.exists() else self.spark.createDataFrame([], "path string")
        # files are listed; those of a known time and length aren't read
        contents = files.scan(self.spark, source) if force or not self.exists() else files.changed(self.spark, source, self.read("documents"))
        with self._told(source):
            status = self._take(contents, force)
            rest = files.listed(self.spark, source).join(status.select("path"), "path", "left_anti").select("path", F.lit("unchanged").alias("status"))
            counts = status.union(rest).groupBy("status").agg(F.count("*").alias("n")).collect()
            self._counts.update({r["status"]: r["n"] for r in counts})
        if file_base:
            self._carry_out(self.filing_plan().join(old, "path", "left_anti"), file_base, "auto")
        return self.spark.createDataFrame([tuple(r) for r in counts], "status string, n long")

    def _take(self, contents: DataFrame, force: bool = False) -> DataFrame:
        """(path, status) of files (path, sha256, mtime, length, content, reader), of which the new ones are read and indexed. Taking the same files again changes nothing."""
        if self.exists():
            known = self.read("documents").select("path", "sha256", "mtime", "status")
        else:
            known = self.spark.createDataFrame([], "path string, sha256 string, mtime double, status string")
        found = written(contents.select("path", "sha256", "mtime", F.col("length").alias("size")), "found")
        status = written(store.new_files(found.drop("size"), known, force).select("path", "status"), "status")
        fresh = contents.join(status.where("status = 'new'").select("path"), "path", "left_semi")
        pages = written(files.pages(fresh).join(found, "path"), "pages")
        if not self.exists() or pages.limit(1).count():
            self._index(pages)
        return status

    @contextmanager
    def _told(self, source: str) -> Iterator[None]:
        """Rows of progress around a scan: running, then finished with its counts or failed with its error. Scans of one archive take turns."""
        with self._turn:
            self._counts: dict[str, int] = {}
            scan = uuid.uuid4().hex
            self._tell(scan, source, "running")
            try:
                yield
            except Exception as error:
                self._tell(scan, source, "failed", f"{type(error).__name__}: {error}"[:500])
                raise
            self._tell(scan, source, "finished")

    def _tell(self, scan: str, source: str, state: str, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(scan, source, state, error, dict(self._counts))], "scan string, source string, state string, error string, counts map<string,long>")
        with self.tables.change() as change:
            change.append("scans", "scan", row.withColumn("told_at", F.current_timestamp()))

    def progress(self) -> DataFrame:
        """(scan, source, state, error, counts, began_at, told_at) of each scan of a folder or batch of a watched one, the latest first."""
        if not self.tables.exists("scans"):
            return self.spark.createDataFrame([], "scan string, source string, state string, error string, counts map<string,long>, began_at timestamp, told_at timestamp")
        rows = self.read("scans").groupBy("scan").agg(F.max_by(F.struct("source", "state", "error", "counts"), F.struct("told_at", (F.col("state") != "running").cast("int"))).alias("r"), F.min("told_at").alias("began_at"), F.max("told_at").alias("told_at"))
        return rows.select("scan", "r.*", "began_at", "told_at").orderBy(F.desc("began_at"), "scan")

    def watch(self, checkpoint: str, seconds: int | None = watching.WATCH_SECONDS) -> list[StreamingQuery]:
        """A stream for each folder of the settings that is watched: what arrives is indexed, batch by batch, into this archive.

        What is known are the archive's documents, so a batch that runs again after a failure changes nothing, and earlier batches aren't read. With ``seconds`` None present files are indexed, then the streams end.
        """
        streams = []
        for r in self.folders().where("watch").orderBy("path").collect():  # a short list of settings

            def take(batch: DataFrame, number: int, source: str = r["path"]) -> None:
                with self._told(f"{source}#{number}"):
                    status = self._take(batch)
                    self._counts.update({x["status"]: x["n"] for x in status.groupBy("status").agg(F.count("*").alias("n")).collect()})

            name = "".join(c if c.isalnum() else "_" for c in r["path"]).strip("_")
            out = watching.arriving(self.spark, r["path"]).writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
            streams.append((out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start())
        return streams

    def upload(self, name: str, content: bytes) -> DataFrame:
        """Store a file under a safe name in the archive's own folder and index it, also if its content is known; a file of an unsupported kind isn't stored, and counts as skipped."""
        if files.suffix_of(name) not in files.SUFFIXES:
            return self.spark.createDataFrame([("skipped", 1)], "status string, n long")
        path = f"{self.folder}/files/{datetime.now():%Y%m%d_%H%M%S_%f}_{files.safe_name(name)}"
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(content))
        out.close()
        return self.ingest(path, force=True)

    def reocr(self, doc_id: int, reader: Callable[[bytes], list]) -> None:
        """Read one document's file again with another reader or engine (see :func:`papyra.sources.files.pages`) and index what it gives."""
        row = self.document(doc_id).select("path").first()
        if row:
            found = files.scan(self.spark, row["path"])
            self._index(files.pages(found, dict.fromkeys(set(files.SUFFIXES.values()), reader)).join(found.select("path", "sha256", "mtime", F.col("length").alias("size")), "path"))

    def _index(self, pages: DataFrame) -> None:
        """Documents of pages (path, page, text, engine, words, sha256, mtime, size)."""
        texts = files.whole_texts(pages).join(pages.groupBy("path").agg(*(F.first(c).alias(c) for c in ("sha256", "mtime", "size"))), "path")
        new = pages.select(F.xxhash64("path").alias("doc_id"), "page", "text", "engine", "words")
        defaults = store.folder_defaults(texts.withColumn("_at", F.regexp_replace("path", "^file:/*", "/")), self.folders(), "_at").drop("_at")
        named = defaults.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("doc_id", F.xxhash64("path"))
        # a folder may say what it holds; what is said of the text itself stays
        rows = extract.with_metadata(named).withColumn("doc_type", F.coalesce("default_type", "doc_type")).drop("default_type").withColumns({
            "ocr_quality": text.quality("text")["label"], "status": F.when(F.trim("text") == "", "needs_ocr").otherwise("indexed"),
            "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(),
            "norm": text.normalized(F.concat_ws(" ", "text", "title", F.array_join("tags", " "), F.to_json("fields"))),
        })
        with self.tables.change() as change:
            if not self.exists():
                self._chunked(change, change.replace("documents", "doc_id", rows), change.replace("pages", "doc_id", new))
                return
            ids = texts.select(F.xxhash64("path").alias("doc_id")).distinct()
            touched = self.tables.buckets_of("documents", ids)
            old = self.tables.read("documents", touched)
            docs = change.replace("documents", "doc_id", store.upserted(old, rows.select(*old.columns)), touched)
            other = store.deleted(self.tables.read("pages", touched), ids, "doc_id")
            self._chunked(change, docs, change.replace("pages", "doc_id", other.unionByName(new), touched), ids)

    def _chunked(self, change: Change, docs: DataFrame, pages: DataFrame, ids: DataFrame | None = None) -> None:
        """Chunks, words and vectors of the documents of the given ids anew, page by page, or of all; the inverted index follows."""
        own = docs.where("status = 'indexed'").select("doc_id", "title", "doc_type", "updated_at")
        own = own if ids is None else own.join(ids, "doc_id", "left_semi")
        whole = pages.select("doc_id", "page", "text").join(own, "doc_id")
        made = retrieve.chunked(self.tables.dealt("chunks", whole, "doc_id") if ids is None else whole, page_col="page")
        if ids is None:
            for name in [n for n in ("postings", "terms", "corpus") if n in change.state["tables"]]:
                change.state["tables"][name]["files"] = {}
            inverted.add(change, change.replace("chunks", "document_id", made, dealt=True))
            return
        touched = self.tables.buckets_of("chunks", ids)
        old = self.tables.read("chunks", touched)
        now = change.replace("chunks", "document_id", store.deleted(old, ids).unionByName(made.select(*old.columns)), touched)
        mine = lambda rows: rows.join(ids.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
        inverted.add(change, mine(now), mine(old))

    def reindex(self, ids: DataFrame | list[int]) -> DataFrame:
        """Chunks, words and vectors of the given documents anew; those of others are kept as they are."""
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in sorted({*ids})], "doc_id long")
        with self.tables.change() as change:
            touched = self.tables.buckets_of("documents", ids)
            self._chunked(change, self.tables.read("documents", touched), self.tables.read("pages", touched), ids)
        return self.read("chunks")

    def rebuild(self) -> DataFrame:
        """Chunks of all documents anew, from stored texts, and the index with them."""
        with self.tables.change() as change:
            self._chunked(change, self.read("documents"), self.read("pages"))
        return self.read("chunks")

    def _live(self) -> DataFrame:
        """(chunk_id, content, text) of the chunks as they are; the content is what is embedded."""
        body = F.concat_ws("\n", F.col("title"), F.col("text"))
        return self.read("chunks").select("chunk_id", F.xxhash64(body).alias("content"), body.alias("text"))

    def active_model(self) -> str:
        """The model that questions are compared by: the archive's own once it has vectors, else the hashed one."""
        return self.model.name if self.model and self.model.name in self.cells.models() else HASHED

    def embed(self, cells: int | None = None) -> int:
        """Embed the chunks that have no vector of the archive's model for their present text; returns how many. The first call fits the model's cells."""
        if not self.model:
            raise ValueError("the archive has no model")
        todo = self.cells.missing(self.model.name, self._live())
        made = self.model.passages(todo.select(F.col("chunk_id").alias("id"), "text"))
        made = written(made.select("id", "vector", "error").join(todo.select(F.col("chunk_id").alias("id"), "content"), "id"), "embedded")
        n = made.count()
        with self.tables.change() as change:
            own = None if self.model.name in self.cells.models() else self.cells.fit(change, self.model.name, made, cells)
            if n:
                self.cells.add(change, self.model.name, made, own)
        return n

    def prune_vectors(self) -> None:
        """Drop vectors of chunks that have gone or changed."""
        with self.tables.change() as change:
            self.cells.pruned(change, self._live())

    def _near(self, question: str, exact: bool) -> DataFrame | None:
        if self.active_model() == HASHED:
            return None
        return self.cells.hits(self.model.name, self.model.question(question), self._live(), None if exact else cells.PROBES)

    def compact(self) -> None:
        """Put what many changes have appended to the index into one file set for each bucket."""
        self.index.compact()

    def reclassify(self) -> DataFrame:
        """Metadata of all documents anew, from stored texts."""
        old = self.read("documents")
        kept = [c for c in old.columns if c not in ("doc_type", "language", "legal_title", "date_guess", "amount", "company", "title", "tags", "summary", "fields")]
        return self.write("documents", extract.with_metadata(old.select(*kept)).select(*old.columns))

    def correct_text(self, doc_id: int, body: str) -> None:
        """Replace one document's text and index it again."""
        old = self.document(doc_id)
        self._index(old.select("path", "sha256", "mtime", "size").withColumns({"page": F.lit(1), "text": F.lit(body), "engine": F.lit("manual-correction"), "words": F.lit(None).cast(files.BOXES)}))

    def delete(self, ids: list[int] | None = None, everything: bool = False, remove_files: bool = False) -> int:
        """Documents (or all) and all that was made of them go. Files stay, unless asked for: then those below the archive's own folder go too, and no others. Returns the files removed."""
        if everything:
            gone = self.read("documents").select(F.col("doc_id").alias("id"))
        else:
            gone = self.spark.createDataFrame([(i,) for i in sorted({*(ids or [])})], "id long")
        touched, removed = self.tables.buckets_of("documents", gone), 0
        old, chunks = self.tables.read("documents", touched), self.tables.read("chunks", touched)
        paths = old.join(gone, old["doc_id"] == gone["id"], "left_semi").select("path")
        lost = chunks.join(gone, chunks["document_id"] == gone["id"], "left_semi")
        with self.tables.change() as change:
            change.replace("documents", "doc_id", store.deleted(old, gone, "doc_id"), touched)
            change.replace("pages", "doc_id", store.deleted(self.tables.read("pages", touched), gone, "doc_id"), touched)
            change.replace("chunks", "document_id", store.deleted(chunks, gone), touched)
            inverted.add(change, lost.limit(0), lost)
        for r in paths.toLocalIterator() if remove_files else ():
            if self.owns(r["path"]):
                fs, p = self._fs(r["path"])
                removed += fs.delete(p, False)
        return removed

    def owns(self, path: str) -> bool:
        """Whether a file lies below the archive's own folder of files."""
        plain = lambda x: "/" + os.path.normpath(x.partition(":")[2] if ":" in x else x).lstrip("/")
        return plain(path).startswith(plain(self.folder + "/files") + "/")

    def document(self, doc_id: int) -> DataFrame:
        """One document with its text, or no row."""
        return self.tables.read("documents", self.tables.buckets_of("documents", [doc_id])).where(F.col("doc_id") == doc_id)

    def pages(self, doc_id: int) -> DataFrame:
        """(page, text, engine, words) of one document, in order."""
        rows = self.tables.read("pages", self.tables.buckets_of("pages", [doc_id])).where(F.col("doc_id") == doc_id)
        return rows.drop("doc_id").orderBy("page")

    def chunks(self, doc_id: int) -> DataFrame:
        """The chunks of one document, by page and place."""
        return self.tables.read("chunks", self.tables.buckets_of("chunks", [doc_id])).where(F.col("document_id") == doc_id).orderBy("page", "chunk_index")

    def documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return store.browse(self.read("documents"), "updated_at", limit=limit, offset=offset)

    def status(self) -> DataFrame:
        chunks = self.read("chunks")
        return store.status_counts(self.read("documents"), folders=self.folders(), chunks=chunks, embeddings=chunks.where("vec is not null and size(vec) > 0"), fts_rows=index.with_words(chunks).where("size(words) > 0"))

    def export(self) -> DataFrame:
        """All documents, the latest change first."""
        return store.exported(self.read("documents").orderBy(F.desc("updated_at"), "doc_id"))

    def search(self, question: str, doc_type: str | None = None, language: str | None = None, limit: int = 20, exact: bool = False) -> DataFrame:
        """The best documents. ``exact``: all vectors of the active model are compared, not those of the nearest cells."""
        docs = self.read("documents")
        if not question.strip():
            return store.browse(docs, "updated_at", doc_type, language, limit)
        return retrieve.search(self.read("chunks"), docs.withColumnRenamed("doc_id", "document_id"), question, limit, doc_type, language, self.index, self._near(question, exact))

    def ask(self, question: str, limit: int = 8) -> tuple[str, DataFrame]:
        """(an answer made of the best excerpts, its sources)."""
        found = retrieve.hybrid(self.read("chunks"), question, max(1, min(limit, 12)), stored=self.index, near=self._near(question, False))
        return retrieve.extractive_answer(found, question).first()["answer"], retrieve.sources(found)

    def plan(self, question: str):
        return plan(question)

    def filing_plan(self) -> DataFrame:
        return filing.without_collisions(filing.planned(self.read("documents")))

    def file(self, base: str, mode: str = "copy", doc_id: int | None = None) -> list[tuple[str, int]]:
        """Carry out the filing plan below ``base``, of all documents or one; (status, number of files)."""
        found = self.filing_plan()
        return self._carry_out(found if doc_id is None else found.where(F.col("doc_id") == doc_id), base, mode)

    def organize(self, base: str) -> list[tuple[str, int]]:
        """Move all documents to where the plan wants them, then remove folders that are empty."""
        done = self.file(base, "move")
        apply.Files(self.spark, base).prune(base)
        return done

    def company_count(self, company: str) -> int:
        """Documents of a company, as the plan's threshold counts them."""
        return filing.company_counts(self.read("documents").where(F.col("company") == company)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _carry_out(self, found: DataFrame, base: str, mode: str) -> list[tuple[str, int]]:
        return sorted(Counter(status.partition(":")[0] for _, status, _ in apply.carried_out(self.spark, found, base, mode)).items())

    def highlight(self, document_id: int, question: str) -> DataFrame:
        """(document_id, page, position, t, x0, y0, x1, y1): the words of a document that a question's terms mark, with their boxes where its engine had them."""
        plain = F.from_json(F.to_json(F.transform(F.split("text", r"\s+"), lambda t: F.struct(t.alias("t")))), files.BOXES)
        rows = self.pages(document_id).select(F.lit(document_id).alias("document_id"), "page", F.posexplode(F.coalesce("words", plain)).alias("position", "w"))
        return retrieve.highlighted(rows.select("document_id", "page", "position", "w.*"), question)

    def _settings(self, table: str, schema: str) -> DataFrame:
        return self.read(table) if self.tables.exists(table) else self.spark.createDataFrame([], schema)

    def folders(self) -> DataFrame:
        """Watched folders: path, recursive, watch, default_type."""
        return self._settings("folders", "path string, recursive boolean, watch boolean, default_type string, created_at timestamp")

    def add_folder(self, path: str, recursive: bool = True, watch: bool = False, default_type: str | None = None) -> None:
        """Add a folder, or change the settings of a known one."""
        old = self.folders()
        new = self.spark.createDataFrame([(path, recursive, watch, default_type)], "path string, recursive boolean, watch boolean, default_type string").withColumn("created_at", F.current_timestamp())
        first = old.select("path", F.col("created_at").alias("_first"))
        new = new.join(first, "path", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
        self.write("folders", old.join(new.select("path"), "path", "left_anti").unionByName(new))

    def remove_folder(self, path: str) -> None:
        self.write("folders", self.folders().where(F.col("path") != path))

    def eval_cases(self) -> DataFrame:
        return self._settings("eval_cases", "id long, question string, expected string, must_cite string")

    def add_eval_case(self, question: str, expected: str = "", must_cite: str = "") -> None:
        number = (self.eval_cases().agg(F.max("id")).first()[0] or 0) + 1
        self.write("eval_cases", self.eval_cases().unionByName(self.spark.createDataFrame([(number, question, expected, must_cite)], "id long, question string, expected string, must_cite string")))

    def remove_eval_case(self, number: int) -> None:
        self.write("eval_cases", self.eval_cases().where(F.col("id") != number))

    def evaluate(self) -> tuple[DataFrame, DataFrame]:
        """(each case judged, the score): all cases are answered at once."""
        results = many.evaluated(self.eval_cases(), self.read("chunks"), self.index)
        return results, evaluate.score(results)
