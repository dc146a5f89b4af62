"""Keeping the archive's tables: upserts, deletes, duplicates, defaults of folders, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text


def upserted(old: DataFrame, new: DataFrame, key: str = "path", version: str = "updated_at", created: str = "created_at") -> DataFrame:
    """``old`` with the rows of ``new``, by key: the latest version stays, with the earliest creation time.

    Tables are Parquet snapshots, which can't be changed in place; the result is
    written as the next snapshot. The newest row is an aggregate (max_by), so
    many versions of one key combine before they meet.
    """
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c not in (key, created)]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("_r"), F.min(created).alias(created))
    return latest.select(key, created, "_r.*").select(*old.columns)


def deleted(table: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """``table`` without the rows of the given ids."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def deduplicated(docs: DataFrame, key: str = "doc_id", content: str = "sha256") -> DataFrame:
    """(key, content, status, original): the first of each content is indexed, the others are its duplicates."""
    first = docs.groupBy(content).agg(F.min(key).alias("original"))
    return docs.select(key, content).join(first, content).select(key, content, F.when(F.col(key) == F.col("original"), "indexed").otherwise("duplicate").alias("status"), "original")


def new_files(scan: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """``scan`` (path, sha256, mtime) with ``status``: unchanged, duplicate of another indexed path, or new.

    ``known`` has path, sha256, mtime and status. Duplicates are only looked for
    among paths that aren't known, and not if ``force`` is set; of equal new
    files the first path stays.
    """
    if force:
        return scan.withColumn("status", F.lit("new"))
    mine = known.select("path", F.col("sha256").alias("_sha"), F.col("mtime").alias("_mtime"))
    others = known.where("status = 'indexed'").groupBy("sha256").agg(F.min("path").alias("_other"))
    fresh = scan.join(known.select("path"), "path", "left_anti").groupBy("sha256").agg(F.min("path").alias("_first"))
    out = scan.join(mine, "path", "left").join(others, "sha256", "left").join(fresh, "sha256", "left")
    same = (F.col("_sha") == F.col("sha256")) & (F.abs(F.col("_mtime") - F.col("mtime")) < 0.001)
    twin = F.col("_sha").isNull() & (F.col("_other").isNotNull() | (F.col("_first") < F.col("path")))
    return out.withColumn("status", F.when(same, "unchanged").when(twin, "duplicate").otherwise("new")).select(*scan.columns, "status")


def folder_defaults(docs: DataFrame, folders: DataFrame, path: str = "path", most_folders: int = 1000) -> DataFrame:
    """``docs`` with ``default_type`` of the longest folder that the path begins with, whatever the case.

    Folders are a table of settings. Up to ``most_folders`` they become a literal
    list, longest first, and nothing is shuffled. Beyond that, distinct paths
    are joined to folders by their own prefixes of a folder's length, an
    equi-join.
    """
    own = folders.where("default_type is not null and default_type <> ''").groupBy(F.lower("path").alias("folder")).agg(F.min("default_type").alias("default_type"))
    some = own.limit(most_folders + 1).collect()
    low = F.lower(F.col(path))
    if len(some) <= most_folders:
        known = sorted(some, key=lambda r: (-len(r["folder"]), r["folder"]))
        if not known:
            return docs.withColumn("default_type", F.lit(None).cast("string"))
        table = F.array(*(F.struct(F.lit(r["folder"]).alias("folder"), F.lit(r["default_type"]).alias("default_type")) for r in known))
        return docs.withColumn("default_type", F.try_element_at(F.filter(table, lambda x: F.startswith(low, x["folder"])), F.lit(1))["default_type"])
    lengths = F.array(*(F.lit(r[0]) for r in own.select(F.length("folder")).distinct().orderBy(F.length("folder")).collect()))
    each = docs.select(low.alias("_path")).distinct()
    each = each.withColumn("folder", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))))
    best = each.join(own, "folder").groupBy("_path").agg(F.max_by("default_type", F.length("folder")).alias("default_type"))
    return docs.withColumn("_path", low).join(best, "_path", "left").drop("_path")


def status_counts(docs: DataFrame, **others: DataFrame) -> DataFrame:
    """One row, in one pass: all documents, by status, by quality, and the rows of each further table under its name (folders, chunks, ...)."""
    rows = docs.select(F.lit("documents").alias("of"), "status", F.coalesce("ocr_quality", F.lit("unknown")).alias("quality"))
    for name, table in others.items():
        rows = rows.unionByName(table.select(F.lit(name).alias("of"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("quality")))
    count = lambda test: F.count_if(test)
    return rows.agg(
        *(count(F.col("of") == n).alias(n) for n in ("documents", *others)),
        count(F.col("status") == "indexed").alias("indexed"),
        count(F.col("status") != "indexed").alias("needs_review"),
        count(F.col("status") == "needs_ocr").alias("needs_ocr"),
        count(F.col("status") == "duplicate").alias("duplicates"),
        *(count(F.col("quality") == q).alias(f"quality_{q}") for q in ("good", "medium", "poor", "empty", "unknown")),
    )


def quality_histogram(docs: DataFrame, label: str = "ocr_quality") -> DataFrame:
    return docs.groupBy(F.coalesce(label, F.lit("unknown")).alias("quality")).agg(F.count("*").alias("n"))


def browse(docs: DataFrame, order: str, doc_type: str | None = None, language: str | None = None, limit: int = 20, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """Newest first, with optional type and part of the language (any case)."""
    out = docs
    if doc_type:
        out = out.where(F.col("doc_type") == doc_type)
    if language:
        out = out.where(F.contains(F.lower("language"), F.lit(language.lower())))
    return out.orderBy(F.desc(order), key).offset(offset).limit(max(1, min(limit, 100)))


def exported(docs: DataFrame) -> DataFrame:
    """The flat table of an export, in its order of columns: fields in columns of their own, the summary cut to 500 characters."""
    names = ["total", "currency", "invoice_number", "vat_number", "iban", "due_or_expiry_date"]
    return docs.select("doc_id", "title", "doc_type", "language", "date_guess", "company", "amount", *(F.col(f"fields.{n}").alias(n) for n in names), "status", "ocr_quality", "path", F.substring("summary", 1, 500).alias("summary"))


def parsed(c: Column | str, schema: str, otherwise: Column | None = None) -> Column:
    """JSON text as a struct or array; what can't be read gives ``otherwise`` (null)."""
    out = F.from_json(text.text_of(c), schema)
    return out if otherwise is None else F.coalesce(out, otherwise)


