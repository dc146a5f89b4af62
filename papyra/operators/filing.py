"""Where each document would be filed: category, subcategory, company folder, name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import extract, rules, text


def _mapped(kind: Column, table: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def category(kind: Column) -> Column:
    return _mapped(F.coalesce(kind, F.lit("general")), rules.CATEGORIES, "Other")


def company_name(c: Column | str) -> Column:
    """The company as a file name of 40 characters at most; empty without a company."""
    x = F.trim(text.text_of(c))
    return F.when(x == "", "").otherwise(F.substring(text.file_name(x), 1, 40))


def subcategory(kind: Column, head: Column, body: Column, ym: Column) -> Column:
    """Bills by provider, laws by kind of instrument (normalised title first, then body), all else by year."""
    law = text.first_rule(head, rules.LEGAL_SUBTYPES, F.when(text.has_any(head, rules.LAW_TITLE), "Laws").otherwise(text.first_rule(body, rules.LEGAL_SUBTYPES, F.lit("Other Legal"))))
    return F.when(kind.isin("invoice", "receipt"), text.first_rule(body, rules.PROVIDERS, F.lit("General"))).when(kind == "legal", law).otherwise(F.substring(ym, 1, 4))


def company_counts(docs: DataFrame) -> DataFrame:
    """(company_name, n) over business documents that name a company."""
    own = docs.where(F.col("doc_type").isin(*rules.BUSINESS)).select(company_name("company").alias("company_name"))
    return own.where("company_name <> ''").groupBy("company_name").agg(F.count("*").alias("n"))


def planned(docs: DataFrame, pattern: str | None = None, suffix: Column | None = None) -> DataFrame:
    """``docs`` with category, subcategory, file, folder and relative path.

    ``docs`` has doc_type, title, company, summary, norm, date_guess, mtime and
    name. Counts of companies are joined by name: a row for each company,
    pre-aggregated. ``pattern`` may use {type}, {company}, {date}, {year}, {title}.
    """
    kind = F.coalesce("doc_type", F.lit("general"))
    out = docs.withColumns({"ym": extract.year_month("date_guess", F.col("mtime")), "company_name": company_name("company"), "kind": kind})
    out = out.join(company_counts(docs).withColumnRenamed("n", "company_n"), "company_name", "left")
    body = F.concat_ws(" ", text.text_of("company"), text.text_of("title"), text.text_of("summary"), F.substring(text.text_of("norm"), 1, 2000))
    out = out.withColumns({"_head": text.normalized("title"), "_body": text.normalized(body)})
    out = out.withColumns({"category": category(F.col("kind")), "subcategory": subcategory(F.col("kind"), F.col("_head"), F.col("_body"), F.col("ym"))})
    parts = {
        "{type}": _mapped(F.col("kind"), rules.TYPE_CODES, "doc"), "{company}": F.coalesce(F.nullif("company_name", F.lit("")), F.lit("unknown")),
        "{date}": F.col("ym"), "{year}": F.substring("ym", 1, 4), "{title}": F.substring(text.file_name("title"), 1, 60),
    }

    def stem(p: str) -> Column:
        x = F.lit(p)
        for k, v in parts.items():
            x = F.replace(x, F.lit(k), v)
        return F.substring(text.file_name(x), 1, 140)

    named = stem(pattern) if pattern else F.when(F.col("kind") == "legal", stem("{type}_{title}_{year}")).otherwise(stem("{type}_{company}_{date}"))
    ext = suffix if suffix is not None else F.regexp_extract(F.lower("name"), r"\.[^.]+$", 0)
    firm = F.when(F.col("kind").isin(*rules.BUSINESS) & (F.col("company_n") >= rules.COMPANY_FOLDER_FROM), F.substring("company_name", 1, 30))
    folder = F.when(F.col("kind") == "legal", F.concat_ws("/", "category", "subcategory", F.substring("ym", 1, 4))).otherwise(F.concat_ws("/", "category", "subcategory", F.nullif(firm, F.lit(""))))
    out = out.withColumns({"file": F.concat(named, ext), "folder": folder})
    return out.withColumn("relative", F.concat_ws("/", "folder", "file")).drop("kind", "company_n", "_head", "_body")


def without_collisions(plan: DataFrame, key: str = "doc_id", content: str = "sha256") -> DataFrame:
    """``plan`` with ``target`` and ``action``: of documents with one path the first keeps it, copies of its content are skipped, others get -2, -3 and so on before the suffix.

    Numbers come from sorting (path, content) pairs by their first document,
    one row for each content, not each document.
    """
    first = plan.groupBy("relative", content).agg(F.min(key).alias("_first"))
    order = Window.partitionBy("relative").orderBy("_first")
    numbered = first.withColumn("_n", F.row_number().over(order))
    out = plan.join(numbered, ["relative", content])
    cut = F.regexp_extract("relative", r"^(.*?)(\.[^./]*)?$", 1)
    end = F.regexp_extract("relative", r"^(.*?)(\.[^./]*)?$", 2)
    target = F.when(F.col("_n") == 1, F.col("relative")).otherwise(F.concat(cut, F.lit("-"), F.col("_n").cast("string"), end))
    return out.withColumns({"target": target, "action": F.when(F.col(key) == F.col("_first"), "copy").otherwise("already-exists")}).drop("_n", "_first")


def tree(plan: DataFrame) -> DataFrame:
    """(folder, n): documents of each folder."""
    return plan.groupBy("folder").agg(F.count("*").alias("n"))
