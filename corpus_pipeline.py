"""Pipeline from raw documents to a training order.

Each stage reads all that the one before kept, as a table of the columns of
``documents``, and its decisions take effect in what it returns. Further columns
of any name pass through all stages. A stage on an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontam, jaccard, mixing, quality, secret_scan
from papyra.llm.common import drop_written, table, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is judged as an empty one; a null id isn't learned from; repeated rows are judged each, alike; long texts whole.
    Without labels of both classes nothing goes.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by the n-gram Jaccard join at five words and 0.8, the document of the smallest id stays.

    Null, empty and wordless texts and rows of a null id link with nothing and stay; of repeated rows of one id and text one stays.
    """
    return jaccard.one_of_each(docs, words=5, numerator=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover to a twentieth or more go.

    Null and empty texts have no words and stay; repeated rows are judged each, alike; an empty benchmark removes nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark that tells owner-specific from widely copied ones; all documents stay.

    Null texts stay null with their ``n_chars``; else that is the new length. A null source is an owner of its own; repeated rows are uses of one repository.
    """
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources, by exact weights; the training order is (slot, start).

    A null source is a source of its own; null and empty texts count one character; repeated rows are rows of their own, ties of ids go by row.
    """
    return mixing.in_order(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again; what it read goes then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            # nothing reads a stage's input again once its output is there
            if before is not None:
                drop_written(before)
            before = docs
    return docs
