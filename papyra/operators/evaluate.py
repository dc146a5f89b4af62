"""Scoring retrieval against expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text


def judged(cases: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, expected_ok, cite_ok, pass) for each case.

    ``cases``: id, expected, must_cite; ``answers``: id, answer; ``sources``: id,
    cited (title and path of one source). A blank expectation is met.
    """
    blank = lambda c: text.text_of(c) == ""
    cited = cases.join(sources, "id").where(F.contains(text.normalized("cited"), text.normalized("must_cite"))).select("id").distinct().withColumn("_cited", F.lit(True))
    out = cases.join(answers, "id", "left").join(cited, "id", "left")
    expected = blank("expected") | F.contains(text.normalized("answer"), text.normalized("expected"))
    out = out.select("id", expected.alias("expected_ok"), (blank("must_cite") | F.coalesce("_cited", F.lit(False))).alias("cite_ok"))
    return out.withColumn("pass", F.col("expected_ok") & F.col("cite_ok"))


def score(results: DataFrame) -> DataFrame:
    """(total, passed, share); the share of no case is null."""
    return results.agg(F.count("*").alias("total"), F.count_if("pass").alias("passed"), F.avg(F.col("pass").cast("int")).alias("share"))
