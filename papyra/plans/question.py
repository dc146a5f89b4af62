"""What a question asks for."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import rules, text


@dataclasses.dataclass(frozen=True)
class Plan:
    """Document type to restrict to, field asked for, order, search terms."""

    doc_type: str | None = None
    field: str | None = None
    sort: str | None = None
    terms: list[str] = dataclasses.field(default_factory=list)


def _has(norm: str, keyword: str) -> bool:
    """:func:`papyra.functions.text.has_keyword` of one string on the driver."""
    kw = text.plain(keyword)
    if " " in kw or (kw.isascii() and kw.isalnum()):
        return f" {kw} " in f" {norm} "
    for word in norm.split():
        prefix = next((p for p in rules.STRIPPED_ONCE if word.startswith(p) and len(word) > len(p) + 1), "")
        if word == kw or word in [p + kw for p in rules.KEYWORD_FORMS] or word[len(prefix) :] == kw:
            return True
    return False


def plan(question: str) -> Plan:
    norm = text.plain(question)
    some = lambda words: any(_has(norm, w) for w in words)
    asked = "amount" if some(rules.ASKS_AMOUNT) else "date" if some(rules.ASKS_DATE) else None
    return Plan(next((t for t, words in rules.INTENTS if some(words)), None), asked, "latest" if some(rules.ASKS_LATEST) else None, text.terms_of(question))


def index_terms(terms: list[str]) -> list[str]:
    """The terms that search the inverted index: the first twelve, of two characters or more, as the index splits them."""
    import re
    import unicodedata

    out = []
    for t in terms[:12]:
        if len(t) >= 2:
            base = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
            out += [w for w in re.split(r"[^\w]|_", base) if w]
    return list(dict.fromkeys(out))


def planned(asked: DataFrame, question: str = "question") -> DataFrame:
    """``asked`` with ``plan``: struct<doc_type, field, sort, terms> of each question."""
    norm, nothing = F.col("_norm"), F.lit(None).cast("string")
    plan_of = F.struct(
        text.first_rule(norm, rules.INTENTS, nothing).alias("doc_type"),
        F.when(text.has_any(norm, rules.ASKS_AMOUNT), "amount").when(text.has_any(norm, rules.ASKS_DATE), "date").alias("field"),
        F.when(text.has_any(norm, rules.ASKS_LATEST), "latest").alias("sort"),
        text.query_terms(question).alias("terms"),
    )
    return asked.withColumn("_norm", text.normalized(question)).withColumn("plan", plan_of).drop("_norm")
