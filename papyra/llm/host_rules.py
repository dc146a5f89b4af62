"""Quality rules judged by host: rule failures are summed by domain, and verdicts on domains come back to their documents.

Each document is measured once: words, symbols, repeated lines, words in
repeated windows. Rules on these measures fail or hold. A host's failure rates
say what to expect of its documents, but a host of three documents says little;
so rates are shrunk towards the mean of all hosts by a beta prior, whose
strength is how much hosts differ beyond chance (moments of an overdispersed
binomial). A host that fails a rule too often loses all its documents; one that
fails often is held to all rules; at the others a document goes for what is
plainly wrong with it.

Everything is column expressions: measures are made within a row, counts of
hosts are combined before they meet, and only verdicts that differ from the usual
one are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import quoted, sized_broadcast, spare, written

#: Words of a window whose repetition counts.
WINDOW = 8
#: Base limits: least words, and most words in repeated windows in a hundred.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Further limits: symbols in a hundred words, repeated lines and repeated words in a hundred, characters of a word.
MOST_SYMBOLS, MOST_LINES, MOST_AGAIN, WORD_LENGTH = 10, 30, 20, (3, 10)
#: Shrunk rates from which a host is held to all rules, and from which it is blocked.
STRICT, BLOCKED = 0.3, 0.6
#: Rules, in the order of their columns, and the points of a document that fails them.
POINTS = {"short": 2, "repetitive": 2, "symbols": 2, "lines": 1, "lengths": 1}
#: Rules that can block a host: a short document says nothing of the others.
BLOCKING = ("repetitive", "symbols", "lines", "lengths")
#: Points that remove a document of a usual host, and of a strict one.
LIMIT, STRICT_LIMIT = 2, 1
#: Bounds of what hosts' rates are taken to differ (an intraclass correlation).
LEAST_SPREAD, MOST_SPREAD = 1e-6, 1 - 1e-6
#: Hosts with an unusual verdict that are broadcast; more are joined by a shuffle.
MOST_HOSTS = 200_000
_SPACE = "\\x20\\x09-\\x0D"
_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often and in whatever loop ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeated(words: Column) -> Column:
    """Words that are in a window found twice or more; windows are told apart by 64 bits of hash."""

    def covered(at: Column) -> Column:
        # starts in order: each window adds what the one before doesn't cover
        steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x))

    def starts(pairs: Column) -> Column:
        same = lambda k, other: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, other)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(pairs, k)["i"]))

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(pairs, lambda p: _let(starts(p), covered)))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted))


def measures(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words> of a whole text; a null is an empty one."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, f"[{_SPACE}]+"), "")
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    return _let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(body, F.lit(r"[#*$%&|<>]")).alias("s")),
        lambda m: F.struct(*(x.cast("long").alias(name) for name, x in (("n_words", m["w"]["n"]), ("word_chars", m["w"]["chars"]), ("n_symbols", m["s"]), ("n_lines", m["l"]["n"]), ("n_dup_lines", m["l"]["again"]), ("n_repeat_words", m["w"]["again"])))),
    )


def failures(m: Column) -> dict[str, Column]:
    """Whether a document of these measures fails each rule of ``POINTS``."""
    low, high = WORD_LENGTH
    return {
        "short": m["n_words"] < LEAST_WORDS,
        "repetitive": m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED,
        "symbols": m["n_symbols"] * 100 > m["n_words"] * MOST_SYMBOLS,
        "lines": (m["n_dup_lines"] * 100 > m["n_lines"] * MOST_LINES) | (m["n_repeat_words"] * 100 > m["n_words"] * MOST_AGAIN),
        "lengths": (m["word_chars"] < m["n_words"] * low) | (m["word_chars"] > m["n_words"] * high),
    }


def host_of(url: Column) -> Column:
    """The host of a web address, in lower case and without ``www.``; null if it has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def prior(n: int, x: int, squares: float, sizes: float, hosts: int) -> tuple[float, float]:
    """(a, b) of the beta prior of a failure rate, by moments.

    ``n`` documents of ``hosts`` hosts, ``x`` failures; ``squares``: sum of a host's failures squared by its documents; ``sizes``: sum of squared documents.
    The spread beyond chance is (S / p(1-p) - (hosts - 1)) / (n - sizes / n - (hosts - 1)) with S the weighted squares about the mean.
    """
    rate = x / n if n else 0.0
    noise, free = rate * (1 - rate), (n - sizes / n if n else 0.0) - (hosts - 1)
    spread = ((squares - n * rate * rate) / noise - (hosts - 1)) / free if noise > 0 and free > 0 else LEAST_SPREAD
    strength = 1 / min(max(spread, LEAST_SPREAD), MOST_SPREAD) - 1
    return rate * strength, (1 - rate) * strength


def hosts(facts: DataFrame) -> DataFrame:
    """(host, documents, rate_<rule> for each rule, verdict) of each host; null is a host of its own.

    ``facts``: host and the boolean columns ``fails_<rule>``. The verdict is usual, strict or blocked.
    """
    counts = written(facts.groupBy("host").agg(F.count("*").alias("documents"), *(F.count_if(f"fails_{r}").alias(r) for r in POINTS)), "host-counts")
    n = F.col("documents")
    one = counts.agg(F.sum(n).alias("n"), F.sum(n.cast("double") * n).alias("sizes"), F.count("*").alias("hosts"), *(f for r in POINTS for f in (F.sum(r).alias(r), F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"{r}_squares")))).first()
    rates = {}
    for r in POINTS:
        a, b = prior(one["n"] or 0, one[r] or 0, one[f"{r}_squares"] or 0.0, one["sizes"] or 0.0, one["hosts"])
        rates[r] = (F.col(r) + F.lit(a)) / (n + F.lit(a) + F.lit(b))
    worst = lambda names: F.greatest(*(F.col(f"rate_{r}") for r in names))
    verdict = F.when(worst(BLOCKING) >= BLOCKED, "blocked").when(worst(POINTS) >= STRICT, "strict").otherwise("usual")
    return counts.select("host", "documents", *(F.round(x, 6).alias(f"rate_{r}") for r, x in rates.items())).withColumn("verdict", verdict)


def judged(facts: DataFrame) -> DataFrame:
    """``facts`` with ``host_verdict``, ``base_failed`` and ``kept``."""
    # most hosts are usual: only the others are joined, and a hot host's documents are never gathered
    odd = written(hosts(facts).where("verdict <> 'usual'").select(F.col("host").alias("_odd"), "verdict"), "host-verdicts")
    out = facts.join(sized_broadcast(odd, MOST_HOSTS), F.col("host").eqNullSafe(F.col("_odd")), "left").drop("_odd")
    points = sum((F.when(F.col(f"fails_{r}"), p).otherwise(0) for r, p in POINTS.items()), F.lit(0))
    verdict = F.coalesce("verdict", F.lit("usual"))
    base = F.col("fails_short") | F.col("fails_repetitive")
    good = F.when(verdict == "blocked", False).when(verdict == "strict", points < STRICT_LIMIT).otherwise(points < LIMIT)
    return out.withColumns({"host_verdict": verdict, "base_failed": base, "kept": ~base & good}).drop("verdict")


def _facts(docs: DataFrame, host: Column, text: str, *columns: Column) -> DataFrame:
    made = docs.select(*columns, host.cast("string").alias("host"), measures(quoted(text)).alias("m"))
    return made.select("*", *(x.alias(f"fails_{r}") for r, x in failures(F.col("m")).items()))


def filtered(docs: DataFrame, host: Column | str = "source", text: str = "text") -> DataFrame:
    """The documents that their rules and their hosts' verdicts keep, with their own columns.

    A document that is repeated is judged each time, alike. Null and empty texts are short and go; a null host is one host. Texts are measured
    once to judge hosts and once to judge themselves, so nothing but counts is stored.
    """
    names = spare(docs.columns, "row")
    facts = _facts(docs, host if isinstance(host, Column) else quoted(host), text, F.struct(*(quoted(c) for c in docs.columns)).alias(names[0]))
    return judged(facts).where("kept").select(f"{names[0]}.*")


def digest(docs: DataFrame, id_col: str = "doc_id", host: Column | str = "source", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_verdict) of each document.

    Null and empty texts have no words and fail; repeated rows get a row each; a null host is a host of its own; an
    empty table gives an empty result; very long texts are measured whole. Further columns of any name are left alone.
    """
    facts = written(_facts(docs, host if isinstance(host, Column) else quoted(host), text, quoted(id_col).alias("doc_id")), "host-facts")
    return judged(facts).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept", "host_verdict")
