"""Secret scans: spans in each text, judged by how many repositories and owners share the secret across the corpus.

An owner is the value of a column. So is a repository where there is a column for
it; else it is the host and first two path parts of the first web address in
the text (as of a code host), or the text itself if it names none. So one owner
has many repositories, and copies of a text are one.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import any_names, bounded_batches, char_at, quoted, sized_broadcast, slices, spare, text_bytes, written

#: Fixed kinds in their listed order, then the kind that the corpus decides on.
KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_OPAQUE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
_MARKS = re.compile(rb"[0-9]")
#: What the segments of a path are made of: words in one case, capitalised or in camel case, numbers after them.
_NAME = rb"(?:[A-Z]*|[A-Z]?[a-z]*(?:[A-Z][a-z]{2,})*)[0-9]*"
_PATH = re.compile(rb"(?:" + _NAME + rb"[/_-])*" + _NAME)

#: An opaque token is a candidate from so many bits a character; it becomes a span if one owner alone uses it.
OPAQUE_BITS = 3.5
#: A secret in more repositories, of more owners or used more often than this is a widely copied example.
MOST_OWNERS, MOST_REPOSITORIES, MOST_USES = 1, 5, 1000
#: Secrets whose verdicts are broadcast; beyond, they are shuffled to.
MOST_BROADCAST = 1_000_000
_ADDRESS = re.compile(rb"https?://([A-Za-z0-9.-]+/[A-Za-z0-9_.~-]+/[A-Za-z0-9_.~-]+)")

_CANDIDATE = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("secret", pa.int64())])
_FOUND = "array<struct<kind:string,begin:int,end:int,secret:bigint>>"
_SPANS = "array<struct<begin:int,rank:int,kind:string,end:int,live:boolean>>"


def _bits(token: bytes) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _opaque(token: bytes) -> bool:
    """Digits and letters of both cases, with little repetition; letters alone or a path, whose segments are all names, are not."""
    if not (_MARKS.search(token) and token.lower() != token and token.upper() != token and _bits(token) >= OPAQUE_BITS):
        return False
    return token.count(b"/") < 3 or not _PATH.fullmatch(token)


def byte_spans(text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(kind, begin, end, begin and end of the secret itself) in bytes; ASCII matches only, so byte and text matching agree."""
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield 0, m.start(), m.end(), m.start(2), m.end(2)
    if b"AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield 1, m.start(), m.end(), m.start(), m.end()
    for m in _HEX.finditer(text):
        yield 2, m.start(), m.end(), m.start(), m.end()
    for m in _OPAQUE.finditer(text):
        if _opaque(m[0]):
            yield 3, m.start(), m.end(), m.start(), m.end()


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True)


def repository(text: bytes) -> bytes:
    """What stands for the repository of a text: the web address it names first, or else itself."""
    address = _ADDRESS.search(text)
    return address[1].lower() if address else text


def _find(text_col: str, columns: list[str], made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            data, offsets = text_bytes(batch.column(text_col))
            out, homes = [], []
            for d in range(batch.num_rows):
                text = data[offsets[d] : offsets[d + 1]].tobytes()
                spans = list(byte_spans(text))
                base = [(b, e) for k, b, e, _, _ in spans if k < 3]
                if base and len(spans) > len(base):
                    # base spans of one kind don't overlap, so few of them begin before an end
                    base.sort()
                    starts, reach = [b for b, _ in base], list(itertools.accumulate((e for _, e in base), max))
                    spans = [s for s in spans if s[0] < 3 or not (k := bisect.bisect_left(starts, s[2])) or reach[k - 1] <= s[1]]
                if spans:
                    ends = np.array([[s[1], s[2]] for s in spans])
                    chars = char_at(data, ends.ravel() + offsets[d], int(offsets[d])).reshape(-1, 2)
                    out.append([{"kind": KINDS[k], "begin": b, "end": e, "secret": _hash(text[sb:se])} for (k, _, _, sb, se), (b, e) in zip(spans, chars.tolist(), strict=True)])
                    homes.append(_hash(repository(text)))
                else:
                    out.append([])
                    homes.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.list_(_CANDIDATE)), pa.array(homes, pa.int64())], names=columns + made)

    return run


def candidates(docs: DataFrame, text_col: str, found: str, home: str) -> DataFrame:
    """``docs`` with candidate spans (code points, end exclusive) with a 64-bit hash of the secret itself, and a hash of the repository by the text."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumns({found: F.array().cast(_FOUND), home: F.lit(None).cast("long")})
    return out.mapInArrow(_find(text_col, docs.columns, [found, home]), out.schema)


def ownership(uses: DataFrame) -> DataFrame:
    """secret -> n_uses, n_repositories, n_owners from rows of secret, repository, owner.

    Rows are reduced to distinct (secret, repository, owner) with their counts
    before anything meets by secret, and to (secret, owner) and (secret,
    repository) after, so a secret copied a million times is a
    few rows by then. A null repository or owner counts as one of its own.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = uses.select("secret", named("repository"), named("owner")).groupBy("secret", "repository", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("secret").agg(F.sum("n").alias("n_uses"), F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def judged(docs: DataFrame, text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", keep: tuple[str, ...] = (), spans: str = "_spans") -> DataFrame:
    """The documents' columns in ``keep`` with ``_spans``: array of (begin, rank, kind, end, live), sorted.

    Base spans (assign, access, hex) always stay; an opaque token becomes a
    span only if the corpus shows that it is owner-specific. ``live`` is true
    for a secret that few repositories (``MOST_REPOSITORIES``) of few owners
    (``MOST_OWNERS``) use, not more than ``MOST_USES`` times; false for a widely copied example.

    Null and empty texts have no spans; repeated rows are rows of their own, uses of one repository;
    spans of one begin are in the order of kinds; texts are taken whole, a few MB or one text at a time;
    an empty table gives an empty result.
    """
    row, found, home = spare([*docs.columns, spans], "row", "found", "home")
    columns = list(dict.fromkeys([*keep, owner_col, *([repo_col] if repo_col else [])]))
    rows = candidates(docs.select(*map(quoted, dict.fromkeys([*columns, text_col]))), text_col, found, home)
    rows = written(rows.select(*map(quoted, columns), found, home).withColumn(row, F.monotonically_increasing_id()), "secrets")
    some = rows.where(F.size(found) > 0)
    uses = ownership(some.select(F.explode(F.col(found)["secret"]).alias("secret"), (quoted(repo_col) if repo_col else F.col(home)).alias("repository"), quoted(owner_col).alias("owner")))
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES) & (F.col("n_uses") <= MOST_USES)
    # of a widely copied secret, all uses need one row of this table: it goes to them, unless it is too large
    verdicts = sized_broadcast(written(uses.select("secret", live.alias("live")), "verdicts"), MOST_BROADCAST)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    one = some.select(F.col(row).alias("row"), F.inline(found)).join(verdicts, "secret").where((F.col("kind") != KINDS[3]) | F.col("live"))
    own = one.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("begin", rank.alias("rank"), "kind", "end", "live"))).alias(spans))
    empty = F.array().cast(_SPANS)
    kept = [quoted(c) for c in keep]
    some = some.select(row, *kept).join(own, row, "left").select(*kept, F.coalesce(spans, empty).alias(spans))
    return some.union(rows.where(F.size(found) == 0).select(*kept, empty.alias(spans)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_live and n_example (spans that look owner-specific or widely copied)."""
    out = judged(docs, keep=("doc_id",), **options)
    count = lambda test: F.size(F.filter("_spans", test)).cast("long")
    of = lambda kind: count(lambda s: s["kind"] == kind)
    return out.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.filter("_spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def _redact(text_col: str, columns: list[str], spans: str, live_mark: str, example_mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            out = batch.column(text_col).to_pylist()
            for d, own in enumerate(batch.column(spans).to_pylist()):
                if not own:
                    continue
                at, parts, text = 0, [], out[d]
                for begin, _, end, live in sorted((s["begin"], not s["live"], s["end"], s["live"]) for s in own):
                    if begin >= at:
                        parts += [text[at:begin], live_mark if live else example_mark]
                    at = max(at, end)
                out[d] = "".join([*parts, text[at:]])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in columns], names=columns)

    return run


@any_names
def redact(docs: DataFrame, text_col: str = "text", live_mark: str = "<SECRET>", example_mark: str = "<EXAMPLE>", **options) -> DataFrame:
    """``docs`` with each span replaced by a mark; overlapping spans are replaced as one, with the mark of the first of them (of those that begin there, a live one).

    Documents without spans stay as they are, null texts included; all rows and columns stay.
    """
    [spans] = spare(docs.columns, "spans")
    out = judged(docs, text_col=text_col, keep=tuple(docs.columns), spans=spans, **options)
    return out.mapInArrow(_redact(text_col, docs.columns, spans, live_mark, example_mark), docs.schema)
