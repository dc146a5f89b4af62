"""Structure-aware chunks: blocks of a page are packed up to a token limit, with an overlap of trailing blocks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import rules, text
from papyra.functions.extract import lines

_BREAK = rf"\n\s*\n|(?<=\.)\s+(?=[A-Z{rules.ARABIC}])"
#: White space as Unicode has it, and characters that are counted at once.
_BLANKS, _AT_ONCE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", 1 << 20
_BREAKS = re.compile("\n[ \t-\r]*\n|(?<=\\.)[ \t-\r]+(?=[A-Z\u0600-\u06ff])")
_CHUNKS = "array<struct<text:string,tokens:int>>"


def blocks(c: Column | str) -> Column:
    """Parts between blank lines and sentence ends before a capital; the lines of a text that has no such break."""
    raw = text.stripped(c)
    parts = F.filter(F.transform(F.split(raw, _BREAK), text.stripped), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(lines(raw))


def blocks_of(body: str) -> list[str]:
    """:func:`blocks` of one text."""
    raw = body.strip(text.BLANKS)
    parts = [x for x in (x.strip(text.BLANKS) for x in _BREAKS.split(raw)) if x]
    return parts if len(parts) > 1 else [x for x in (x.strip(text.BLANKS) for x in raw.splitlines()) if x]


def _packed(parts: list[str], sizes: list[int], most: int, overlap: int) -> list[tuple[str, int | None]]:
    """The chunks of one page's blocks and their tokens, which aren't known yet where blocks have been put together or cut."""
    done, open_, size = [], [], 0  # open: (block, tokens)

    def joined():
        return ("\n".join(b for b, _ in open_), open_[0][1] if len(open_) == 1 else None)

    for block, tokens in zip(parts, sizes, strict=True):
        if open_ and size + tokens > most:
            done.append(joined())
            kept = 0
            # trailing blocks while their sum fits; the first that doesn't ends it
            size = 0
            while kept < len(open_) and size + open_[-1 - kept][1] <= overlap:
                size, kept = size + open_[-1 - kept][1], kept + 1
            open_ = open_[len(open_) - kept :]
        if tokens > most:
            words = re.sub(_BLANKS, " ", block).split(" ")
            done += [(" ".join(words[at : at + most]), None) for at in range(0, len(words), max(1, most - overlap))]
            open_, size = [], 0
        else:
            open_.append((block, tokens))
            size += tokens
    return [*done, joined()] if open_ else done


def _tokens(texts: list[str]) -> list[int]:
    """The tokens of each text: of a text that Latin-1 can hold by its bytes, of others about ``_AT_ONCE`` characters at a time."""
    words, others = text.latin_word_counts(texts)
    begin = 0
    while begin < len(others):
        end, size = begin + 1, len(texts[others[begin]])
        while end < len(others) and size + len(texts[others[end]]) <= _AT_ONCE:
            size, end = size + len(texts[others[end]]), end + 1
        words[others[begin:end]] = text.word_counts([texts[k] for k in others[begin:end]])
        begin = end
    return text.tokens_of(words).tolist()


def _folded(texts: list[str], most: int, overlap: int) -> list[list[tuple[str, int | None]]]:
    """:func:`_packed` of the blocks of each text."""
    rows = [blocks_of(t) for t in texts]
    sizes, at, out = _tokens([b for r in rows for b in r]), 0, []
    for r in rows:
        out.append(_packed(r, sizes[at : at + len(r)], most, overlap))
        at += len(r)
    return out


def cut(texts: list[str], most: int = rules.CHUNK_TOKENS, overlap: int = rules.OVERLAP_TOKENS) -> list[list[str]]:
    """The chunks of each text, in a task."""
    return [[t for t, _ in own] for own in _folded(texts, most, overlap)]


def packed(body: Column | str, most: int = rules.CHUNK_TOKENS, overlap: int = rules.OVERLAP_TOKENS) -> Column:
    """The :func:`blocks` of a text folded into chunks: array<struct<text, tokens>>.

    A block that doesn't fit ends the chunk; the next begins with the last
    blocks that make up ``overlap`` tokens. A block over the limit ends the
    chunk, gives windows of ``most`` words, and leaves nothing to carry.
    Blocks are cut, counted and folded by batch: as nested expressions the fold copies a page's chunks with each block, and each block is made a string anew by each step.
    """

    def pack(column: pa.Array) -> pa.Array:
        out = _folded(column.to_pylist(), most, overlap)
        unknown = iter(_tokens([t for own in out for t, n in own if n is None]))
        flat = pa.StructArray.from_arrays([pa.array([t for own in out for t, _ in own], pa.string()), pa.array([next(unknown) if n is None else n for own in out for _, n in own], pa.int32())], ["text", "tokens"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in out])]).astype(np.int32)), flat)

    if (spark := SparkSession.getActiveSession()) is not None:
        importable(spark)
    return F.arrow_udf(pack, _CHUNKS)(F.make_valid_utf8(text.text_of(body)))


def chunks(pages: DataFrame, key: str, text_col: str = "text", page_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, page, chunk_index, text, token_count) and the columns to ``keep``; the index starts anew on each page, a blank page has no chunk."""
    page = F.col(page_col) if page_col else F.lit(1)
    each = pages.select(key, *(keep or []), page.alias("page"), F.posexplode(packed(text_col)).alias("chunk_index", "chunk"))
    return each.select(key, *(keep or []), "page", "chunk_index", F.col("chunk.text").alias("text"), F.col("chunk.tokens").alias("token_count"))
