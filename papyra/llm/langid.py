"""Language identification by rank-order profiles of byte n-grams and out-of-place distance."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.common import LOWER, any_names, bounded_batches, fold, slices, text_bytes

#: Bytes of the longest n-gram, and n-grams of a profile.
LONGEST, PROFILE = 4, 400
#: Bytes of a text that n-grams are counted of at once; a longer text is cut between words.
PIECE_BYTES = 1 << 20
#: A profile is counted on about so many texts of its language, by a hash of the id; fewer if there are fewer.
TRAIN_TEXTS = 600
MOST_LANGUAGES = 2000
UNKNOWN = "und"
#: Share of the largest possible distance by which a language must lead to be e times likelier.
_SHARPNESS = 0.02

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_GAP = np.uint8(32)


def ranked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), each text's n-grams from the most frequent on, ties by the n-gram. Texts: 2048 at most, or one of any length."""
    if len(offsets) != 2 or len(data) <= PIECE_BYTES:
        return _ranked(data, offsets)
    grams, counts, at = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data):  # up to the next gap, so that no word is cut
            gaps = np.flatnonzero(~_LETTER[LOWER[data[end : end + 4096]]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, len(data))
        _, own, n = _ranked(data[at:end], np.array([0, end - at]))
        grams, place = np.unique(np.concatenate([grams, own]), return_inverse=True)
        counts, at = np.bincount(place, np.concatenate([counts, n])).astype(np.int64), end
    order = np.lexsort((grams, -counts))
    return np.zeros(len(grams), np.int64), grams[order], counts[order]


def _ranked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), each text's n-grams from the most frequent on, ties by the n-gram.

    Letters are lower-case ASCII letters and all non-ASCII bytes; other bytes
    are one gap between words. An n-gram is 1 to ``LONGEST`` bytes of a word with
    a gap on each side. Texts: 2048 at most, or one.
    """
    low = LOWER[data]
    letter = _LETTER[low]
    n_texts = len(offsets) - 1
    # a gap after each text keeps texts apart
    text = np.repeat(np.arange(n_texts), np.diff(offsets) + 1)
    at = np.arange(len(low)) + np.repeat(np.arange(n_texts), np.diff(offsets))
    symbols = np.full(len(low) + n_texts, _GAP)
    symbols[at[letter]] = low[letter]
    gap = symbols == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    symbols, text, gap = symbols[keep], text[keep], gap[keep]
    # a word at the start of a text has the gap of the text before, and the first of all needs one
    symbols, gap = np.concatenate([[_GAP], symbols]), np.concatenate([[True], gap])
    text = np.concatenate([[0], text]).astype(np.uint64)
    keys = []
    for n in range(1, LONGEST + 1):
        size = len(symbols) - n + 1
        if size <= 0:
            break
        gram = np.zeros(size, np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(8)) | symbols[k : k + size]
        ok = ~gap[:size] if n == 1 else np.ones(size, bool)
        for k in range(1, n - 1):
            ok &= ~gap[k : k + size]
        if n == 2:
            ok &= ~(gap[:size] & gap[1 : 1 + size])
        owner = text[n - 1 :] if n > 1 else text
        keys.append((owner[ok] << np.uint64(32)) | gram[ok])
    keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([heads, [len(keys)]]))
    keys = keys[heads]
    bits = max(1, int(n_texts - 1).bit_length()) if n_texts > 1 else 0
    most = (1 << (32 - bits)) - 1
    packed = ((keys >> np.uint64(32)) << np.uint64(64 - bits)) if bits else np.zeros(len(keys), np.uint64)
    packed = packed | ((most - np.minimum(counts, most)).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    packed.sort()
    count = most - ((packed >> np.uint64(32)) & np.uint64(most)).astype(np.int64)
    owner = (packed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(packed), np.int64)
    return owner, packed & np.uint64(0xFFFFFFFF), count


class Profiles:
    """Rank of each n-gram in each language's profile."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.array(profiles[k], np.uint64) for k in self.languages])) if profiles else np.empty(0, np.uint64)
        self.rank = np.full((len(self.grams) + 1, len(self.languages)), PROFILE, np.int32)
        for j, k in enumerate(self.languages):
            self.rank[np.searchsorted(self.grams, np.array(profiles[k], np.uint64)), j] = np.arange(len(profiles[k]))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        owner, grams, _ = ranked(data, offsets)
        lettered = np.zeros(n, bool)
        lettered[owner] = True
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        first = np.searchsorted(owner, np.arange(n + 1))
        rank = np.arange(len(owner)) - first[owner]
        top = rank < PROFILE
        owner, grams, rank = owner[top], grams[top], rank[top]
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at[self.grams[at] != grams] = len(self.grams)
        theirs = self.rank[at]
        place = np.where(theirs < PROFILE, np.abs(theirs - rank[:, None]), PROFILE)
        distance = np.stack([np.bincount(owner, place[:, j], minlength=n) for j in range(len(self.languages))], axis=1)
        size = np.maximum(np.bincount(owner, minlength=n), 1)[:, None] * PROFILE
        z = -(distance - distance.min(axis=1, keepdims=True)) / (size * _SHARPNESS)
        share = np.exp(z)
        score = share.max(axis=1) / share.sum(axis=1)
        best = distance.argmin(axis=1)
        out = [self.languages[best[d]] if lettered[d] and _has_letter(data[offsets[d] : offsets[d + 1]]) else UNKNOWN for d in range(n)]
        return out, np.where([k != UNKNOWN for k in out], score, 0.0)


def _has_letter(text: np.ndarray) -> bool:
    if bool(_LETTER[LOWER[text]][text < 128].any()):
        return True
    return any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            owner, grams, counts = ranked(*text_bytes(part.column("text")))
            if len(owner):
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(owner)), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def train(docs: DataFrame, texts: int = TRAIN_TEXTS) -> Profiles:
    """Profiles from the (doc_id, text, lang) rows of ``docs``: the ``PROFILE`` most frequent n-grams of about ``texts`` whole texts a language.

    Rows without an id, a text or a language are left out; languages are
    bounded by ``MOST_LANGUAGES``, as the driver holds a profile of each.
    """
    rows = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Profiles({})
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, texts / r["rows"])))))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    grams = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
    grams = grams.withColumn("part", F.pmod("gram", F.lit(16))).withColumn("rank", best("lang", "part")).where(F.col("rank") <= PROFILE)
    grams = grams.withColumn("rank", best("lang")).where(F.col("rank") <= PROFILE)
    out: dict[str, list] = {}
    for r in grams.select("lang", "gram", "rank").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in out.items()})


def _predict(packed, text_col: str, columns: list[str], lang: str, score: str):
    kept: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(pickle.loads(packed.value))  # noqa: S301  made by this driver
        for whole in slices(batches, text_col):
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                languages, scores = kept[0].predict(*text_bytes(batch.column(text_col)))
                own = {lang: pa.array(languages, pa.string()), score: pa.array(scores, pa.float64())}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in columns], names=columns)

    return run


@any_names
def predicted(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang: str = "_lang", score: str = "_score") -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` of each whole text (columns of these names are replaced).

    ``und`` with score 0 for null, for a text without a letter, and if nothing was learned. The score
    is the best language's share when distances are weighed exponentially; ties go to the first name.
    Long texts are read whole, a piece at a time; repeated rows are judged each; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    out = docs.withColumns({lang: F.lit("").cast("string"), score: F.lit(0.0)})
    return out.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(pickle.dumps(profiles)), text_col, out.columns, lang, score), out.schema)


def digest(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a null id is in no fold and isn't learned from."""
    out_fold = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    profiles = train(docs.where(~out_fold))
    return predicted(docs.select("doc_id", "text"), profiles).select("doc_id", out_fold.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
