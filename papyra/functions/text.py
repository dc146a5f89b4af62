"""Text functions on columns. Null texts are treated as empty unless said otherwise."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import rules

#: A word: letters, digits, underscore or a character of the Arabic block.
WORD = rf"[\p{{L}}\p{{N}}_{rules.ARABIC}]"
_NOT_WORD = rf"[^\p{{L}}\p{{N}}_{rules.ARABIC}]+"
_GREEK = r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"
#: Arabic characters and all that compatibility folding can make one of, and many others.
_FOLDS_TO_ARABIC = r"[\x{0600}-\x{08FF}\x{FB50}-\x{FEFF}\x{10000}-\x{10FFFF}]"
_WIDE = r"[^\x00-\x7F]"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def nfkc(c: Column) -> Column:
    """Unicode compatibility folding, of texts that aren't plain ASCII: by the library that Spark has for collations, so no Python worker is needed."""
    folded = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(_WIDE), folded).otherwise(c)


def plain(text: str | None) -> str:
    """:func:`normalized` for one string on the driver, compatibility folding included."""
    text = unicodedata.normalize("NFKC", text or "")
    text = re.sub("[ؐ-ًؚ-ٰٟۖ-ۭ]", "", text).translate(str.maketrans(*rules.LETTERS))
    text = text.translate({ord(c): " " for c in rules.SPACES}).lower()
    return " ".join(re.sub("[^\\w؀-ۿ]+", " ", text).split())


def normalized(c: Column | str, fold: bool = True) -> Column:
    """Lower-case words parted by single spaces, Arabic letters unified, vowel marks dropped. ``fold``: presentation forms, ligatures and full-width characters first become what they stand for."""
    x = text_of(c)
    wide = nfkc(x) if fold else x
    arabic = F.translate(F.regexp_replace(wide, rules.TASHKEEL, ""), rules.LETTERS[0] + rules.SPACES, rules.LETTERS[1] + " " * len(rules.SPACES))
    words = lambda y, other: F.trim(F.regexp_replace(F.lower(y), other, " "))
    # a step is left out of texts that it can't change: folding of plain ASCII ones, Arabic letters of those that have none, nor what folds to one
    return F.when(~x.rlike(_WIDE), words(x, r"\W+")).when(x.rlike(_FOLDS_TO_ARABIC), words(arabic, _NOT_WORD)).otherwise(words(wide, _NOT_WORD))


#: Bytes of Latin-1 as :func:`normalized` has them: lower case, a space for what isn't part of a word.
_PLAIN_BYTES = bytes(ord(chr(c).lower()) if unicodedata.category(chr(c))[0] in "LN" or c == 0x5F else 0x20 for c in range(256))
_FOLDS, _MARKS, _OTHERS = re.compile("[\u0600-\u08ff\ufb50-\ufeff\U00010000-\U0010ffff]"), re.compile("[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed]"), re.compile("[^\\w\u0600-\u06ff]+")
_UNIFIED = str.maketrans(rules.LETTERS[0] + rules.SPACES, rules.LETTERS[1] + " " * len(rules.SPACES))


def folded(body: str) -> bool:
    """Whether compatibility folding and Arabic rules leave a text as it is, so that its index words are those of its normalised form."""
    return body.isascii() or (unicodedata.is_normalized("NFKC", body) and (_narrow(body) or not _FOLDS.search(body)))


def _narrow(body: str) -> bool:
    try:
        body.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def normal(body: str) -> str:
    """:func:`normalized` of one text in a task. A text that folding leaves as it is and that Latin-1 can hold is translated byte by byte."""
    if folded(body):
        try:
            return " ".join(body.encode("latin-1").translate(_PLAIN_BYTES).decode("latin-1").split())
        except UnicodeEncodeError:
            return _OTHERS.sub(" ", body.lower()).strip(" ")
    wide = unicodedata.normalize("NFKC", body)
    if _FOLDS.search(body):
        wide = _MARKS.sub("", wide).translate(_UNIFIED)
    return _OTHERS.sub(" ", wide.lower()).strip(" ")


def ascii_digits(c: Column | str) -> Column:
    """Arabic-Indic, Persian and full-width digits and separators as ASCII, after compatibility folding."""
    x = text_of(c)
    return F.when(x.rlike(_WIDE), F.translate(nfkc(x), *rules.DIGITS)).otherwise(x)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: White space as Unicode has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column | str) -> Column:
    """A text without the white space around it. Ends are looked at only, where a pattern would go through all of the text."""
    return F.btrim(text_of(c), F.lit(BLANKS))


def matches(c: Column, pattern: str) -> Column:
    """How often the pattern matches."""
    return F.regexp_count(c, F.lit(pattern))


def token_count(c: Column | str) -> Column:
    """About the tokens of a text: five for four words, one at least if there is a word."""
    n = matches(text_of(c), f"{WORD}+")
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 1.25).cast("int")))


def has_arabic(c: Column | str) -> Column:
    return text_of(c).rlike(f"[{rules.ARABIC}]")


def _times(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _odd(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[{rules.USUAL}]", ""))


def garbled(c: Column | str) -> Column:
    """Text that an extraction left useless: empty, full of replacement marks, Greek noise, odd characters, or symbols only."""

    def bad(x: Column) -> Column:
        n = F.length(x)
        return (
            (n == 0)
            | ((n >= 8) & (_times(x, "?�□■") > 0.22 * n))
            | x.rlike(rf"{_GREEK}(?s:.*?){_GREEK}")
            | ((n >= 20) & (_odd(x) > 0.08 * n))
            | (~x.rlike(rules.WORDLY) & (_times(x, "?") >= 4))
        )

    return let(F.regexp_replace(text_of(c), r"(?U)\s+", ""), bad)


def needs_ocr(c: Column | str) -> Column:
    return let(stripped(c), lambda x: (F.length(x) < 25) | garbled(x))


#: What a character counts as: a letter, a digit, part of a word, a mark of failed recognition, odd in clean text; white space.
_LETTER, _DIGIT, _IN_WORD, _MARK, _ODD, _BLANK = 1, 2, 4, 8, 16, 32
#: Characters that are counted at once.
_AT_ONCE = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    """The classes of each code point."""
    out = np.full(0x110000, _ODD, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L" or kind[0] == "N":
            out[c] |= _IN_WORD | (_DIGIT if kind == "Nd" else 0)
    out[[ord(c) for c in rules.USUAL_ASCII + rules.USUAL_OTHERS]] &= ~np.uint8(_ODD)
    out[0x600:0x700] = (out[0x600:0x700] | _IN_WORD | _LETTER) & ~np.uint8(_ODD)
    out[[ord(c) for c in rules.LATIN]] |= _LETTER
    out[[ord(c) for c in "?\ufffd\u25a1"]] |= _MARK
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] |= _BLANK
    return out


def _counts(texts: list[str]) -> np.ndarray:
    """A row for each text without the white space around it: its length, marks, words of two characters or more, points."""
    ends = np.cumsum([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, begins = _classes()[points], np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # the first and the last character of each text that isn't blank
    own = np.flatnonzero((kinds & _BLANK) == 0)
    low, high = np.searchsorted(own, begins), np.searchsorted(own, ends) - 1
    some = low <= high
    own = own if len(own) else np.zeros(1, np.int64)
    begins, ends = np.where(some, own[np.minimum(low, len(own) - 1)], begins), np.where(some, own[np.maximum(high, 0)] + 1, begins)

    def of(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return total[ends] - total[begins]

    word = (kinds & _IN_WORD) != 0
    first = np.zeros(len(kinds) + 1, bool)  # where a text begins, so that no word goes across
    first[begins] = True
    starts = word & (first[:-1] | ~np.concatenate([[False], word[:-1]]))
    inside = np.concatenate([word[1:] & ~starts[1:], [False]]) if len(word) else word  # the next character goes on with it
    marks, words = of((kinds & _MARK) != 0), of(starts & inside)
    return np.stack([ends - begins, marks, words, 2 * of((kinds & _LETTER) != 0) + of((kinds & _DIGIT) != 0) + 3 * words - 10 * marks - 2 * of((kinds & _ODD) != 0)], axis=1)


def word_counts(texts: list[str]) -> np.ndarray:
    """The words of each text, a character or more."""
    size = np.array([len(t) for t in texts], np.int64)
    word = (_classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)] & _IN_WORD) != 0
    ends = np.cumsum(size)
    first = np.zeros(len(word) + 1, bool)
    first[ends - size] = True
    total = np.concatenate([[0], np.cumsum(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))])
    return total[ends] - total[ends - size]


def latin_word_counts(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """The words of each text that Latin-1 can hold, and the places of the others."""
    counts, others = np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        try:
            counts[k] = len(t.encode("latin-1").translate(_PLAIN_BYTES).split())
        except UnicodeEncodeError:
            others.append(k)
    return counts, others


def tokens_of(words):
    """About the tokens of a number of words, or of an array of them."""
    return np.where(words == 0, 0, np.maximum(1, (words * 5) // 4))


def _tallied(column: pa.Array) -> pa.Array:
    """:func:`_counts` of an Arrow column of texts, a part at a time; a null is an empty text."""
    texts, out, begin = column.to_pylist(), [np.zeros((0, 4), np.int64)], 0
    texts = [t or "" for t in texts]
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= _AT_ONCE:
            size, end = size + len(texts[end]), end + 1
        out.append(_counts(texts[begin:end]))
        begin = end
    every = np.concatenate(out)
    return pa.StructArray.from_arrays([pa.array(every[:, k].astype(np.int32)) for k in range(4)], ["n", "bad", "words", "points"])


def tally(c: Column | str) -> Column:
    """struct<n, bad, words, points> of a text without the white space around it: :func:`legibility` and :func:`quality` read it. Counted by batch: a regular expression would make a string of each character it finds."""

    def counted(column: pa.Array) -> pa.Array:
        return _tallied(column)

    if (spark := SparkSession.getActiveSession()) is not None:
        importable(spark)
    return F.arrow_udf(counted, "struct<n:int,bad:int,words:int,points:int>")(F.col(c) if isinstance(c, str) else c)


def legibility(c: Column | str) -> Column:
    """Points for letters, digits and words, points off for marks of failed recognition."""
    return tally(c)["points"]


def judged(v: Column) -> Column:
    """:func:`quality` by a :func:`tally`."""
    n = F.greatest(v["n"], F.lit(1))
    low = (v["bad"] > 0.08 * n) | (v["words"] < 3)
    density = v["points"] / n
    label = F.when(v["n"] == 0, "empty").when(low | (density < 0.55), "poor").when(density < 1.15, "medium").otherwise("good")
    return F.struct(label.alias("label"), F.when(low, F.greatest(density, F.lit(0.0))).otherwise(density).alias("score"))


def quality(c: Column | str) -> Column:
    """struct<label, score>: empty, poor, medium or good, and points for each character."""
    return judged(tally(c))


def language(c: Column | str) -> Column:
    latin = text_of(c).rlike("[A-Za-z]")
    return F.when(has_arabic(c) & latin, "Arabic + English").when(has_arabic(c), "Arabic").when(latin, "English").otherwise("unknown")


def keyword_forms(keyword: str) -> list[str]:
    """The words or phrases that count as the keyword: a phrase or an ASCII word as it is, an Arabic word also behind its usual prefixes."""
    kw = plain(keyword)
    if not kw or " " in kw or all(ch.isascii() and ch.isalnum() for ch in kw):
        return [kw] if kw else []
    # a word is the keyword, one of its forms, or the keyword behind the first prefix that fits the word
    fits = []
    for i, p in enumerate(rules.STRIPPED_ONCE):
        earlier = [q for q in rules.STRIPPED_ONCE[:i] if (p + kw).startswith(q) and len(p + kw) > len(q) + 1]
        if not earlier and len(kw) > 1:
            fits.append(p + kw)
    return list(dict.fromkeys([kw, *(p + kw for p in rules.KEYWORD_FORMS), *fits]))


def has_any(norm: Column, keywords: list[str]) -> Column:
    """Whether normalised text has one of the keywords as whole words; one expression, however many there are."""
    forms = list(dict.fromkeys(f for k in keywords for f in keyword_forms(k)))
    if not forms:
        return F.lit(False)
    # where no form can begin, by its first two characters, they aren't tried one by one
    first, second = ("".join(sorted({f"{f} "[k] for f in forms})) for k in (0, 1))
    return F.concat(F.lit(" "), norm, F.lit(" ")).rlike(f" (?=[{first}][{second}])(?:{'|'.join(forms)}) ")


def has_keyword(norm: Column, keyword: str) -> Column:
    return has_any(norm, [keyword])


def first_rule(norm: Column, table: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The name of the first rule with a keyword in the text."""
    out = otherwise
    for name, keywords in reversed(table):
        out = F.when(has_any(norm, keywords), name).otherwise(out)
    return out


def query_terms(c: Column | str) -> Column:
    """Distinct search terms of a question in order: its words, forms without prefixes, synonyms."""
    words = F.filter(F.split(normalized(c), " "), lambda w: F.length(w) > 1)
    synonyms = F.create_map(*(x for k, v in rules.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def forms(w: Column) -> Column:
        bare = [F.when(F.startswith(w, F.lit(p)) & (F.length(w) > len(p) + 1), F.substring(w, len(p) + 1, 1 << 30)) for p in rules.STRIPPED_EACH]
        return F.concat(F.array(w), F.array_compact(F.array(*bare)), F.coalesce(F.try_element_at(synonyms, w), F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(words, forms)))


def terms_of(question: str) -> list[str]:
    """:func:`query_terms` of one question on the driver."""
    out: list[str] = []
    for w in (w for w in plain(question).split() if len(w) > 1):
        out += [w, *(w[len(p) :] for p in rules.STRIPPED_EACH if w.startswith(p) and len(w) > len(p) + 1), *rules.SYNONYMS.get(w, [])]
    return list(dict.fromkeys(t for t in map(plain, out) if t))


def lexical_score(norm: Column, terms: list[str]) -> Column:
    """Points of a normalised text for the terms: 4 for a whole word, one for each occurrence, one if a longer word and the term begin alike."""
    words = F.array_distinct(F.split(norm, " "))
    long_words = F.filter(words, lambda w: F.length(w) > 3)
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.array_contains(words, t), 4).otherwise(0) + (F.length(norm) - F.length(F.replace(norm, F.lit(t), F.lit("")))) / len(t)
        if len(t) > 3:
            score = score + _alike(long_words, t)
    return F.floor(score).cast("int")


def _alike(words: Column, term: str) -> Column:
    return F.when(F.exists(words, lambda w: F.startswith(w, F.lit(term)) | F.startswith(F.lit(term), w)), 1).otherwise(0)


def snippet(c: Column | str, terms: list[str], size: int = 360, before: int = 100) -> Column:
    """The text around the first term that occurs, in the terms' order."""
    nowhere = F.lit(None).cast("int")

    def found(norm: Column) -> Column:
        return F.coalesce(*(F.nullif(F.locate(t, norm), F.lit(0)) for t in terms), nowhere) if terms else nowhere

    def cut(clean: Column) -> Column:
        def around(at: Column) -> Column:
            begin = F.when(at.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.length(clean), at - 1) - before))
            return let(begin, lambda b: F.concat(F.substring(clean, b + 1, F.lit(size)), F.when(F.length(clean) > b + size, "...").otherwise("")))

        return let(let(normalized(clean), found), around)

    return let(F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " ")), cut)


def counted(values: Column) -> Column:
    """array<struct<value, n>>: the distinct elements of an array, sorted, with their numbers, by one sort of the array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("value"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).alias("n"))))

    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.filter(F.transform(s, lambda x: F.struct(x.alias("value"), F.lit(0).alias("n"))), lambda x: F.lit(False))))


def file_name(c: Column | str) -> Column:
    """A name that is safe in any file system: letters of the Latin and Arabic blocks, digits, and single underscores."""
    x = F.regexp_replace(F.translate(text_of(c), "ـ", ""), f"[^A-Za-z0-9{rules.ARABIC}_.-]+", "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[_.-]+|[_.-]+$", "")
    return F.when(x == "", "document").otherwise(x)


def trigrams(word: Column) -> Column:
    """Overlapping 3-character pieces of a word; none of a shorter one."""
    return F.when(F.length(word) >= 3, F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


@functools.cache
def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_INDEXED = re.compile(r"[^\W_]+")


def index_words(*bodies: str) -> list[str]:
    """:func:`index_tokens` of texts, with their accents: :func:`without_accents` takes those off a word."""
    return [w for b in bodies for w in _INDEXED.findall(b.lower())]


def indexed_in(norm: str) -> str:
    """:func:`index_words` of a normalised text with spaces between them."""
    # one of Latin-1 has letters, digits, underscores and spaces only
    return norm.replace("_", " ") if _narrow(norm) else " ".join(index_words(norm))


def index_words_of(norm: str) -> list[str]:
    """:func:`index_words` of a normalised text."""
    return indexed_in(norm).split()


@functools.cache
def _bare() -> dict[int, str]:
    return str.maketrans(*_accents())


def without_accents(word: str) -> str:
    return word if word.isascii() else word.translate(_bare())


def index_tokens(c: Column) -> Column:
    """Words of the inverted index: lower case, without accents, of letters and digits only."""
    return F.filter(F.split(F.translate(F.lower(c), *_accents()), r"[^\p{L}\p{N}]+"), lambda w: w != "")
