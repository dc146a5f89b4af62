"""What a document says of itself: type, date, amount, company, title, fields, summary. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions import rules, text

_NEWLINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}]"
_I = "(?i)"
#: A currency; where none can begin, its many names aren't tried one by one.
_CURRENCY = rf"(?=[asuegqkboj][easubwhmgo][drp]|[$£]|[€{rules.ARABIC}]){rules.CURRENCY}"
_PREFIXED, _SUFFIXED = rf"{_CURRENCY}\s*({rules.NUMBER})", rf"({rules.NUMBER})\s*{_CURRENCY}"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, _I + pattern, group), F.lit(""))


def every(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(_I + pattern), group)


def lines(c: Column | str) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text.text_of(c), _NEWLINES), text.stripped), lambda x: x != "")


def first_of(values: Column, fits: Callable[[Column], Column]) -> Column:
    """The first of an array of texts that fits, null without one; those after it aren't looked at."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, F.when(fits(x), x)))


def legislation(raw: Column, norm: Column) -> Column:
    """A law by its form: a marker of one, or many numbered articles without the words of a contract's parties."""
    articles = text.matches(raw, _I + rules.ARTICLE)
    return text.has_any(norm, rules.LEGISLATION) | ((articles >= 12) & ~text.has_any(norm, rules.PARTIES))


def doc_type(raw: Column | str, norm: Column) -> Column:
    """The type of a document by its text and its normalised text and file name: laws by their form, then the first rule that fits.

    ``norm`` should be a column of its own, as a hundred rules read it.
    """
    return F.when(legislation(text.text_of(raw), norm), "legal").otherwise(text.first_rule(norm, rules.DOC_TYPES, F.lit("general")))


def legal_title(raw: Column | str) -> Column:
    """The first of the opening lines that names a law; null without one."""

    def names(x: Column) -> Column:
        return F.length(x).between(12, 140) & x.rlike(rules.WORDLY) & ~text.garbled(x) & (text.has_any(text.normalized(x), rules.LEGISLATION) | x.rlike(_I + rules.LAW_LINE))

    return first_of(F.slice(lines(raw), 1, 40), names)


def _newest(c: Column) -> Column:
    years = F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1)
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def date_guess(raw: Column | str, kind: Column, title: Column, year: Column | int | None = None, digits: Column | None = None) -> Column:
    """The date as written. A law is dated by the newest year of its title or else of its opening, between 1950 and this year. ``digits``: the text with ASCII digits, if it is there already."""
    digits = text.ascii_digits(raw) if digits is None else digits
    now = F.year(F.current_date()) if year is None else F.lit(year)
    own = F.when(kind == "legal", F.coalesce(_newest(text.ascii_digits(title)), _newest(F.substring(digits, 1, 1500))))
    law = text.let(own, lambda y: F.when(y.between(F.lit(1950), now), y.cast("string")))
    return F.coalesce(law, *(found(digits, p) for p in rules.DATES))


def amount(raw: Column | str, digits: Column | None = None) -> Column:
    """The last amount after a currency; if there is none, the last before one."""
    digits = text.ascii_digits(raw) if digits is None else digits
    last = lambda p: F.try_element_at(every(digits, p), F.lit(-1))
    return F.coalesce(last(_PREFIXED), last(_SUFFIXED))


def company(raw: Column | str) -> Column:
    """The first of the opening lines that can be a name."""
    return first_of(F.slice(lines(raw), 1, 12), lambda x: F.length(x).between(2, 80) & x.rlike(rules.WORDLY) & ~text.garbled(x))


def title(name: Column | str, kind: Column, law: Column) -> Column:
    """The law's own title, or the file's name in title case without its suffix."""
    stem = F.regexp_replace(text.text_of(name), r"(?<=.)\.[^.]*$", "")
    return F.when((kind == "legal") & law.isNotNull(), law).otherwise(F.initcap(F.trim(F.translate(stem, "_-", "  "))))


def tags(kind: Column, lang: Column, money: Column, date: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(kind, F.split(F.lower(lang), " ")[0], F.when(money.isNotNull(), "amount"), F.when(date.isNotNull(), "date")))))


def summary(raw: Column | str, kind: Column, lang: Column, date: Column, money: Column, firm: Column) -> Column:
    bits = F.concat_ws(", ", F.concat(F.lit("date: "), date), F.concat(F.lit("amount: "), money), F.when(lang != "unknown", F.concat(F.lit("language: "), lang)))
    head = F.concat(F.initcap(kind), F.lit(" document"), F.coalesce(F.concat(F.lit(" from "), firm), F.lit("")), F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise(""))

    def told(clean: Column) -> Column:
        body = F.concat(F.substring(clean, 1, 420), F.when(F.length(clean) > 420, "...").otherwise(""))
        return F.when(clean == "", "No text extracted yet.").otherwise(F.concat(head, F.lit(". "), body))

    return text.let(F.trim(F.regexp_replace(text.text_of(raw), r"(?U)\s+", " ")), told)


def fields(raw: Column | str, kind: Column, name: Column, firm: Column, date: Column, money: Column, digits: Column | None = None) -> Column:
    """A struct of all fields, null where the document has none; ``to_json`` of it drops those."""
    digits = text.ascii_digits(raw) if digits is None else digits
    both = rf"{_PREFIXED}|{_SUFFIXED}"
    pairs = F.transform(every(digits, both, 0), lambda m: F.regexp_extract(m, rules.NUMBER, 0))  # a currency has no digits
    amounts = text.let(pairs, lambda p: F.when(F.size(p) > 0, F.slice(p, F.greatest(F.size(p) - 7, F.lit(1)), 8)))
    total_line = rf"({rules.NUMBER})\s*{_CURRENCY}|{_CURRENCY}\s*({rules.NUMBER})|({rules.NUMBER})\s*$"
    # a text without such a word has no line with one
    total = F.when(digits.rlike(_I + rules.TOTAL), first_of(lines(digits), lambda x: x.rlike(_I + rules.TOTAL) & x.rlike(_I + total_line)))
    iban = F.substring(F.regexp_replace(found(digits, r"(?:iban|ايبان|آيبان)\s*[:#-]?\s*([A-Z]{2}\s?[0-9]{2}[0-9A-Z\s]{10,32})"), r"\s+", ""), 1, 34)
    people = F.transform(F.slice(every(text.text_of(raw), r"(?:name|الاسم)\s*[:#-]?\s*([^\n]{3,80})"), 1, 6), text.stripped)
    return F.struct(
        kind.alias("doc_type"), name.alias("title"), firm.alias("company"), date.alias("date"),
        F.coalesce(money, F.try_element_at(amounts, F.lit(-1))).alias("amount"),
        found(digits, r"(?:invoice\s*(?:no|number|#)|رقم\s*الفاتور[ةه]|فاتور[ةه]\s*رقم)\s*[:#-]?\s*([A-Z0-9\-/]+)").alias("invoice_number"),
        F.nullif(F.substring(F.trim(F.regexp_replace(found(digits, r"(?:due\s*date|expiry\s*date|تاريخ\s*(?:الاستحقاق|الانتهاء|انتهاء))\s*[:#-]?\s*([0-9A-Za-z\-/\.\s]+)"), r"^\s+|\s+$", "")), 1, 60), F.lit("")).alias("due_or_expiry_date"),
        amounts.alias("amounts_found"),
        found(digits, f"({_CURRENCY})").alias("currency"),
        text.let(total, lambda x: F.coalesce(*(found(x, total_line, k) for k in (1, 2, 3)))).alias("total"),
        found(digits, r"(?:vat\s*(?:no|number|reg(?:istration)?)?|tax\s*(?:no|number)|الرقم\s*الضريبي|رقم\s*ضريبي)\s*[:#.]?\s*([0-9]{9,15})").alias("vat_number"),
        iban.alias("iban"),
        F.when(kind == "contract", found(digits, rf"(?:rent|annual rent|الايجار|قيمة الايجار|الأجر[ةه]|قيم[ةه]\s*الإيجار)\s*[:#-]?\s*({rules.NUMBER}\s*{rules.CURRENCY}?)")).alias("rent_amount"),
        F.when(kind.isin("id", "legal", "contract"), text.let(people, lambda x: F.when(F.size(x) > 0, x))).alias("names_found"),
    )


def year_month(guess: Column | str, mtime: Column) -> Column:
    """yyyy-MM of a date as written; without one, of the file's time (seconds)."""
    raw = text.ascii_digits(guess)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    year_only = F.when(raw.rlike(r"^\s*(?:19|20)[0-9]{2}\s*$"), F.concat(F.trim(raw), F.lit("-01")))
    first = r"(20[0-9]{2})[-/.]([0-9]{1,2})"
    last = r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.](20[0-9]{2})"
    word = rf"({'|'.join(rules.MONTHS)})[a-z]*\s+(20[0-9]{{2}})"
    month = F.array_position(F.array(*map(F.lit, rules.MONTHS)), F.lower(found(raw, word)))
    return F.coalesce(
        year_only,
        F.concat(found(raw, first, 1), F.lit("-"), two(found(raw, first, 2))),
        F.concat(found(raw, last, 3), F.lit("-"), two(found(raw, last, 2))),
        F.concat(found(raw, word, 2), F.lit("-"), two(month)),
        F.date_format(F.timestamp_seconds(F.coalesce(mtime, F.lit(0))), "yyyy-MM"),
    )


def with_metadata(docs, text_col: str = "text", name_col: str = "name", year: int | None = None):
    """``docs`` with doc_type, language, legal_title, date_guess, amount, company, title, tags, summary and fields.

    Steps build on each other in separate projections: what many rules read is
    computed once a row, and each rule chain is in the plan once.
    """
    c = F.col
    out = docs.withColumns({"_all": F.concat_ws(" ", text.text_of(text_col), text.text_of(name_col)), "_digits": text.ascii_digits(text_col)})
    out = out.withColumn("_norm", text.normalized("_all")).drop("_all")
    out = out.withColumns({"doc_type": doc_type(text_col, c("_norm")), "language": text.language(text_col), "amount": amount(text_col, c("_digits")), "company": company(text_col)}).drop("_norm")
    out = out.withColumn("legal_title", F.when(c("doc_type") == "legal", legal_title(text_col)))
    out = out.withColumns({"date_guess": date_guess(text_col, c("doc_type"), c("legal_title"), year, c("_digits")), "title": title(name_col, c("doc_type"), c("legal_title"))})
    return out.withColumns({
        "tags": tags(c("doc_type"), c("language"), c("amount"), c("date_guess")),
        "summary": summary(text_col, c("doc_type"), c("language"), c("date_guess"), c("amount"), c("company")),
        "fields": fields(text_col, c("doc_type"), c("title"), c("company"), c("date_guess"), c("amount"), c("_digits")),
    }).drop("_digits")
