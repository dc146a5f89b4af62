"""DuckDB SQL of the registered queries, written for itself and not from the Spark expressions."""

from __future__ import annotations

from papyra.functions import rules

AR = "\\x{0600}-\\x{06FF}"
WORD = f"[\\p{{L}}\\p{{N}}_{AR}]"
QUESTION_TERMS = ["latest", "license", "amount", "of", "the", "thing", "on", "heer", "onatth"]
_PREFIXES = "(?:وال|بال|لل|ال|و|ب|ل)?"
_SPACE = "[\\s\\x0B\\x{0085}\\p{Z}]"
_NEWLINE = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{0085}\\x{2028}\\x{2029}]"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm(x: str) -> str:
    letters = rules.LETTERS[0] + rules.SPACES
    x = f"regexp_replace(coalesce({x}, ''), {s(rules.TASHKEEL)}, '', 'g')"
    return f"trim(regexp_replace(lower(translate({x}, {s(letters)}, {s(rules.LETTERS[1] + ' ' * len(rules.SPACES))})), '[^\\p{{L}}\\p{{N}}_{AR}]+', ' ', 'g'))"


#: What the characters of the catalogue's FORMS stand for: written out here, as DuckDB has no compatibility folding.
FOLDS = {"ﻻ": "لا", "ﬁ": "fi", "ﬂ": "fl", "ﻋ": "ع", "ﻘ": "ق", "ﺪ": "د", "ﻹ": "لإ", "½": "1⁄2", "№": "No", "①": "1", "ﷺ": "صلى الله عليه وسلم"} | dict(zip("０１２３４５６７８９ＡＢＣｒｅｎｔ", "0123456789ABCrent", strict=True))


def folded(x: str) -> str:
    for k, v in FOLDS.items():
        x = f"replace({x}, {s(k)}, {s(v)})"
    return x


def times(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {s(pattern)}))"


def chars(x: str, which: str) -> str:
    return f"(length({x}) - length(translate({x}, {s(which)}, '')))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def odd(x: str) -> str:
    return f"length(regexp_replace({x}, {s('[' + rules.USUAL + ']')}, '', 'g'))"


def tokens(x: str) -> str:
    n = times(f"coalesce({x}, '')", WORD + "+")
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, CAST(floor({n} * 1.25) AS BIGINT)) END)"


def garbled(x: str) -> str:
    c = f"regexp_replace(coalesce({x}, ''), '{_SPACE}+', '', 'g')"
    return f"""(length({c}) = 0 OR (length({c}) >= 8 AND {chars(c, '?�□■')} > 0.22 * length({c}))
        OR {times(c, '[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]')} >= 2
        OR (length({c}) >= 20 AND {odd(c)} > 0.08 * length({c}))
        OR (NOT regexp_matches({c}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]') AND {chars(c, '?')} >= 4))"""


def points(x: str) -> str:
    c = strip(x)
    return f"(2 * ({times(c, '[' + AR + ']')} + {times(c, '[A-Za-z]')}) + {times(c, '\\p{Nd}')} + 3 * {times(c, WORD + '{2,}')} - 10 * {chars(c, '?�□')} - 2 * {odd(c)})"


def label(x: str, p: str) -> str:
    c = strip(x)
    n = f"greatest(length({c}), 1)"
    return f"""CASE WHEN length({c}) = 0 THEN 'empty' WHEN {chars(c, '?�□')} > 0.08 * {n} OR {times(c, WORD + '{2,}')} < 3 OR {p} / {n} < 0.55 THEN 'poor' WHEN {p} / {n} < 1.15 THEN 'medium' ELSE 'good' END"""


def keyword(n: str, kw: str) -> str:
    kw = kw.strip()
    if " " in kw or kw.isascii():
        return f"contains(' ' || {n} || ' ', {s(' ' + kw + ' ')})"
    return f"regexp_matches(' ' || {n} || ' ', {s(' ' + _PREFIXES + kw + ' ')})"


#: Keywords of the rule tables that normalising changes, as they are then.
_NORMAL = {"e&": "e", "tas-heel": "tas heel", "إيجار": "ايجار", "تأشيره": "تاشيره"}


def some(n: str, words: list[str]) -> str:
    return "(" + " OR ".join(keyword(n, _NORMAL.get(w, w)) for w in words) + ")"


def rule(n: str, table: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {some(n, words)} THEN {s(name)}" for name, words in table) + f" ELSE {otherwise} END"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '{_NEWLINE}'), lambda l: regexp_replace(l, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda l: l <> '')"


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {s('(?i)' + pattern)}, {group}), '')"


READINGS = "SELECT doc_id AS id, text AS body FROM documents UNION ALL SELECT page_id + 2000000000, html FROM pages UNION ALL SELECT doc_id + 1000000000, translate(text, 'etao', '????') FROM documents"
BLOCKS = f"""
    raw AS (SELECT doc_id, {strip('text')} AS raw FROM documents),
    split AS (
        SELECT doc_id, raw, list_filter(list_transform(regexp_split_to_array(
            regexp_replace(raw, '(\\.)\\s+([A-Z{AR}])', '\\1' || chr(1) || '\\2', 'g'), '\\n\\s*\\n|' || chr(1)),
            lambda b: regexp_replace(b, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda b: b <> '') AS parts
        FROM raw
    ),
    parts AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN parts ELSE {lines('raw')} END AS parts FROM split)"""
#: Blocks one after another, with what is open and what a block closes.
CHUNKS = BLOCKS + f""",
    block AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS b, len(parts) AS n FROM parts),
    sized AS (SELECT *, CAST({tokens('b')} AS BIGINT) AS bt FROM block),
    walk AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, CAST([] AS BIGINT[]) AS counts, CAST([] AS VARCHAR[]) AS done FROM parts WHERE len(parts) > 0
        UNION ALL
        SELECT doc_id, i, CASE WHEN bt > 700 THEN CAST([] AS VARCHAR[]) ELSE list_append(kept, b) END, CASE WHEN bt > 700 THEN CAST([] AS BIGINT[]) ELSE list_append(kept_counts, bt) END,
            list_concat(CASE WHEN is_full THEN [array_to_string(held, chr(10))] ELSE CAST([] AS VARCHAR[]) END,
                CASE WHEN bt > 700 THEN list_transform(range(0, len(words), 610), lambda a: array_to_string(words[a + 1:a + 700], ' ')) ELSE CAST([] AS VARCHAR[]) END)
        FROM (
            SELECT *, regexp_split_to_array(b, '{_SPACE}+') AS words,
                CASE WHEN is_full THEN held[len(held) - n_kept + 1:] ELSE held END AS kept, CASE WHEN is_full THEN counts[len(counts) - n_kept + 1:] ELSE counts END AS kept_counts
            FROM (
                SELECT *, len(held) > 0 AND coalesce(list_sum(counts), 0) + bt > 700 AS is_full,
                    coalesce(list_max(list_filter(range(1, len(counts) + 1), lambda k: list_sum(counts[len(counts) - k + 1:]) <= 90)), 0) AS n_kept
                FROM (SELECT w.doc_id, s.i, w.held, w.counts, s.b, s.bt FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
            )
        )
    ),
    told AS (
        SELECT doc_id, i, unnest(done) AS t, generate_subscripts(done, 1) AS k FROM walk WHERE len(done) > 0
        UNION ALL
        SELECT w.doc_id, w.i + 1, array_to_string(held, chr(10)), 1 FROM walk w JOIN (SELECT doc_id, max(i) AS i FROM walk GROUP BY doc_id) USING (doc_id, i) WHERE len(held) > 0
    ),
    chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS chunk_index, t AS text, CAST({tokens('t')} AS BIGINT) AS token_count FROM told)"""
_INDEXED = f"""list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', 'Document ' || CAST(doc_id AS VARCHAR), text, {norm('text')}))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"""
_IN_TERMS = ", ".join(s(t) for t in QUESTION_TERMS)
_ALIKE = " + ".join(f"CASE WHEN len(list_filter(ws, lambda w: length(w) > 3 AND (starts_with(w, {s(t)}) OR starts_with({s(t)}, w)))) > 0 THEN 1 ELSE 0 END" for t in QUESTION_TERMS if len(t) > 3)
_SCORE = " + ".join(f"CASE WHEN list_contains(ws, {s(t)}) THEN 4 ELSE 0 END + (length(n) - length(replace(n, {s(t)}, ''))) // {len(t)}" for t in QUESTION_TERMS) + " + " + _ALIKE


def features(x: str) -> str:
    return f"flatten(list_transform(list_filter(string_split({x}, ' '), lambda w: length(w) > 1), lambda w: list_concat([w], CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE CAST([] AS VARCHAR[]) END)))"


def hashed(source: str, key: str, n: str) -> str:
    """SQL of (key, dim, weight)."""
    return f"""SELECT {key}, CAST(h % 384 AS INTEGER) AS dim, sum(CASE WHEN (h >> 3) & 1 = 1 THEN 1 ELSE -1 END) AS weight
        FROM (SELECT {key}, CAST(concat('0x', substr(sha256(f), 1, 12)) AS BIGINT) AS h FROM (SELECT {key}, unnest({features(n)}) AS f FROM {source}))
        GROUP BY ALL HAVING weight <> 0"""


RETRIEVAL = CHUNKS + f""",
    item AS (SELECT concat_ws(':', CAST(doc_id AS VARCHAR), '1', CAST(chunk_index AS VARCHAR)) AS chunk_id, doc_id, chunk_index, text, {norm('text')} AS n, {_INDEXED} AS words FROM chunk),
    corpus AS (SELECT count(*) AS n_chunks, sum(len(words)) AS n_words FROM item),
    tf AS (SELECT chunk_id, any_value(len(words)) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, words, unnest(words) AS term FROM item) WHERE term IN ({_IN_TERMS}) GROUP BY chunk_id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    word_score AS (
        SELECT chunk_id, round(sum(greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (n_words / n_chunks)))), 12) AS bm25
        FROM tf JOIN df USING (term), corpus GROUP BY chunk_id
    ),
    question AS (SELECT 1 AS q, {s(' '.join(QUESTION_TERMS))} AS t),
    own AS ({hashed('question', 'q', 't')}),
    vec AS ({hashed('item', 'chunk_id', 'n')}),
    near AS (
        SELECT chunk_id, sum(vec.weight * coalesce(own.weight, 0)) / (sqrt(sum(vec.weight * vec.weight)) * sqrt((SELECT sum(weight * weight) FROM own))) AS sim
        FROM vec LEFT JOIN own USING (dim) GROUP BY chunk_id
    ),
    w60 AS (SELECT chunk_id, 2.0 + greatest(bm25, 0) AS score FROM word_score ORDER BY bm25 DESC, chunk_id LIMIT 60),
    v60 AS (SELECT chunk_id, 1.5 + 3.0 * sim AS near FROM near WHERE sim > 0.18 ORDER BY sim DESC, chunk_id LIMIT 60),
    fused AS (
        SELECT chunk_id, coalesce(score, 0) + coalesce(near, 0) AS score, CASE WHEN near IS NULL THEN 'bm25' WHEN score IS NULL THEN 'vector' ELSE 'bm25+vector' END AS retrieval
        FROM w60 FULL JOIN v60 USING (chunk_id)
    ),
    scored AS (
        SELECT chunk_id, doc_id AS document_id, chunk_index, text, retrieval, 'Document ' || CAST(doc_id AS VARCHAR) AS title,
            round(score + least(3.0, 0.08 * ({_SCORE})) + CASE WHEN regexp_matches(text, '(?i)(?:AED|د\\.إ|درهم|total|amount|اجمالي|مبلغ|\\p{{Nd}}+[,.]?\\p{{Nd}}*)') THEN 0.9 ELSE 0 END + 0.15, 9) AS score
        FROM fused JOIN (SELECT *, string_split(n, ' ') AS ws FROM item) USING (chunk_id)
    ),
    top AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 20)"""


#: The same for each item of ``benchmark`` as a question.
_SEARCHED = f"""list_filter(regexp_split_to_array(strip_accents(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"""
_POINTS = """list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(ws, t) THEN 4 ELSE 0 END + (length(n) - length(replace(n, t, ''))) // length(t)
    + CASE WHEN length(t) > 3 AND len(list_filter(ws, lambda w: length(w) > 3 AND (starts_with(w, t) OR starts_with(t, w)))) > 0 THEN 1 ELSE 0 END))"""
MANY = CHUNKS + f""",
    item AS (SELECT concat_ws(':', CAST(doc_id AS VARCHAR), '1', CAST(chunk_index AS VARCHAR)) AS chunk_id, doc_id, text, {norm('text')} AS n, {_INDEXED} AS words FROM chunk),
    corpus AS (SELECT count(*) AS n_chunks, sum(len(words)) AS n_words FROM item),
    ask AS (SELECT item_id AS q, text AS question, {norm('text')} AS n FROM benchmark),
    planned AS (
        SELECT q, question, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]), lambda z: z[1]) AS terms, {some('n', rules.ASKS_AMOUNT)} AS amount, {some('n', rules.ASKS_DATE)} AS date, {some('n', rules.ASKS_LATEST)} AS latest
        FROM (SELECT q, question, n, list_filter(string_split(n, ' '), lambda w: length(w) > 1) AS ws FROM ask)
    ),
    search AS (SELECT DISTINCT q, unnest({_SEARCHED}) AS term FROM (SELECT q, unnest(list_filter(terms[1:12], lambda t: length(t) >= 2)) AS t FROM planned)),
    tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(words) AS dl, unnest(words) AS term FROM item) WHERE term IN (SELECT term FROM search) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    word_score AS (
        SELECT q, chunk_id, round(sum(greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (n_words / n_chunks)))), 12) AS bm25
        FROM search JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY q, chunk_id
    ),
    own AS ({hashed('ask', 'q', 'n')}),
    vec AS ({hashed('item', 'chunk_id', 'n')}),
    near AS (
        SELECT q, chunk_id, dot / (sqrt(a.size) * sqrt(b.size)) AS sim FROM (SELECT q, chunk_id, sum(vec.weight * own.weight) AS dot FROM vec JOIN own USING (dim) GROUP BY q, chunk_id)
        JOIN (SELECT chunk_id, sum(weight * weight) AS size FROM vec GROUP BY chunk_id) a USING (chunk_id) JOIN (SELECT q, sum(weight * weight) AS size FROM own GROUP BY q) b USING (q)
    ),
    w60 AS (SELECT q, chunk_id, 2.0 + greatest(bm25, 0) AS score FROM word_score QUALIFY row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, chunk_id) <= 60),
    v60 AS (SELECT q, chunk_id, 1.5 + 3.0 * sim AS near FROM near WHERE sim > 0.18 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, chunk_id) <= 60),
    fused AS (SELECT q, chunk_id, coalesce(score, 0) + coalesce(near, 0) AS score, CASE WHEN near IS NULL THEN 'bm25' WHEN score IS NULL THEN 'vector' ELSE 'bm25+vector' END AS retrieval FROM w60 FULL JOIN v60 USING (q, chunk_id)),
    scored AS (
        SELECT q AS id, chunk_id, text, retrieval, 'Document ' || CAST(doc_id AS VARCHAR) AS title,
            round(score + least(3.0, 0.08 * {_POINTS}) + CASE WHEN amount AND regexp_matches(text, '(?i)(?:AED|د\\.إ|درهم|total|amount|اجمالي|مبلغ|\\p{{Nd}}+[,.]?\\p{{Nd}}*)') THEN 0.9 ELSE 0 END
                + CASE WHEN NOT amount AND date AND regexp_matches(text, '(?i)20\\p{{Nd}}{{2}}|\\p{{Nd}}{{1,2}}[-/.]\\p{{Nd}}{{1,2}}|expiry|due|انتهاء|تاريخ') THEN 0.7 ELSE 0 END + CASE WHEN latest THEN 0.15 ELSE 0 END, 9) AS score
        FROM fused JOIN (SELECT *, string_split(n, ' ') AS ws FROM item) USING (chunk_id) JOIN planned USING (q)
    ),
    top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS place FROM scored QUALIFY place <= 8),
    answer AS (
        SELECT q AS id, concat_ws(chr(10), 'Closest matches from your archive:', string_agg('[' || CAST(place AS VARCHAR) || '] ' || title || ' - page 1: ' || substr(text, 1, 360) || '...', chr(10) ORDER BY place)) AS answer
        FROM ask LEFT JOIN (SELECT * FROM top WHERE place <= 4) ON id = q GROUP BY q
    )"""


def snippet(x: str, source: str) -> str:
    clean = f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}+', ' ', 'g'))"
    at = "coalesce(" + ", ".join(f"nullif(strpos(n, {s(t)}), 0)" for t in QUESTION_TERMS) + ")"
    return f"""SELECT *, substr(clean, b + 1, 360) || CASE WHEN length(clean) > b + 360 THEN '...' ELSE '' END AS snippet
        FROM (SELECT *, CASE WHEN {at} IS NULL THEN 0 ELSE greatest(0, least(length(clean), {at} - 1) - 100) END AS b FROM (SELECT *, {norm('clean')} AS n FROM (SELECT *, {clean} AS clean FROM {source})))"""


# --- business documents -------------------------------------------------------------------


def _filled(template: str) -> str:
    values = {"key": "k", "key9": "lpad(k, 9, '0')", "company": "'Firm ' || c_name", "money": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "date": "strftime(o_orderdate, '%Y-%m-%d')", "due": "strftime(o_orderdate, '%d/%m/%Y')", "year": "strftime(o_orderdate, '%Y')", "lines": "CAST(coalesce(n_lines, 0) AS VARCHAR)"}
    out, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            out.append(s(before).replace("\n", "' || chr(10) || '"))
        if brace:
            name, _, rest = after.partition("}")
            out.append("(" + values[name] + ")")
        else:
            break
    return " || ".join(out)


def _rendered() -> str:
    from papyra.sources.rendered import NAMES, TEMPLATES

    pick = lambda table: "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {_filled(t)}" for k, t in enumerate(table)) + " END"
    return f"""rendered AS (
        SELECT o_orderkey AS doc_id, {pick(NAMES)} AS name, {pick(TEMPLATES)} AS text, o_orderdate AS made
        FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders) JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    )"""


_PRE, _SUF = f"{rules.CURRENCY}\\s*({rules.NUMBER})", f"({rules.NUMBER})\\s*{rules.CURRENCY}"
_ARTICLES = "(?i)(?:الماد[ةه]|article)\\s*\\(?\\s*\\p{Nd}+\\s*\\)?"
_WORDLY = "[\\p{L}\\p{Nl}\\p{No}]"
_LAW = "(?i)(?:law|decree|resolution|regulation|rules|قانون|مرسوم|قرار|لائح|نظام)"
_YEARS = "list_max(list_transform(regexp_extract_all(' ' || regexp_replace({x}, '([0-9]+)', ' \\1 ', 'g'), ' ((?:19|20)[0-9]{{2}}) ', 1), lambda y: CAST(y AS INTEGER)))"
_TOTAL_LINE = f"({rules.NUMBER})\\s*{rules.CURRENCY}|{rules.CURRENCY}\\s*({rules.NUMBER})|({rules.NUMBER})\\s*$"
_TOTAL = "(?i)(?:grand\\s*total|total\\s*(?:due|amount)?|الاجمالي|الإجمالي|المجموع|المبلغ\\s*الاجمالي|المبلغ\\s*المستحق|صافي)"


def _business() -> str:
    law_line = f"length(l) BETWEEN 12 AND 140 AND regexp_matches(l, {s(_WORDLY)}) AND NOT {garbled('l')} AND ({some(norm('l'), ['federal law', 'decree law', 'law no', 'decree no', 'official gazette'])} OR regexp_matches(l, {s(_LAW)}))"
    each = lambda p, g=1: f"regexp_extract_all(text, {s('(?i)' + p)}, {g})"
    both = f"{_PRE}|{_SUF}"
    return f"""{_rendered()},
    typed AS (
        SELECT *, CASE WHEN {some('n', rules.LEGISLATION)} OR ({times('text', _ARTICLES)} >= 12 AND NOT {some('n', rules.PARTIES)}) THEN 'legal' ELSE {rule('n', rules.DOC_TYPES, "'general'")} END AS doc_type
        FROM (SELECT *, {norm("text || ' ' || name")} AS n FROM rendered)
    ),
    read AS (
        SELECT *, 'English' AS language, coalesce({each(_PRE)}[-1], {each(_SUF)}[-1]) AS amount,
            list_filter({lines('text')}[:12], lambda l: length(l) BETWEEN 2 AND 80 AND NOT {garbled('l')} AND regexp_matches(l, {s(_WORDLY)}))[1] AS company,
            CASE WHEN doc_type = 'legal' THEN list_filter({lines('text')}[:40], lambda l: {law_line})[1] END AS legal_title
        FROM typed
    ),
    dated AS (
        SELECT *, coalesce(
                CASE WHEN doc_type = 'legal' AND coalesce({_YEARS.format(x="coalesce(legal_title, '')")}, {_YEARS.format(x='substr(text, 1, 1500)')}) BETWEEN 1950 AND 2026
                    THEN CAST(coalesce({_YEARS.format(x="coalesce(legal_title, '')")}, {_YEARS.format(x='substr(text, 1, 1500)')}) AS VARCHAR) END,
                {', '.join(first('text', p) for p in rules.DATES)}) AS date_guess,
            CASE WHEN doc_type = 'legal' AND legal_title IS NOT NULL THEN legal_title ELSE
                array_to_string(list_transform(string_split(trim(translate(regexp_replace(name, '(.)\\.[^.]*$', '\\1'), '_-', '  ')), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END AS title
        FROM read
    ),
    whole AS (
        SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean,
            list_transform(list_zip({each(both, 1)}, {each(both, 2)}), lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END) AS found,
            list_filter({lines('text')}, lambda l: regexp_matches(l, {s(_TOTAL)}) AND regexp_matches(l, {s('(?i)' + _TOTAL_LINE)}))[1] AS total_line,
            strftime(made, '%Y-%m') AS file_ym
        FROM dated
    ),
    business AS (
        SELECT *, upper(doc_type[1:1]) || doc_type[2:] || ' document' || coalesce(' from ' || company, '') || ' (' || concat_ws(', ', 'date: ' || date_guess, 'amount: ' || amount, 'language: English') || '). '
                || substr(clean, 1, 420) || CASE WHEN length(clean) > 420 THEN '...' ELSE '' END AS summary,
            {norm("text || ' ' || title")} AS norm,
            CASE WHEN regexp_matches(coalesce(date_guess, ''), '^\\s*(?:19|20)[0-9]{{2}}\\s*$') THEN trim(date_guess) || '-01' ELSE coalesce(
                regexp_extract(date_guess, '(20[0-9]{{2}})[-/.]([0-9]{{1,2}})', 1) || '-' || lpad(CAST(TRY_CAST(nullif(regexp_extract(date_guess, '(20[0-9]{{2}})[-/.]([0-9]{{1,2}})', 2), '') AS INTEGER) AS VARCHAR), 2, '0'),
                regexp_extract(date_guess, '([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.](20[0-9]{{2}})', 3) || '-' || lpad(CAST(TRY_CAST(nullif(regexp_extract(date_guess, '([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.](20[0-9]{{2}})', 2), '') AS INTEGER) AS VARCHAR), 2, '0'),
                file_ym) END AS ym
        FROM whole
    )"""


def file_name(x: str) -> str:
    y = f"regexp_replace(regexp_replace(translate(coalesce({x}, ''), 'ـ', ''), '[^A-Za-z0-9{AR}_.-]+', '_', 'g'), '_+', '_', 'g')"
    return f"coalesce(nullif(regexp_replace({y}, '^[_.-]+|[_.-]+$', '', 'g'), ''), 'document')"


def _filed() -> str:
    case = lambda table, other: "CASE doc_type " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in table.items()) + f" ELSE {s(other)} END"
    law = f"CASE {' '.join(f'WHEN {some("head", w)} THEN {s(n)}' for n, w in rules.LEGAL_SUBTYPES)} WHEN {some('head', rules.LAW_TITLE)} THEN 'Laws' {' '.join(f'WHEN {some("hay", w)} THEN {s(n)}' for n, w in rules.LEGAL_SUBTYPES)} ELSE 'Other Legal' END"
    return f"""{_business()},
    firms AS (SELECT firm, count(*) AS firm_n FROM (SELECT substr({file_name('trim(company)')}, 1, 40) AS firm FROM business WHERE doc_type IN ('invoice', 'receipt', 'bank', 'contract') AND trim(coalesce(company, '')) <> '') GROUP BY firm),
    sub AS (
        SELECT *, CASE WHEN doc_type IN ('invoice', 'receipt') THEN {rule('hay', rules.PROVIDERS, "'General'")} WHEN doc_type = 'legal' THEN {law} ELSE substr(ym, 1, 4) END AS subcategory,
            {case(rules.CATEGORIES, 'Other')} AS category, {case(rules.TYPE_CODES, 'doc')} AS code
        FROM (SELECT *, {norm("coalesce(company, '') || ' ' || title || ' ' || summary || ' ' || substr(norm, 1, 2000)")} AS hay, {norm('title')} AS head,
            CASE WHEN trim(coalesce(company, '')) = '' THEN '' ELSE substr({file_name('trim(company)')}, 1, 40) END AS firm FROM business)
    ),
    named AS (
        SELECT sub.*, substr({file_name("CASE WHEN doc_type = 'legal' THEN code || '_' || substr(" + file_name('title') + ", 1, 60) || '_' || substr(ym, 1, 4) ELSE code || '_' || coalesce(nullif(sub.firm, ''), 'unknown') || '_' || ym END")}, 1, 140) || regexp_extract(lower(name), '\\.[^.]+$') AS file,
            CASE WHEN doc_type = 'legal' THEN concat_ws('/', category, subcategory, substr(ym, 1, 4))
                 WHEN doc_type IN ('invoice', 'receipt', 'bank', 'contract') AND firm_n >= 3 THEN concat_ws('/', category, subcategory, substr(sub.firm, 1, 30)) ELSE concat_ws('/', category, subcategory) END AS folder
        FROM sub LEFT JOIN firms ON firms.firm = sub.firm
    )"""


_B, _F = "WITH " + _business(), "WITH " + _filed()
_Q = f"SELECT id, body, {points('body')} AS p FROM ({READINGS})"
_STATES = f"""states AS (
    SELECT doc_id, CASE WHEN doc_id <> original THEN 'duplicate' WHEN label IN ('empty', 'poor') THEN 'needs_ocr' ELSE 'indexed' END AS status, CASE WHEN doc_id % 10 <> 0 THEN label END AS ocr_quality
    FROM (SELECT doc_id, {label('text', points('text'))} AS label, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents)
)"""
_DOCS = "SELECT *, make_timestamp((1700000000 + (doc_id * 7919) % 1000003) * 1000000) AS updated_at FROM documents"
_ASKED = "text || ' ' || ['total bill', 'passport expiry date', 'latest rent', 'price of clinic', ''][conv_id % 5 + 1]"
_WANTS = f"(trim(t0) = '' OR {label('t0', points('t0'))} IN ('empty', 'poor') OR conf < 65 OR (regexp_matches(t0, '[{AR}]') AND {label('t0', points('t0'))} = 'medium'))"
_UNSURE = f"(trim(t0) = '' OR conf < 65 OR {label('t0', points('t0'))} IN ('empty', 'poor'))"


def _wins(t: str) -> str:
    return f"(trim({t}) <> '' AND ({points(t)} >= {points('t0')} OR ({_UNSURE} AND length(trim({t})) >= 20 AND NOT {garbled(t)})))"


_MODELLED = """m AS (SELECT vec_id, ['multilingual-e5-small', 'local-hash-384', 'some-model'][vec_id % 3 + 1] AS model, embedding AS e, vec_id % 50 = 7 AS failed FROM embeddings),
    sim AS (SELECT vec_id, model, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(q AS DOUBLE[])) AS cosine FROM m, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE NOT failed)"""
#: Written out again, as the catalogue imports this module.
_FORMS = "(SELECT doc_id, text FROM documents UNION ALL VALUES (-1, 'ﻻ ﬁne １２３ ＡＢＣ'), (-2, 'ﻋﻘﺪ اﻹيجار ٢٠٢٤'), (-3, 'ﬂat ½ №５ ①'), (-4, 'ｒｅｎｔ ﷺ'))"
#: The same, of the catalogue's EASTERN.
_EASTERN = f"""(SELECT * FROM (VALUES (-1, {s(chr(10).join(f"المادة ({d}) نص" for d in "١٢٣٤٥٦٧٨٩٠١٢٣"))}), (-2, '٢٠٢٤/٠٥/٠١' || chr(10) || 'شركة النور للتجارة' || chr(10) || '١٢'), (-3, '؟؟؟ ????? ١٢٣'), (-4, '١٢٣٤٥٦٧٨٩٠'), (-5, 'المادة ٣ و المادة ٤')) v(doc_id, text))"""
ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, {norm(folded('text'))} AS norm FROM {_FORMS}",
    "normalize_digits": "SELECT conv_id, turn, text AS digits, text AS wide FROM conversations",
    "token_count": f"SELECT doc_id, CAST({tokens('text')} AS BIGINT) AS tokens FROM documents",
    "text_quality": f"SELECT id, CAST(p AS BIGINT) AS points, {label('body', 'p')} AS label FROM ({_Q})",
    "garbled_flag": f"SELECT id, {garbled('body')} AS garbled FROM ({READINGS} UNION ALL SELECT * FROM {_EASTERN})",
    "needs_ocr": f"SELECT id, length(x) < 25 OR {garbled('x')} AS needs_ocr FROM (SELECT id, {strip('body')} AS x FROM ({READINGS}))",
    "detect_language": f"SELECT id, CASE WHEN a AND l THEN 'Arabic + English' WHEN a THEN 'Arabic' WHEN l THEN 'English' ELSE 'unknown' END AS language FROM (SELECT id, regexp_matches(coalesce(body, ''), '[{AR}]') AS a, regexp_matches(coalesce(body, ''), '[A-Za-z]') AS l FROM ({READINGS}))",
    "char_trigrams": f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS gram FROM (SELECT unnest(string_split({norm('text')}, ' ')) AS w FROM benchmark)) GROUP BY gram",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "keyword_match": f"SELECT doc_id, {', '.join(f'{keyword("n", k)} AS hit_{i}' for i, k in enumerate(['the', 'license', 'apache license', 'rent', 'عقد', 'de la']))} FROM (SELECT doc_id, {norm(folded('text'))} AS n FROM {_FORMS})",
    "query_expand": f"SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]), lambda z: z[1]), ' ') AS terms FROM (SELECT conv_id, turn, list_filter(string_split({norm('text')}, ' '), lambda w: length(w) > 1) AS ws FROM conversations WHERE role = 'user')",
    "query_plan": f"SELECT conv_id, turn, {rule('n', rules.INTENTS, 'NULL')} AS doc_type, CASE WHEN {some('n', rules.ASKS_AMOUNT)} THEN 'amount' WHEN {some('n', rules.ASKS_DATE)} THEN 'date' END AS field, CASE WHEN {some('n', rules.ASKS_LATEST)} THEN 'latest' END AS sort FROM (SELECT conv_id, turn, {norm(_ASKED)} AS n FROM conversations WHERE role = 'user')",
    "lexical_score": f"SELECT item_id, CAST({_SCORE} AS BIGINT) AS points FROM (SELECT item_id, n, string_split(n, ' ') AS ws FROM (SELECT item_id, {norm('text')} AS n FROM benchmark))",
    "snippets": f"SELECT doc_id, snippet FROM ({snippet('text', 'documents')})",
    "split_blocks": f"WITH {BLOCKS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS block, text FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS text FROM parts)",
    "chunk_documents": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, text, token_count FROM chunk",
    "chunks_documents_join": f"WITH RECURSIVE {CHUNKS} SELECT source, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens, count(DISTINCT doc_id) AS n_documents FROM chunk JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source",
    "bm25_doc_stats": f"WITH RECURSIVE {CHUNKS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest({_INDEXED}) AS term FROM chunk) GROUP BY ALL) GROUP BY term",
    "bm25_topk": f"WITH RECURSIVE {RETRIEVAL} SELECT chunk_id, round(bm25, 9) AS bm25 FROM word_score ORDER BY round(bm25, 9) DESC, chunk_id LIMIT 60",
    "hash_embedding": f"SELECT item_id, dim, CAST(weight AS BIGINT) AS weight FROM ({hashed('(SELECT item_id, ' + norm('text') + ' AS n FROM benchmark)', 'item_id', 'n')})",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "knn_cosine": "SELECT vec_id, cosine FROM (SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY cosine DESC, vec_id LIMIT 60",
    "vector_threshold": "SELECT vec_id, round(1.5 + 3.0 * cosine, 6) AS score FROM (SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE cosine > 0.18",
    "knn_by_model": f"WITH {_MODELLED} SELECT model, vec_id, round(cosine, 6) AS cosine FROM sim QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(cosine, 6) DESC, vec_id) <= 60",
    "model_scores": f"WITH {_MODELLED} SELECT model, vec_id, round(CASE WHEN model = 'multilingual-e5-small' THEN 1.5 + (cosine - 0.75) * 10.0 ELSE 1.5 + cosine * 3.0 END, 6) AS score FROM sim WHERE cosine > CASE model WHEN 'multilingual-e5-small' THEN 0.78 WHEN 'local-hash-384' THEN 0.18 ELSE 0.12 END",
    "embedding_errors": f"WITH {_MODELLED} SELECT CASE WHEN failed THEN 'embedding-error:timeout' ELSE model END AS model, CAST(CASE WHEN failed THEN 0 ELSE len(e) END AS INTEGER) AS dims, count(*) AS n FROM m GROUP BY ALL",
    "hybrid_fusion": f"WITH RECURSIVE {RETRIEVAL} SELECT chunk_id, round(score, 6) AS score, retrieval FROM fused",
    "rerank": f"WITH RECURSIVE {RETRIEVAL} SELECT chunk_id, round(score, 6) AS score FROM scored",
    "hybrid_search": f"WITH RECURSIVE {RETRIEVAL} SELECT chunk_id, document_id, title, round(score, 6) AS score, retrieval FROM top",
    "ranked_from_outside": f"WITH RECURSIVE {RETRIEVAL} SELECT chunk_id, row_number() OVER (ORDER BY CASE WHEN document_id % 2 = 0 THEN -document_id END NULLS LAST, score DESC, chunk_id) AS rank, round(score, 6) AS score FROM top",
    "supported_answers": f"""SELECT item_id, len(w) = 0 OR len(list_filter(w, lambda x: list_contains(e, x))) >= 0.6 * len(w) AS supported FROM (
        SELECT item_id, string_split({norm('text')}, ' ') AS e, list_filter(list_distinct(string_split({norm('answer')}, ' ')), lambda x: length(x) > 3 OR regexp_matches(x, '\\p{{Nd}}')) AS w
        FROM (SELECT a.item_id, a.text, substr(CASE WHEN a.item_id % 3 = 0 AND b.text IS NOT NULL THEN b.text ELSE a.text END, 1, 200) AS answer FROM benchmark a LEFT JOIN benchmark b ON b.item_id = a.item_id + 1))""",
    "best_chunk_per_doc": f"WITH RECURSIVE {RETRIEVAL} SELECT document_id, chunk_id, round(score, 6) AS score FROM top QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) = 1",
    "document_search": f"WITH RECURSIVE {RETRIEVAL}, best AS (SELECT * FROM (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) = 1) ORDER BY score DESC, chunk_id LIMIT 10) SELECT document_id, title, round(score, 6) AS score, snippet FROM ({snippet('text', "(SELECT * FROM best JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = document_id WHERE contains(lang, 'e'))")})",
    "ask_sources": f"WITH RECURSIVE {RETRIEVAL} SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS source, document_id, title, 1 AS page, substr(text, 1, 650) AS snippet FROM top ORDER BY score DESC, chunk_id LIMIT 8",
    "extractive_answer": f"WITH RECURSIVE {RETRIEVAL} SELECT 'Closest matches from your archive:' || chr(10) || string_agg('[' || CAST(i AS VARCHAR) || '] ' || title || ' - page 1: ' || substr(text, 1, 360) || '...', chr(10) ORDER BY i) AS answer FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS i FROM top) WHERE i <= 4",
    "highlight_words": f"SELECT document_id, position, t FROM (SELECT document_id, CAST(i - 1 AS INTEGER) AS position, t, {norm('t')} AS w FROM (SELECT item_id AS document_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS t FROM (SELECT item_id, regexp_split_to_array(text, '\\s+') AS ws FROM benchmark))) WHERE w <> '' AND ({' OR '.join(f"contains(w, {s(t)}) OR (length(w) > 2 AND contains({s(t)}, w))" for t in QUESTION_TERMS)})",
    "rag_eval": f"""SELECT id, e AS expected_ok, c AS cite_ok, e AND c AS pass FROM (
        SELECT item_id AS id, contains({norm("CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 20) ELSE '>> ' || text END")}, {norm('substr(text, 1, 40)')}) AS e,
            contains('item ' || CAST(item_id + CASE WHEN item_id % 5 = 0 THEN 1000 ELSE 0 END AS VARCHAR) || ' benchmark', 'item ' || CAST(item_id AS VARCHAR)) AS c FROM benchmark)""",
    "search_many": f"WITH RECURSIVE {MANY} SELECT id, CAST(place AS BIGINT) AS place, chunk_id, round(score, 6) AS score, retrieval FROM top",
    "ask_many": f"WITH RECURSIVE {MANY} SELECT id, answer FROM answer",
    "rag_eval_retrieved": f"""WITH RECURSIVE {MANY} SELECT id, e AS expected_ok, c AS cite_ok, e AND c AS pass FROM (
        SELECT answer.id, contains({norm('answer')}, {norm('substr(question, 1, 40)')}) AS e, EXISTS (SELECT 1 FROM top WHERE top.id = answer.id AND contains(lower(title), 'document ' || CAST(answer.id AS VARCHAR))) AS c FROM answer JOIN ask ON q = answer.id)""",
    "classify_documents": _B + " SELECT doc_id, doc_type, language FROM business",
    "extract_date": _B + " SELECT doc_id, date_guess FROM business",
    "extract_amount": _B + " SELECT doc_id, amount FROM business",
    "extract_company": _B + f" SELECT doc_id, company FROM business UNION ALL SELECT doc_id, list_filter({lines('text')}[:12], lambda l: length(l) BETWEEN 2 AND 80 AND NOT {garbled('l')} AND regexp_matches(l, {s(_WORDLY)}))[1] FROM {_EASTERN}",
    "structured_fields": _B + f""" SELECT doc_id, title, coalesce(amount, found[-1]) AS amount, {first('text', 'invoice\\s*(?:no|number|#)\\s*[:#-]?\\s*([A-Z0-9\\-/]+)')} AS invoice_number,
        nullif(substr(regexp_replace({first('text', '(?:due\\s*date|expiry\\s*date)\\s*[:#-]?\\s*([0-9A-Za-z\\-/\\.\\s]+)')}, '^\\s+|\\s+$', '', 'g'), 1, 60), '') AS due_or_expiry_date,
        CASE WHEN len(found) > 0 THEN array_to_string(found[-8:], ';') END AS amounts_found, {first('text', '(' + rules.CURRENCY + ')')} AS currency,
        coalesce({', '.join(first('total_line', _TOTAL_LINE, k) for k in (1, 2, 3))}) AS total, {first('text', '(?:vat\\s*(?:no|number|reg(?:istration)?)?|tax\\s*(?:no|number))\\s*[:#.]?\\s*([0-9]{9,15})')} AS vat_number,
        substr(regexp_replace({first('text', 'iban\\s*[:#-]?\\s*([A-Z]{2}\\s?[0-9]{2}[0-9A-Z\\s]{10,32})')}, '\\s+', '', 'g'), 1, 34) AS iban,
        CASE WHEN doc_type = 'contract' THEN {first('text', f'(?:rent|annual rent)\\s*[:#-]?\\s*({rules.NUMBER}\\s*{rules.CURRENCY}?)')} END AS rent_amount,
        CASE WHEN doc_type IN ('id', 'legal', 'contract') AND len(regexp_extract_all(text, '(?i)name\\s*[:#-]?\\s*([^\\n]{{3,80}})', 1)) > 0 THEN array_to_string(list_transform(regexp_extract_all(text, '(?i)name\\s*[:#-]?\\s*([^\\n]{{3,80}})', 1)[:6], lambda x: trim(x)), ';') END AS names_found
        FROM business""",
    "summarize": _B + " SELECT doc_id, summary, array_to_string(list_sort(list_distinct(list_filter([doc_type, 'english', CASE WHEN amount IS NOT NULL THEN 'amount' END, CASE WHEN date_guess IS NOT NULL THEN 'date' END], lambda x: x IS NOT NULL))), ',') AS tags FROM business",
    "parse_date_ym": _B + " SELECT doc_id, ym FROM business",
    "filing_category": _F + " SELECT category, count(*) AS n FROM named GROUP BY category",
    "filing_subcategory": _F + " SELECT doc_type, subcategory, count(*) AS n FROM named GROUP BY ALL",
    "filing_plan": _F + " SELECT doc_id, folder, file, folder || '/' || file AS relative FROM named",
    "filing_tree": _F + " SELECT folder, count(*) AS n FROM named GROUP BY folder",
    "filing_collisions": _F + """, c AS (SELECT doc_id, category || '/' || doc_type || '_' || ym || '.pdf' AS relative, CASE WHEN doc_id % 20 = 1 THEN 'same' ELSE CAST(doc_id AS VARCHAR) END AS content FROM named),
        f AS (SELECT relative, content, min(doc_id) AS first FROM c GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY relative ORDER BY first) AS n FROM f)
        SELECT doc_id, CASE WHEN n = 1 THEN relative ELSE replace(relative, '.pdf', '-' || CAST(n AS VARCHAR) || '.pdf') END AS target, CASE WHEN doc_id = first THEN 'copy' ELSE 'already-exists' END AS action FROM c JOIN g USING (relative, content)""",
    "company_counts": _F + " SELECT firm AS company_name, firm_n AS n FROM firms",
    "normalize_filename": f"SELECT page_id, {file_name('url')} AS file FROM pages",
    "archive_export": _B + f" SELECT doc_id, title, doc_type, language, company, date_guess, amount, CASE WHEN trim(text) = '' THEN 'needs_ocr' ELSE 'indexed' END AS status, {label('text', points('text'))} AS ocr_quality, '/inbox/' || name AS path, substr(summary, 1, 500) AS summary, nullif(substr(regexp_replace({first('text', '(?:due\\s*date|expiry\\s*date)\\s*[:#-]?\\s*([0-9A-Za-z\\-/\\.\\s]+)')}, '^\\s+|\\s+$', '', 'g'), 1, 60), '') AS due_or_expiry_date, substr(regexp_replace({first('text', 'iban\\s*[:#-]?\\s*([A-Z]{2}\\s?[0-9]{2}[0-9A-Z\\s]{10,32})')}, '\\s+', '', 'g'), 1, 34) AS iban, {first('text', 'invoice\\s*(?:no|number|#)\\s*[:#-]?\\s*([A-Z0-9\\-/]+)')} AS invoice_number, coalesce({', '.join(first('total_line', _TOTAL_LINE, k) for k in (1, 2, 3))}) AS total, {first('text', '(' + rules.CURRENCY + ')')} AS currency, {first('text', '(?:vat\\s*(?:no|number|reg(?:istration)?)?|tax\\s*(?:no|number))\\s*[:#.]?\\s*([0-9]{9,15})')} AS vat_number FROM business",
    "dedup_exact": "SELECT doc_id, CASE WHEN doc_id = original THEN 'indexed' ELSE 'duplicate' END AS status, original FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents)",
    "status_counts": f"WITH {_STATES} SELECT count(*) AS documents, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status <> 'indexed') AS needs_review, count(*) FILTER (status = 'needs_ocr') AS needs_ocr, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (coalesce(ocr_quality, 'unknown') = 'good') AS quality_good, count(*) FILTER (coalesce(ocr_quality, 'unknown') = 'medium') AS quality_medium, count(*) FILTER (coalesce(ocr_quality, 'unknown') = 'poor') AS quality_poor, count(*) FILTER (coalesce(ocr_quality, 'unknown') = 'empty') AS quality_empty, count(*) FILTER (coalesce(ocr_quality, 'unknown') = 'unknown') AS quality_unknown, (SELECT count(*) FROM pages) AS folders, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM embeddings WHERE len(embedding) > 0) AS embeddings, (SELECT count(*) FROM conversations WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) AS fts_rows FROM states",
    "quality_histogram": f"WITH {_STATES} SELECT coalesce(ocr_quality, 'unknown') AS quality, count(*) AS n FROM states GROUP BY 1",
    "browse_filter": f"SELECT doc_id, 'Lang-' || upper(lang) AS language, 'Document ' || CAST(doc_id AS VARCHAR) AS title FROM ({_DOCS}) WHERE contains(lower('Lang-' || upper(lang)), 'lang-e') ORDER BY updated_at DESC, doc_id LIMIT 50",
    "documents_page": f"SELECT doc_id, 'Document ' || CAST(doc_id AS VARCHAR) AS title FROM ({_DOCS}) ORDER BY updated_at DESC, doc_id LIMIT 25 OFFSET 50",
    "distinct_pages": f"SELECT DISTINCT conv_id, turn FROM conversations WHERE contains({norm('text')}, 'the')",
    "upsert_latest": "SELECT '/c/' || CAST(o_custkey AS VARCHAR) AS path, o_orderkey, o_totalprice AS amount, min(o_orderdate) OVER (PARTITION BY o_custkey) AS created_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "cascade_delete": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL",
    "longest_prefix_join": """WITH f AS (SELECT lower(path) AS path, t FROM (VALUES ('/', 'any'), ('/M.', 'mobile'), ('/th', 'th'), ('/the', 'the'), ('/theR', 'ther'), ('/in', 'in'), ('/www.', 'www'), ('/oN', 'on')) v(path, t))
        SELECT page_id, arg_max(t, length(f.path)) AS default_type FROM (SELECT page_id, lower(regexp_replace(url, '^https?:/', '')) AS p FROM pages) LEFT JOIN f ON starts_with(p, f.path) GROUP BY page_id""",
    "engine_select": f"""SELECT doc_id, CASE WHEN {_WANTS} AND doc_id % 2 = 0 AND {_wins('t1')} THEN 'ollama:fallback-from-' || e0 WHEN {_WANTS} AND {_wins('t2')} THEN 'azure:fallback-from-' || e0 ELSE e0 END AS engine,
        sha256(CASE WHEN {_WANTS} AND doc_id % 2 = 0 AND {_wins('t1')} THEN t1 WHEN {_WANTS} AND {_wins('t2')} THEN t2 ELSE t0 END) AS sha256
        FROM (SELECT doc_id, doc_id % 90 + 10 AS conf, 'tesseract:conf' || CAST(doc_id % 90 + 10 AS VARCHAR) AS e0, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'etaoin', '??????') ELSE text END AS t0, translate(text, 'e', '?') AS t1, substr(text, 1, 300) AS t2 FROM documents)""",
    "grid_choice": f"""WITH RECURSIVE reading AS (
            SELECT doc_id, angle, step, body, CASE WHEN doc_id % 11 = 3 THEN NULL ELSE list_transform(list_slice(string_split(body, ' '), 1, 6), lambda w, i: {{'t': w, 'c': (doc_id * 7 + step * 13 + angle + (i - 1) * 5) % 110 - 10}}) END AS words
            FROM (
                SELECT doc_id, angle, step, CASE (step + CASE WHEN angle > 0 THEN 2 ELSE 0 END + doc_id) % 6 WHEN 0 THEN translate(text, 'etaoin', '??????') WHEN 1 THEN translate(text, 'eta', '???') WHEN 2 THEN text WHEN 3 THEN translate(text, 'e', '?') WHEN 4 THEN translate(text, 'etaoinshr', '?????????') ELSE translate(text, 'a', '?') END AS body
                FROM documents, (SELECT unnest([{{'angle': 0, 'step': 0}}, {{'angle': 0, 'step': 1}}, {{'angle': 0, 'step': 2}}, {{'angle': 0, 'step': 3}}, {{'angle': 0, 'step': 4}}, {{'angle': 0, 'step': 5}}, {{'angle': 90, 'step': 0}}, {{'angle': 90, 'step': 1}}, {{'angle': 90, 'step': 2}}], recursive := true))
            )
        ),
        known AS (SELECT *, list_filter(words, lambda w: trim(w.t) <> '' AND w.c >= 0) AS sure, {points('body')} AS points FROM reading),
        scored AS (SELECT doc_id, angle, step, body, words, points, {label('body', 'points')} AS label, CASE WHEN words IS NULL THEN -1.0 WHEN len(sure) = 0 THEN 0.0 ELSE list_sum(list_transform(sure, lambda w: w.c)) / len(sure) END AS conf FROM known),
        record AS (SELECT *, points > greatest(0, coalesce(max(points) OVER (PARTITION BY doc_id, angle ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS leads FROM scored),
        won AS (SELECT * FROM record WHERE leads QUALIFY row_number() OVER (PARTITION BY doc_id, angle ORDER BY CASE WHEN label = 'good' AND (conf < 0 OR conf >= 60) THEN step ELSE 1000 - step END) = 1),
        pair AS (
            SELECT d.doc_id, s.step, s.body, s.words, s.conf, t.step AS t_step, t.body AS t_body, t.conf AS t_conf,
                coalesce((s.doc_id IS NULL OR s.label IN ('empty', 'poor') OR (s.conf >= 0 AND s.conf < 50)) AND ((t.conf >= 0 AND t.conf > greatest(coalesce(s.conf, 0), 0) + 10) OR (t.conf < 0 AND t.points > coalesce(s.points, 0))), false) AS turn
            FROM documents d LEFT JOIN (SELECT * FROM won WHERE angle = 0) s ON s.doc_id = d.doc_id LEFT JOIN (SELECT * FROM won WHERE angle = 90) t ON t.doc_id = d.doc_id
        ),
        taken AS (SELECT doc_id, turn, words, coalesce(CASE WHEN turn THEN t_body ELSE body END, '') AS x, CASE WHEN turn THEN t_conf ELSE conf END AS c, CASE WHEN turn THEN t_step ELSE step END AS k FROM pair)
        SELECT doc_id, CASE WHEN trim(x) = '' THEN 'tesseract-no-text' ELSE 'tesseract:eng:psm' || CAST(k AS VARCHAR) || CASE WHEN k < 3 THEN ':plain' ELSE ':sharp' END || CASE WHEN turn THEN ':rot90' ELSE '' END || CASE WHEN c >= 0 THEN ':conf' || CAST(CAST(trunc(c) AS INTEGER) AS VARCHAR) ELSE '' END END AS engine,
            sha256(CASE WHEN trim(x) = '' THEN '' ELSE x END) AS sha256, CASE WHEN turn OR trim(x) = '' OR words IS NULL THEN 0 ELSE len(words) END AS boxes FROM taken""",
    "json_props": "SELECT event_type, count(*) AS n, count(k) AS known, CAST(sum(k) AS BIGINT) AS k_sum FROM (SELECT event_type, CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY event_type",
    "quality_rollup": f"SELECT lang, quality, count(*) AS n FROM (SELECT lang, {label('text', points('text'))} AS quality FROM documents) GROUP BY ROLLUP (lang, quality)",
    "event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "new_files": """WITH d AS (SELECT doc_id, '/f/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha FROM documents), k AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE sha END AS sha FROM d WHERE doc_id % 3 = 0)
        SELECT path, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE 'unchanged' END
            WHEN sha IN (SELECT sha FROM k) OR path > min(CASE WHEN doc_id % 3 <> 0 THEN path END) OVER (PARTITION BY sha) THEN 'duplicate' ELSE 'new' END AS status FROM d""",
    "legislation_flag": f"WITH {_rendered()} SELECT doc_id, {some('n', rules.LEGISLATION)} OR ({times('text', _ARTICLES)} >= 12 AND NOT {some('n', rules.PARTIES)}) AS legislation FROM (SELECT doc_id, text, {norm('text')} AS n FROM (SELECT doc_id, text FROM rendered UNION ALL SELECT * FROM {_EASTERN}))",
    "vision_fallback": f"SELECT doc_id, {label('text', points('text'))} IN ('empty', 'poor') OR doc_id % 100 < 65 OR (regexp_matches(text, '[{AR}]') AND {label('text', points('text'))} = 'medium') AS wants FROM documents",
    "engine_labels": "SELECT source, string_agg(e, ', ' ORDER BY e) AS engines FROM (SELECT DISTINCT source, ['text', 'ocr', 'word'][doc_id % 3 + 1] AS e FROM documents) GROUP BY source",
    "conversation_length": "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "embedding_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings",
}
ORACLE_SQL["scan_tally"] = f"SELECT status, count(*) AS n FROM ({ORACLE_SQL['new_files']}) GROUP BY status"
ORACLE_SQL["eval_pass_rate"] = f"SELECT count(*) AS total, count(*) FILTER (pass) AS passed, round(avg(CAST(pass AS INTEGER)), 6) AS share FROM ({ORACLE_SQL['rag_eval']})"
