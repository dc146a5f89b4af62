"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import conversations, decontam, host_rules, html_text, jaccard, langid, licenses, lm, mixing, near_vectors, quality, secret_scan, vector_codes
from papyra.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.digest(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_quality, op4_near_vectors, op5_language_id, op6_html_text, op7_jaccard_join, op8_mix_sources, op9_lm_scores, op10_license_scan, op11_conversation_repair, op12_vector_codes, op13_host_rules)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPACED = r"[^\x20\x09-\x0D]"


def _repair() -> str:
    """Damage by a checksum, then a walk over each conversation's rows that keeps the least (cost, audit, text) for what has been read: nothing (e), a system row (s), a user row (u), a pair (p)."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, n: xor(x >> 1, (x & 1) * 3988292384)))"
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    then = lambda x, cost, edit, line="''": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {line}}}"
    insert = lambda x, role: then(x, "2", "I", f"'{role}:' || chr(10)")
    def kept(x: str, initial: str, role: str) -> str:
        """A row kept as it is, or made one of ``role``, behind the state ``x``."""
        other = then(x, "2 + cut", "R", f"'{role}:' || text || chr(10)") if role else "{'c': 1000000000, 'a': '', 't': ''}"
        return f"CASE WHEN gone THEN {{'c': 1000000000, 'a': '', 't': ''}} WHEN role[1:1] = '{initial}' THEN {then(x, 'cut', 'K', "role || ':' || text || chr(10)")} ELSE {other} END"

    none, start = "{'c': 1000000000, 'a': '', 't': ''}", "{'c': 0, 'a': '', 't': ''}"
    return f"""
        WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        hashed AS (SELECT *, xor({crc}, 4294967295) % 20 AS h FROM keyed),
        broken AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, h FROM hashed WHERE h <> 0),
        damaged AS (SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE h = 3),
        placed AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '{_SPACED}') AS blank,
                right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS open
            FROM damaged
        ),
        item AS MATERIALIZED (
            SELECT *, blank OR seen AS gone, CASE WHEN open AND NOT blank AND NOT seen THEN 1 ELSE 0 END AS cut, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed)
        ),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
                sum(cut) AS truncated, count(*) FILTER (before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM item GROUP BY conv_id
        ),
        walk AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {start} AS e, {none} AS s, {none} AS u, {none} AS p FROM conversations
            UNION ALL
            SELECT conv_id, i + 1, {then('e', '3', 'D')},
                {least(then('s', '3', 'D'), kept('e', 's', ''))},
                {least(then('u1', '3', 'D'), kept('e', 'u', 'user'), kept('s', 'u', 'user'), kept('p1', 'u', 'user'))},
                {least(then('p1', '3', 'D'), kept('u1', 'a', 'assistant'))}
            FROM (
                SELECT *, {least('p', insert('u1', 'assistant'))} AS p1
                FROM (SELECT w.*, f.role, f.text, f.gone, f.cut, {least('u', insert('e', 'user'), insert('s', 'user'), insert('p', 'user'))} AS u1 FROM walk w JOIN item f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)
            )
        ),
        ended AS (SELECT w.conv_id, gaps, blank, duplicate, truncated, illegal, {least('e', 'p', insert('u', 'assistant'), insert(insert('s', 'user'), 'assistant').replace(insert('s', 'user'), 's2'))} AS best FROM (SELECT *, {insert('s', 'user')} AS s2 FROM walk) w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n, 0))
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(CASE WHEN best.t = '' THEN '' ELSE best.t[:-2] END) AS repaired_sha256
        FROM ended
    """


def _codes() -> str:
    """Whole numbers, parts by position, and the rounds written one after another."""
    size = f"CAST(((SELECT max(len(v)) FROM whole) + {vector_codes.PARTS - 1}) // {vector_codes.PARTS} AS BIGINT)"
    assign = lambda books: f"""SELECT r, vec_id, label, p, v, min(x) AS x FROM (
            SELECT r, vec_id, label, part.p, part.v, {{'d': CAST(coalesce(list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT), 'k': b.k}} AS x FROM part JOIN {books} b ON b.p = part.p
        ) GROUP BY r, vec_id, label, p, v"""  # noqa: E731
    rounds = "".join(f"""
        a{n} AS MATERIALIZED ({assign(f'b{n}')}),
        b{n + 1} AS MATERIALIZED (
            SELECT b{n}.p, b{n}.k, coalesce(m.v, b{n}.v) AS v FROM b{n} LEFT JOIN (
                SELECT p, k, list(CAST(floor_div AS BIGINT) ORDER BY i) AS v FROM (
                    SELECT p, x.k AS k, i, CASE WHEN sum(v[i]) >= 0 THEN sum(v[i]) // count(*) ELSE -((count(*) - 1 - sum(v[i])) // count(*)) END AS floor_div FROM (SELECT p, x, v, unnest(range(1, len(v) + 1)) AS i FROM a{n}) GROUP BY ALL
                ) GROUP BY p, k
            ) m ON m.p = b{n}.p AND m.k = b{n}.k
        ),""" for n in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
        WITH whole AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
                SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * {vector_codes.SCALE}) AS BIGINT)) AS v
                FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            )
        ),
        part AS MATERIALIZED (
            SELECT r, vec_id, label, p, v[p * s + 1:p * s + s] AS v
            FROM (SELECT r, vec_id, label, s, list_concat(v, list_transform(range(CAST(s * {vector_codes.PARTS} - len(v) AS BIGINT)), lambda i: CAST(0 AS BIGINT))) AS v, unnest(range({vector_codes.PARTS})) AS p FROM (SELECT *, {size} AS s FROM whole))
        ),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM part WHERE r <= {vector_codes.ENTRIES}),{rounds}
        a{last} AS MATERIALIZED ({assign(f'b{last}')}),
        coded AS (SELECT r, vec_id, label, string_agg(lpad(printf('%x', x.k), 2, '0'), '' ORDER BY p) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM a{last} GROUP BY r, vec_id, label),
        books AS (SELECT sha256(coalesce(string_agg(array_to_string(v, ','), ',' ORDER BY p, k), '')) AS codebooks_sha256 FROM b{last})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
    """


def _hosts() -> str:
    h, w = host_rules, host_rules.WINDOW
    low, high = h.WORD_LENGTH
    rule = lambda r: f"CAST(count(*) FILTER ({r}) AS BIGINT) AS {r}"
    sums = lambda r: f"sum({r}) AS {r}, sum(CAST({r} AS DOUBLE) * {r} / documents) AS {r}_q"
    spread = lambda r: f"least(greatest(CASE WHEN a.{r} > 0 AND a.{r} < a.n AND a.n - a.sizes / a.n > hosts - 1 THEN ((a.{r}_q - a.n * pow(a.{r} / a.n, 2)) / ((a.{r} / a.n) * (1 - a.{r} / a.n)) - (hosts - 1)) / (a.n - a.sizes / a.n - (hosts - 1)) ELSE 0 END, {h.LEAST_SPREAD}), {h.MOST_SPREAD})"
    rate = lambda r: f"(c.{r} + a.{r} / a.n * (1 / {spread(r)} - 1)) / (c.documents + 1 / {spread(r)} - 1)"
    worst = lambda names: f"greatest({', '.join(map(rate, names))})"
    return f"""
        WITH words AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}+') AS ws FROM documents),
        starts AS (SELECT r, unnest(list_transform(range(1, len(ws) - {w} + 2), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + {w - 1}], ' ')}})) AS x FROM words WHERE len(ws) >= {w}),
        found AS (SELECT r, unnest(places) AS i FROM (SELECT r, list(x.i) AS places FROM starts GROUP BY r, x.g HAVING count(*) > 1)),
        covered AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {w})) AS j FROM found) GROUP BY r),
        fact AS (
            SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SPACED}')) AS lines FROM words) LEFT JOIN covered USING (r)
        ),
        judged AS (
            SELECT *, n_words < {h.LEAST_WORDS} AS short, n_repeat_words * 100 > n_words * {h.MOST_REPEATED} AS repetitive, n_symbols * 100 > n_words * {h.MOST_SYMBOLS} AS symbols,
                n_dup_lines * 100 > n_lines * {h.MOST_LINES} OR n_repeat_words * 100 > n_words * {h.MOST_AGAIN} AS lines, word_chars < n_words * {low} OR word_chars > n_words * {high} AS lengths
            FROM fact
        ),
        c AS (SELECT host, count(*) AS documents, {', '.join(map(rule, h.POINTS))} FROM judged GROUP BY host),
        a AS (SELECT sum(documents) AS n, sum(CAST(documents AS DOUBLE) * documents) AS sizes, count(*) AS hosts, {', '.join(map(sums, h.POINTS))} FROM c),
        verdicts AS (SELECT host, CASE WHEN {worst(h.BLOCKING)} >= {h.BLOCKED} THEN 'blocked' WHEN {worst(h.POINTS)} >= {h.STRICT} THEN 'strict' ELSE 'usual' END AS host_verdict FROM c, a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, host_verdict,
            NOT (short OR repetitive) AND CASE host_verdict WHEN 'blocked' THEN false ELSE {' + '.join(f'CASE WHEN {r} THEN {p} ELSE 0 END' for r, p in h.POINTS.items())} < CASE host_verdict WHEN 'strict' THEN {h.STRICT_LIMIT} ELSE {h.LIMIT} END END AS kept
        FROM judged JOIN verdicts USING (host)
    """


ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item, len(g) AS n, g
            FROM (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + least(13, len(w)) - 1])) AS g FROM item WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT n FROM grams),
        doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        runs AS (
            SELECT r, n, i, w[i:i + n - 1] AS g
            FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
        ),
        found AS (SELECT r, i, runs.n, item FROM runs JOIN grams ON runs.n = grams.n AND runs.g = grams.g),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
    "op4_near_vectors": f"""
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ),
        good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
        pair AS (SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.r < b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {near_vectors.THRESHOLD}),
        link AS (SELECT ra AS r, a AS x, b AS y FROM pair UNION ALL SELECT rb, b, a FROM pair),
        reach AS (SELECT vec_id AS node, vec_id AS root FROM good UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node),
        name AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
        sums AS (SELECT r, count(*) AS n FROM link GROUP BY r)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
        FROM v LEFT JOIN sums USING (r) LEFT JOIN name ON name.node = vec_id
    """,
    "op7_jaccard_join": f"""
        WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        gram AS (
            SELECT DISTINCT r, g FROM (
                SELECT r, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {jaccard.WORDS} THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - {jaccard.WORDS} + 2), lambda i: array_to_string(w[i:i + {jaccard.WORDS} - 1], ' ')) END) AS g
                FROM doc)
        ),
        size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
        shared AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
        pair AS (
            SELECT da.doc_id AS x, db.doc_id AS y
            FROM shared JOIN size sa ON sa.r = ra JOIN size sb ON sb.r = rb JOIN doc da ON da.r = ra JOIN doc db ON db.r = rb
            WHERE {jaccard.DENOMINATOR} * c >= {jaccard.NUMERATOR} * (sa.n + sb.n - c)
        ),
        link AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair),
        reach AS (SELECT x AS node, x AS root FROM link UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node),
        name AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
        FROM doc LEFT JOIN size USING (r) LEFT JOIN name ON name.node = doc_id
    """,
    "op8_mix_sources": f"""
        WITH RECURSIVE unit AS (
            SELECT doc_id, source, coalesce(source, '') AS name, CAST(greatest(coalesce(length(text), 0), 1) AS BIGINT) AS units,
                   CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
            FROM documents
        ),
        stream AS (
            SELECT *, CAST(sum(units) OVER (PARTITION BY name ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - units AS BIGINT) AS start FROM unit
        ),
        doc AS (SELECT *, CAST(start // greatest({mixing.BLOCK_UNITS}, (SELECT (sum(units) + {mixing.MOST_BLOCKS - 1}) // {mixing.MOST_BLOCKS} FROM unit)) AS BIGINT) + 1 AS block FROM stream),
        src AS (SELECT name, sum(units) AS own_units, max(block) AS blocks FROM doc GROUP BY name),
        part AS (SELECT name, blocks, CAST(greatest(1, round(pow(own_units / (SELECT sum(own_units) FROM src), {mixing.TEMPERATURE}) * {mixing.SCALE})) AS HUGEINT) AS p FROM src),
        step AS (
            SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS begin, 0 AS phase, CAST(NULL AS STRUCT(d HUGEINT, k VARCHAR, i BIGINT, rel HUGEINT)) AS pick, CAST(NULL AS BIGINT) AS made_phase,
                   (SELECT list({{'k': name, 'p': p, 'had': CAST(0 AS BIGINT), 'gone': CAST(0 AS BIGINT), 'n': blocks}} ORDER BY name) FROM part) AS s
            UNION ALL
            SELECT t + 1,
                   CASE WHEN ends THEN t + 1 ELSE begin END,
                   phase + CASE WHEN ends THEN 1 ELSE 0 END,
                   now, phase,
                   CASE WHEN ends THEN list_transform(list_filter(next, lambda x: x.gone < x.n), lambda x: {{'k': x.k, 'p': x.p, 'had': CAST(0 AS BIGINT), 'gone': x.gone, 'n': x.n}}) ELSE next END
            FROM (
                SELECT *, len(list_filter(next, lambda x: x.gone >= x.n)) > 0 AS ends
                FROM (
                    SELECT *, list_transform(s, lambda x: {{'k': x.k, 'p': x.p, 'had': x.had + CASE WHEN x.k = now.k THEN 1 ELSE 0 END, 'gone': x.gone + CASE WHEN x.k = now.k THEN 1 ELSE 0 END, 'n': x.n}}) AS next
                    FROM (
                        SELECT *, list_sort(list_transform(
                            list_filter(s, lambda x: x.had * total // x.p <= t - begin),
                            lambda x: {{'d': ((x.had + 1) * total + x.p - 1) // x.p, 'k': x.k, 'i': x.gone + 1, 'rel': x.had * total // x.p}}))[1] AS now
                        FROM (SELECT *, CAST(list_sum(list_transform(s, lambda x: x.p)) AS HUGEINT) AS total FROM step WHERE len(s) > 0)
                    )
                )
            )
        )
        SELECT doc_id, source, units, doc.block AS block, CAST(made_phase AS INTEGER) AS phase, t - 1 AS slot, CAST(pick.rel AS BIGINT) AS release, CAST(pick.d AS BIGINT) AS deadline, start
        FROM doc JOIN step ON pick.k = doc.name AND pick.i = doc.block
    """,
    "op11_conversation_repair": _repair(),
    "op12_vector_codes": _codes(),
    "op13_host_rules": _hosts(),
}
