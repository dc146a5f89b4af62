"""Conversation repair (11), vector codes (12) and rules by host (13) against plain versions."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from papyra.llm import conversations, host_rules, vector_codes

# --- 11 conversation structure repair ---------------------------------------------------------

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOOD = re.compile("(s?(ua)+)?")


def repairs(rows):
    """Every way to repair up to three rows, with two inserted rows a gap at most: (cost, audit, lines)."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    options = [[("D", None), *([] if must else [("K", role), *(("R", r) for r in ("user", "assistant"))])] for role, _, must, _ in rows]
    for edits in itertools.product(*options):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines, initials = 0, "", [], ""
            for k, more in enumerate(inserted):
                for role in more:
                    cost, audit, initials = cost + 2, audit + "I", initials + role[0]
                    lines.append(role + ":")
                if k < len(rows):
                    (edit, role), (_, text, _, cut) = edits[k], rows[k]
                    audit += edit
                    if edit == "D":
                        cost += 3
                    else:
                        cost += (2 if edit == "R" else 0) + cut
                        initials += role[:1] or " "
                        lines.append(f"{role}:{text}")
            if GOOD.fullmatch(initials):
                yield cost, audit, "\n".join(lines)


def cheapest(rows):
    """(cost, audit, text) by states of the pattern: nothing, s, u, a; all edits as strings."""
    states = {"": (0, "", "")}

    def insert():
        for _ in range(2):
            for q, (c, a, t) in list(states.items()):
                role = {"": "user", "s": "user", "a": "user", "u": "assistant"}[q]
                new = (c + 2, a + "I", t + role + ":\n")
                if role[0] not in states or new < states[role[0]]:
                    states[role[0]] = new

    for role, text, must, cut in rows:
        insert()
        new = {}
        for q, (c, a, t) in states.items():
            options = [(q, (c + 3, a + "D", t))]
            if not must:
                for to in {"": "su", "s": "u", "a": "u", "u": "a"}[q]:
                    if role[:1] == to:
                        options.append((to, (c + cut, a + "K", f"{t}{role}:{text}\n")))
                    elif to != "s":
                        options.append((to, (c + 2 + cut, a + "R", f"{t}{ {'u': 'user', 'a': 'assistant'}[to] }:{text}\n")))
            for to, x in options:
                new[to] = min(new.get(to, x), x)
        states = new
    insert()
    cost, audit, text = min(states[q] for q in ("", "a") if q in states)
    return cost, audit, text[:-1]


def plain_repairs(data, damage):
    """The contract over (conv_id, turn, role, text) in plain Python."""
    groups = defaultdict(list)
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 5
        groups[conv] += {0: [], 1: [(turn, role, "")], 2: [(turn, role, re.sub("[.!?]", "", text))], 3: [(turn, role, text)] * 2, 4: [(turn, "user", text)]}.get(kind, [(turn, role, text)])
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults, marked = [r[0] for r in rows if r[0] is not None], set(), Counter(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, text = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def random_conversation(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "u", "", None, "User"]
    texts = ["Well.", "Yes!", "no end", "", " \n", None, "Well.", "é? ", "a.b\x0b"]
    return [(conv, rng.choice([None, *range(6)]), rng.choices(roles, [8, 8, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


def test_the_chart_keeps_the_cheapest_of_all_repairs():
    rng = random.Random(41)
    for n in [0, 1, 1, 2, 2, 2, *[3] * 20]:
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{k}", rng.random() < 0.2, int(rng.random() < 0.3)) for k in range(n)]
        chart = conversations.Chart()
        for role, text, must, cut in rows:
            chart.scan(role, text, must, bool(cut))
        cost, audit, text = min(repairs(rows))
        assert chart.result() == (cost, audit, hashlib.sha256(text.encode()).hexdigest()) == (*cheapest(rows)[:2], hashlib.sha256(cheapest(rows)[2].encode()).hexdigest())


def test_repairs_match_a_plain_version(spark):
    rng = random.Random(42)
    data = [r for conv in range(150) for r in random_conversation(rng, conv, rng.randrange(1, 14))] + random_conversation(rng, None, 9)
    data += [(500, 3, "user", "Same."), (500, 3, "user", "Same."), (500, 3, "assistant", "Same."), (501, None, "user", "A."), (501, None, "assistant", "B."), (502, 0, "user", "x" * 300_000 + ".")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("k"), "copies": F.lit(7), "seen": F.lit("s"), "kind": F.lit(0), "edit": F.lit(1)}).repartition(5)
    assert got(conversations.digest(df)) == plain_repairs(data, True)
    assert got(conversations.parsed(df.drop("copies").withColumn("copies", F.lit(1)))) == plain_repairs(data, False)
    assert conversations.digest(df.limit(0)).collect() == []


def test_conversations_that_damage_empties_stay(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    data = [(c, 0, "user", "Hello.") for c in gone]
    out = got(conversations.digest(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))
    assert len(gone) > 5 and out == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone], key=repr)


def test_a_long_conversation_takes_one_pass(spark):
    """Roles that no pair has, so that edits never agree: as many chart items throughout, and edits that are put away stay comparable."""
    rng = random.Random(43)
    rows = [(rng.choice(["tool", "tool", "user", "system", "assistant"]), f"line {k}", rng.random() < 0.05, 0) for k in range(1500)]
    chart = conversations.Chart()
    for row in rows:
        chart.scan(*row)
        assert len(chart.items) <= len(conversations._ITEMS)
    cost, audit, text = cheapest(rows)
    assert chart.result() == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    began = time.process_time()
    chart = conversations.Chart()
    for k in range(30_000):
        chart.scan("tool", "x", False, False)
    assert chart.result()[:2] == (2 * 30_000, "R" * 30_000) and time.process_time() - began < 30


def test_repaired_rows_are_what_the_hash_is_of(spark):
    rng = random.Random(44)
    data = [r for conv in range(60) for r in random_conversation(rng, conv, rng.randrange(1, 9))] + random_conversation(rng, None, 5)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    lines = defaultdict(list)
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {r[0]: r[-1] for r in plain_repairs(data, False)}
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == want


# --- 12 vector code compression -----------------------------------------------------------------


def plain_codes(data, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) by Python integers and by comparing with every entry."""
    kept = [(i, v, label) for i, v, label in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    if not rows:
        return []
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    size = width // parts
    rows = [(i, v + [0] * (width - len(v)), label) for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for p in range(parts)] for _, v, _ in rows]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), f in zip(rows, found, strict=True) if f[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [(i, label, [near(v, p) for p in range(parts)]) for i, v, label in rows]
    by_label = Counter()
    for _, label, n in out:
        by_label[label] += sum(d for d, _ in n)
    return sorted([(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), by_label[label], digest) for i, label, n in out], key=repr)


CODE_COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def vectors(spark, data):
    df = spark.createDataFrame([(i, v, label) for i, v, label in data], "vec_id long, embedding array<float>, label int")
    return df.withColumns({"v": F.lit("own"), "code": F.lit(1), "of": F.lit(2), "error": F.lit("e")}).repartition(4)


def test_annulus_finds_the_nearest_entry_and_skips_others():
    rng = np.random.default_rng(45)
    book = rng.integers(-50, 50, (16, 4)) * rng.integers(1, 200, (16, 1))
    book[7] = book[3]  # ties go to the lower index
    x = np.concatenate([rng.integers(-4000, 4000, (3000, 4)), book, np.zeros((1, 4), np.int64), -book])
    code, best, compared = vector_codes.nearest(x, book)
    exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert compared < exact.size
    near = book[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 4))  # parts as codebooks are made for
    assert vector_codes.nearest(near, book)[2] < 0.25 * len(near) * len(book)
    one = vector_codes.nearest(x, book[:1])
    assert (one[0] == 0).all() and (one[1] == exact[:, 0]).all()
    # an entry at the very edge of the annulus ties with the best one: equal norms' distance and parts' distance
    line = np.array([[4, 0], [2, 0]])
    assert vector_codes.nearest(np.array([[3, 0]]), line)[0].tolist() == [0]


def test_codes_match_a_plain_version(spark):
    rng = random.Random(46)
    vec = lambda n=16: [rng.gauss(0, 1) for _ in range(n)]
    same = vec()
    data = [(i, vec(), rng.choice([0, 1, 2, None])) for i in range(100, 250)] + [(300 + i, same, 1) for i in range(60)]
    data += [(1, None, 0), (2, [None] + vec(15), 0), (3, [float("nan")] + vec(15), 1), (4, [float("inf")] + vec(15), 1), (5, [0.0] * 16, None), (6, vec(5), 2), (7, [], 2), (101, same, 0), (101, same, 0), (None, vec(), 1), (8, [-0.0, -1e-9, 1e-9] + vec(13), 0)]
    assert got(vector_codes.digest(vectors(spark, data)), CODE_COLUMNS) == plain_codes(data)
    assert got(vector_codes.digest(vectors(spark, data[:9])), CODE_COLUMNS) == plain_codes(data[:9])  # fewer vectors than entries
    assert vector_codes.digest(vectors(spark, [(1, None, 0)])).collect() == []
    assert vector_codes.digest(vectors(spark, data[:0])).collect() == []
    assert got(vector_codes.digest(vectors(spark, [(7, [], 2)])), CODE_COLUMNS) == [(7, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_codes_name_entries_near_the_vectors(spark):
    rng = random.Random(47)
    data = [(i, [rng.gauss(0, 1) for _ in range(16)], 0) for i in range(300)]
    rows = vector_codes.integers(vectors(spark, data)).cache()
    books = vector_codes.codebooks(rows)
    back = {r["vec_id"]: r for r in vector_codes.decoded(vector_codes.encoded(rows, books), books).collect()}
    for i, v, _ in data:
        whole = [math.floor(4096 * float(np.float32(x))) for x in v]
        assert round(sum((a - 4096 * b) ** 2 for a, b in zip(whole, back[i]["vector"], strict=True))) == back[i]["error"]
    with pytest.raises(PySparkException, match="in size"):
        vector_codes.digest(vectors(spark, [(1, [1e30] * 8, 0)])).collect()


# --- 13 rules by host ------------------------------------------------------------------------------


def plain_measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {k for starts in at.values() if len(starts) > 1 for i in starts for k in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


MEASURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_match_a_plain_version(spark, docs, rows, empty):
    rng = random.Random(48)
    block = prose(rng, 9)
    data = [*rows, *((1000 + k, text) for k, text in enumerate([
        "\n".join([block] * 6), f"{block} {block} {prose(rng, 200)}", " ".join(["a"] * 100), "a b c d\x0be\x1ff\x85g " * 5, "x\n\nx\n x\nx\r\n", f"{prose(rng, 30)} {block} {prose(rng, 3)} {block} {block[: len(block) // 2]}",
        "🙂é # * $ % & | < > " * 4, prose(rng, 7), " ".join(prose(rng, 8).split() * 2), "\n".join(["same line"] * 4 + ["Same line", "same line "]),
    ]))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"source": F.lit("s"), "host": F.lit("h"), "m": F.lit(1), "kept": F.lit(2), "verdict": F.lit(3), "n_words": F.lit(4)})
    assert got(host_rules.digest(df), MEASURES) == sorted([(i, *plain_measures(t)) for i, t in data], key=repr)
    assert host_rules.digest(empty).collect() == []


def test_hosts_are_shrunk_towards_the_mean_of_all():
    # hosts that differ no more than chance says: a strong prior, so one document says nothing
    a, b = host_rules.prior(1000, 100, 20 * 25 / 50, 20 * 50.0**2, 20)
    assert a + b > 1000 and a / (a + b) == pytest.approx(0.1)
    # hosts that fail either all or nothing: a weak prior
    a, b = host_rules.prior(1000, 100, 2 * 50.0, 20 * 50.0**2, 20)
    assert a + b < 1 and (1 + a) / (1 + a + b) > 0.5
    assert host_rules.prior(0, 0, 0.0, 0.0, 0)[0] == 0


def test_verdicts_of_hosts_reach_their_documents(spark):
    rng = random.Random(49)
    clean = lambda: prose(rng, 60)
    noisy = lambda: " ".join(w + "###" for w in clean().split())
    lines = lambda: "\n".join([(line := prose(rng, 5)), prose(rng, 12), line, prose(rng, 12), line])  # noqa: E731  two of five lines are repeated
    data = [(f"good{h}", clean(), True) for h in range(10) for _ in range(30)]
    data += [("spam", noisy(), False) for _ in range(28)] + [("spam", clean(), False) for _ in range(2)]  # blocked as a whole
    data += [("mixed", lines(), False) for _ in range(14)] + [("mixed", clean(), True) for _ in range(16)]  # held to all rules
    data += [("good1", lines(), True), ("good1", noisy(), False), ("once", noisy(), False), (None, clean(), True), (None, None, False), ("good2", "short", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, source string, text string, wanted boolean")
    out = {r["doc_id"]: r for r in host_rules.digest(df).collect()}
    for i, (host, text, wanted) in enumerate(data):
        assert out[i]["kept"] == wanted, (host, text, out[i])
    kept = host_rules.filtered(df.withColumn("row", F.lit("mine")))
    assert kept.columns == ["doc_id", "source", "text", "wanted", "row"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, r in enumerate(data) if r[2]]
    assert all(r["wanted"] and r["row"] == "mine" for r in kept.collect())


def test_host_of_an_address(spark):
    df = spark.createDataFrame([("HTTPS://WWW.Example.org:80/a?b",), ("http://a.b.c",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(host_rules.host_of(F.col("u"))).collect()] == ["example.org", "a.b.c", None, None]


def test_all_three_have_no_python_where_none_is_allowed(spark, docs):
    plan = host_rules.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert brute.space_words("A b") == ["a", "b"]
