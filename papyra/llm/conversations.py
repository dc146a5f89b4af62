"""Repairing the structure of conversations by an error-correcting Earley parser.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles:
maybe a system row, then pairs of user and assistant. The grammar below says so;
beside scanning a row as it is (Keep), each terminal may be made of a row of
another role (Rerole) or of none (Insert), and a row may be passed over (Delete).
Each of these error productions has a cost. A chart item keeps the least
(cost, audit), where the audit is the string of the edits' first letters; the
completed chart yields the repair.

No production has a nonterminal behind its first place, so all items begin at
the first row, and a chart set holds one item for each production and dot at
most. Of two audits of one item neither is the beginning of the other at equal
cost (both edit the same rows, and each further Insert costs more), so the least
one stays the least whatever follows: keeping one is enough.

Rows of a conversation are sorted by Spark and stream through the parser. It
keeps one chart set, a running hash of each item's repaired text, and the edits
themselves, a letter a row; so a conversation of any length takes one pass and
holds none of its texts. Its hash and its audit are one value each, made in the
order of its rows, so one task must read them in turn.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from papyra.llm.common import bounded_batches, quoted

#: The role grammar: C is the whole, P one pair or more; s, u and a are rows of system, user and assistant.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua"))
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Terminals that rows can be made of.
NAMES = {"u": "user", "a": "assistant"}
#: An item that costs so much more than the best one of its set can't be part of the cheapest repair: the best one gets wherever the
#: other gets by two Inserts (4) to end a pair, an Insert (2) where the other is within one, and a Delete (3) for the other's system row.
MARGIN = 10
#: Rows after which the edits that items have in memory as strings are put away.
PUT_AWAY = 256
_SPACES = " \t\n\x0b\x0c\r"

_ITEMS = [(k, dot) for k, (_, body) in enumerate(GRAMMAR) for dot in range(len(body) + 1)]
_NEXT = {(k, dot): GRAMMAR[k][1][dot : dot + 1] for k, dot in _ITEMS}
_WAITING = {s: [x for x in _ITEMS if _NEXT[x] == s] for s in "CP"}


class _Path:
    """How an item was reached: its cost, its edits and the hash of what they leave.

    ``edits`` are those since the last were put away, ``rank`` the place of those among the items' (equal if they are), ``chain`` all of them.
    """

    __slots__ = ("chain", "cost", "edits", "rank", "sha")

    def __init__(self, cost: int, rank: int, edits: str, chain, sha):
        self.cost, self.rank, self.edits, self.chain, self.sha = cost, rank, edits, chain, sha

    def audit(self) -> str:
        out, at = [self.edits], self.chain
        while at:
            at, head = at
            out.append(head)
        return "".join(reversed(out))


def _with(sha, line: bytes):
    """The hash of a repaired text with one more line; None is the hash of no line yet."""
    new = sha.copy() if sha else hashlib.sha256()
    new.update(b"\n" + line if sha else line)
    return new


class Chart:
    """The last set of the chart of one conversation."""

    def __init__(self):
        self.rows = 0
        start = _Path(0, 0, "", None, None)
        self.items = self._closed([(0, 0, "", x, start, None) for x in _ITEMS if x[1] == 0 and _NEXT[x] != "P"])

    @staticmethod
    def _closed(seeds: list[tuple]) -> dict:
        """The items of a set from what scanning gives, completions and Inserts included: best first, so that each item is final when it is taken."""
        heap = [(cost, rank, edits, n, item, path, line) for n, (cost, rank, edits, item, path, line) in enumerate(seeds)]
        heapq.heapify(heap)
        n, out = len(heap), {}
        while heap:
            cost, rank, edits, _, item, path, line = heapq.heappop(heap)
            if item in out:
                continue
            if out and cost > best + MARGIN:  # noqa: F821  set with the first item
                break
            if not out:
                best = cost
            out[item] = own = _Path(cost, rank, edits, path.chain, path.sha if line is None else _with(path.sha, line))
            symbol, (k, dot) = _NEXT[item], item
            if symbol in NAMES:
                heapq.heappush(heap, (cost + INSERT, rank, edits + "I", n, (k, dot + 1), own, NAMES[symbol].encode() + b":"))
                n += 1
            elif not symbol:
                for waiting in _WAITING[GRAMMAR[k][0]]:
                    heapq.heappush(heap, (cost, rank, edits, n, (waiting[0], waiting[1] + 1), own, None))
                    n += 1
        return out

    def scan(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """The next set, by a row of this role and text."""
        seeds = []
        extra = TRUNCATED if truncated else 0
        own = {}
        for item, p in self.items.items():
            symbol, (k, dot) = _NEXT[item], item
            if symbol in ("u", "a", "s"):
                seeds.append((p.cost + DELETE, p.rank, p.edits + "D", item, p, None))
                if must_go:
                    continue
                if role[:1] == symbol:
                    seeds.append((p.cost + extra, p.rank, p.edits + "K", (k, dot + 1), p, own.setdefault(role, f"{role}:{text}".encode())))
                elif symbol in NAMES:
                    name = NAMES[symbol]
                    seeds.append((p.cost + REROLE + extra, p.rank, p.edits + "R", (k, dot + 1), p, own.setdefault(name, f"{name}:{text}".encode())))
            elif not symbol and GRAMMAR[k][0] == "C":
                seeds.append((p.cost + DELETE, p.rank, p.edits + "D", item, p, None))
        self.items = self._closed(seeds)
        self.rows += 1
        if self.rows % PUT_AWAY == 0:
            self._put_away()

    def _put_away(self) -> None:
        """Edits up to the last row's go to the chain, in the order of audits; Inserts behind it stay, as they may yet be compared with what follows."""
        heads = sorted({(p.rank, p.edits.rstrip("I")) for p in self.items.values()})
        place = {head: n for n, head in enumerate(heads)}
        chains = {}
        for p in self.items.values():
            head = (p.rank, p.edits.rstrip("I"))
            chain = chains.setdefault(head, (p.chain, head[1]))
            p.rank, p.edits, p.chain = place[head], p.edits[len(head[1]) :], chain

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired text) of the cheapest repair."""
        best = min((self.items[x] for x in _ITEMS if GRAMMAR[x[0]][0] == "C" and not _NEXT[x] and x in self.items), key=lambda p: (p.cost, p.rank, p.edits))
        return best.cost, best.audit(), (best.sha or hashlib.sha256()).hexdigest()


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows with faults put in by a checksum of conversation and turn, for testing repairs.

    Of 20 remainders 0 drops a row (``copies`` is 0), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    word = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word(conv), F.lit(":"), word(turn))), F.lit(20))
    rows = conversations.select(quoted(conv).alias("conv_id"), quoted(turn).cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out by conversation and in order, with ``blank``, ``seen`` (role and text are in an earlier row) and ``cut`` (no sentence end); rows of no copy are marks of their conversation."""
    # a single shuffle: both sorts stand on the same dealing
    dealt = rows.withColumn("key", F.col("conv_id").cast("string")).repartition("key")
    again = Window.partitionBy("key", F.col("copies") > 0, "role", F.xxhash64("text"), "text").orderBy(F.asc_nulls_first("turn"))
    body = F.rtrim(F.col("text"), F.lit(_SPACES))
    return dealt.withColumns({"seen": F.row_number().over(again) > 1, "blank": body == "", "cut": ~F.right(body, F.lit(1)).isin(".", "!", "?")}).sortWithinPartitions("key", *_order(), "seen")


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys."""
    chart = key = first = None
    counts: dict[str, int] = {}
    out: list[tuple] = []
    last = None  # (role, turn) of the row before
    low = None

    def closed() -> tuple:
        gaps = 0 if low is None else last[1] - low + 1 - counts["turns"]
        return (first, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], *chart.result())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        columns = [b.column(c) if c == "conv_id" else b.column(c).to_pylist() for c in ("conv_id", "key", "turn", "role", "text", "copies", "seen", "blank", "cut")]
        for conv, own, turn, role, text, copies, seen, blank, cut in zip(*columns, strict=True):
            if chart is None or own != key:
                if chart is not None:
                    out.append(closed())
                chart, key, first, last, low = Chart(), own, conv.as_py(), None, None
                counts = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
            for k in range(copies):
                again = seen or k > 0
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                if fault:
                    counts[fault] += 1
                if last is not None and last[0][:1] + role[:1] not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                if turn is not None and (low is None or turn != last[1]):
                    counts["turns"] += 1
                    low = turn if low is None else low
                chart.scan(role, text, blank or again, fault == "truncated")
                last = (role, turn)
        if len(out) >= 1000:
            yield batch()
            out = []
    if chart is not None:
        out.append(closed())
    if out:
        yield batch()


def parsed(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows``: conv_id, turn, role, text and ``copies``, the times that a row
    occurs in turn (0: it is gone, but its conversation has a result); further
    columns are left alone. Rows go by turn (nulls first), then role and text.
    A null role or text is one space, so a null text is blank; a null conv_id is
    a conversation of its own. Empty texts are blank and must go; of repeated
    rows all but the first must. Conversations without rows left have zeros, an
    empty audit and the hash of nothing; an empty table gives an empty one.
    Long texts and long conversations stream through.
    """
    bounded_batches(rows.sparkSession)
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("int").alias("copies"))
    kind = T.StructType([T.StructField("conv_id", filled.schema["conv_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return _faults(filled).mapInArrow(lambda batches: _summed(batches, schema), kind)


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows that the cheapest repair leaves, in order; inserted ones have no turn and an empty text.

    Edits are posed to rows by number, so no conversation is gathered.
    """
    rows = conversations.select(quoted(conv).alias("conv_id"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role), F.lit(" ")).alias("role"), F.coalesce(quoted(text), F.lit(" ")).alias("text"), F.lit(1).alias("copies"))
    edits = parsed(rows).select(F.col("conv_id").cast("string").alias("key"), F.col("conv_id").alias("_conv"), F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumns({"row": F.sum((F.col("edit") != "I").cast("int")).over(before), "place": F.sum((F.col("edit") != "D").cast("int")).over(before)}).where("edit <> 'D'")
    own = rows.withColumn("key", F.col("conv_id").cast("string"))
    own = own.withColumn("row", F.row_number().over(Window.partitionBy("key").orderBy(*_order()))).select(F.col("key").alias("_key"), F.col("row").alias("_row"), "turn", "role", "text")
    both = edits.join(own, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")) & (F.col("edit") != "I"), "left")
    # a system row can only be a kept first one; the roles of all others follow from their places
    opens = F.max(((F.col("place") == 1) & (F.col("edit") == "K") & F.startswith("role", F.lit("s"))).cast("int")).over(Window.partitionBy("key"))
    made = F.when((F.col("place") - opens) % 2 == 1, "user").otherwise("assistant")
    return both.select(F.col("_conv").alias("conv_id"), "place", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def digest(conversations: DataFrame) -> DataFrame:
    """The query's rows: conversations are damaged, then repaired."""
    return parsed(damaged(conversations))
