"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of equal blocks. Block i of a source of weight w has
the release time floor((i - 1) / w) and the deadline ceil(i / w), counted in
blocks of the mixture; at each time the released block of the earliest deadline
is next. So after any number of blocks each source is less than one block from
its target.

Weights are taken as they are, as rationals, and releases and deadlines are
whole-number arithmetic on them, so nothing drifts however long the mixture is.
The schedule is a table of a row for each block, made with a heap of a row for
each source and written bit by bit; blocks grow with the corpus beyond
``MOST_BLOCKS`` of them, so its length is bounded. All else is sums and joins on
DataFrames.

A caller that can do with rounded weights may ask for a number of ``parts``:
the schedule repeats after so many blocks then, and is a smaller table. Its
targets drift from the weights given by up to one part a block.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.common import any_names, drop_written, literal, quoted, spare, written

#: Parts that weights are fractions of where a caller asks for rounded ones.
PARTS = 1000
#: Units (characters) of a block at least, and blocks of the whole mixture at most: larger corpora have larger blocks.
BLOCK_UNITS, MOST_BLOCKS = 65_536, 4_000_000
#: Default weights are whole numbers of 1 / SCALE.
SCALE = 10**12
#: The weight of a source is its share of all units to this power, if weights aren't given.
TEMPERATURE = 0.5
#: Sources whose schedules are held by the driver; with more, the schedule is a table of all blocks.
MOST_SOURCES = 500
#: Blocks of a schedule that the driver holds at once as it writes that table.
SCHEDULE_ROWS = 50_000
#: Rows, on average, in each part of a source that is sorted in one task.
PART_ROWS = 2000


def apportioned(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """Whole parts of each weight, by largest remainder, one at least for a weight above 0; ties go to the smaller name."""
    weights = {k: w for k, w in weights.items() if w and w > 0 and math.isfinite(w)}
    parts = max(parts, 10 * len(weights))
    total = sum(weights[k] for k in sorted(weights))
    exact = {k: w / total * parts for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (-(exact[k] - math.floor(exact[k])), k))
    spare, i = parts - sum(out.values()), 0
    while spare and out:
        k = order[i % len(order)]
        if spare > 0 or out[k] > 1:
            out[k] += 1 if spare > 0 else -1
            spare += -1 if spare > 0 else 1
        i += 1
    return out


def exact(weights: Mapping[str, float | int | Fraction]) -> dict[str, int]:
    """Whole numbers in the very proportions of the weights."""
    own = {k: Fraction(w) for k, w in weights.items() if w and w > 0 and math.isfinite(w)}
    whole = math.lcm(*(w.denominator for w in own.values()))
    return {k: int(w * whole) for k, w in own.items()}


def schedule(parts: Mapping[str, int], length: int | None = None) -> list[tuple[int, str, int, int, int]]:
    """(time, source, block, release, deadline) of the first ``length`` blocks, one period by default; deadlines tie in the order of names."""
    total = sum(parts.values())
    window = lambda k, i: ((i - 1) * total // parts[k], -(-i * total // parts[k]))
    coming = [(0, k, 1) for k in parts]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(total if length is None else length):
        while coming and coming[0][0] <= t:
            _, k, i = heapq.heappop(coming)
            heapq.heappush(ready, (window(k, i)[1], k, i))
        deadline, k, i = heapq.heappop(ready)
        out.append((t, k, i, window(k, i)[0], deadline))
        heapq.heappush(coming, (window(k, i + 1)[0], k, i + 1))
    return out


def phases(blocks: Mapping[str, int], parts: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """How the sources run out, one after another.

    In a phase the sources with blocks left are scheduled by their parts; it
    ends with the last block of a source, and the next starts anew with the
    others. Returns (phase, first time, period) and (phase, source, blocks it
    has had before, time in the period, block in the period, parts, end), where
    ``end`` is the number of blocks it has had after the phase.
    """
    left, had, start, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, 0
    runs, slots = [], []
    while left:
        own = {k: parts[k] for k in left}
        step = math.gcd(*own.values())
        own = {k: v // step for k, v in own.items()}
        period = sum(own.values())
        table = schedule(own)
        place: dict[str, list[int]] = {k: [] for k in own}
        for t, k, *_ in table:
            place[k].append(t)
        last = {k: (left[k] - 1) // own[k] * period + place[k][(left[k] - 1) % own[k]] for k in own}
        length = min(last.values()) + 1
        whole, over = divmod(length, period)
        took = {k: whole * own[k] + sum(t < over for t in place[k]) for k in own}
        runs.append((phase, start, period))
        slots += [(phase, k, had[k], t, i, own[k], had[k] + took[k]) for k in own for i, t in enumerate(place[k]) if t < length]
        for k in own:
            had[k] += took[k]
            left[k] -= took[k]
        left = {k: n for k, n in left.items() if n}
        start += length
        phase += 1
    return runs, slots


def every_block(blocks: Mapping[str, int], parts: Mapping[str, int]) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(phase, source, block, slot, release, deadline) of all blocks in their order; phases are those of :func:`phases`.

    Sources of the same parts wait in one line in the order of names, and lines
    are opened by their deadlines, so a phase costs what it schedules and not
    all sources that are left.
    """
    left, had, slot, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, 0
    lines: dict[int, list[str]] = {}
    for k in sorted(left):
        lines.setdefault(parts[k], []).append(k)
    sizes, total = sorted(lines, reverse=True), sum(parts[k] for k in left)
    while left:
        ready: list[tuple[int, str, int, int]] = []
        coming: list[tuple[int, str, int]] = []
        took: dict[str, int] = {}
        opened, t, over = 0, 0, None
        while over is None:
            while coming and coming[0][0] <= t:
                _, k, i = heapq.heappop(coming)
                heapq.heappush(ready, (-(-i * total // parts[k]), k, i, -1))
            while opened < len(sizes) and (not ready or -(-total // sizes[opened]) <= ready[0][0]):
                heapq.heappush(ready, (-(-total // sizes[opened]), lines[sizes[opened]][0], 1, 0))
                opened += 1
            deadline, k, i, place = heapq.heappop(ready)
            p = parts[k]
            if 0 <= place < len(lines[p]) - 1:
                heapq.heappush(ready, (deadline, lines[p][place + 1], 1, place + 1))
            yield phase, k, had[k] + i, slot + t, (i - 1) * total // p, deadline
            took[k], t = i, t + 1
            if i == left[k]:
                over = k
            else:
                heapq.heappush(coming, (i * total // p, k, i + 1))
        for k, i in took.items():
            had[k] += i
            left[k] -= i
        del left[over]
        line = lines[parts[over]]
        del line[bisect.bisect_left(line, over)]
        if not line:
            sizes.remove(parts[over])
        total -= parts[over]
        slot, phase = slot + t, phase + 1


def _units(text: Column) -> Column:
    return F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")


def streams(docs: DataFrame, id_col: str, source_col: str, text_col: str, block_units: int, row: Column | None = None) -> DataFrame:
    """id, source, units, start (units of the source's stream before the document) and block (from 1, that of its first unit).

    A block has ``block_units`` units, or so many more that ``MOST_BLOCKS`` hold the corpus.

    The stream of a source is in the order of a hash of the id. It is cut into
    parts by that hash, about ``PART_ROWS`` rows each whatever the size of the
    source, so that no task sorts a whole source; the sums of the parts
    before are added from a table of a row for each part.
    """
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"), _units(quoted(text_col)).alias("units"), row.alias("row"))
    rows = rows.withColumn("hash", F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"))
    rows = rows_table = written(rows, "units")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("units"), F.lit(0))).first()
    block_units = max(block_units, -(-total // MOST_BLOCKS))
    cuts = max(1, -(-count // PART_ROWS))
    rows = rows.withColumn("part", F.floor(F.col("hash").cast("double") / 2.0**60 * cuts).cast("long"))
    parts = rows.groupBy("source", "part").agg(F.sum("units").alias("sum"))
    # two levels again: parts are summed in runs of 1000, so that no task holds all parts of a source
    parts = written(parts.withColumn("run", F.floor(F.col("part") / 1000)), "parts")
    runs = parts.groupBy("source", "run").agg(F.sum("sum").alias("run_sum"))
    runs = runs.select("source", "run", (F.sum("run_sum").over(Window.partitionBy("source").orderBy("run")) - F.col("run_sum")).alias("before_run"))
    inner = parts.select("source", "part", "run", (F.sum("sum").over(Window.partitionBy("source", "run").orderBy("part")) - F.col("sum")).alias("in_run"))
    on = lambda a, b, *names: [a["source"].eqNullSafe(b["source"]), *(a[n] == b[n] for n in names)]
    before = inner.join(runs, on(inner, runs, "run")).select(inner["source"].alias("source"), "part", (F.col("in_run") + F.col("before_run")).alias("before"))
    order = Window.partitionBy("source", "part").orderBy("hash", "id", "row")
    own = rows.withColumn("in_part", F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("units"))
    own = own.join(before, on(own, before, "part")).select(own["id"], own["source"], own["units"], own["hash"], own["row"], (F.col("in_part") + F.col("before")).alias("start"))
    out = written(own.withColumn("block", F.floor(F.col("start") / block_units).cast("long") + 1), "streams")
    drop_written(rows_table, parts)
    return out


def _all_slots(rows: DataFrame, first: Mapping[str, int], own: Mapping[str, int], rest: Mapping[str, int]) -> DataFrame:
    """``rows`` of :func:`streams` with the phase, slot, release and deadline of their blocks, by a table of all blocks that the driver writes bit by bit."""
    spark, begin, k = rows.sparkSession, sum(first.values()), len(first)
    more = ((p + k, name, b, s + begin, r, d) for p, name, b, s, r, d in every_block(rest, dict.fromkeys(rest, 1)))
    made, pieces = itertools.chain(every_block(first, own), more), []
    kind = "phase int, name string, block long, slot long, release long, deadline long"
    while piece := list(itertools.islice(made, SCHEDULE_ROWS)):
        # releases and deadlines are whole blocks, however long the numbers of the weights are
        pieces.append(written(literal(spark, piece, kind), "schedule"))
    slots = functools.reduce(DataFrame.union, pieces) if pieces else literal(spark, [], kind)
    return rows.join(slots, ["name", "block"])


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", parts: int | None = None, block_units: int = BLOCK_UNITS, temperature: float = TEMPERATURE, row: Column | None = None) -> DataFrame:
    """Each document once, with its place in the mixture.

    Columns: id, source, units, block, phase, slot (the time of the block),
    release and deadline of the block within its phase (in blocks of the
    phase), start (place within the source). The training order is
    (slot, start).

    ``weights`` are target shares of units; by default a source's share of all
    units to the power ``temperature``. A null source is a source of its own,
    with its weight under the name '', as is an empty one. While all sources of a phase have
    blocks, each is less than one block from the target of its weight at any
    time; when one runs out, the others go on by their weights. With ``parts``
    that holds for the weights rounded to so many parts. Sources without a weight
    above 0 come after all others, by equal weights. A document is served with
    the block it begins in, so delivered units are within one block and the
    longest document of a source's target. Null and
    empty texts count one unit; ids tie by row; repeated rows are rows of their own; a
    text may be longer than a block; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = streams(docs, id_col, source_col, text_col, block_units, row).withColumn("name", F.coalesce("source", F.lit("")))
    sums = rows.groupBy("name").agg(F.sum("units").alias("units"), F.max("block").alias("blocks")).orderBy("name").collect()
    total = sum(r["units"] for r in sums) or 1
    if weights is None:
        weights = {r["name"]: max(1, round((r["units"] / total) ** temperature * SCALE)) for r in sums}
    first = {r["name"]: r["blocks"] for r in sums if (weights.get(r["name"]) or 0) > 0}
    rest = {r["name"]: r["blocks"] for r in sums if r["name"] not in first}
    own = {k: weights[k] for k in first}
    own = exact(own) if parts is None else apportioned(own, parts)
    if parts is None or len(sums) > MOST_SOURCES:
        return _all_slots(rows, first, own, rest).select("id", "source", "units", "block", "phase", "slot", "release", "deadline", "start", "row")
    runs, slots = phases(first, own)
    if rest:
        more_runs, more_slots = phases(rest, dict.fromkeys(rest, 1))
        begin, k = sum(first.values()), len(runs)
        runs += [(p + k, s + begin, n) for p, s, n in more_runs]
        slots += [(p + k, *x) for p, *x in more_slots]
    spans = sorted({(k, p, had, own, end) for p, k, had, _, _, own, end in slots})
    spans_df = literal(spark, spans, "name string, phase int, had long, own int, end long")
    runs_df = literal(spark, runs, "phase int, first long, period long")
    slots_df = literal(spark, [(p, k, i, t) for p, k, _, t, i, *_ in slots], "phase int, name string, turn long, place long")
    # MOST_SOURCES bounds these tables: all are for the driver's schedule, not for the data
    spans_df = F.broadcast(spans_df.join(F.broadcast(runs_df), "phase"))
    placed = rows.join(spans_df, "name").where((F.col("block") > F.col("had")) & (F.col("block") <= F.col("end")))
    placed = placed.withColumn("own_block", F.col("block") - F.col("had")).withColumn("turn", (F.col("own_block") - 1) % F.col("own"))
    placed = placed.join(F.broadcast(slots_df), ["phase", "name", "turn"])
    whole = F.floor((F.col("own_block") - 1) / F.col("own")).cast("long")
    return placed.select(
        "id", "source", "units", "block", "phase",
        (F.col("first") + whole * F.col("period") + F.col("place")).alias("slot"),
        F.expr("(own_block - 1) * period div own").alias("release"),
        F.expr("(own_block * period + own - 1) div own").alias("deadline"),
        "start", "row",
    )


@any_names
def in_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with phase, slot, release, deadline, block, units and start of :func:`mixed`; they replace columns of these names.

    The rows are written with a row number first, so that both reads of them
    agree; ordering the result by (slot, start) gives the training order.
    """
    names = ["phase", "slot", "release", "deadline", "block", "units", "start"]
    [number] = spare(docs.columns, "row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "mixed-rows")
    placed = mixed(rows, row=F.col(number), **options).select(F.col("row").alias(number), *names)
    return rows.drop(*names).join(placed, number).drop(number)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, units, block, phase, slot, release, deadline, start."""
    return mixed(docs, **options).withColumnRenamed("id", "doc_id").drop("row")
