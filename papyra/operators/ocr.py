"""Recognition engines: which one's text is taken, and a slot for engines that aren't installed here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import text

#: The order in which other engines are tried after the first.
FALLBACKS = ["ollama", "azure", "openai"]
LEAST_CONFIDENCE = 65


def confidence(engine: Column | str) -> Column:
    """The number in an engine label such as tesseract:conf71; null without one."""
    return F.regexp_extract(text.text_of(engine), r":conf([0-9]+)", 1).try_cast("int")


def wants_fallback(body: Column | str, engine: Column | str, cloud: bool = True, tally: Column | None = None) -> Column:
    """Whether a reading is bad enough to ask another engine. ``tally``: that of the reading, if it is known."""
    label = text.judged(text.tally(body) if tally is None else tally)["label"]
    doubtful = text.text_of(engine).contains("tesseract") & text.has_arabic(body) & (label == "medium") & F.lit(cloud)
    return label.isin("empty", "poor") | F.coalesce(confidence(engine) < LEAST_CONFIDENCE, F.lit(False)) | doubtful


def chosen(readings: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, engine, text): the reading that is kept of each page.

    ``readings`` has key, place (0 for the first engine, then fallbacks in order),
    engine and text. The first stays unless it wants a fallback; then the
    first fallback that wins is taken: one with at least as many points, or,
    when the first is unsure, one of 20 characters or more that isn't garbled.
    Without a winner a first text stays, if there is any.
    """
    first = readings.where("place = 0").select(key, F.col("engine").alias("_engine"), text.text_of("text").alias("_text"))
    first = first.withColumn("_tally", text.tally("_text"))
    first = first.withColumns({"_points": F.col("_tally.points"), "_wants": (F.trim("_text") == "") | wants_fallback("_text", "_engine", tally=F.col("_tally")), "_unsure": (F.trim("_text") == "") | F.coalesce(confidence("_engine") < LEAST_CONFIDENCE, F.lit(False)) | text.judged(F.col("_tally"))["label"].isin("empty", "poor")}).drop("_tally")
    other = readings.where("place > 0").join(first, key)
    body = text.text_of("text")
    wins = (F.trim(body) != "") & ((text.legibility("text") >= F.col("_points")) | (F.col("_unsure") & (F.length(F.trim(body)) >= 20) & ~text.garbled("text")))
    best = other.where(F.col("_wants") & wins).groupBy(key).agg(F.min_by(F.struct("engine", "text"), "place").alias("_best"))
    out = first.join(best, key, "left")
    named = F.concat(F.col("_best.engine"), F.lit(":fallback-from-"), F.col("_engine"))
    return out.select(key, F.coalesce(named, F.col("_engine")).alias("engine"), F.coalesce("_best.text", "_text").alias("text"))


#: A reading that is good and of this mean confidence ends the search; one below the other is read again turned round, which must be better by the third.
ENOUGH, DOUBTFUL, BETTER_BY = 60, 50, 10
#: Language combinations in the order they are tried, and what is tried without any.
LANGUAGES, DEFAULT_LANGUAGE = ["ara+eng", "eng+ara", "ara", "eng"], "eng"


def attempts(available: Column) -> Column:
    """The language combinations that can be tried with the languages of an array, in their order."""
    tried = F.filter(F.array(*map(F.lit, LANGUAGES)), lambda x: F.size(F.array_except(F.split(x, r"\+"), available)) == 0)
    return F.when(F.size(tried) > 0, tried).otherwise(F.array(F.lit(DEFAULT_LANGUAGE)))


def mean_confidence(words: Column) -> Column:
    """The mean confidence of a reading's words (array<struct<t, conf>>): of those that aren't blank and have one (0 or more), 0 without any; -1 where words couldn't be had."""
    known = F.filter(words, lambda w: (F.trim(w["t"]) != "") & (w["conf"] >= 0))
    total = F.aggregate(known, F.lit(0).cast("long"), lambda s, w: s + w["conf"].cast("int"))
    return F.when(words.isNull(), -1.0).when(F.size(known) == 0, 0.0).otherwise(total / F.size(known))


def _grid_best(readings: DataFrame, key: str) -> DataFrame:
    """(key, angle, step, points, conf, label): of each grid the reading that its search ends with; angle 0 without a step where nothing was read of the straight page."""
    judged = readings.select(key, "angle", "step", text.tally("text").alias("_tally"), mean_confidence(F.col("words")).alias("conf"))
    judged = judged.select(key, "angle", "step", "_tally.points", text.judged(F.col("_tally"))["label"].alias("label"), "conf")
    # a grid has a row for each variant, language and mode: a hundred or so, without their texts
    grid = judged.groupBy(key, "angle").agg(F.array_sort(F.collect_list(F.struct("step", "points", "label", "conf"))).alias("tried"))
    start = F.struct(F.lit(-1).cast("int").alias("step"), F.lit(0).cast("int").alias("points"), F.lit(-1.0).alias("conf"), F.lit("empty").alias("label"), F.lit(False).alias("ended"))

    def step(best: Column, r: Column) -> Column:
        ends = (r["label"] == "good") & ((r["conf"] < 0) | (r["conf"] >= ENOUGH))
        new = F.struct(r["step"].cast("int").alias("step"), r["points"].cast("int").alias("points"), r["conf"].alias("conf"), r["label"].alias("label"), ends.alias("ended"))
        return F.when(best["ended"] | (r["points"] <= best["points"]), best).otherwise(new)

    return grid.select(key, "angle", F.aggregate("tried", start, step).alias("b")).select(key, "angle", "b.step", "b.points", "b.conf", "b.label")


def grid_choice(readings: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, engine, text, words): the reading that a search over a grid of variants, languages and modes keeps of each page.

    ``readings`` has key, angle (0, or that by which a page was turned), step (the
    place in the grid), variant, languages, mode, text and words (array<struct<t,
    conf>>). The search goes by steps and keeps what has more points than all before; one that is good and sure ends it. A
    turned page is only taken where the straight one is empty, poor or
    doubtful, and if it is clearly surer, or has more points and no confidence. Its word boxes don't
    fit the page and go. A page that nothing was read of has an empty text.
    """
    best = _grid_best(readings, key)
    row = F.struct("angle", "step", "points", "conf", "label")
    both = best.groupBy(key).agg(F.min(F.when(F.col("angle") == 0, row)).alias("s"), F.min(F.when(F.col("angle") != 0, row)).alias("t"))
    doubtful = F.coalesce(F.col("s.label"), F.lit("empty")).isin("empty", "poor") | F.coalesce((F.col("s.conf") >= 0) & (F.col("s.conf") < DOUBTFUL), F.lit(False))
    surer = (F.col("t.conf") >= 0) & (F.col("t.conf") > F.greatest(F.coalesce("s.conf", F.lit(0.0)), F.lit(0.0)) + BETTER_BY)
    more = (F.col("t.conf") < 0) & (F.col("t.points") > F.coalesce("s.points", F.lit(0)))
    turn = F.coalesce(doubtful & (surer | more), F.lit(False))
    # one row a page, so that each reading's text is looked for once
    taken = both.select(key, turn.alias("turn"), F.when(turn, F.col("t")).otherwise(F.col("s")).alias("r")).select(key, "turn", "r.angle", "r.step", "r.conf")
    texts = readings.select(key, "angle", "step", "text", "words", F.concat_ws(":", F.lit("tesseract"), "languages", F.concat(F.lit("psm"), F.col("mode")), "variant").alias("engine"))
    out = taken.join(texts, [key, "angle", "step"], "left")
    body, conf = text.text_of("text"), F.col("conf")
    name = F.when(F.col("turn"), F.concat("engine", F.lit(":rot"), F.col("angle").cast("string"))).otherwise(F.col("engine"))
    label = F.concat(name, F.when(conf >= 0, F.concat(F.lit(":conf"), conf.cast("int").cast("string"))).otherwise(""))
    empty = F.trim(body) == ""
    return out.select(key, F.when(empty, "tesseract-no-text").otherwise(label).alias("engine"), F.when(empty, "").otherwise(body).alias("text"), F.when(~F.col("turn") & ~empty, F.col("words")).alias("words"))


def with_engine(images: DataFrame, engine: Callable[[bytes], tuple[str, str]], content: str = "content") -> DataFrame:
    """``images`` with ``text`` and ``engine`` from a function of the image's bytes; an error is a page that needs recognition, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image in batch[content]:
                try:
                    out.append(engine(bytes(image)))
                except Exception as error:  # noqa: BLE001  any engine's failure is a result
                    out.append(("", f"error:{type(error).__name__}"))
            yield batch.assign(text=[t for t, _ in out], engine=[e for _, e in out])

    importable(images.sparkSession)
    own = ", ".join(f"`{n}` {t}" for n, t in images.dtypes if n not in ("text", "engine"))
    return images.drop("text", "engine").mapInPandas(run, f"{own}, text string, engine string")
