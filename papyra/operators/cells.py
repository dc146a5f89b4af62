"""Vectors by model, dealt into cells of a coarse quantiser.

Vectors of different models say nothing of each other, so all is kept and asked
by model. The vectors of a model are dealt into cells around centroids, which a few
rounds of k-means by aggregates find on a bounded sample; every vector is then
stored with its nearest one. A question looks at the cells nearest to it, and only
their files are read; with all cells the search is exact.

Tables (see :mod:`papyra.tables`): ``cells`` (model, cell, centroid) and
``vectors`` (place, id, model, cell, dims, vector, content), where ``place`` is
model and cell. An embedding that failed is a row of no dimensions, in no cell.
``content`` is a hash of what was embedded, so that an old vector of a changed
chunk isn't taken for its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import importable
from papyra.functions import vectors
from papyra.tables import Change, Tables, written

#: Rows of the fitting sample for each cell, and rounds of fitting.
SAMPLE, ROUNDS = 256, 8
#: Cells that a question looks at, if it doesn't say otherwise.
PROBES = 8
#: Models whose cosines need a rule of their own: least cosine, and the score of a cosine as (offset, factor).
SENTENCE_MODELS = ("multilingual-e5-small",)
_ROWS = 4096


def least(model: str) -> float:
    """The cosine above which a vector of a model counts as a hit."""
    return 0.78 if model in SENTENCE_MODELS else 0.18 if model.startswith("local-hash") else 0.12


def score(model: str, similarity: Column) -> Column:
    """Points for a cosine: those of sentence models lie close together and are spread."""
    return 1.5 + (similarity - 0.75) * 10.0 if model in SENTENCE_MODELS else 1.5 + similarity * 3.0


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of length one; zero ones stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T).argmax(axis=1)


def centroids(rows: DataFrame, cells: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of vectors (id, vector; all of one size): k-means on the ``sample * cells`` rows that a hash of their id puts first, about; all rows if there are fewer.

    Tasks send a sum for each cell and no rows; only the first centroids are picked on the driver.
    """
    importable(rows.sparkSession)
    total = rows.count()
    share = min(1.0, sample * cells / max(1, total))
    some = written((rows if share == 1 else rows.where(F.xxhash64("id") < int((2 * share - 1) * 2**63))).select("id", "vector"), "sample")
    first = some.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(cells).collect()
    if not first:
        return np.empty((0, 0))
    dims = len(first[0]["vector"])
    own = _unit(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), dims)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], own: np.ndarray = own) -> Iterator[pa.RecordBatch]:
            out, counts = np.zeros_like(own), np.zeros(len(own), np.int64)
            for batch in batches:
                for begin in range(0, batch.num_rows, _ROWS):
                    x = _unit(batch.column("vector").slice(begin, _ROWS), dims)
                    at = _nearest(x, own)
                    np.add.at(out, at, x)
                    counts += np.bincount(at, minlength=len(own))
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(list(out[full]), pa.list_(pa.float64()))], ["cell", "total"])

        found = some.select("vector").mapInArrow(sums, "cell int, total array<double>")
        each = found.select("cell", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"))
        new = own.copy()
        for r in each.collect():
            new[r["cell"], r["at"]] = r["x"]
        norm = np.sqrt((new * new).sum(axis=1, keepdims=True))
        new = np.where(norm > 0, new / np.where(norm > 0, norm, 1), own)
        if np.abs(new - own).max() < 1e-9:
            break
        own = new
    return own


class Cells:
    """The stored vectors of a folder of tables."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def models(self) -> list[str]:
        return sorted(r["model"] for r in self.tables.read("cells").select("model").distinct().collect()) if self.tables.exists("cells") else []

    def centroids(self, model: str) -> np.ndarray:
        if not self.tables.exists("cells"):
            return np.empty((0, 0))
        rows = self.tables.read("cells", self.tables.buckets_of("cells", [model])).where(F.col("model") == model).orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows]) if rows else np.empty((0, 0))

    def fit(self, change: Change, model: str, rows: DataFrame, cells: int | None = None) -> np.ndarray:
        """Centroids of a model that has none, from vectors (id, vector) of the size that most have: about the root of their number, if ``cells`` isn't given."""
        sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
        most = sizes.orderBy(F.desc("n"), "dims").first()
        if not most:
            return np.empty((0, 0))  # nothing to fit: the next call may
        own = centroids(rows.where(F.size("vector") == most["dims"]), cells or max(1, round(most["n"] ** 0.5)))
        made = [(model, k, [float(x) for x in c]) for k, c in enumerate(own)]
        change.append("cells", "model", self.tables.spark.createDataFrame(made, "model string, cell int, centroid array<double>"))
        return own

    def add(self, change: Change, model: str, rows: DataFrame, own: np.ndarray | None = None) -> DataFrame:
        """Store embedded rows (id, content, vector, error): null or empty vectors, and such of another size than the model's, as rows of no dimensions under ``embedding-error:``."""
        importable(self.tables.spark)
        own = self.centroids(model) if own is None else own
        dims = own.shape[1]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(begin, _ROWS)
                    at = _nearest(_unit(part.column("vector"), dims), own)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("content"), part.column("vector"), pa.array(at.astype(np.int32))], ["id", "content", "vector", "cell"])

        fits = F.coalesce(F.size("vector") == dims, F.lit(False)) & F.lit(dims > 0)
        plain = rows.select("id", "content", F.col("vector").cast("array<double>").alias("vector"), "error")
        good = plain.where(fits).select("id", "content", "vector").mapInArrow(deal, "id string, content long, vector array<double>, cell int")
        good = good.select(F.concat_ws(":", F.lit(model), "cell").alias("place"), "id", F.lit(model).alias("model"), "cell", F.lit(dims).alias("dims"), "vector", "content")
        name = F.concat(F.lit("embedding-error:"), F.substring(F.coalesce("error", F.lit("no vector")), 1, 80))
        bad = plain.where(~fits).select(F.lit("error").alias("place"), "id", name.alias("model"), F.lit(-1).alias("cell"), F.lit(0).alias("dims"), F.array().cast("array<double>").alias("vector"), "content")
        return change.append("vectors", "place", good.unionByName(bad), sort=["place", "id"])

    def rows(self, model: str, cells: list[int] | None = None) -> DataFrame:
        """Stored vectors of a model, of some cells or of all: files of other buckets aren't listed."""
        cells = list(range(len(self.centroids(model)))) if cells is None else cells
        places = [f"{model}:{c}" for c in cells]
        return self.tables.read("vectors", self.tables.buckets_of("vectors", places)).where(F.col("place").isin(*places))

    def probed(self, model: str, question: list[float], probes: int = PROBES) -> list[int]:
        """The cells nearest to a question, the nearest first."""
        own = self.centroids(model)
        near = own @ np.asarray(question, np.float64) if own.size and own.shape[1] == len(question) else np.empty(0)
        return [int(k) for k in np.argsort(-near, kind="stable")[:probes]]

    def similar(self, model: str, question: list[float], probes: int | None = PROBES) -> DataFrame:
        """(id, content, similarity) of the model's vectors in the nearest cells, or with ``probes`` None of all: the exact search. Vectors of other models are never compared."""
        cells = self.probed(model, question, len(self.centroids(model)) if probes is None else probes)
        q = F.array(*(F.lit(float(x)) for x in question))
        return self.rows(model, cells).where(F.col("dims") == len(question)).select("id", "content", vectors.cosine(F.col("vector"), q).alias("similarity"))

    def hits(self, model: str, question: list[float], live: DataFrame, probes: int | None = PROBES, most: int = 60) -> DataFrame:
        """(chunk_id, score): the best chunks by the model's own rule. ``live`` (chunk_id, content): chunks as they are, so that vectors of what has changed since don't count."""
        near = self.similar(model, question, probes).where(F.col("similarity") > least(model))
        own = near.join(live.select(F.col("chunk_id").alias("id"), "content"), ["id", "content"], "left_semi").dropDuplicates(["id"])
        best = own.orderBy(F.desc("similarity"), "id").limit(most)
        return best.select(F.col("id").alias("chunk_id"), score(model, F.col("similarity")).alias("score"))

    def missing(self, model: str, live: DataFrame) -> DataFrame:
        """Of ``live`` (chunk_id, content, ...) the chunks without a vector of the model for their content; failed ones count as missing."""
        if model not in self.models():
            return live
        have = self.rows(model).select(F.col("id").alias("chunk_id"), "content")
        return live.join(have, ["chunk_id", "content"], "left_anti")

    def pruned(self, change: Change, live: DataFrame) -> None:
        """Keep the vectors of chunks as they are, and one error row of the others that failed; the rest goes."""
        every = self.tables.read("vectors")
        kept = every.join(live.select(F.col("chunk_id").alias("id"), "content"), ["id", "content"], "left_semi").select(*every.columns).dropDuplicates(["place", "id"])
        change.replace("vectors", "place", kept, sort=["place", "id"])
