"""Similarity search with an inverted file: vectors are kept by cell, and a query looks only into the cells that can hold what it asks for.

Cells are the clusters of a bounded sample of the vectors (MLlib's k-means on directions); every vector is assigned to the nearest one and written in cell order, so that
Parquet's statistics find a cell's row groups.  ``search`` reads the ``probes`` cells nearest to each query and scores their vectors exactly; how many these are
is settled when the index is built, as the fewest that find the share ``recall`` of a sample's true neighbours (vectors without clusters need many, clustered ones few).
With ``exact`` it then reads each cell whose bound - the cosine of the angle to the centre less the cell's largest angle - reaches the k-th score found, and
nothing can be missed.  The vectors are a ``SegmentStore``: added, deleted and compacted without building the index again.

Queries go to the tasks in blocks, each with a bit for every cell that it looks into; vectors come in cell order, a cell of many of them over several tasks, so equal vectors or a
favourite cell fill no task.  What leaves a task is k rows a query.  Zero vectors score 0 with everything and have a cell's widest angle.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from maskwright.operators.retrieval import BATCH, ROWS, Nearest, in_blocks, norm, numbers, runs, tasks, unit
from maskwright.plans.scratch import written
from maskwright.sources.segments import SegmentStore

SAMPLE = 50_000  #: vectors that cells are fitted on: those of the smallest digests of their keys
TRIALS, AMONG = 200, 5_000  #: vectors of the sample whose neighbours among so many others settle the number of probes
MAX_CELLS = 16_384  #: centres that may be sent to all tasks
BLOCK = 1_024  #: vectors whose cells are found at once


def _unit(x) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in x]) if len(x) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def probes_for(vectors: np.ndarray, centres: np.ndarray, recall: float, k: int = 5) -> int:
    """The fewest nearest cells that hold the share ``recall`` of the ``k`` nearest others of some of the vectors."""
    if len(vectors) < 2:
        return len(centres)
    some = np.arange(min(TRIALS, len(vectors)))
    scores = vectors[some] @ vectors.T
    scores[some, some] = -2
    near = np.argsort(-scores, axis=1)[:, : min(k, len(vectors) - 1)]
    cell = (vectors @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(vectors[some] @ centres.T), axis=1), axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


class VectorIndex:
    """An index in a folder; ``key`` and ``vector`` name the columns, further columns are kept and may be filtered by."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector
        in_order = lambda df: df.repartitionByRange("__cell", F.xxhash64(key)).sortWithinPartitions("__cell")  # noqa: E731  a large cell has several parts
        self.store = SegmentStore(spark, f"{self.path}/vectors", key, in_order)

    # -------------------------------------------------------- building

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = 0.95, seed: int = 1) -> VectorIndex:
        """Fit ``cells`` (by default the square root of the number of vectors, doubled) on a ``sample`` and store all vectors."""
        some = vectors.filter(norm(F.col(self.vector)) > 0).select(self.key, self.vector).orderBy(F.xxhash64(self.key), self.key).limit(sample)
        some = written(some, "sample")
        n = vectors.count()
        cells = min(cells or 2 * math.isqrt(n) + 1, MAX_CELLS, max(1, some.count() // 4))
        if cells > 1:
            points = some.select(array_to_vector(F.col(self.vector).cast("array<double>")).alias("features"))
            centres = KMeans(k=cells, distanceMeasure="cosine", maxIter=10, seed=seed).fit(points).clusterCenters()
        else:
            centres = [np.ones(len((some.first() or {self.vector: [1.0]})[self.vector]))]
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        probes = probes_for(_unit([r[self.vector] for r in some.limit(AMONG).collect()]), self.centres(), recall)
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/probes")
        self._put(vectors, self.store.build, "overwrite")
        return self

    def _put(self, vectors: DataFrame, store, mode: str) -> int:
        placed = written(self.placed(vectors), "placed")
        placed.groupBy("__cell").agg(F.count("*").alias("n"), F.max("__angle").alias("angle")).write.mode(mode).parquet(f"{self.path}/cells")
        return store(placed.drop("__angle"))

    def add(self, vectors: DataFrame) -> int:
        return self._put(vectors, self.store.add, "append")

    def delete(self, keys: DataFrame) -> int:
        return self.store.delete(keys)

    def compact(self) -> int:
        return self.store.compact()

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # MAX_CELLS at most
        return _unit([r["centre"] for r in rows])

    def placed(self, vectors: DataFrame) -> DataFrame:
        """The vectors with their nearest cell and the angle to its centre."""
        centres = self.spark.sparkContext.broadcast(self.centres())

        @F.pandas_udf("cell int, angle double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            cells, angles = np.zeros(len(v), np.int32), np.zeros(len(v))
            for s in range(0, len(v), BLOCK):
                m = _unit(v.iloc[s : s + BLOCK])
                near = m @ centres.value.T
                best = near.argmax(1)
                zero = ~m.any(1)
                cells[s : s + len(m)] = np.where(zero, 0, best)
                angles[s : s + len(m)] = np.where(zero, math.pi, np.arccos(np.clip(near[np.arange(len(m)), best], -1, 1)) + 1e-7)
            return pd.DataFrame({"cell": cells, "angle": angles})

        return vectors.withColumn("__p", nearest(self.vector)).withColumns({"__cell": F.col("__p.cell"), "__angle": F.col("__p.angle")}).drop("__p")

    # -------------------------------------------------------- searching

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, where: Column | None = None, digits: int = 6, version: int | None = None) -> DataFrame:
        """qid, key, score, rank of each query's k nearest vectors of those that meet ``where``, in ``probes`` cells (by default as built).  ``queries``: qid, query."""
        rows = self.store.load(version)
        rows = rows.filter(where) if where is not None else rows
        probes = probes or self.spark.read.parquet(f"{self.path}/probes").first()["probes"]
        stats = {r["__cell"]: (r["n"], r["angle"]) for r in self.spark.read.parquet(f"{self.path}/cells").groupBy("__cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect()}
        if not stats:
            columns = [queries.schema["qid"], rows.schema[self.key], StructField("score", DoubleType()), StructField("rank", IntegerType())]
            return self.spark.createDataFrame([], StructType(columns))
        there = np.array(sorted(stats), np.int64)

        def of(block: DataFrame) -> DataFrame:
            found = self._met(self._probes(block, probes, stats), rows, k, digits, there)
            if exact:
                found = written(found, "found")
                last = self._first(found, k).groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
                found = found.unionByName(self._met(self._probes(block.join(last, "qid", "left"), probes, stats, 10.0**-digits), rows, k, digits, there))
            return self._first(found, k)

        return in_blocks(queries.select("qid", "query"), of)

    def _first(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.desc("score"), self.key)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _probes(self, queries: DataFrame, probes: int, stats: dict, slack: float | None = None) -> DataFrame:
        """qid, query and the cells to look into, a bit for each: the nearest ones, or with ``slack`` those others that may reach the score ``least``."""
        there = np.array(sorted(stats), np.int64)
        centres = self.spark.sparkContext.broadcast(self.centres()[there])
        angles = np.array([stats[c][1] for c in there])
        schema = StructType([queries.schema["qid"], queries.schema["query"], StructField("cells", BinaryType())])

        def cells(batches):
            for pdf in batches:
                for s in range(0, len(pdf), 256):
                    some = pdf.iloc[s : s + 256]
                    near = np.clip(_unit(some["query"]) @ centres.value.T, -1, 1)
                    nearest = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                    may = np.zeros(near.shape, bool)
                    if slack is None:
                        np.put_along_axis(may, nearest, True, axis=1)
                    else:
                        bound = np.cos(np.maximum(np.arccos(near) - angles, 0))
                        may = bound + slack >= some["least"].fillna(-2.0).to_numpy(float)[:, None]
                        np.put_along_axis(may, nearest, False, axis=1)
                    yield pd.DataFrame({"qid": some["qid"].to_numpy(), "query": some["query"].to_numpy(), "cells": [b.tobytes() for b in np.packbits(may, axis=1)]})

        return written(queries.mapInPandas(cells, schema), "probes")

    def _met(self, probes: DataFrame, rows: DataFrame, k: int, digits: int, there: np.ndarray) -> DataFrame:
        """qid, key, score: of a block of queries, each task's k best in their cells.  Vectors come in cell order; a cell meets the queries that look into it by one product."""
        asked = probes.toArrow()  # retrieval.MAX_QUERIES at most, with MAX_CELLS bits each
        bits = np.stack([np.frombuffer(b, np.uint8) for b in asked.column("cells").to_pylist()]) if asked.num_rows else np.zeros((0, -(-len(there) // 8)), np.uint8)
        wanted = there[np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=len(there)).astype(bool)].tolist() if len(bits) else []
        width = len(self.spark.read.parquet(f"{self.path}/centres").first()["centre"])
        sent = self.spark.sparkContext.broadcast((asked.column("qid").combine_chunks(), unit(asked.column("query").combine_chunks(), width), bits))
        key, vector = self.key, self.vector
        held = rows.filter(F.col("__cell").isin(wanted)) if len(wanted) <= 1000 else rows  # reaches the scan
        held = held.select("__cell", key, vector).repartitionByRange(tasks(rows), "__cell", F.xxhash64(key)).sortWithinPartitions("__cell")
        schema = StructType([probes.schema["qid"], rows.schema[key], StructField("score", DoubleType())])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, queries, bits = sent.value
            best, kind = Nearest(len(qids), k, digits), None
            for batch in batches:
                kind = batch.schema.field(1).type
                for first, last in runs(batch.column(0)):
                    at = int(np.searchsorted(there, batch.column(0)[first].as_py()))
                    asking = np.flatnonzero(bits[:, at >> 3] >> (7 - (at & 7)) & 1)
                    for s in range(first, last, BATCH) if len(asking) else ():
                        part = batch.slice(s, min(BATCH, last - s))
                        best.add(asking, queries[asking], unit(part.column(2), width), numbers(part.column(1)))
            if kind is not None:
                row, found, score = best.settle()
                for s in range(0, len(row), ROWS):
                    yield pa.record_batch([qids.take(pa.array(row[s : s + ROWS])), pa.array(found[s : s + ROWS], kind), pa.array(score[s : s + ROWS])], schema.names)

        return held.mapInArrow(compare, schema)
