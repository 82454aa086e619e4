"""Similarity search over vectors, and keyword retrieval.  Queries are few; the store may be large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from maskwright.plans.scratch import written

MAX_QUERIES = 10_000  #: queries that may be broadcast at once; more are taken in blocks
TILE, BATCH = 512, 4_096  #: queries and vectors that are compared by one product
ROWS = 50_000  #: rows of a batch that a task gives


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of at most ``MAX_QUERIES``: themselves if they are so few, else written once with their numbers."""
    n = queries.count()
    if n <= MAX_QUERIES:
        return [queries]
    # numbers within a partition, then from the partitions before it: no task takes all rows
    at = written(queries.withColumn("__id", F.monotonically_increasing_id()), "queries").withColumn("__part", F.shiftright("__id", 33))
    starts = at.groupBy("__part").count().withColumn("__start", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))  # a row for each partition
    number = F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)
    numbered = at.join(F.broadcast(starts.drop("count")), "__part").withColumn("__block", F.floor(number / MAX_QUERIES)).drop("__id", "__part", "__start")
    numbered = written(numbered, "blocks")
    return [numbered.filter(F.col("__block") == b).drop("__block") for b in range(-(-n // MAX_QUERIES))]


def in_blocks(queries: DataFrame, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of what ``reduce`` leaves of each block; with several blocks each is written before the next begins."""
    each = blocks(queries)
    if len(each) == 1:
        return reduce(each[0])
    out = [written(reduce(b), "block") for b in each]
    while len(out) > 1:  # in pairs, so that the plan is no deeper than it has to be
        out = [out[i].unionByName(out[i + 1]) if i + 1 < len(out) else out[i] for i in range(0, len(out), 2)]
    return out[0]


class Queries:
    """A block of queries (qid, query; see ``blocks``) as unit vectors by their number of dimensions, for the tasks."""

    def __init__(self, block: DataFrame):
        rows = block.select("qid", "query").toArrow()  # MAX_QUERIES at most
        self.qids, vectors = rows.column("qid").combine_chunks(), rows.column("query").combine_chunks()
        sizes = lengths(vectors)
        self.groups = [(np.flatnonzero(sizes == w), unit(vectors, w)[sizes == w]) for w in np.unique(sizes)]

    def __len__(self) -> int:
        return len(self.qids)


def lengths(vectors: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)


def unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in rows; zeros for null vectors, those of other widths and those with missing values, which are like nothing."""
    sizes = lengths(vectors)
    out, flat = np.zeros((len(vectors), width)), vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    out[sizes == width] = flat[np.repeat(sizes == width, sizes)].reshape(-1, width)
    out[~np.isfinite(out).all(1)] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


class Nearest:
    """The k best of each of n queries so far; ties of rounded scores by key.  It holds k rows a query, and as many that wait to be compared with them."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits, self.least = k, digits, np.full(n, -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, asking: np.ndarray, queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray) -> None:
        """Compare the vectors with the queries of the numbers ``asking``."""
        for s in range(0, len(asking), TILE):
            own, scores = asking[s : s + TILE], queries[s : s + TILE] @ vectors.T
            low = self.least[own]
            new = np.isneginf(low)
            if new.any() and scores.shape[1] > self.k:
                low[new] = np.partition(scores[new], -self.k, axis=1)[:, -self.k]
            at, place = np.nonzero(scores >= (low - 10.0**-self.digits)[:, None])  # what rounding may bring level stays
            self.rows.append((own[at], keys[place], np.round(scores[at, place], self.digits) + 0.0))
            self.waiting += len(at)
            if self.waiting > max(len(self.least) * self.k, 1 << 16):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, key and score of the best so far."""
        if not self.rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        row, key, score = map(np.concatenate, zip(*self.rows, strict=True))
        order = np.lexsort((key, -score, row))
        row, key, score = row[order], key[order], score[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        last, kept = rank == self.k - 1, rank < self.k
        self.least[row[last]] = score[last]
        self.rows, self.waiting = [(row[kept], key[kept], score[kept])], 0
        return self.rows[0]


def tasks(df: DataFrame) -> int:
    """Tasks for costly work on a table whose rows come in few files."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def runs(column: pa.Array) -> list[tuple[int, int]]:
    """First and last place (exclusive) of each run of equal values."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(codes)], strict=True))


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def nearest(queries: DataFrame, store: DataFrame, k: int, digits: int, key: str = "vec_id", group: str | None = None) -> DataFrame:
    """(group,) qid, key, score: of a block of queries, each task's k nearest vectors (of each group); rows with null keys are left out.

    Vectors are read in Arrow batches and compared with all queries of the block by products of matrices; a task holds k rows a query, of one group at a time.
    """
    asked = store.sparkSession.sparkContext.broadcast(Queries(queries))
    rows = store.select(*([group] if group else []), key, "embedding").filter(F.col(key).isNotNull())
    rows = rows.repartitionByRange(tasks(store), group, F.xxhash64(key)).sortWithinPartitions(group) if group else rows.repartition(tasks(store))
    fields = [rows.schema[group]] if group else []
    schema = StructType([*fields, queries.schema["qid"], rows.schema[key], StructField("score", DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best, of = asked.value, None, None

        def told() -> Iterator[pa.RecordBatch]:
            row, found, score = best.settle()
            for s in range(0, len(row), ROWS):
                part = slice(s, s + ROWS)
                own = [pa.array([of] * len(row[part]), kind)] if group else []
                yield pa.record_batch([*own, q.qids.take(pa.array(row[part])), pa.array(found[part], key_kind), pa.array(score[part])], schema.names)

        for batch in batches:
            kind, key_kind = batch.schema.field(0).type, batch.schema.field(key).type
            for first, last in runs(batch.column(0)) if group else [(0, batch.num_rows)]:
                now = batch.column(0)[first].as_py() if group else None
                if best is None or now != of:
                    if best is not None:
                        yield from told()
                    best, of = Nearest(len(q), k, digits), now
                for s in range(first, last, BATCH):
                    part = batch.slice(s, min(BATCH, last - s))
                    for asking, own in q.groups:
                        best.add(asking, own, unit(part.column("embedding"), own.shape[1]), numbers(part.column(key)))
        if best is not None:
            yield from told()

    return rows.mapInArrow(compare, schema)


def top_k(queries: DataFrame, store: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """qid, vec_id, score, rank of the k most similar vectors; ties by vec_id.  Queries are taken in blocks.

    Each task keeps k of its vectors first, so what meets in a query's task is bounded whatever the store's size.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    first = lambda near: near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return in_blocks(queries, lambda block: first(nearest(block, store, k, digits)).select("qid", "vec_id", "score", "rank"))


def over_threshold(queries: DataFrame, store: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """qid, vec_id, score of all pairs that reach the threshold."""
    return in_blocks(queries, lambda block: _over(block, store, threshold, digits))


def _over(queries: DataFrame, store: DataFrame, threshold: float, digits: int) -> DataFrame:
    asked = store.sparkSession.sparkContext.broadcast(Queries(queries))
    rows = store.select("vec_id", "embedding").repartition(tasks(store))
    schema = StructType([queries.schema["qid"], rows.schema["vec_id"], StructField("score", DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH):
                part = batch.slice(s, BATCH)
                for asking, own in q.groups:
                    vectors = unit(part.column("embedding"), own.shape[1])
                    for t in range(0, len(asking), TILE):
                        scores = own[t : t + TILE] @ vectors.T
                        at, place = np.nonzero(scores >= threshold - 10.0**-digits)
                        score = np.round(scores[at, place], digits) + 0.0
                        hit = score >= threshold
                        yield pa.record_batch([q.qids.take(pa.array(asking[t + at[hit]])), part.column("vec_id").take(pa.array(place[hit])), pa.array(score[hit])], schema.names)

    return rows.mapInArrow(compare, schema)


def mmr(queries: DataFrame, store: DataFrame, k: int = 5, fetch: int = 20, trade: float = 0.5) -> DataFrame:
    """qid, rank, vec_id by maximal marginal relevance: of the ``fetch`` nearest, k picked one by one by
    trade * similarity to the query - (1 - trade) * largest similarity to one picked before.  A group has ``fetch`` rows at most."""
    near = top_k(queries, store, fetch).join(store.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "query"), "qid")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v = np.stack(pdf["embedding"].to_list()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        q = np.array(pdf["query"].iloc[0], float)
        to_query, between, picked = v @ (q / max(np.linalg.norm(q), 1e-12)), v @ v.T, []
        while len(picked) < min(k, len(v)):
            far = between[:, picked].max(1) if picked else np.zeros(len(v))
            value = trade * to_query - (1 - trade) * far
            value[picked] = -np.inf
            picked.append(int(np.argmax(np.round(value, 12))))
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "rank": range(1, len(picked) + 1), "vec_id": pdf["vec_id"].to_numpy()[picked]})

    return near.groupBy("qid").applyInPandas(pick, f"qid {near.schema['qid'].dataType.simpleString()}, rank int, vec_id long")


def union_of(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, the first of each key."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    first = out.groupBy(key).agg(F.min("__part").alias("__part"))
    return out.join(first, [key, "__part"]).drop("__part").dropDuplicates([key])


def in_all_types(store: DataFrame, key: str, types: list) -> DataFrame:
    """Keys that occur with each of the types."""
    return store.filter(F.col("type").isin(*types)).groupBy(key).agg(F.count_distinct("type").alias("n")).filter(F.col("n") == len(set(types))).select(key)


def top_by_score(store: DataFrame, k: int, key: str = "source") -> DataFrame:
    """The k entries of largest stored ``score``; ties by key."""
    return store.orderBy(F.desc("score"), key).limit(k)


def keyword(store: DataFrame, word: str, text: str = "content") -> DataFrame:
    return store.filter(F.contains(F.lower(text), F.lit(word.lower())))


def context(hits: DataFrame, by: str = "qid") -> DataFrame:
    """The hits (rank, source, content) of a query as one text, in order of rank."""
    part = F.concat(F.lit("["), "source", F.lit("]\n"), "content")
    return hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def hashed_terms(text: Column, dimensions: int = 64) -> Column:
    """A unit vector of hashed word counts: an embedding without a model."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")
    # sorted places with a sentinel for each dimension: one pass counts them all, where a filter per dimension would hash every word again
    places = F.array_sort(F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions))), F.sequence(F.lit(0).cast("long"), F.lit(dimensions).cast("long"))))

    def counted(p: Column) -> Column:
        # where a place begins in the sorted array; the difference to the next one's beginning is its count and its sentinel
        begins = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimensions).cast("long")), lambda i: F.array_position(p, i))
        return _bound(begins, lambda b: F.transform(F.slice(b, 1, dimensions), lambda x, i: (F.get(b, i + 1) - x - 1).cast("double")))

    unit = lambda c: _bound(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return _bound(places, lambda p: _bound(counted(p), unit))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def chunk_retrieval(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per document and query, its k nearest chunks.  ``chunks``: doc_id, chunk_id, embedding."""
    order = Window.partitionBy("doc_id", "qid").orderBy(F.desc("score"), "chunk_id")

    def near(block: DataFrame) -> DataFrame:
        s = nearest(block, chunks, k, 6, "chunk_id", "doc_id")
        return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", "qid", "chunk_id", "score", "rank")

    return in_blocks(queries, near)


class VectorStore:
    """A Parquet table of vectors: build, add, delete, search, count."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame) -> None:
        vectors.write.mode("overwrite").parquet(self.path)

    def add(self, vectors: DataFrame) -> None:
        vectors.write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def without(self, ids: DataFrame) -> DataFrame:
        """The store less some vec_ids; written elsewhere by the caller, since a table is not overwritten while it is read."""
        return self.load().join(ids.select("vec_id"), "vec_id", "left_anti")

    def stats(self) -> DataFrame:
        return self.load().agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"))
