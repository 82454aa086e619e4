"""Streams of documents: stateless detection and masking, resumed from a checkpoint; event windows; duplicates across chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from maskwright.operators.chunking import windows
from maskwright.operators.spans import distinct_spans, shifted, with_spans
from maskwright.plans.pipeline import Deidentifier, rule_detectors


def read_stream(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def deidentified_stream(docs: DataFrame, engine: Deidentifier | None = None, text: str = "text") -> DataFrame:
    """The same columns as in batch: detection keeps no state."""
    return (engine or Deidentifier()).run(docs, text)


def chunk_spans(docs: DataFrame, size: int = 2000, overlap: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans found chunk by chunk in the documents' places; works on batches and streams."""
    chunks = windows(docs, size, overlap, text, (key,))
    found = with_spans(chunks, rule_detectors(), "content")
    placed = found.select(key, "chunk_id", F.explode(distinct_spans(shifted(F.col("spans"), F.col("start_pos")))).alias("s"))
    return placed.select(key, "chunk_id", "s.*")


def without_overlap_copies(spans: DataFrame, key: str = "doc_id", watermark: tuple[str, str] | None = None) -> DataFrame:
    """One row per (document, start, end, type): overlapping chunks find a span twice.  A stream needs a ``watermark`` (column, delay) to bound its state."""
    keys = [key, "start_pos", "end_pos", "phi_type"]
    return spans.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys) if watermark else spans.dropDuplicates(keys)


def write_lines(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON lines; a query started again with the same checkpoint goes on where it ended."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, path: str, checkpoint: str) -> dict:
    """Process what is there, then stop; the last progress."""
    query = write_lines(df, path, checkpoint)
    query.awaitTermination()
    return {"batches": len(query.recentProgress), "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def progress(done: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: chunks, those that are done, percentage and whether it is complete.  ``done`` and ``chunks``: key, chunk_id."""
    total = chunks.groupBy(key).agg(F.count("*").alias("total"))
    ready = done.dropDuplicates([key, "chunk_id"]).groupBy(key).agg(F.count("*").alias("done"))
    out = total.join(ready, key, "left").select(key, "total", F.coalesce("done", F.lit(0)).cast("long").alias("done"))
    return out.withColumns({"percent": F.round(F.least(100.0 * F.col("done") / F.col("total"), F.lit(100.0)), 6), "complete": F.col("done") >= F.col("total")})


def reset(spark: SparkSession, checkpoint: str) -> bool:
    """Forget a query's progress: its checkpoint folder goes; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def with_errors(chunks: DataFrame, step: Column, out: str, check: Column) -> DataFrame:
    """``out`` by ``step`` where ``check`` holds, else null and an ``error``: a faulty chunk does not end the others."""
    return chunks.withColumns({out: F.when(F.coalesce(check, F.lit(False)), step), "error": F.when(~F.coalesce(check, F.lit(False)), F.lit("invalid_chunk"))})


def write_batches(df: DataFrame, output: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch given to ``output`` (batch, number), once per checkpoint if ``output`` is idempotent by number."""
    return df.writeStream.foreachBatch(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_discovery(known: DataFrame, callback: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """An output for ``write_batches`` that calls back with the types of a batch (phi_type) which ``known`` (name) lacks."""
    from maskwright.functions.types import discovered

    return lambda batch, number: callback(discovered(batch.select("phi_type"), known))


def fingerprints(files: DataFrame) -> DataFrame:
    """path and a hash of a file's length, time and first MiB: a changed file is a new input.  ``files``: path, length, modified, bytes."""
    head = F.sha2(F.substring("bytes", 1, 1 << 20), 256)
    return files.select("path", F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.col("modified").cast("string"), head), 256).alias("fingerprint"))


def to_process(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or changed against a manifest (path, fingerprint)."""
    return files.join(manifest, ["path", "fingerprint"], "left_anti")


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with ``delay`` late rows are dropped after it (streams)."""
    rows = events.withWatermark("ts", delay) if delay else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: start, end, number of events."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
