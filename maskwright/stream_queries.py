"""Queries over keyed state and progress, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import rules, spans
from maskwright.plans import progress
from maskwright.plans.scratch import fresh_path
from maskwright.queries import EMAIL, query, table
from maskwright.streaming import documents as streams
from maskwright.streaming import state


@query("SELECT user_id, count(*) AS chunks, count(*) AS done, count(*) AS total, 0 AS expired FROM events GROUP BY user_id")
def stream_chunks_once(spark, d):
    """Events as chunks of their users, a third sent again with the first ones and half sent again after a restart: each counts once."""
    rows = table(spark, d, "events")
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    sent = rows.join(totals, "user_id").select("user_id", F.col("event_id").alias("chunk_id"), "total", F.lit("v1").alias("fingerprint"), "ts")
    path, out, checkpoint = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    groups = max(256, totals.count() // 100)
    stream = lambda: state.chunks_once(streams.read_stream(spark, path, sent.schema, files_per_trigger=100), "user_id", "3650 days", groups=groups)
    sent.unionByName(sent.filter("chunk_id % 3 = 0")).filter("chunk_id % 5 <> 0").write.parquet(path)
    state.start_stateful(stream(), out, checkpoint).awaitTermination()
    sent.filter("chunk_id % 2 = 0 or chunk_id % 5 = 0").write.mode("append").parquet(path)
    state.start_stateful(stream(), out, checkpoint).awaitTermination()
    seen = spark.read.parquet(out)
    is_chunk = F.col("event") == "chunk"
    return seen.groupBy("user_id").agg(F.count_if(is_chunk).alias("chunks"), F.max("done").alias("done"), F.max("total").alias("total"), F.count_if(~is_chunk).cast("int").alias("expired"))


_FOUND = rf"len(regexp_extract_all(text, '{EMAIL}'))"


@query(f"""
WITH d AS (SELECT doc_id, {_FOUND} AS n FROM documents), stages AS (
  SELECT 'detect' AS stage, count(*) AS rows, sum(n) AS spans FROM d UNION ALL
  SELECT 'keep', count(*) FILTER (n > 0), sum(n) FROM d UNION ALL
  SELECT 'count', count(*) FILTER (n > 0), NULL FROM d
)
SELECT job, stage, CAST(rows AS BIGINT) AS rows, CAST(spans AS BIGINT) AS spans FROM stages, unnest(['batch', 'stream']) AS t(job)""")
def progress_events(spark, d):
    """Rows and spans of each stage as a job's events tell them, in batch and as a stream."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    emails = rules.of_type(rules.PARITY, "EMAIL")
    stages = [
        ("detect", lambda df: spans.with_spans(df, [lambda t: spans.scan(t, emails)], resolve=False)),
        ("keep", lambda df: df.filter(F.size("spans") > 0)),
        ("count", lambda df: df.select("doc_id", F.size("spans").alias("found"))),
    ]
    wanted = {"spans": ("spans", F.size("spans"))}
    path, source, out = (fresh_path(spark, x) for x in ("progress", "stream-in", "out"))
    batch, stream = progress.Progress(spark, path, "batch"), progress.Progress(spark, path, "stream")
    progress.run(batch, docs, stages, lambda df: df.write.parquet(f"{out}/batch"), wanted)
    files = max(3, docs.count() // 10_000)  # so that a file is no more than a task's share
    docs.repartition(files).write.parquet(source)
    progress.run_stream(stream, streams.read_stream(spark, source, docs.schema, files_per_trigger=-(-files // 3)), stages, f"{out}/stream", f"{out}/checkpoint", wanted)
    told = batch.events().unionByName(stream.events()).filter("event = 'stage_completed'")
    sums = {c: F.sum(F.col("measures")[c]).alias(c) for c in ("rows", "spans")}
    return told.groupBy(F.col("job_id").alias("job"), "stage").agg(*sums.values())
