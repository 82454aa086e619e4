"""Progress of a running job as rows: what each stage has taken in and found, in batch and in streams.

Counts come from ``observe``: Spark sums them while the job runs, in the same pass, so watching costs no job of its own.  Events are JSON lines in a folder of the
job's, one small file each, and are read as a table while the job is running.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from maskwright.sources.segments import _Files

Stage = Callable[[DataFrame], DataFrame]
SCHEMA = "job_id string, number long, event string, stage string, batch long, measures map<string, long>, error string, seconds double, at double"


class Progress:
    """The events of one job under ``path``."""

    def __init__(self, spark: SparkSession, path: str, job_id: str):
        self.spark, self.path, self.job_id, self.files = spark, path.rstrip("/"), job_id, _Files(spark, path)
        self.number, self.began = 0, time.time()

    def emit(self, event: str, stage: str | None = None, batch: int | None = None, measures: dict | None = None, error: str | None = None) -> None:
        now = time.time()
        row = {"job_id": self.job_id, "number": self.number, "event": event, "stage": stage, "batch": batch, "measures": measures or {}, "error": error, "seconds": now - self.began, "at": now}
        self.number += 1
        self.files.write_new(f"{self.path}/{self.job_id}-{uuid.uuid4().hex}.json", json.dumps(row) + "\n")

    def events(self) -> DataFrame:
        """All events so far, in order."""
        return self.spark.read.schema(SCHEMA).json(self.path, pathGlobFilter="*.json").filter(F.col("job_id") == self.job_id).orderBy("number")

    def name(self, stage: str) -> str:
        return f"{self.job_id}/{stage}"


def measures(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> list[Column]:
    """The number of rows, and the wanted sums (name: column that has to be there, value) that the stage's columns allow."""
    return [F.count(F.lit(1)).alias("rows"), *(F.sum(value).cast("long").alias(name) for name, (needed, value) in wanted.items() if needed in df.columns)]


def watched(progress: Progress, docs: DataFrame, stages: list[tuple[str, Stage]], wanted: dict[str, tuple[str, Column]] | None = None) -> tuple[DataFrame, dict[str, Observation]]:
    """``docs`` through the stages, each one's rows counted as they pass.  For a stream the observations are only named and come with its progress."""
    seen = {}
    for name, stage in stages:
        progress.emit("stage_started", name)
        try:
            docs = stage(docs)
            if docs.isStreaming:
                docs = docs.observe(progress.name(name), *measures(docs, wanted or {}))
            else:
                seen[name] = Observation(progress.name(name))
                docs = docs.observe(seen[name], *measures(docs, wanted or {}))
        except Exception as e:
            progress.emit("stage_failed", name, error=type(e).__name__)
            raise
    return docs, seen


def run(progress: Progress, docs: DataFrame, stages: list[tuple[str, Stage]], action: Callable[[DataFrame], object], wanted: dict[str, tuple[str, Column]] | None = None):
    """What ``action`` (a write) gives for ``docs`` after all stages, with events from beginning to end.  Errors are told by their type alone."""
    progress.emit("job_started")
    out, seen = watched(progress, docs, stages, wanted)
    try:
        result = action(out)
    except Exception as e:
        progress.emit("job_failed", error=type(e).__name__)
        raise
    for name, observation in seen.items():
        progress.emit("stage_completed", name, measures={k: v or 0 for k, v in observation.get.items()})
    progress.emit("job_completed")
    return result


class StreamProgress(StreamingQueryListener):
    """Writes an event for each stage of each micro-batch of the query of one job.  Add it with ``spark.streams.addListener``."""

    def __init__(self, progress: Progress):
        self.progress, self.ids = progress, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.progress.job_id:
            self.ids.add(str(event.id))
            self.progress.emit("job_started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.progress.job_id and p.numInputRows:
            for name, row in p.observedMetrics.items():
                self.progress.emit("stage_completed", name.removeprefix(self.progress.name("")), p.batchId, {k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) in self.ids:
            self.progress.emit("job_failed" if event.exception else "job_completed", error=(event.errorClassOnException or "error") if event.exception else None)


def run_stream(progress: Progress, docs: DataFrame, stages: list[tuple[str, Stage]], path: str, checkpoint: str, wanted: dict[str, tuple[str, Column]] | None = None) -> None:
    """All that is there of a stream through the stages into Parquet files under ``path``, with events for each micro-batch."""
    spark = docs.sparkSession
    out, _ = watched(progress, docs, stages, wanted)
    listener = StreamProgress(progress)
    spark.streams.addListener(listener)
    try:
        writer = out.writeStream.queryName(progress.job_id).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        end = time.time() + 60
        while time.time() < end and not _ended(progress):
            time.sleep(0.1)  # listeners hear of the end a little later
    finally:
        spark.streams.removeListener(listener)


def _ended(progress: Progress) -> bool:
    return progress.events().filter(F.col("event").isin("job_completed", "job_failed")).count() > 0
