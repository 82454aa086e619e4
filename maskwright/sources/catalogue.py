"""Catalogues of files and tasks: owners' views, latest tasks, directory statistics, packed exports."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.plans.reports import latest


def listing(files: DataFrame, tasks: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """An owner's files (file_id, owner, name, uploaded) with their latest task (file_id, task_id, status, created), newest first."""
    own = files if admin else files.filter(F.col("owner") == user)
    last = latest(tasks.select("file_id", "task_id", "status", "created"), "file_id", [F.col("created"), F.col("task_id")])
    return own.join(last, "file_id", "left").orderBy(F.desc("uploaded"), "file_id")


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks that were running when the service ended are marked as interrupted."""
    return tasks.withColumn("status", F.when(F.col("status").isin("running", "processing"), "interrupted").otherwise(F.col("status")))


def status_counts(tasks: DataFrame, statuses: tuple[str, ...] = ("pending", "processing", "completed", "failed")) -> DataFrame:
    return tasks.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def directory_stats(files: DataFrame, folder: Column) -> DataFrame:
    """Files and bytes by folder.  ``files``: path, length."""
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def packed(outputs: DataFrame, most_bytes: int = 64 << 20) -> bytes:
    """A ZIP of small outputs (name, bytes), whose total size is checked; equal names are numbered."""
    size = outputs.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{size} bytes are more than {most_bytes}")
    out, seen = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for row in outputs.orderBy("name").toLocalIterator():
            n = seen[row["name"]] = seen.get(row["name"], 0) + 1
            stem, dot, end = row["name"].rpartition(".")
            name = row["name"] if n == 1 else f"{stem or end}_{n}{dot}{end if stem else ''}"
            book.writestr(name, bytes(row["bytes"]))
    return out.getvalue()
