"""Reports over spans, documents, jobs and files: sums before shuffles, ratios after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_distribution(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per type (and ``by``): count, mean, least and largest confidence."""
    c = F.col("confidence")
    return spans.groupBy(*by, "phi_type").agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence")
    )


def confidence_stats(spans: DataFrame) -> DataFrame:
    """One row; zeros where there are no spans."""
    c, zero = F.col("confidence"), F.lit(0.0)
    return spans.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(c), 6), zero).alias("mean"), F.coalesce(F.min(c), zero).alias("min"), F.coalesce(F.max(c), zero).alias("max"))


def audit(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), spans: str = "spans") -> DataFrame:
    """One row per entity."""
    return docs.select(*keys, F.posexplode(spans).alias("entity_id", "s")).select(*keys, "entity_id", "s.phi_type", "s.text", "s.start_pos", "s.end_pos", "s.confidence")


def totals(docs: DataFrame, spans: str = "spans", by: tuple[str, ...] = ()) -> DataFrame:
    """Documents, entities and their mean number per document; with ``by``, subtotals and the whole (rollup)."""
    grouped = docs.rollup(*by) if by else docs.groupBy()
    n = F.size(spans).cast("long")
    return grouped.agg(F.count("*").alias("documents"), F.sum(n).alias("entities"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("mean_entities"))


def display_names(types: Column, shown: int = 3) -> Column:
    """The first names and 'etc.' for more."""
    head = F.array_join(F.slice(types, 1, shown), ", ")
    return F.when(F.size(types) > shown, F.concat(head, F.lit(" etc."))).otherwise(head)


def hints(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), most: int = 5) -> DataFrame:
    """Per document and type: largest confidence and up to ``most`` distinct texts."""
    by = [*keys, "phi_type"]
    once = spans.groupBy(*by, "text").agg(F.max("confidence").alias("confidence"))
    best = Window.partitionBy(*by)
    # only the first texts of a type, and the confidence of all of them, meet in one task
    first = once.filter(F.col("text").isNotNull()).withColumn("n", F.row_number().over(best.orderBy("text"))).filter(F.col("n") <= most)
    texts = first.groupBy(*by).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    most_sure = once.groupBy(*by).agg(F.max("confidence").alias("max_confidence"))
    return most_sure.join(texts, by, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def job_result(docs: DataFrame, most_errors: int = 10) -> DataFrame:
    """One row of a job's documents (error, spans): counts, success ratio, first errors.

    The errors kept are the smallest by doc_id; a bounded heap per task would do, here counts are per error text first.
    """
    ok = F.col("error").isNull()
    counts = docs.agg(F.count("*").alias("documents"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.size("spans"))), F.lit(0)).alias("entities"))
    errors = docs.filter(~ok).orderBy("doc_id").limit(most_errors).agg(F.array_sort(F.collect_list(F.struct("doc_id", "error"))).alias("errors"))
    out = counts.crossJoin(errors)  # one row each
    return out.withColumn("success_ratio", F.round(F.coalesce(F.try_divide("succeeded", "documents"), F.lit(0.0)), 6)).withColumn("status", final_status(F.col("failed"), F.col("documents")))


def batch_report(rows: DataFrame) -> DataFrame:
    """Per file: rows, processed and failed ones, success ratio, entities and their mean per processed row, seconds and their mean per row.

    ``rows``: file, ok, entities, seconds."""
    ok = F.col("ok")
    sums = rows.groupBy("file").agg(
        F.count("*").alias("total_rows"), F.count_if(ok).alias("processed_rows"), F.count_if(~ok).alias("failed_rows"), F.coalesce(F.sum(F.when(ok, F.col("entities"))), F.lit(0)).cast("long").alias("entities"),
        F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.avg("seconds"), 6).alias("mean_seconds"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return sums.withColumns({"success_ratio": share("processed_rows", "total_rows"), "mean_entities": share("entities", "processed_rows")})


def summary_report(jobs: DataFrame) -> DataFrame:
    """One row over jobs (job_id, total_rows, processed_rows, entities): sums, success ratio, and the jobs themselves, smallest id first."""
    out = jobs.agg(
        F.count("*").alias("jobs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_rows", "processed_rows", "entities")],
        F.array_sort(F.collect_list(F.struct("job_id", F.col("total_rows").alias("rows"), "entities"))).alias("each"),
    )
    return out.withColumn("success_ratio", F.round(F.coalesce(F.try_divide("processed_rows", "total_rows"), F.lit(0.0)), 6))


def entity_rows(files: DataFrame) -> DataFrame:
    """file, phi_type, value, masked, confidence of every entity in files (file, entities); missing values are shown as redacted."""
    hidden = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("[REDACTED]"))
    each = files.select("file", F.explode("entities").alias("e")).select("file", "e.*")
    return each.select("file", F.coalesce("phi_type", F.lit("")).alias("phi_type"), hidden("value").alias("value"), hidden("masked").alias("masked"), "confidence")


def types_by_count(spans: DataFrame) -> DataFrame:
    """Types, the most frequent first."""
    return spans.groupBy("phi_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phi_type")


def final_status(failed: Column, total: Column) -> Column:
    return F.when((total > 0) & (failed == total), "failed").when(failed > 0, "partial").otherwise("completed")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key: the largest in the order, found by a partial maximum, not by sorting groups."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def throughput(tasks: DataFrame) -> DataFrame:
    """Characters and files per second over finished tasks (chars, files, seconds)."""
    s = F.sum("seconds")
    return tasks.agg(F.round(F.coalesce(F.try_divide(F.sum("chars"), s), F.lit(0.0)), 6).alias("chars_per_second"), F.round(F.coalesce(F.try_divide(F.sum("files"), s), F.lit(0.0)), 6).alias("files_per_second"))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Per stage: runs, failures, total and mean seconds."""
    return stages.groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def visible(rows: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Rows of an owner, or all for an administrator."""
    return rows if admin else rows.filter(F.col("owner") == user)


def newest(rows: DataFrame, when: str, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(when), key).limit(limit)


def running(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Running sum within groups."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))
