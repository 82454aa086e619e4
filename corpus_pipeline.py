"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each stage's result as
Parquet to the shared folder and gives it, read again, to the next.

Defined results of all stages: null and empty texts are kept by every stage but the mix, where they have no tokens and go along free in a leaf that has any;
rows without a doc_id are kept as they are; repeated rows are treated alike; an empty table gives an empty one; a document's own columns come
out as they went in, whatever they are called (but for text and n_chars, and for domain, tokens and epoch in the mix, which adds these).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from maskwright.llm.common import materialize
from maskwright.llm.queries import MIX

#: SQL cannot train or score the network of the first stage; tests/llm/test_whole_pipeline.py holds run() against a plain version instead.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns in one, out of the way of those that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("__own"))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_packed(docs), model, out="toxicity")
    return scored.filter(F.col("toxicity") < 0.5).select("__own.*")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; ``n_chars`` follows the text."""
    out = line_dedup.drop_lines(_packed(docs), min_docs=10)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("__own")[c]).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by shingles of five words and a similarity of 0.8."""
    groups = ngram_join.similar_groups(docs, shingle=5, threshold=(80, 100))
    gone = materialize(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth, or none, stands in a benchmark passage."""
    found = decontaminate.contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select("__own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights, with domain, tokens and epoch."""
    return mixing.mix(docs, **MIX)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("ngram_join", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
