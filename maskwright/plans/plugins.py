"""Detectors that need a model: Arrow batches, loaded once per task, off unless given."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.spans import EMPTY, merge_overlaps

Found = list[dict]  #: phi_type, text, start_pos, end_pos, confidence

# What common recognisers call their entities, with the type and confidence that results must carry.
ENTITY_LABELS: dict[str, tuple[str, float]] = {
    "PERSON": ("NAME", 0.85), "PER": ("NAME", 0.85), "GPE": ("LOCATION", 0.80), "LOC": ("LOCATION", 0.75), "FAC": ("LOCATION", 0.70), "ORG": ("HOSPITAL_NAME", 0.75),
    "DATE": ("DATE", 0.80), "TIME": ("DATE", 0.75), "CARDINAL": ("OTHER", 0.50), "ORDINAL": ("OTHER", 0.50),
}


def labelled(hits: Found, labels: dict[str, tuple[str, float]]) -> Found:
    """Entities by a model's own ``label`` as types with their confidence; labels that are not listed are left out."""
    return [{**{k: v for k, v in h.items() if k != "label"}, "phi_type": labels[h["label"]][0], "confidence": labels[h["label"]][1]} for h in hits if h["label"] in labels]


def model_stage(load: Callable[[], Callable[[str], Found]], tool: str, text: str = "text", threads: int = 1, least: float = 0.0, labels: dict[str, tuple[str, float]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A pipeline stage that adds a model's entities to ``spans`` and merges.  ``load`` runs once per task; a remote model may use several
    threads; a text on which it fails gets none of its spans, the failure's class goes to ``<tool>_error``.  With ``labels`` (such as ``ENTITY_LABELS``) the model gives a ``label`` in place of type and confidence."""

    def stage(df: DataFrame) -> DataFrame:
        @F.pandas_udf(f"spans {EMPTY}, error string")
        def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()

            def one(t: str | None) -> tuple[Found, str | None]:
                try:
                    hits = model(t) if t else []
                    hits = [h for h in (labelled(hits, labels) if labels else hits) if h["confidence"] >= least]
                    return [{**h, "tool": tool, "rule_id": tool, "seq": 900} for h in hits], None
                except Exception as e:  # one text's failure is its own
                    return [], type(e).__name__

            with ThreadPoolExecutor(threads) as pool:
                for p in parts:
                    yield pd.DataFrame(list(pool.map(one, p)), columns=["spans", "error"])

        out = df.withColumn("__found", found(F.col(text)))
        return out.withColumns({"spans": merge_overlaps(F.concat("spans", "__found.spans")), f"{tool}_error": F.col("__found.error")}).drop("__found")

    return stage
