"""De-identification end to end: detect, resolve, mask, validate, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import keeps_age, language
from maskwright.functions.types import STANDARD, STRICT
from maskwright.operators.identifiers import id_spans, phone_spans
from maskwright.operators.masking import Mask, apply_masks, leaks, redaction
from maskwright.operators.rules import PARITY, Rule
from maskwright.operators.spans import scan, with_spans

Stage = Callable[[DataFrame], DataFrame]
Detector = Callable[[Column], Column]


def rule_detectors(rules: Iterable[Rule] = PARITY, ids: bool = True, phones: bool = True) -> list[Detector]:
    """Pattern, identifier and phone tools."""
    rules = tuple(rules)
    return [lambda t: scan(t, rules), *([id_spans] if ids else []), *([phone_spans] if phones else [])]


def resolve_types(required: Iterable[str] = (), strict: bool = False) -> tuple[str, ...]:
    """Types to mask: the required ones, else the strict or the standard set."""
    return tuple(required) or (STRICT if strict else STANDARD)


@dataclass(frozen=True)
class Deidentifier:
    """Stages over a table with a text column.  No stage shuffles.

    ``types``: types that are masked (none: all).  ``extra``: stages that run after masking.  Detectors that need Python (models) are added
    as ``plugins``: DataFrame to DataFrame, adding to the span array column ``spans``.
    """

    detectors: list[Detector] = field(default_factory=rule_detectors)
    mask: Mask = field(default_factory=redaction)
    types: tuple[str, ...] = ()
    plugins: tuple[Stage, ...] = ()
    extra: tuple[Stage, ...] = ()
    skip: frozenset[str] = frozenset()

    def stages(self, text: str) -> list[tuple[str, Stage]]:
        def keep(df: DataFrame) -> DataFrame:
            wanted = F.filter("spans", lambda s: (s["phi_type"].isin(*self.types) if self.types else F.lit(True)) & keeps_age(s["phi_type"], s["text"]))
            return df.withColumn("spans", wanted)

        listed: list[tuple[str, Stage]] = [
            ("language", lambda df: df.withColumn("language", language(F.col(text)))),
            ("detect", lambda df: with_spans(df, self.detectors, text, resolve=not self.plugins)),
            *[(f"plugin_{i}", p) for i, p in enumerate(self.plugins)],
            ("filter", keep),
            ("mask", lambda df: df.withColumn("masked", apply_masks(F.col(text), F.col("spans"), self.mask))),
            ("validate", lambda df: df.withColumn("residual", leaks(F.col("masked"), F.col("spans"))).withColumn("valid", F.size("residual") == 0)),
            *[(f"extra_{i}", e) for i, e in enumerate(self.extra)],
        ]
        return [(n, s) for n, s in listed if n not in self.skip]

    def run(self, docs: DataFrame, text: str = "text") -> DataFrame:
        for _, stage in self.stages(text):
            docs = docs.transform(stage)
        return docs


def table_rows(table: DataFrame, columns: list[str], key: str) -> DataFrame:
    """A table's rows as documents: key and the combined text of its columns."""
    from maskwright.sources.documents import combined

    return table.select(key, combined(columns).alias("text"))
