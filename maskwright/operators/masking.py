"""Masks of values, texts and tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import CJK
from maskwright.functions.types import literal_map
from maskwright.operators.replacement import replacing

Mask = Callable[[Column, Column], Column]  #: (value, type) to mask

# Pseudonym forms per type, date formats in the order in which they are tried, and policies per type.
PSEUDONYMS = {
    "NAME": "Patient-{hash}", "PHONE": "XXX-XXXX-{hash}", "EMAIL": "patient{hash}@example.com", "MEDICAL_RECORD_NUMBER": "MRN-{hash}",
    "SSN": "XXX-XX-{hash}", "ID": "ID-{hash}", "ACCOUNT_NUMBER": "ACC-{hash}",
}
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy")
POLICY = {
    "AGE_OVER_89": "generalization", "AGE_OVER_90": "generalization", "NAME": "pseudonymization", "MEDICAL_RECORD_NUMBER": "pseudonymization",
    "DATE": "date_shifting", "PHONE": "partial", "SSN": "partial", "ID": "partial",
}


def redaction(placeholder: str = "[REDACTED]", mask_char: str | None = None) -> Mask:
    return lambda value, kind: F.lit(placeholder) if mask_char is None else F.repeat(F.lit(mask_char), F.char_length(value))


def generalization(custom: Mapping[str, Callable[[Column], Column]] | None = None, year_aware: bool = False) -> Mask:
    """Ages to a bucket, dates to their first four characters (with ``year_aware``: to their year), places to a tag."""

    def mask(value: Column, kind: Column) -> Column:
        year = F.coalesce(F.nullif(F.regexp_extract(value, r"(\d{4})", 1), F.lit("")), F.lit("[DATE]")) if year_aware else F.substring(value, 1, 4)
        english = F.lower(value).contains("year")
        out = F.when(F.lit(False), value)
        for t, f in (custom or {}).items():
            out = out.when(kind == t, f(value))
        return (
            out.when(kind == "AGE_OVER_89", F.when(english, "≥90 years").otherwise("≥90歲"))
            .when(kind == "AGE_OVER_90", F.when(english, ">90 years").otherwise(">90歲"))
            .when(kind == "DATE", F.when(F.char_length(value) >= 4, year).otherwise("[DATE]"))
            .when(kind == "LOCATION", F.when(value.rlike(CJK), "[地區]").otherwise("[LOCATION]"))
            .otherwise("[GENERALIZED]")
        )

    return mask


def pseudonymization(salt: str = "", length: int = 4, forms: Mapping[str, str] | None = None) -> Mask:
    """A form per type around the first digits of a salted hash: equal values have equal pseudonyms."""

    def mask(value: Column, kind: Column) -> Column:
        digits = F.upper(F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, length))
        form = F.coalesce(F.try_element_at(literal_map({**PSEUDONYMS, **(forms or {})}), kind), F.lit("PSEUDO-{hash}"))
        return F.replace(form, F.lit("{hash}"), digits)

    return mask


def seeded_offset(seed: Column, least: int = -365, most: int = 365) -> Column:
    """A day offset in the range, fixed by the seed's hash: the 256-bit number modulo the range's size."""
    if most < least:
        raise ValueError("the range must be ordered")
    span, digest = most - least + 1, F.sha2(seed.cast("string"), 256)
    rest = F.lit(0).cast("long")
    for i in range(0, 64, 8):  # modulo by eight hexadecimal digits at a time
        rest = (rest * (1 << 32) + F.conv(F.substring(digest, i + 1, 8), 16, 10).cast("long")) % span
    return (rest + least).cast("int")


def parsed_date(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def date_shifting(offset: Column | int, preserve_year: bool = False) -> Mask:
    """Dates moved by days, in ISO form; what is no date becomes [DATE].  The 29th of February in a kept year without one does too."""
    days = F.lit(offset) if isinstance(offset, int) else offset

    def mask(value: Column, kind: Column) -> Column:
        date = parsed_date(value)
        moved = F.date_format(F.date_add(date, days), "yyyy-MM-dd")
        if preserve_year:
            moved = F.concat(F.date_format(date, "yyyy"), F.substring(moved, 5, 6))
            moved = F.when(F.try_to_timestamp(moved, F.lit("yyyy-MM-dd")).isNotNull(), moved)
        return F.coalesce(moved, F.lit("[DATE]"))

    return mask


def partial(keep_prefix: int = 2, keep_suffix: int = 2, mask_char: str = "*") -> Mask:
    """Both ends stay; values no longer than these are masked whole."""

    def mask(value: Column, kind: Column) -> Column:
        n = F.char_length(value)
        middle = F.repeat(F.lit(mask_char), n - keep_prefix - keep_suffix)
        tail = F.right(value, F.lit(keep_suffix)) if keep_suffix else F.lit("")
        return F.when(n <= keep_prefix + keep_suffix, F.repeat(F.lit(mask_char), n)).otherwise(F.concat(F.substring(value, 1, keep_prefix), middle, tail))

    return mask


def suppression() -> Mask:
    return lambda value, kind: F.lit("")


STRATEGIES: dict[str, Callable[..., Mask]] = {
    "redaction": redaction, "generalization": generalization, "pseudonymization": pseudonymization, "date_shifting": date_shifting, "partial": partial, "suppression": suppression,
}


def strategy(name: str, **options) -> Mask:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name](**options)


def by_type(masks: Mapping[str, Mask], default: Mask) -> Mask:
    """Each type its mask."""

    def mask(value: Column, kind: Column) -> Column:
        out = F.when(F.lit(False), value)
        for t, m in masks.items():
            out = out.when(kind == t, m(value, kind))
        return out.otherwise(default(value, kind))

    return mask


def recommended(offset: Column | int = 0, salt: str = "") -> Mask:
    """The policy per type: ages generalised, names and record numbers pseudonymised, dates shifted, numbers partly masked, others redacted."""
    made = {"generalization": generalization(), "pseudonymization": pseudonymization(salt), "date_shifting": date_shifting(offset), "partial": partial()}
    return by_type({t: made[s] for t, s in POLICY.items()}, redaction())


def apply_masks(text: Column, spans: Column, mask: Mask) -> Column:
    """The text with each span replaced.  ``spans`` are ordered and do not overlap (merge first); one walk from left to right."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start_pos"] - acc["at"])
        return F.struct(s["end_pos"].alias("at"), F.concat(acc["out"], F.array(kept, F.coalesce(mask(s["text"], s["phi_type"]), s["text"]))).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def leaks(masked: Column, spans: Column) -> Column:
    """Spans whose text still stands in the masked text."""
    return F.filter(spans, lambda s: (F.char_length(s["text"]) > 0) & F.contains(masked, s["text"]))


def no_leak(masked: Column, spans: Column) -> Column:
    return F.size(leaks(masked, spans)) == 0


# ---------------------------------------------------------------- service masks


def hmac_sha256(key: str, text: Column) -> Column:
    """Hexadecimal HMAC-SHA256 from nested hashes."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


@dataclass(frozen=True)
class TypeConfig:
    enabled: bool = True
    masking: str | None = None
    replace_with: str | None = None


@dataclass(frozen=True)
class MaskConfig:
    """Masking per type.  ``types``: what is enabled (none given: all types)."""

    default_masking: str = "redact"
    types: Mapping[str, TypeConfig] = field(default_factory=dict)
    secret: str | None = None  #: needed where values are hashed

    def masking_of(self, phi_type: str) -> str:
        own = self.types.get(phi_type)
        renamed = {"redact": "mask", "pseudonymize": "hash"}
        return (own.masking if own and own.masking else None) or renamed.get(self.default_masking, self.default_masking)


def service_mask(value: Column, kind: Column, masking: Column, replace_with: Column, secret: str) -> Column:
    """hash / pseudonymize, replace, delete, keep, generalize, else redact; empty values are redacted."""
    tag = F.concat(F.lit("["), kind, F.lit("]"))
    hashed = F.concat(F.lit("["), kind, F.lit("_"), F.substring(hmac_sha256(secret, value), 1, 12), F.lit("]"))
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "[REDACTED]")
        .when(masking.isin("hash", "pseudonymize"), hashed)
        .when(masking == "replace", F.coalesce(F.nullif(replace_with, F.lit("")), tag))
        .when(masking == "delete", "")
        .when(masking == "keep", value)
        .when(masking == "generalize", tag)
        .otherwise("[REDACTED]")
    )


def configured(entities: DataFrame, config: MaskConfig) -> DataFrame:
    """Rows (phi_type, text, ...) of enabled types with ``masked``.  Type names are expected normalised."""
    kind = F.col("phi_type")
    enabled = kind.isin(*[t for t, c in config.types.items() if c.enabled]) if config.types else F.lit(True)
    known = {t: config.masking_of(t) for t in config.types}
    masking = F.coalesce(F.try_element_at(literal_map(known), kind), F.lit(config.masking_of(""))) if known else F.lit(config.masking_of(""))
    texts = {t: c.replace_with for t, c in config.types.items() if c.replace_with}
    replaced = F.try_element_at(literal_map(texts), kind) if texts else F.lit(None).cast("string")
    if config.secret is None and {"hash", "pseudonymize"} & {config.masking_of(t) for t in ("", *config.types)}:
        raise ValueError("hashing needs a secret")
    return entities.filter(enabled).withColumn("masked", service_mask(F.col("text"), kind, masking, replaced, config.secret or ""))


# The presets' masking and, per type, its own masking (None: the type is off).
PRESETS: dict[str, tuple[str, dict[str, str | None]]] = {
    "hipaa_standard": (
        "redact",
        {
            "NAME": "mask", "DATE": "mask", "PHONE": "mask", "FAX": "mask", "EMAIL": "mask", "SSN": "mask", "MEDICAL_RECORD": "mask", "ID_NUMBER": "mask", "ACCOUNT": "mask", "LICENSE": "mask",
            "VEHICLE": "mask", "DEVICE": "mask", "URL": "mask", "IP": "mask", "BIOMETRIC": "mask", "PHOTO": "mask", "AGE_OVER_89": "mask", "ADDRESS": "mask", "LOCATION": "mask",
        },
    ),
    "minimal": ("redact", {"NAME": "mask", "ID_NUMBER": "mask", "SSN": "mask", "MEDICAL_RECORD": "mask"}),
    "research_safe": ("pseudonymize", {"NAME": "hash", "DATE": None, "PHONE": "mask", "EMAIL": "hash", "ADDRESS": "mask", "ID_NUMBER": "hash", "MEDICAL_RECORD": "hash"}),
}
#: the detectors' types that the presets' names stand for
PRESET_TYPES = {"MEDICAL_RECORD": "MEDICAL_RECORD_NUMBER", "ID_NUMBER": "ID", "ACCOUNT": "ACCOUNT_NUMBER", "LICENSE": "CERTIFICATE", "DEVICE": "DEVICE_ID", "IP": "IP_ADDRESS", "ADDRESS": "LOCATION"}


def preset(name: str, secret: str | None = None) -> MaskConfig:
    """hipaa_standard, minimal or research_safe, under the detectors' type names (and the preset's own)."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}; there are {', '.join(sorted(PRESETS))}")
    masking, listed = PRESETS[name]
    types = {t: TypeConfig(enabled=m is not None, masking=m or "keep") for t, m in listed.items()}
    return MaskConfig(default_masking=masking, types={**{PRESET_TYPES[t]: c for t, c in types.items() if t in PRESET_TYPES}, **types}, secret=secret)


def to_json(config: MaskConfig) -> str:
    """A configuration as JSON, without its secret."""
    import json

    return json.dumps({"masking_type": config.default_masking, "phi_types": {t: {"enabled": c.enabled, "masking": c.masking, "replace_with": c.replace_with} for t, c in config.types.items()}}, ensure_ascii=False, sort_keys=True)


def from_json(text: str, secret: str | None = None) -> MaskConfig:
    import json

    read = json.loads(text)
    return MaskConfig(default_masking=read.get("masking_type", "redact"), types={t: TypeConfig(**c) for t, c in read.get("phi_types", {}).items()}, secret=secret)


def filtered_out(entities: DataFrame, config: MaskConfig) -> DataFrame:
    """The entities that a configuration leaves unmasked, for the log: their types and numbers, never their texts."""
    if not config.types:
        return entities.limit(0).groupBy("phi_type").count()
    return entities.filter(~F.col("phi_type").isin(*[t for t, c in config.types.items() if c.enabled])).groupBy("phi_type").count()


def storage_safe(entities: DataFrame, raw_allowed: bool = False) -> DataFrame:
    """What may be stored: values and reasons hidden unless raw ones are allowed."""
    return entities if raw_allowed else entities.withColumns({"text": F.lit("[REDACTED]"), "reason": F.lit("")})


def response_safe(entities: Column, requested: Column, allowed: bool) -> Column:
    """struct(entities, raw_requested, raw_allowed, raw_available, raw_included): values only if asked for, allowed and there."""
    there = F.exists(entities, lambda s: (s["text"] != "[REDACTED]") & (s["text"] != ""))
    reveal = requested & F.lit(allowed) & there
    shown = F.transform(entities, lambda s: F.when(reveal, s).otherwise(s.withField("text", F.lit("[REDACTED]"))))
    return F.struct(shown.alias("entities"), requested.alias("raw_requested"), F.lit(allowed).alias("raw_allowed"), there.alias("raw_available"), reveal.alias("raw_included"))


# ---------------------------------------------------------------- tables


def replacement_pairs(entities: DataFrame) -> DataFrame:
    """One (value, mask) per value, the last by ``seq``; empty values do not count."""
    return entities.filter("value <> ''").groupBy("value").agg(F.max_by("masked", "seq").alias("masked"))


def replaced(cell: Column, pairs: Column) -> Column:
    """All pairs (array<struct<value, masked>>) applied to a cell at once: the leftmost value, there the longest; masks are left alone."""

    def longest(a: Column, b: Column) -> Column:
        n, m = F.char_length(a["value"]), F.char_length(b["value"])
        return F.when(n != m, m - n).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).when(a["masked"] < b["masked"], -1).when(a["masked"] > b["masked"], 1).otherwise(0)

    ordered = F.array_sort(F.filter(pairs, lambda p: p["value"] != ""), longest)
    quoted = F.transform(ordered, lambda p: F.concat(F.lit("\\Q"), F.replace(p["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.array_join(quoted, "|")
    masks = F.transform(F.regexp_extract_all(cell, pattern, F.lit(0)), lambda v: F.get(F.filter(ordered, lambda p: p["value"] == v), 0)["masked"])
    put = F.array_join(F.zip_with(F.split(cell, pattern, -1), masks, lambda rest, mask: F.concat(rest, F.coalesce(mask, F.lit("")))), "")
    return F.when(F.size(ordered) > 0, put).otherwise(cell)


def mask_table(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every cell as text with all pairs applied at once (the last mask of a value).  ``pairs`` is a case's list; for pairs per row use ``replaced`` after a join, for a table
    of pairs ``replacement.replace_all``."""
    apply = replacing({v: m for v, m in pairs if v})
    return table.withColumns({c: apply(F.col(c).cast("string")) for c in table.columns})


def with_sheet(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Sheets one under the other, with ``__sheet`` if there are several."""
    parts = [df.withColumn("__sheet", F.lit(name)) if len(sheets) > 1 else df for name, df in sheets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def regenerated(text: Column, entities: Column) -> Column:
    """Masks put into a text by entities (value, masked, start_pos, end_pos), from the right; where the value does not stand at its place, its
    first occurrence is replaced, and nothing if there is none."""

    def from_right(a: Column, b: Column) -> Column:
        return F.signum((b["start_pos"] - a["start_pos"]).cast("double")).cast("int")

    def step(acc: Column, e: Column) -> Column:
        there = F.substring(acc, e["start_pos"] + 1, e["end_pos"] - e["start_pos"]) == e["value"]
        spliced = F.concat(F.substring(acc, F.lit(1), e["start_pos"]), e["masked"], F.substring(acc, e["end_pos"] + 1, F.char_length(acc)))
        at = F.call_function("locate", e["value"], acc)
        first = F.concat(F.substring(acc, F.lit(1), at - 1), e["masked"], F.substring(acc, at + F.char_length(e["value"]), F.char_length(acc)))
        return F.when(there, spliced).when(at > 0, first).otherwise(acc)

    return F.aggregate(F.array_sort(F.filter(entities, lambda e: F.char_length(e["value"]) > 0), from_right), text, step)
