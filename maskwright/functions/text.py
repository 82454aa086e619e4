"""Scalar text functions: normal forms, languages, token estimates, scores, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4E00}-\x{9FFF}]"


def collapse(text: Column) -> Column:
    """All white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    return F.lower(collapse(text))


def language(text: Column) -> Column:
    return F.when(text.rlike(CJK), "zh-TW").otherwise("en")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def token_estimate(text: Column) -> Column:
    """CJK / 1.5 + ASCII letters / 4 + others / 2, truncated."""
    cjk, letters = count_of(text, CJK), count_of(text, "[A-Za-z]")
    rest = F.char_length(text) - cjk - letters
    return F.coalesce((cjk / 1.5 + letters / 4.0 + rest / 2.0).cast("long"), F.lit(0).cast("long"))


def short_token_estimate(text: Column) -> Column:
    """1.5 per CJK character and 0.5 per other, truncated."""
    cjk = count_of(text, CJK)
    return (1.5 * cjk + 0.5 * (F.char_length(text) - cjk)).cast("long")


def rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(0.0)


def rule_count(text: Column) -> Column:
    """Rules in a regulation text: the larger of numbered and bulleted lines, 1 at least."""
    return F.greatest(count_of(text, r"(?m)^\s*\d+\."), count_of(text, r"(?m)^\s*[-*•]"), F.lit(1).cast("long"))


def age_number(text: Column) -> Column:
    """The first number (a label before it changes nothing, nor does a unit behind it)."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def keeps_age(phi_type: Column, text: Column) -> Column:
    """Ages count as sensitive from 89 on; unreadable ones do not; other types always."""
    return ~phi_type.isin("AGE_OVER_89", "AGE_OVER_90") | F.coalesce(age_number(text) >= 89, F.lit(False))


def efficiency(f1: Column, milliseconds: Column, prompt_length: Column) -> Column:
    time = F.least(F.lit(1.0), 1000.0 / F.greatest(milliseconds, F.lit(1.0)))
    prompt = F.least(F.lit(1.0), 500.0 / F.greatest(prompt_length, F.lit(1.0)))
    return f1 * (0.7 + 0.15 * time + 0.15 * prompt)


def added_efficiency(f1: Column, milliseconds: Column, prompt_length: Column, most_milliseconds: float = 1000.0, most_length: float = 500.0) -> Column:
    """The additive variant: 70 % F1, 15 % time, 15 % prompt; an unmeasured time or length costs nothing."""
    part = lambda most, x: F.when(x > 0, F.least(F.lit(1.0), most / F.greatest(x, F.lit(1.0)))).otherwise(1.0)
    return 0.7 * f1 + 0.15 * part(most_milliseconds, milliseconds) + 0.15 * part(most_length, prompt_length)


def grade(f1: Column) -> Column:
    return F.when(f1 >= 0.9, "A (Excellent)").when(f1 >= 0.8, "B (Good)").when(f1 >= 0.7, "C (Acceptable)").when(f1 >= 0.5, "D (Poor)").otherwise("F (Fail)")


def duration(seconds: Column) -> Column:
    """Readable duration."""
    hours, minutes = F.floor(seconds / 3600).cast("string"), F.floor(seconds % 3600 / 60).cast("string")
    return (
        F.when(seconds.isNull() | (seconds < 0), "計算中...")
        .when(seconds < 60, F.concat(F.rint(seconds).cast("long").cast("string"), F.lit(" 秒")))
        .when(seconds < 3600, F.concat(minutes, F.lit(" 分 "), F.floor(seconds % 60).cast("string"), F.lit(" 秒")))
        .otherwise(F.concat(hours, F.lit(" 小時 "), minutes, F.lit(" 分")))
    )


def file_size(size: Column) -> Column:
    """Readable size with one decimal."""
    units, out = ("B", "KB", "MB", "GB", "TB"), None
    for i, u in enumerate(units):
        text = F.concat(F.format_string("%.1f", size / float(1024**i)), F.lit(" " + u))
        last = i == len(units) - 1
        here = size < float(1024 ** (i + 1))
        out = F.when(here, text) if out is None else (out.otherwise(text) if last else out.when(here, text))
    return out


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that remain at the rate so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(100.0 * done / total, F.lit(100.0))).otherwise(0.0)


def safe_error(kind: Column) -> Column:
    """What may be told of an exception: its class, never its message."""
    return F.regexp_extract(kind, r"^([\w.]+)", 1)


def safe_stem(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^\w.-]+", "_"), 1, 100)
