"""National identifiers with their checksum, and phone numbers with their context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.types import literal_map
from maskwright.operators.spans import EMPTY, matches, no_spans, span

# The names of identifiers, the letter codes and weights of the national identifier, and the ordered phone patterns.
LETTER_CODES = {
    "A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16, "H": 17, "I": 34, "J": 18, "K": 19, "L": 20, "M": 21, "N": 22,
    "O": 35, "P": 23, "Q": 24, "R": 25, "S": 26, "T": 27, "U": 28, "V": 29, "W": 32, "X": 30, "Y": 31, "Z": 33,
}
WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)
PHONES = (
    # pattern, kind, region, confidence; earlier patterns claim text first
    (r"(?U)\b09\d{2}[-\s]?\d{3}[-\s]?\d{3}\b", "MOBILE", "TW", 0.95),
    (r"(?U)\(0[2-9]\)\s?\d{4}[-\s]?\d{4}\b", "LANDLINE", "TW", 0.95),
    (r"(?U)\b0[2-9][-\s]?\d{4}[-\s]?\d{4}\b", "LANDLINE", "TW", 0.90),
    (r"(?U)\b[2-9]\d{3}[-\s]?\d{4}\b", "LANDLINE", "TW", 0.70),
    (r"(?U)\+886[-\s]?[2-9][-\s]?\d{4}[-\s]?\d{4}\b", "LANDLINE", "TW", 0.98),
    (r"(?U)\+886[-\s]?9\d{2}[-\s]?\d{3}[-\s]?\d{3}\b", "MOBILE", "TW", 0.98),
    (r"(?U)\+\d{1,3}[-\s]?\d{2,4}[-\s]?\d{3,4}[-\s]?\d{3,4}\b", "INTERNATIONAL", "UNKNOWN", 0.85),
)
#: what each pattern's matches hold, cheaply tested
PHONE_ANCHORS = ("09[0-9\\x{660}-\\x{10FFFF}]", r"\(0[2-9]\)", "0[2-9]", "[2-9][0-9\\x{660}-\\x{10FFFF}]{3}", r"\+886", r"\+886", r"\+[0-9\x{660}-\x{10FFFF}]")
PHONE_WORDS = r"(?Ui)(?:電話|手機|聯絡|連絡|phone|tel|mobile|cell|contact|fax|傳真)[\s:：]*"
FAX_WORDS = "(?i)fax|傳真"
NOT_PHONES = r"(?U)\d{4}[-/]\d{2}[-/]\d{2}|[A-Z][12]\d{8}"


def checksum_valid(value: Column) -> Column:
    """Whether a national identifier (a letter and nine digits) passes its checksum."""
    code = F.try_element_at(literal_map(LETTER_CODES), F.substring(value, 1, 1))
    digit = lambda i: F.substring(value, i + 1, 1).try_cast("int")
    total = F.floor(code / 10) * WEIGHTS[0] + code % 10 * WEIGHTS[1]
    for i in range(1, 10):
        total = total + digit(i) * WEIGHTS[i + 1]
    return F.coalesce(value.rlike("^[A-Z][0-9]{9}$") & (total % 10 == 0), F.lit(False))


def validate_id(value: Column) -> Column:
    """struct(valid, id_type) of one identifier, trimmed and upper-cased."""
    v = F.upper(F.trim(value))
    national, resident = v.rlike("^[A-Z][12][0-9]{8}$"), v.rlike("^[A-Z]{2}[0-9]{8}$")
    kind = F.when(national, "TW_NATIONAL_ID").when(resident, "TW_ARC").otherwise("UNKNOWN")
    valid = F.when(national, checksum_valid(v)).when(resident, F.lit(True)).otherwise(F.lit(False))
    return F.struct(valid.alias("valid"), kind.alias("id_type"))


def id_spans(text: Column, validate: bool = True) -> Column:
    """National identifiers (0.99 valid; not valid 0.60, or 0.70 where validity is not asked for) and resident certificates (0.95)."""
    national = F.transform(
        matches(text, r"(?U)\b[A-Z][12]\d{8}\b", anchor="[0-9]{8}"),
        lambda m: span(F.lit("ID"), m["text"], m["start"], m["end"], F.when(checksum_valid(m["text"]), 0.99).otherwise(0.60 if validate else 0.70), F.lit("id"), F.lit("TW_NATIONAL_ID"), F.lit(100)),
    )
    resident = F.transform(
        matches(text, r"(?U)\b[A-Z]{2}\d{8}\b", anchor="[0-9]{8}"),
        lambda m: span(F.lit("ID"), m["text"], m["start"], m["end"], F.lit(0.95), F.lit("id"), F.lit("TW_ARC"), F.lit(101)),
    )
    return F.concat(F.coalesce(national, no_spans()), F.coalesce(resident, no_spans()))


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before a place (fewer at the beginning)."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def phone_spans(text: Column) -> Column:
    """Phone and fax numbers.  A match whose first character lies in an accepted one is skipped; earlier patterns come first."""
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def phones(order: int, pattern: str, kind: str, region: str, confidence: float) -> Column:
        found = F.coalesce(matches(text, pattern, anchor=PHONE_ANCHORS[order]), none)
        return F.transform(found, lambda m: span(F.lit("PHONE"), m["text"], m["start"], m["end"], F.lit(confidence), F.lit("phone"), F.lit(f"{kind}:{region}"), F.lit(200 + order)))

    each = [phones(i, *p) for i, p in enumerate(PHONES)]
    # in pattern order, by place within a pattern, as built; all patterns share one test of the text
    free = F.when(text.rlike("[0-9]{3}"), F.filter(F.concat(*each), lambda s: ~s["text"].rlike(NOT_PHONES)))

    def claim(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (x["start_pos"] >= k["start_pos"]) & (x["start_pos"] < k["end_pos"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    def scored(s: Column) -> Column:
        boosted = F.when(before(text, s["start_pos"], 20).rlike(PHONE_WORDS), F.least(F.lit(0.99), s["confidence"] + 0.05)).otherwise(s["confidence"])
        kind = F.when(before(text, s["start_pos"], 15).rlike(FAX_WORDS), F.lit("FAX")).otherwise(F.lit("PHONE"))
        return s.withField("confidence", F.round(boosted, 6)).withField("phi_type", kind)

    return F.coalesce(F.transform(F.aggregate(F.coalesce(free, no_spans()), F.array().cast(EMPTY), claim), scored), no_spans())


def phone_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[^\d+]", "")
