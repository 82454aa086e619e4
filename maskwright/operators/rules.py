"""Rule packs: immutable lists of patterns with a type and a confidence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


#: what a text must have for rules that need it: a digit (of any script), a CJK ideograph
GUARDS = {"digit": r"[0-9\x{660}-\x{10FFFF}]", "cjk": r"[\x{4E00}-\x{9FFF}]"}


@dataclass(frozen=True)
class Rule:
    """A pattern in Java syntax.  ``group`` 1 takes the pattern's only group, which must end the match.

    ``anchor``: a cheap pattern that any text with a match has; texts without it are skipped.  ``needs``: one of ``GUARDS``, a test that rules share.
    """

    rule_id: str
    phi_type: str
    pattern: str
    confidence: float
    group: int = 0
    anchor: str | None = None
    tool: str = "pattern"
    needs: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.confidence <= 1:
            raise ValueError(f"{self.rule_id}: confidence {self.confidence}")
        if self.group not in (0, 1) or (self.group == 1 and not self.pattern.endswith(")")):
            raise ValueError(f"{self.rule_id}: the group must end the pattern")


_U = "(?U)"  # Unicode classes, as \d, \s, \w and \b are meant
# Patterns and confidences that results must carry.
PARITY: tuple[Rule, ...] = (
    Rule("id_national", "ID", _U + r"\b[A-Z][12]\d{8}\b", 0.95, anchor=r"[A-Z][12][0-9\x{660}-\x{10FFFF}]", needs="digit"),
    Rule("id_resident", "ID", _U + r"\b[A-Z]{2}\d{8,10}\b", 0.8, anchor=r"[A-Z]{2}[0-9\x{660}-\x{10FFFF}]", needs="digit"),
    Rule("email", "EMAIL", _U + r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95, anchor="@"),
    Rule("url_http", "URL", _U + r'https?://[^\s<>"]+', 0.95, anchor="://"),
    Rule("url_www", "URL", _U + r'www\.[^\s<>"]+', 0.90, anchor=r"www\."),
    Rule("ipv4", "IP_ADDRESS", _U + r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.95, anchor=r"[0-9]\.[0-9]", needs="digit"),
    Rule("ipv6", "IP_ADDRESS", _U + r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.90, anchor=":[0-9a-fA-F]"),
    Rule("date_ymd", "DATE", _U + r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", 0.90, anchor=r"(?U)\d[-/]\d", needs="digit"),
    Rule("date_dmy", "DATE", _U + r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b", 0.85, anchor=r"(?U)\d[-/]\d", needs="digit"),
    Rule("date_cjk", "DATE", _U + r"(?:民國)?\d{2,4}年\d{1,2}月\d{1,2}日", 0.90, anchor="年", needs="cjk"),
    Rule("date_en", "DATE", r"(?Ui)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", 0.85, anchor=r"(?U)\s\d{4}", needs="digit"),
    Rule("mrn", "MEDICAL_RECORD_NUMBER", _U + r"\b[A-Z]?\d{7,10}\b", 0.70, anchor=r"(?U)\d{7}", needs="digit"),
    Rule("account_bank", "ACCOUNT_NUMBER", _U + r"\b\d{3}-\d{2}-\d{6,7}-\d\b", 0.85, anchor=r"(?U)\d-\d", needs="digit"),
    Rule("account_digits", "ACCOUNT_NUMBER", _U + r"\b\d{10,16}\b", 0.60, anchor=r"(?U)\d{10}", needs="digit"),
    Rule("fax", "FAX", r"(?Ui)(?:傳真|fax)[^\d]*(\d{2,4}[-\s]?\d{3,4}[-\s]?\d{3,4})", 0.90, group=1, anchor="(?i)傳真|fax", needs="digit"),
    Rule("location_district", "LOCATION", _U + r"[\x{4e00}-\x{9fff}]{2,4}(?:市|縣)[\x{4e00}-\x{9fff}]{2,4}(?:區|鎮|鄉)", 0.80, anchor="[市縣]", needs="cjk"),
    Rule("location_street", "LOCATION", _U + r"\b\d{3,5}\s*[\x{4e00}-\x{9fff}]+(?:市|縣|區|路|街|巷|弄|號)", 0.85, anchor="[市縣區路街巷弄號]", needs="cjk"),
)
#: the fallback pack of English evaluation corpora, opt-in
US_BASIC: tuple[Rule, ...] = (
    Rule("us_email", "EMAIL", _U + r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9, anchor="@"),
    Rule("us_phone", "PHONE", _U + r"(?:\+\d{1,3}\s?)?(?:\(\d{3}\)\s?|\b\d{3}[-.])\d{3}[-.]\d{4}\b", 0.8, anchor=r"(?U)\d{3}[-.]\d{4}"),
    Rule("us_ssn", "SSN", _U + r"\b\d{3}-\d{2}-\d{4}\b", 0.9, anchor=r"(?U)-\d{2}-"),
    Rule("us_date", "DATE", _U + r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", 0.8, anchor=r"(?U)\d/\d"),
)
#: identifiers that stand next to CJK characters, which word boundaries miss; opt-in
CJK_BOUNDARY: tuple[Rule, ...] = (
    Rule("id_national_cjk", "ID", r"(?<![A-Za-z0-9_])[A-Z][12][0-9]{8}(?![A-Za-z0-9_])", 0.95, anchor="[0-9]{8}"),
    Rule("mrn_cjk", "MEDICAL_RECORD_NUMBER", r"(?<![A-Za-z0-9_])[A-Z]?[0-9]{7,10}(?![A-Za-z0-9_])", 0.70, anchor="[0-9]{7}"),
)


def of_type(rules: Iterable[Rule], phi_type: str) -> tuple[Rule, ...]:
    return tuple(r for r in rules if r.phi_type == phi_type)


def merged(rules: Iterable[Rule], custom: Iterable[Rule]) -> tuple[Rule, ...]:
    """A pack with custom rules after the given ones; neither is changed."""
    return (*rules, *custom)
