"""SQL functions for use in queries: masks and identifiers as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskwright.operators.identifiers import LETTER_CODES, WEIGHTS

_CODE = "CASE left(upper(trim(v)), 1) " + " ".join(f"WHEN '{k}' THEN {c // 10 * WEIGHTS[0] + c % 10 * WEIGHTS[1]}" for k, c in LETTER_CODES.items()) + " END"
_SUM = " + ".join([_CODE, *(f"try_cast(substring(trim(v), {i + 1}, 1) AS INT) * {WEIGHTS[i + 1]}" for i in range(1, 10))])
#: name -> (parameters, type, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "mask_partial": (
        "v STRING, keep_prefix INT, keep_suffix INT", "STRING",
        "CASE WHEN char_length(v) <= keep_prefix + keep_suffix THEN repeat('*', char_length(v))"
        " ELSE concat(left(v, keep_prefix), repeat('*', char_length(v) - keep_prefix - keep_suffix), right(v, keep_suffix)) END",
    ),
    "pseudonym": ("v STRING, salt STRING", "STRING", "concat('PSEUDO-', upper(substring(sha2(concat(salt, v), 256), 1, 4)))"),
    "validate_id": (
        "v STRING", "STRING",
        "CASE WHEN upper(trim(v)) RLIKE '^[A-Z][12][0-9]{8}$' THEN CASE WHEN (" + _SUM + ") % 10 = 0 THEN 'valid' ELSE 'invalid' END"
        " WHEN upper(trim(v)) RLIKE '^[A-Z]{2}[0-9]{8}$' THEN 'valid' ELSE 'unknown' END",
    ),
    "collapse_spaces": ("v STRING", "STRING", r"trim(regexp_replace(v, '(?U)\\s+', ' '))"),
    "text_language": ("v STRING", "STRING", r"CASE WHEN v RLIKE '[\\x{4E00}-\\x{9FFF}]' THEN 'zh-TW' ELSE 'en' END"),
    "phone_digits": ("v STRING", "STRING", r"regexp_replace(v, '(?U)[^\\d+]', '')"),
    "strip_tags": ("v STRING", "STRING", r"regexp_replace(v, '【PHI:(\\w+):?(\\w*)】([^【]+?)【/PHI】', '$3')"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session (again where they are there already); their names."""
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    return sorted(FUNCTIONS)
