"""The library's queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions import types as Y
from maskwright.operators import chunking, evaluation, identifiers, masking, retrieval, rules, spans
from maskwright.plans import reports
from maskwright.plans.pipeline import Deidentifier, rule_detectors
from maskwright.plans.scratch import spread
from maskwright.sources import documents as sources
from maskwright.streaming import documents as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents for costly scans, dealt over all cores where the table is small."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


# ---------------------------------------------------------------- scans


def spans_sql(source: str, key: str, text: str, pattern: str, extra: str = "") -> str:
    """SQL of all matches with their places in code points."""
    return f"""
SELECT {key}, m[i] AS text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_pos,
       CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS end_pos{extra}
FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {source}) s, unnest(range(1, len(m) + 1)) AS u(i)"""


EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
DIGITS = r"\b\d{10,16}\b"
MRN = r"\b[A-Z]?\d{7,10}\b"


def _scanned(df: DataFrame, key: str, ids: tuple[str, ...], resolve: bool = False) -> DataFrame:
    pack = [r for r in rules.PARITY if r.rule_id in ids]
    found = spans.with_spans(df, [lambda t: spans.scan(t, pack)], resolve=resolve)
    return spans.exploded(found, keys=(key,)).select(key, "text", "start_pos", "end_pos", "confidence")


@query(spans_sql("documents", "doc_id", "text", EMAIL, ", CAST(0.95 AS DOUBLE) AS confidence"))
def scan_email(spark, d):
    return _scanned(table(spark, d, "documents"), "doc_id", ("email",))


@query(spans_sql("documents", "doc_id", "text", IPV4, ", CAST(0.95 AS DOUBLE) AS confidence"))
def scan_ipv4(spark, d):
    return _scanned(table(spark, d, "documents"), "doc_id", ("ipv4",))


@query(spans_sql("documents", "doc_id", "text", DIGITS, ", CAST(0.6 AS DOUBLE) AS confidence"))
def scan_account(spark, d):
    return _scanned(table(spark, d, "documents"), "doc_id", ("account_digits",))


@query(spans_sql("pages", "page_id", "html", EMAIL, ", CAST(0.95 AS DOUBLE) AS confidence") + "\nUNION ALL" + spans_sql("pages", "page_id", "html", DIGITS, ", CAST(0.6 AS DOUBLE) AS confidence"))
def scan_pages(spark, d):
    return _scanned(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), "page_id", ("email", "account_digits"))


CUSTOMER_TEXT = "'[c_name] ' || c_name || chr(10) || chr(10) || '[c_mktsegment] ' || c_mktsegment"


@query(spans_sql("customer", "c_custkey", CUSTOMER_TEXT, MRN, ", CAST(0.7 AS DOUBLE) AS confidence"))
def scan_mrn_rows(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", sources.combined(["c_name", "c_mktsegment"]).alias("text"))
    return _scanned(rows, "c_custkey", ("mrn",))


@query(spans_sql("orders", "o_orderkey", "'ordered on ' || strftime(o_orderdate, '%Y-%m-%d') || ', ' || o_orderpriority", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", ", CAST(0.9 AS DOUBLE) AS confidence"))
def scan_dates_rows(spark, d):
    text = F.concat(F.lit("ordered on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", "), F.col("o_orderpriority"))
    return _scanned(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", ("date_ymd",))


@query(
    f"""
WITH s AS (SELECT 'IP_ADDRESS' AS phi_type, doc_id, 0.95 AS c, unnest(regexp_extract_all(text, '{IPV4}')) AS v FROM documents
  UNION ALL SELECT 'EMAIL', doc_id, 0.95, unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents
  UNION ALL SELECT 'ACCOUNT_NUMBER', doc_id, 0.6, unnest(regexp_extract_all(text, '{DIGITS}')) FROM documents)
SELECT lang, phi_type, count(*) AS n, round(avg(c), 6) AS mean_confidence, CAST(min(c) AS DOUBLE) AS min_confidence, CAST(max(c) AS DOUBLE) AS max_confidence
FROM s JOIN documents USING (doc_id) GROUP BY lang, phi_type"""
)
def phi_type_distribution(spark, d):
    """The flagship: which types of spans, how many and how sure, each language has."""
    found = spans.with_spans(texts(spark, d, "doc_id", "lang", "text"), [spans.scan])
    return reports.type_distribution(spans.exploded(found, keys=("lang",)), ("lang",))


def _typed_sql(pattern: str, phi_type: str, confidence: str) -> str:
    return f"SELECT doc_id, {phi_type} AS phi_type, text, start_pos, end_pos, CAST({confidence} AS DOUBLE) AS confidence FROM ({spans_sql('documents', 'doc_id', 'text', pattern)})"


@query(
    f"""
WITH s AS ({_typed_sql(IPV4, "'IP_ADDRESS'", '0.95')} UNION ALL {_typed_sql(EMAIL, "'EMAIL'", '0.95')} UNION ALL {_typed_sql(MRN, "'MEDICAL_RECORD_NUMBER'", '0.7')} UNION ALL {_typed_sql(DIGITS, "'ACCOUNT_NUMBER'", '0.6')})
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start_pos ORDER BY confidence DESC) AS r FROM s) WHERE r = 1"""
)
def detect_all(spark, d):
    """All tools, merged.  Of these tables only four kinds of spans overlap at most at their start."""
    found = spans.with_spans(texts(spark, d, "doc_id", "text"), rule_detectors())
    return spans.exploded(found).select("doc_id", "phi_type", "text", "start_pos", "end_pos", "confidence")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh-TW' ELSE 'en' END AS language FROM documents")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


_CJK, _ALPHA = "length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g'))", "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query(f"SELECT doc_id, CAST(trunc({_CJK} / 1.5 + {_ALPHA} / 4.0 + (length(text) - {_CJK} - {_ALPHA}) / 2.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return texts(spark, d, "doc_id", "text").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------- identifiers (from customer keys)

_ID_SQL = "chr(CAST(65 + c_custkey % 26 AS INTEGER)) || CAST(1 + c_custkey % 2 AS VARCHAR) || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0')"
_LETTERS = "[10,11,12,13,14,15,16,17,34,18,19,20,21,22,35,23,24,25,26,27,28,29,32,30,31,33]"
_VALID_SQL = f"(({_LETTERS}[ascii(id) - 64] // 10) + ({_LETTERS}[ascii(id) - 64] % 10) * 9 + list_sum(list_transform(range(1, 10), lambda i: CAST(substr(id, i + 1, 1) AS INTEGER) * [8,7,6,5,4,3,2,1,1][i]))) % 10 = 0"


def customer_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.char(65 + k % 26), (1 + k % 2).cast("string"), number).alias("id"))


@query(f"SELECT c_custkey, id, {_VALID_SQL} AS valid, 'TW_NATIONAL_ID' AS id_type FROM (SELECT c_custkey, {_ID_SQL} AS id FROM customer)")
def id_checksum(spark, d):
    return customer_ids(spark, d).withColumn("v", identifiers.validate_id(F.col("id"))).select("c_custkey", "id", "v.valid", "v.id_type")


@query(f"SELECT c_custkey, id AS text, CAST(8 AS INTEGER) AS start_pos, CAST(18 AS INTEGER) AS end_pos, CAST(CASE WHEN {_VALID_SQL} THEN 0.99 ELSE 0.6 END AS DOUBLE) AS confidence FROM (SELECT c_custkey, {_ID_SQL} AS id FROM customer)")
def id_scan(spark, d):
    rows = customer_ids(spark, d).select("c_custkey", F.concat(F.lit("Patient "), "id", F.lit(" seen")).alias("text"))
    return spans.exploded(spans.with_spans(rows, [identifiers.id_spans]), keys=("c_custkey",)).select("c_custkey", "text", "start_pos", "end_pos", "confidence")


_PHONE_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'tel 09' || n[1:2] || '-' || n[3:5] || '-' || n[6:8] WHEN 1 THEN 'fax: (02) ' || n[1:4] || '-' || n[5:8] WHEN 2 THEN 'reach +886-9' || n[1:2] || '-' || n[3:5] || '-' || n[6:8] ELSE 'ref +44-20-1' || n[2:4] || '-' || n[5:8] END"


@query(
    f"""
SELECT c_custkey, substr(t, strpos(t, ' ') + 1) AS text, CASE c_custkey % 4 WHEN 1 THEN 'FAX' ELSE 'PHONE' END AS phi_type,
       CAST(CASE c_custkey % 4 WHEN 0 THEN 0.99 WHEN 1 THEN 0.99 WHEN 2 THEN 0.98 ELSE 0.85 END AS DOUBLE) AS confidence, regexp_replace(substr(t, strpos(t, ' ') + 1), '[^0-9+]', '', 'g') AS digits
FROM (SELECT c_custkey, {_PHONE_SQL} AS t FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 90000000 + 10000000 AS VARCHAR), 8, '0') AS n FROM customer))"""
)
def phone_scan(spark, d):
    k = F.col("c_custkey")
    n = (k * 7919 % 90000000 + 10000000).cast("string")
    part = lambda a, b: F.substring(n, a, b)
    dash = F.lit("-")
    mobile = F.concat(part(1, 2), dash, part(3, 3), dash, part(6, 3))
    land = F.concat(part(1, 4), dash, part(5, 4))
    text = F.when(k % 4 == 0, F.concat(F.lit("tel 09"), mobile)).when(k % 4 == 1, F.concat(F.lit("fax: (02) "), land)).when(k % 4 == 2, F.concat(F.lit("reach +886-9"), mobile)).otherwise(F.concat(F.lit("ref +44-20-1"), part(2, 3), dash, part(5, 4)))
    rows = table(spark, d, "customer").select("c_custkey", text.alias("text"))
    found = spans.exploded(rows.withColumn("spans", identifiers.phone_spans(F.col("text"))), keys=("c_custkey",))
    return found.select("c_custkey", "text", "phi_type", "confidence", identifiers.phone_digits(F.col("text")).alias("digits"))


# ---------------------------------------------------------------- overlap resolution (spans from order lines)

_SPAN_ROWS = """SELECT l_orderkey AS doc_id, l_linenumber * 4 + CAST(l_quantity AS INTEGER) % 7 AS a, l_linenumber * 4 + CAST(l_quantity AS INTEGER) % 7 + 2 + CAST(l_quantity AS INTEGER) % 5 AS b,
       CAST(l_partkey % 4 AS INTEGER) / 4.0 AS c, l_linenumber AS seq, l_partkey, l_suppkey FROM lineitem"""


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    start = n * 4 + q % 7
    s = spans.span(F.lit("ID"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), start, start + 2 + q % 5, (F.col("l_partkey") % 4) / 4.0, F.lit("t"), F.lit("r"), n)
    # rows of an order with one line number are told apart by part: order lines are few per order
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("x"), s.alias("s")))).alias("r")).select(
        "doc_id", F.transform("r", lambda r, i: r["s"].withField("seq", i.cast("int"))).alias("spans")
    )


@query(
    f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, l_partkey, l_suppkey) - 1 AS s FROM ({_SPAN_ROWS})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, c DESC, s) AS k FROM r),
f AS (SELECT doc_id, k, a, b, c, FALSE AS opened FROM o WHERE k = 1
  UNION ALL
  SELECT o.doc_id, o.k, CASE WHEN o.a >= f.b OR o.c > f.c OR (o.c = f.c AND o.b - o.a > f.b - f.a) THEN o.a ELSE f.a END,
         CASE WHEN o.a >= f.b OR o.c > f.c OR (o.c = f.c AND o.b - o.a > f.b - f.a) THEN o.b ELSE f.b END,
         CASE WHEN o.a >= f.b OR o.c > f.c OR (o.c = f.c AND o.b - o.a > f.b - f.a) THEN o.c ELSE f.c END, o.a >= f.b
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
g AS (SELECT *, lead(opened) OVER (PARTITION BY doc_id ORDER BY k) AS next_opens FROM f)
SELECT doc_id, CAST(a AS INTEGER) AS start_pos, CAST(b AS INTEGER) AS end_pos, CAST(c AS DOUBLE) AS confidence FROM g WHERE coalesce(next_opens, TRUE)"""
)
def merge_overlaps(spark, d):
    merged = line_spans(spark, d).withColumn("spans", spans.merge_overlaps(F.col("spans")))
    return spans.exploded(merged).select("doc_id", "start_pos", "end_pos", "confidence")


@query(
    f"""
WITH RECURSIVE o AS (SELECT doc_id, a, b, 'p' || l_partkey AS t, row_number() OVER (PARTITION BY doc_id ORDER BY a, seq, l_partkey, l_suppkey) AS k FROM ({_SPAN_ROWS})),
f AS (SELECT doc_id, k, [{{'a': a, 'b': b, 't': t}}] AS kept FROM o WHERE k = 1
  UNION ALL
  SELECT o.doc_id, o.k, CASE WHEN len(list_filter(kept, lambda x: least(x.b, o.b) > greatest(x.a, o.a) AND (x.t = o.t OR (least(x.b, o.b) - greatest(x.a, o.a)) / least(x.b - x.a, o.b - o.a) > 0.8))) > 0
    THEN kept ELSE list_append(kept, {{'a': o.a, 'b': o.b, 't': o.t}}) END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
l AS (SELECT doc_id, arg_max(kept, k) AS kept FROM f GROUP BY doc_id)
SELECT doc_id, e.t AS text, CAST(e.a AS INTEGER) AS start_pos, CAST(e.b AS INTEGER) AS end_pos FROM (SELECT doc_id, unnest(kept) AS e FROM l)"""
)
def dedup_entities(spark, d):
    kept = line_spans(spark, d).withColumn("spans", spans.drop_near_duplicates(F.col("spans")))
    return spans.exploded(kept).select("doc_id", "text", "start_pos", "end_pos")


@query(f"SELECT doc_id, count(DISTINCT ('p' || l_partkey, a, b)) AS n FROM ({_SPAN_ROWS}) GROUP BY doc_id")
def distinct_entities(spark, d):
    return line_spans(spark, d).select("doc_id", F.size(spans.distinct_spans(F.col("spans"))).cast("long").alias("n"))


_TYPE_SQL = "CASE k % 6 WHEN 0 THEN 'NAME' WHEN 1 THEN 'SSN' WHEN 2 THEN 'GENETIC_INFO' WHEN 3 THEN 'DATE' WHEN 4 THEN 'AGE_OVER_90' ELSE 'PHONE' END"


def _kinds(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("NAME", "SSN", "GENETIC_INFO", "DATE", "AGE_OVER_90", "PHONE")]), (k % 6 + 1).cast("int"))


@query(f"SELECT phi_type, phi_type IN ('RARE_DISEASE', 'AGE_OVER_90', 'BIOMETRIC', 'GENETIC_INFO', 'SSN') AS high_risk, count(*) AS n FROM (SELECT {_TYPE_SQL.replace('k %', 'p_partkey %')} AS phi_type FROM part) GROUP BY 1, 2")
def high_risk(spark, d):
    rows = table(spark, d, "part").select(_kinds(F.col("p_partkey")).alias("phi_type"))
    return rows.groupBy("phi_type", Y.is_high_risk(F.col("phi_type")).alias("high_risk")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- masks


def _masked(spark: SparkSession, d: str, name: str, key: str, value: Column, mask: masking.Mask, kind: str) -> DataFrame:
    return table(spark, d, name).select(key, mask(value, F.lit(kind)).alias("masked"))


@query("SELECT c_custkey, repeat('#', length(c_name)) AS masked FROM customer")
def mask_redact(spark, d):
    return _masked(spark, d, "customer", "c_custkey", F.col("c_name"), masking.redaction(mask_char="#"), "NAME")


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 5 THEN repeat('*', length(p_name)) ELSE left(p_name, 2) || repeat('*', length(p_name) - 5) || right(p_name, 3) END AS masked FROM part")
def mask_partial(spark, d):
    return _masked(spark, d, "part", "p_partkey", F.col("p_name"), masking.partial(2, 3), "ID")


@query("SELECT c_custkey, 'Patient-' || upper(substr(sha256('pepper' || c_name), 1, 6)) AS masked FROM customer")
def mask_pseudonym(spark, d):
    return _masked(spark, d, "customer", "c_custkey", F.col("c_name"), masking.pseudonymization("pepper", 6), "NAME")


@query("SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS masked FROM orders")
def mask_generalize(spark, d):
    return _masked(spark, d, "orders", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), masking.generalization(), "DATE")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS masked FROM orders")
def mask_shift(spark, d):
    return _masked(spark, d, "orders", "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd"), masking.date_shifting(45), "DATE")


@query("SELECT s_suppkey, '' AS masked FROM supplier")
def mask_suppress(spark, d):
    return _masked(spark, d, "supplier", "s_suppkey", F.col("s_name"), masking.suppression(), "NAME")


_KEY = b"key"
_INNER, _OUTER = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"SELECT c_custkey, '[NAME_' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))), 1, 12) || ']' AS masked FROM customer")
def mask_hmac(spark, d):
    value = masking.service_mask(F.col("c_name"), F.lit("NAME"), F.lit("hash"), F.lit(None).cast("string"), "key")
    return table(spark, d, "customer").select("c_custkey", value.alias("masked"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g')) AS masked_sha256, NOT list_contains(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: contains(regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g'), x)), TRUE) AS clean FROM documents")
def apply_mask_docs(spark, d):
    engine = Deidentifier(detectors=[lambda t: spans.scan(t, rules.of_type(rules.PARITY, "EMAIL"))])
    out = engine.run(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.col("valid").alias("clean"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{IPV4}')) AS BIGINT) AS leaks FROM documents WHERE regexp_matches(text, '{IPV4}')")
def leak_check(spark, d):
    """Masks that keep the value leak every span."""
    found = spans.with_spans(table(spark, d, "documents").select("doc_id", "text"), [lambda t: spans.scan(t, rules.of_type(rules.PARITY, "IP_ADDRESS"))])
    return found.select("doc_id", F.size(masking.leaks(F.col("text"), F.col("spans"))).cast("long").alias("leaks")).filter("leaks > 0")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, replace(replace(c_name, 'Customer#', 'C-'), 'BUILDING', 'B') AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, replace(c_mktsegment, 'BUILDING', 'B') AS c_mktsegment FROM customer")
def mask_table_customer(spark, d):
    return masking.mask_table(table(spark, d, "customer").drop("c_acctbal"), [("BUILDING", "A"), ("Customer#", "C-"), ("BUILDING", "B"), ("", "x")])


@query("SELECT c_custkey, CAST(c_custkey % 130 AS VARCHAR) || ' years' AS text, c_custkey % 130 >= 89 AS keep FROM customer")
def age_rule(spark, d):
    text = F.concat((F.col("c_custkey") % 130).cast("string"), F.lit(" years"))
    return table(spark, d, "customer").select("c_custkey", text.alias("text"), T.keeps_age(F.lit("AGE_OVER_89"), text).alias("keep"))


@query(
    """
SELECT k AS p_partkey, t AS phi_type, CASE t WHEN 'NAME' THEN '[NAME]' WHEN 'SSN' THEN 'gone' ELSE '[REDACTED]' END AS masked
FROM (SELECT p_partkey AS k, """ + _TYPE_SQL.replace("k %", "p_partkey %") + """ AS t FROM part) WHERE t IN ('NAME', 'SSN', 'PHONE')"""
)
def config_filter(spark, d):
    config = masking.MaskConfig(types={"NAME": masking.TypeConfig(masking="generalize"), "SSN": masking.TypeConfig(masking="replace", replace_with="gone"), "PHONE": masking.TypeConfig(), "DATE": masking.TypeConfig(enabled=False)})
    rows = table(spark, d, "part").select("p_partkey", _kinds(F.col("p_partkey")).alias("phi_type"), F.col("p_name").alias("text"))
    return masking.configured(rows, config).select("p_partkey", "phi_type", "masked")


@query("SELECT s_name AS value, max_by(CAST(s_nationkey AS VARCHAR), s_suppkey) AS masked FROM supplier GROUP BY s_name")
def replacement_pairs(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("value"), F.col("s_nationkey").cast("string").alias("masked"), F.col("s_suppkey").alias("seq"))
    return masking.replacement_pairs(rows)


# ---------------------------------------------------------------- chunks

_BOUNDS = """SELECT doc_id, text, n, unnest(list_concat(list_transform(range(0, k + 1), lambda i: i * 1900), CASE WHEN n - 100 > k * 1900 THEN [n - 100] ELSE [] END)) AS a,
       generate_subscripts(list_concat(list_transform(range(0, k + 1), lambda i: i * 1900), CASE WHEN n - 100 > k * 1900 THEN [n - 100] ELSE [] END), 1) - 1 AS id
  FROM (SELECT doc_id, text, length(text) AS n, greatest(CAST(ceil((length(text) - 2000) / 1900.0) AS BIGINT), 0) AS k FROM documents WHERE length(text) > 0)"""


@query(f"SELECT doc_id, CAST(id AS INTEGER) AS chunk_id, CAST(a AS INTEGER) AS start_pos, CAST(least(a + 2000, n) AS INTEGER) AS end_pos, substr(sha256(substr(text, a + 1, least(a + 2000, n) - a)), 1, 8) AS content_hash FROM ({_BOUNDS})")
def chunk_windows(spark, d):
    return chunking.windows(table(spark, d, "documents")).select("doc_id", "chunk_id", "start_pos", "end_pos", "content_hash")


@query("SELECT doc_id, CAST(i // 500 AS INTEGER) AS slice, substr(text, i + 1, 500) AS content FROM documents, unnest(range(0, length(text), 500)) AS u(i)")
def fixed_slices(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.slices(F.col("text"), 500)).alias("slice", "content"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'chunked' ELSE 'direct' END AS route, CAST(greatest(1, length(text) // 450) AS INTEGER) AS estimate, CAST(ceil(length(text) / 1900.0) AS INTEGER) AS total FROM documents")
def route_long_short(spark, d):
    n = F.char_length("text")
    return table(spark, d, "documents").select("doc_id", F.when(chunking.is_long(F.col("text")), "chunked").otherwise("direct").alias("route"), chunking.estimated_chunks(n).alias("estimate"), chunking.total_chunks(n).alias("total"))


@query(
    """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
f AS (SELECT doc_id, i, line, length(line) + 1 AS n, 0 AS c FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.line, CASE WHEN f.n + length(l.line) > 500 THEN length(l.line) ELSE f.n + length(l.line) + 1 END, CASE WHEN f.n + length(l.line) > 500 THEN f.c + 1 ELSE f.c END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, CAST(c AS INTEGER) AS chunk_id, string_agg(line, chr(10) ORDER BY i) AS content FROM f GROUP BY doc_id, c"""
)
def line_pack(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.packed_lines(F.col("text"))).alias("chunk_id", "content"))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive_chunks(table(spark, d, "documents")).select("doc_id", "chunk_id", "start_pos", "end_pos")


@query(spans_sql("documents", "doc_id", "text", IPV4).replace("end_pos", "end_pos", 1))
def chunk_align(spark, d):
    """Spans found in overlapping chunks, in the documents' places, each once."""
    chunks = chunking.windows(table(spark, d, "documents").select("doc_id", "text"), 2000, 100)
    found = spans.with_spans(chunks, [lambda t: spans.scan(t, rules.of_type(rules.PARITY, "IP_ADDRESS"))], "content")
    each = found.select("doc_id", F.explode(spans.shifted(F.col("spans"), F.col("start_pos"))).alias("s")).select("doc_id", "s.*")
    # a value cut by a chunk's edge is shorter there: the longest span that starts (or ends) at a place is the whole one
    each = streams.without_overlap_copies(each).groupBy("doc_id", "start_pos").agg(F.max_by(F.struct("text", "end_pos"), "end_pos").alias("s"))
    each = each.select("doc_id", "start_pos", "s.*").groupBy("doc_id", "end_pos").agg(F.min_by(F.struct("text", "start_pos"), "start_pos").alias("s"))
    return each.select("doc_id", "s.text", "s.start_pos", "end_pos")


# ---------------------------------------------------------------- types

_LABELS = ("patient name", "姓名", "E-Mail", "MRN", "ip address", "shoe size", " ")


@query(
    """
SELECT c_custkey, ['CUSTOM', 'NAME', 'EMAIL', 'MEDICAL_RECORD_NUMBER', 'IP_ADDRESS', 'CUSTOM', 'CUSTOM'][c_custkey % 7 + 1] AS phi_type,
       ['patient name', NULL, NULL, NULL, NULL, 'shoe size', 'Unknown PHI Type'][c_custkey % 7 + 1] AS custom_type FROM customer"""
)
def alias_map(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", Y.map_alias(label).alias("t")).select("c_custkey", "t.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NAME' WHEN 1 THEN 'ID' WHEN 2 THEN 'LOCATION' ELSE upper(replace(replace(p_brand, ' ', '_'), '-', '_')) END AS form FROM part")
def normal_forms(spark, d):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "patient name").when(k == 1, "credit-card").when(k == 2, "Street Address").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", Y.normal_form(label).alias("form"))


@query("SELECT DISTINCT event_type AS name FROM events")
def discovered_types(spark, d):
    return Y.discovered(table(spark, d, "events").select(F.col("event_type").alias("phi_type")), Y.type_table(spark))


# ---------------------------------------------------------------- tags and evaluation

_FIRST = "regexp_extract(text, '([A-Za-z]+)', 1)"
_TAGGED = f"'【PHI:NAME:' || doc_id || '】' || {_FIRST} || '【/PHI】 from 【PHI:DATE】' || lang || '【/PHI】'"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    first = F.regexp_extract("text", "([A-Za-z]+)", 1)
    text = F.concat(F.lit("【PHI:NAME:"), F.col("doc_id").cast("string"), F.lit("】"), first, F.lit("【/PHI】 from 【PHI:DATE】"), "lang", F.lit("【/PHI】"))
    return table(spark, d, "documents").filter(first != "").select("doc_id", text.alias("tagged"))


@query(f"SELECT doc_id, 'NAME' AS phi_type, CAST(doc_id AS VARCHAR) AS phi_id, {_FIRST} AS content FROM documents WHERE {_FIRST} <> '' UNION ALL SELECT doc_id, 'DATE', NULL, lang FROM documents WHERE {_FIRST} <> ''")
def tag_parse(spark, d):
    return tagged(spark, d).select("doc_id", F.explode(evaluation.tags(F.col("tagged"))).alias("t")).select("doc_id", "t.*")


@query(f"SELECT doc_id, {_FIRST} || ' from ' || lang AS bare FROM documents WHERE {_FIRST} <> ''")
def tag_strip(spark, d):
    return tagged(spark, d).select("doc_id", evaluation.without_tags(F.col("tagged")).alias("bare"))


_GOLD = "SELECT l_orderkey AS sample_id, 'W' || CAST(l_partkey % 5 AS VARCHAR) || ' ' AS text, CASE l_returnflag WHEN 'A' THEN 'PERSON' WHEN 'N' THEN 'DOB' ELSE 'SSN' END AS t FROM lineitem"
_PRED = "SELECT l_orderkey AS sample_id, 'w' || CAST(l_suppkey % 5 AS VARCHAR) AS text, CASE l_returnflag WHEN 'A' THEN 'NAME' WHEN 'N' THEN 'DATE' ELSE 'ID' END AS t FROM lineitem"
_NORMAL = "CASE t WHEN 'PERSON' THEN 'NAME' WHEN 'DOB' THEN 'DATE' WHEN 'SSN' THEN 'ID' ELSE t END"
_RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 6) AS f1"""


def _counts_sql(gold: str, pred: str, keys: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
WITH g AS (SELECT {keys}, count(*) AS g FROM ({gold}) GROUP BY {keys}), p AS (SELECT {keys}, count(*) AS p FROM ({pred}) GROUP BY {keys}),
c AS (SELECT {keys}, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING ({keys})),
s AS (SELECT {lead}CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM c{group})
SELECT *, {_RATIOS} FROM s"""


def gold_and_predicted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    word = lambda c, lead="w", tail="": F.concat(F.lit(lead), (F.col(c) % 5).cast("string"), F.lit(tail)).alias("text")
    kinds = lambda a, n, r: F.when(flag == "A", a).when(flag == "N", n).otherwise(r).alias("phi_type")
    own = F.col("l_orderkey").alias("sample_id")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq")
    return lines.select(own, word("l_partkey", "W", " "), kinds("PERSON", "DOB", "SSN"), seq), lines.select(own, word("l_suppkey"), kinds("NAME", "DATE", "ID"), seq)


_G, _P = f"SELECT sample_id, lower(trim(text)) AS text, {_NORMAL} AS phi_type FROM ({_GOLD})", f"SELECT sample_id, lower(trim(text)) AS text, {_NORMAL} AS phi_type FROM ({_PRED})"


@query(_counts_sql(_G, _P, "sample_id, text, phi_type"))
def eval_exact(spark, d):
    return evaluation.exact(*gold_and_predicted(spark, d))


@query(_counts_sql(_G, _P, "sample_id, text, phi_type", "phi_type"))
def eval_by_type(spark, d):
    return evaluation.exact(*gold_and_predicted(spark, d), by=("phi_type",))


@query(_counts_sql(_G, _P, "sample_id, text, phi_type", "sample_id"))
def eval_by_sample(spark, d):
    return evaluation.exact(*gold_and_predicted(spark, d), by=("sample_id",))


_ACCURACY = "SELECT *, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS accuracy FROM ({})"


@query(_ACCURACY.format(_counts_sql(f"SELECT phi_type FROM ({_G})", f"SELECT phi_type FROM ({_P}) WHERE text <> 'w3'", "phi_type")))
def eval_type_only(spark, d):
    gold, predicted = (x.withColumn("phi_type", Y.normal_form(F.col("phi_type"))) for x in gold_and_predicted(spark, d))
    return evaluation.type_only(gold, predicted.filter("text <> 'w3'"))


@query(_counts_sql(f"SELECT DISTINCT sample_id, lower(trim(text)) AS text FROM ({_GOLD})", f"SELECT DISTINCT sample_id, lower(trim(text)) AS text FROM ({_PRED})", "sample_id, text"))
def eval_sets(spark, d):
    gold, predicted = (x.withColumn("text", evaluation.compared(F.col("text"))) for x in gold_and_predicted(spark, d))
    return evaluation.set_metrics(gold, predicted, keys=("sample_id", "text"))


@query(_counts_sql(_G, _P, "sample_id, text").replace("SELECT sample_id, text, count", "SELECT sample_id, text, count"))
def eval_partial(spark, d):
    """All words have two characters, so containment is equality here; tests cover the others."""
    return evaluation.partial(*gold_and_predicted(spark, d))


@query(
    f"""
WITH g AS (SELECT sample_id, list(DISTINCT lower(trim(text))) AS g FROM ({_GOLD}) GROUP BY sample_id), p AS (SELECT sample_id, list(DISTINCT lower(trim(text))) AS p FROM ({_PRED}) GROUP BY sample_id)
SELECT sample_id, len(list_intersect(g, p)) / len(p) AS precision, len(list_intersect(g, p)) / len(g) AS recall FROM g JOIN p USING (sample_id)"""
)
def eval_containment(spark, d):
    return evaluation.containment(*gold_and_predicted(spark, d)).select("sample_id", "precision", "recall")


@query(
    """
SELECT l_suppkey AS model, CASE WHEN f >= 0.9 THEN 'A (Excellent)' WHEN f >= 0.8 THEN 'B (Good)' WHEN f >= 0.7 THEN 'C (Acceptable)' WHEN f >= 0.5 THEN 'D (Poor)' ELSE 'F (Fail)' END AS grade,
       round(f * (0.7 + 0.15 * least(1.0, 1000.0 / greatest(q * 40, 1.0)) + 0.15 * least(1.0, 500.0 / greatest(q * 30, 1.0))), 6) AS efficiency
FROM (SELECT l_suppkey, round(avg(l_discount) * 15, 4) AS f, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY l_suppkey)"""
)
def model_grades(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(F.round(F.avg("l_discount") * 15, 4).alias("f"), F.round(F.avg("l_quantity"), 4).alias("q"))
    return m.select("model", T.grade(F.col("f")).alias("grade"), F.round(T.efficiency(F.col("f"), F.col("q") * 40, F.col("q") * 30), 6).alias("efficiency"))


_TOKENS = "SELECT o_orderkey // 8 AS doc_id, o_orderkey AS pos, 't' || CAST(o_orderkey % 13 AS VARCHAR) AS token, ['B-PER', 'I-PER', 'I-PER', 'O', 'I-LOC', 'B-LOC', 'I-ORG'][CAST(o_custkey % 7 AS INTEGER) + 1] AS tag FROM orders"


@query(
    f"""
WITH i AS (SELECT *, sum(CASE WHEN tag[1] = 'B' OR tag = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM ({_TOKENS})),
e AS (SELECT doc_id, arg_min(tag, pos) AS first, string_agg(token, ' ' ORDER BY pos) AS text, min(pos) AS pos FROM i WHERE tag <> 'O' GROUP BY doc_id, island)
SELECT doc_id, substr(first, 3) AS phi_type, text, pos FROM e WHERE first IN ('B-PER', 'B-LOC')"""
)
def bio_islands(spark, d):
    tags = F.array(*[F.lit(x) for x in ("B-PER", "I-PER", "I-PER", "O", "I-LOC", "B-LOC", "I-ORG")])
    tokens = table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("t"), (F.col("o_orderkey") % 13).cast("string")).alias("token"), F.element_at(tags, (F.col("o_custkey") % 7 + 1).cast("int")).alias("tag")
    )
    return evaluation.bio_entities(tokens)


# ---------------------------------------------------------------- retrieval


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every 50th vector) and the whole store."""
    store = table(spark, d, "embeddings")
    return store.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), store


_SCORES = "SELECT q.vec_id AS qid, v.vec_id, v.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"


@query(f"SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({_SCORES})) WHERE rank <= 5")
def knn_topk(spark, d):
    return retrieval.top_k(*vectors(spark, d))


@query(f"SELECT qid, vec_id, score FROM ({_SCORES}) WHERE score >= 0.3")
def knn_threshold(spark, d):
    return retrieval.over_threshold(*vectors(spark, d), 0.3)


@query(
    f"""
WITH RECURSIVE near AS (SELECT qid, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({_SCORES})) WHERE rank <= 20),
v AS (SELECT n.qid, n.vec_id, n.score, CAST(e.embedding AS DOUBLE[]) AS e, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s
  FROM near n JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = n.qid),
p AS (SELECT qid, 0 AS k, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS picked FROM (SELECT DISTINCT qid FROM v)
  UNION ALL
  SELECT qid, k, list_append(ids, vec_id), list_append(picked, e) FROM (
    SELECT p.qid, p.k + 1 AS k, p.ids, p.picked, v.vec_id, v.e, row_number() OVER (PARTITION BY p.qid ORDER BY
      round(0.5 * v.s - 0.5 * coalesce(list_max(list_transform(p.picked, lambda x: list_cosine_similarity(x, v.e))), 0), 12) DESC, v.score DESC, v.vec_id) AS r
    FROM p JOIN v ON v.qid = p.qid AND NOT list_contains(p.ids, v.vec_id) WHERE p.k < 5) WHERE r = 1)
SELECT qid, CAST(k AS INTEGER) AS rank, ids[k] AS vec_id FROM p WHERE k > 0"""
)
def mmr(spark, d):
    return retrieval.mmr(*vectors(spark, d))


@query("SELECT DISTINCT label FROM embeddings WHERE label IN (0, 1, 2, 3)")
def retrieve_union(spark, d):
    store = table(spark, d, "embeddings")
    return retrieval.union_of([store.filter("label in (0, 1)").select("label"), store.filter("label in (1, 2, 3)").select("label")], "label")


@query("SELECT c_nationkey AS nation FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) = 2")
def retrieve_intersect(spark, d):
    store = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("type"))
    return retrieval.in_all_types(store, "nation", ["BUILDING", "MACHINERY"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def keyword_search(spark, d):
    return retrieval.keyword(table(spark, d, "documents"), "License", "text").select("doc_id")


# ---------------------------------------------------------------- sources, reports, tables


@query("SELECT n_nationkey, '[n_name] ' || n_name || chr(10) || chr(10) || '[n_regionkey] ' || n_regionkey AS text, 'n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS record FROM nation")
def combine_rows(spark, d):
    columns = ["n_name", "n_regionkey"]
    return table(spark, d, "nation").select("n_nationkey", sources.combined(columns).alias("text"), sources.record_text(columns).alias("record"))


_PLAIN = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g')"
for _mark, _char in sources.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_mark}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, trim(regexp_replace({_PLAIN}, '[ \t\r\n]*\n[ \t\r\n]*', chr(10), 'g'), ' ' || chr(10)) AS text, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", sources.html_text(F.col("html")).alias("text"), sources.html_title(F.col("html")).alias("title"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_preview(spark, d):
    return sources.page(table(spark, d, "orders"), 3, 50, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query(
    f"""
WITH s AS (SELECT 0.95 AS c, unnest(regexp_extract_all(text, '{IPV4}')) FROM documents UNION ALL SELECT 0.95, unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents UNION ALL SELECT 0.6, unnest(regexp_extract_all(text, '{DIGITS}')) FROM documents)
SELECT count(*) AS n, round(avg(c), 6) AS mean, CAST(min(c) AS DOUBLE) AS min, CAST(max(c) AS DOUBLE) AS max FROM s"""
)
def confidence_stats(spark, d):
    found = spans.with_spans(texts(spark, d, "doc_id", "text"), [spans.scan])
    return reports.confidence_stats(spans.exploded(found))


@query(f"SELECT lang, source, count(*) AS documents, CAST(sum(n) AS BIGINT) AS entities, round(avg(n), 6) AS mean_entities FROM (SELECT lang, source, len(regexp_extract_all(text, '{IPV4}')) AS n FROM documents) GROUP BY ROLLUP (lang, source)")
def report_rollup(spark, d):
    found = spans.with_spans(table(spark, d, "documents"), [lambda t: spans.scan(t, rules.of_type(rules.PARITY, "IP_ADDRESS"))])
    return reports.totals(found, by=("lang", "source"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return reports.latest(rows, "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT p_type AS phi_type, CAST(max(p_size) AS DOUBLE) AS max_confidence, array_to_string(list_sort(list(DISTINCT p_brand))[1:5], ',') AS texts FROM part GROUP BY p_type")
def tool_hints(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("phi_type"), F.col("p_brand").alias("text"), F.col("p_size").cast("double").alias("confidence"))
    return reports.hints(rows, keys=()).withColumn("texts", F.array_join("texts", ","))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return streams.event_windows(table(spark, d, "events"))


@query(
    """
WITH o AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS part, 'PSEUDO-' || upper(substr(sha256('s' || c_name), 1, 4)) AS pseudo FROM customer")
def sql_functions(spark, d):
    """The session's SQL functions in a SQL statement."""
    from maskwright.functions.sql import register

    register(spark)
    table(spark, d, "customer").createOrReplaceTempView("maskwright_customer")
    return spark.sql("SELECT c_custkey, mask_partial(c_name, 2, 2) AS part, pseudonym(c_name, 's') AS pseudo FROM maskwright_customer")


@query(
    """
SELECT c_custkey AS file_id, c_name AS name, o_orderkey AS task_id, o_orderstatus AS status FROM customer LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1 WHERE c_mktsegment = 'BUILDING'"""
)
def file_listing(spark, d):
    """Customers as files and orders as their tasks: an owner's files with the latest task of each."""
    from maskwright.sources.catalogue import listing

    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("uploaded"))
    tasks = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"))
    return listing(files, tasks, "BUILDING").select("file_id", "name", "task_id", "status")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")
def status_counts(spark, d):
    from maskwright.sources.catalogue import status_counts as counts

    return counts(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ("O", "F", "P"))
