"""Queries for single operators, over rows derived from the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.functions import types as Y
from maskwright.operators import chunking, evaluation, identifiers, masking, retrieval, rules, spans
from maskwright.plans import reports
from maskwright.plans.plugins import model_stage
from maskwright.plans.scratch import fresh_path, spread
from maskwright.queries import _G, _GOLD, _P, _PRED, _RATIOS, customer_ids, gold_and_predicted, query, spans_sql, table, tagged, vectors
from maskwright.queries import _ACCURACY, _counts_sql, _ID_SQL, _TAGGED, _FIRST, _VALID_SQL
from maskwright.sources import annotated, catalogue, outputs
from maskwright.sources import documents as sources
from maskwright.streaming import documents as streams



def ckey():
    return F.col("c_custkey")


CUSTOMERS = "(SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 90000000 + 10000000 AS VARCHAR), 8, '0') AS n FROM customer)"


def customers(spark, d):
    """c_custkey and n: eight digits from the key."""
    return table(spark, d, "customer").select("c_custkey", (ckey() * 7919 % 90000000 + 10000000).cast("string").alias("n"))


def texts_of(spark, d, text):
    return customers(spark, d).select("c_custkey", text.alias("text"))


def scanned(df, key, ids, pack=rules.PARITY):
    found = spans.with_spans(df, [lambda t: spans.scan(t, [r for r in pack if r.rule_id in ids])], resolve=False)
    return spans.exploded(found, keys=(key,)).select(key, "rule_id", "text", "start_pos", "end_pos", "confidence")


def n(a, b):
    return F.substring("n", a, b)


def one_sql(lead: str, value: str, rule: str, confidence: float) -> str:
    """SQL of one match of a value behind a lead."""
    a = f"length('{lead}')"
    return f"SELECT c_custkey, '{rule}' AS rule_id, {value} AS text, CAST({a} AS INTEGER) AS start_pos, CAST({a} + length({value}) AS INTEGER) AS end_pos, CAST({confidence} AS DOUBLE) AS confidence FROM {CUSTOMERS}"


# ---------------------------------------------------------------- scans of single rules


@query(one_sql("see ", "'https://h' || n[1:3] || '.example.org/p?q=' || n[4:6]", "url_http", 0.95))
def scan_url(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("see https://h"), n(1, 3), F.lit(".example.org/p?q="), n(4, 3), F.lit(" now"))), "c_custkey", ("url_http", "url_www"))


@query(one_sql("see http://", "'www.h' || n[1:3] || '.org/'", "url_www", 0.9) + " UNION ALL " + one_sql("see ", "'http://www.h' || n[1:3] || '.org/'", "url_http", 0.95))
def scan_url_both(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("see http://www.h"), n(1, 3), F.lit(".org/ now"))), "c_custkey", ("url_http", "url_www"))


@query(one_sql("at ", "'20' || n[1:2] || ':db8:a:b:' || n[3:6] || ':0:ff:1'", "ipv6", 0.9))
def scan_ipv6(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("at 20"), n(1, 2), F.lit(":db8:a:b:"), n(3, 4), F.lit(":0:ff:1 ok"))), "c_custkey", ("ipv6", "ipv4"))


@query(one_sql("on ", "n[1:1] || '/' || n[2:2] || '/' || n[3:6]", "date_dmy", 0.85) + " UNION ALL " + one_sql("on 1/2/3456 or ", "n[3:6] || '-' || n[1:1] || '-' || n[7:8]", "date_ymd", 0.9))
def scan_date_forms(spark, d):
    """Day, month, year; then year, month, day."""
    text = F.concat(F.lit("on "), n(1, 1), F.lit("/"), n(2, 1), F.lit("/"), n(3, 4), F.lit(" or "), n(3, 4), F.lit("-"), n(1, 1), F.lit("-"), n(7, 2))
    return scanned(texts_of(spark, d, text), "c_custkey", ("date_dmy", "date_ymd"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS text, CAST(8 AS INTEGER) AS start_pos, CAST(8 + length(strftime(o_orderdate, '%B %-d, %Y')) AS INTEGER) AS end_pos, CAST(0.85 AS DOUBLE) AS confidence FROM orders")
def scan_date_words(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Ordered "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".")).alias("text"))
    return scanned(rows, "o_orderkey", ("date_en",)).drop("rule_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y年%-m月%-d日') AS text, CAST(2 AS INTEGER) AS start_pos, CAST(2 + length(strftime(o_orderdate, '%Y年%-m月%-d日')) AS INTEGER) AS end_pos, CAST(0.9 AS DOUBLE) AS confidence FROM orders")
def scan_date_cjk(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("於 "), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" 訂")).alias("text"))
    return scanned(rows, "o_orderkey", ("date_cjk",)).drop("rule_id")


@query(one_sql("pay ", "n[1:3] || '-' || n[4:5] || '-' || n[1:6] || '-' || n[7:7]", "account_bank", 0.85))
def scan_bank_account(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("pay "), n(1, 3), F.lit("-"), n(4, 2), F.lit("-"), n(1, 6), F.lit("-"), n(7, 1))), "c_custkey", ("account_bank",))


@query(one_sql("call or Fax no.: ", "'02-' || n[1:4] || '-' || n[5:8]", "fax", 0.9))
def scan_fax(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("call or Fax no.: 02-"), n(1, 4), F.lit("-"), n(5, 4))), "c_custkey", ("fax",))


@query(one_sql("住 ", "'台北市中山區'", "location_district", 0.8) + " UNION ALL " + one_sql("住 台北市中山區 ", "n[1:3] || '中山北路'", "location_street", 0.85))
def scan_places(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("住 台北市中山區 "), n(1, 3), F.lit("中山北路"))), "c_custkey", ("location_district", "location_street"))


@query(one_sql("no ", "chr(CAST(65 + c_custkey % 26 AS INTEGER)) || '1' || n", "id_national", 0.95) + " UNION ALL " + one_sql("no A100000000 ", "'AB' || n || '7'", "id_resident", 0.8))
def scan_id_rules(spark, d):
    return scanned(texts_of(spark, d, F.concat(F.lit("no "), F.char(65 + ckey() % 26), F.lit("1"), n(1, 8), F.lit(" AB"), n(1, 8), F.lit("7"))), "c_custkey", ("id_national", "id_resident"))


@query(one_sql("x ", "n[1:3] || '-' || n[4:5] || '-' || n[1:4]", "us_ssn", 0.9) + " UNION ALL " + one_sql("x 000-00-0000 ", "n[1:1] || '/' || n[2:2] || '/' || n[3:4]", "us_date", 0.8))
def scan_us_basic(spark, d):
    text = F.concat(F.lit("x "), n(1, 3), F.lit("-"), n(4, 2), F.lit("-"), n(1, 4), F.lit(" "), n(1, 1), F.lit("/"), n(2, 1), F.lit("/"), n(3, 2))
    return scanned(texts_of(spark, d, text), "c_custkey", ("us_ssn", "us_date"), rules.US_BASIC)


@query(one_sql("病歷", "'A1' || n", "id_national_cjk", 0.95))
def scan_cjk_boundary(spark, d):
    """An identifier between ideographs."""
    return scanned(texts_of(spark, d, F.concat(F.lit("病歷A1"), n(1, 8), F.lit("號"))), "c_custkey", ("id_national_cjk",), rules.CJK_BOUNDARY)


@query("SELECT c_custkey, 'customer_no' AS rule_id, c_name AS text, CAST(3 AS INTEGER) AS start_pos, CAST(3 + length(c_name) AS INTEGER) AS end_pos, CAST(0.5 AS DOUBLE) AS confidence FROM customer")
def scan_custom_rule(spark, d):
    pack = rules.merged(rules.PARITY, [rules.Rule("customer_no", "ACCOUNT_NUMBER", r"\bCustomer#\d+", 0.5)])
    return scanned(table(spark, d, "customer").select("c_custkey", F.concat(F.lit("of "), "c_name").alias("text")), "c_custkey", ("customer_no",), pack)


@query(f"SELECT c_custkey, id AS text, CAST(CASE WHEN {_VALID_SQL} THEN 0.99 ELSE 0.7 END AS DOUBLE) AS confidence, 'TW_NATIONAL_ID' AS id_type FROM (SELECT c_custkey, {_ID_SQL} AS id FROM customer) UNION ALL SELECT c_custkey, 'XY' || n, CAST(0.95 AS DOUBLE), 'TW_ARC' FROM {CUSTOMERS}")
def id_scan_unchecked(spark, d):
    rows = customer_ids(spark, d).join(customers(spark, d), "c_custkey").select("c_custkey", F.concat("id", F.lit(", XY"), "n").alias("text"))
    found = rows.select("c_custkey", F.explode(identifiers.id_spans(F.col("text"), validate=False)).alias("s")).select("c_custkey", "s.*")
    return found.select("c_custkey", "text", "confidence", F.col("rule_id").alias("id_type"))


@query(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'TW_NATIONAL_ID' WHEN 1 THEN 'TW_ARC' ELSE 'UNKNOWN' END AS id_type, CASE c_custkey % 3 WHEN 0 THEN {_VALID_SQL} WHEN 1 THEN TRUE ELSE FALSE END AS valid FROM (SELECT c_custkey, {_ID_SQL} AS id FROM customer)")
def id_validate(spark, d):
    value = F.when(ckey() % 3 == 0, F.concat(F.lit(" "), F.lower("id"), F.lit(" "))).when(ckey() % 3 == 1, F.concat(F.lit("ab"), F.substring("id", 3, 8))).otherwise(F.substring("id", 1, 7))
    return customer_ids(spark, d).withColumn("v", identifiers.validate_id(value)).select("c_custkey", "v.id_type", "v.valid")


@query(f"SELECT c_custkey, CASE WHEN {_VALID_SQL} THEN 'valid' ELSE 'invalid' END AS checked FROM (SELECT c_custkey, {_ID_SQL} AS id FROM customer)")
def sql_validate_id(spark, d):
    from maskwright.functions.sql import register

    register(spark)
    return customer_ids(spark, d).select("c_custkey", F.expr("validate_id(id)").alias("checked"))


@query(f"SELECT c_custkey, '0' || '9' || n[1:8] AS text, CAST(0.95 AS DOUBLE) AS confidence FROM {CUSTOMERS}")
def phone_claims(spark, d):
    """A mobile number takes the text in which a local one starts; a date and an identifier are no phones."""
    text = F.concat(F.lit("x 09"), n(1, 8), F.lit(" y 2024-05-17 z A1"), F.lit("23456789"))
    found = texts_of(spark, d, text).select("c_custkey", F.explode(identifiers.phone_spans(F.col("text"))).alias("s"))
    return found.select("c_custkey", "s.text", "s.confidence")


@query("SELECT doc_id, 'license' AS text, CAST(0.7 AS DOUBLE) AS confidence FROM documents, unnest(range(len(regexp_extract_all(lower(text), 'license')))) AS u(i)")
def plugin_model(spark, d):
    """A detector that runs in Arrow batches: here a word finder stands for a model."""

    def load():
        import re

        return lambda t: [{"phi_type": "CERTIFICATE", "text": m.group().lower(), "start_pos": m.start(), "end_pos": m.end(), "confidence": 0.7} for m in re.finditer("(?i)license", t)]

    rows = table(spark, d, "documents").select("doc_id", "text", spans.no_spans().alias("spans"))
    return spans.exploded(model_stage(load, "words")(rows)).select("doc_id", "text", "confidence")


@query("SELECT c_custkey, c_custkey % 130 AS age FROM customer")
def age_labels(spark, d):
    age = (ckey() % 130).cast("string")
    text = F.when(ckey() % 3 == 0, F.concat(F.lit("age: "), age)).when(ckey() % 3 == 1, F.concat(age, F.lit(" 歲"))).otherwise(F.concat(F.lit("年齡："), age))
    return table(spark, d, "customer").select("c_custkey", T.age_number(text).cast("long").alias("age"))


@query("SELECT doc_id, lang IN ('zh-TW', 'zh-CN', 'en', 'ja', 'ko', 'fr', 'de', 'es', 'vi', 'th') AS ok FROM documents")
def language_supported(spark, d):
    return table(spark, d, "documents").select("doc_id", Y.is_supported(F.col("lang")).alias("ok"))


_ANSWERS = ("Patient Name", "birthday", "Fax tel", "E-mail", "SSN", "home_address", "Hospital Org", "shoe")


@query("SELECT c_custkey, ['NAME', 'DATE', 'PHONE', 'EMAIL', 'ID', 'LOCATION', 'FACILITY', 'SHOE'][c_custkey % 8 + 1] AS phi_type FROM customer")
def keyword_types(spark, d):
    return table(spark, d, "customer").select("c_custkey", Y.keyword_type(F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (ckey() % 8 + 1).cast("int"))).alias("phi_type"))


@query(f"SELECT c_custkey, n[1:6] AS text, c_custkey % 4 = 0 OR n[1:6] LIKE '1%' OR n[1:6] = '123456' AS found FROM {CUSTOMERS}")
def custom_type_match(spark, d):
    value = F.when(ckey() % 4 == 0, F.concat(F.lit("My Code"), n(1, 0))).otherwise(n(1, 6))
    return customers(spark, d).select("c_custkey", n(1, 6).alias("text"), Y.matches_custom(value, ["123456"], ["code"], "1[0-9]+").alias("found"))


# ---------------------------------------------------------------- spans


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS start_pos, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 7 END WHEN c_custkey % 2 = 0 THEN c_custkey ELSE greatest(7, c_custkey) END AS end_pos FROM customer")
def repaired_positions(spark, d):
    a, b = spans.repaired(F.when(ckey() % 3 != 0, ckey()), F.when(ckey() % 2 != 0, F.lit(7).cast("long")))
    return table(spark, d, "customer").select("c_custkey", a.alias("start_pos"), b.alias("end_pos"))


@query("SELECT c_custkey, CAST(strpos(c_name, '00' || c_custkey % 7) - 1 AS INTEGER) AS at FROM customer")
def place_lookup(spark, d):
    return table(spark, d, "customer").select("c_custkey", spans.place_of(F.concat(F.lit("00"), (ckey() % 7).cast("string")), F.col("c_name"), -1).alias("at"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 8 END AS INTEGER) AS at FROM customer")
def aligned_findings(spark, d):
    """A model's places: right, wrong (found again in the document from the chunk on), and of a text that is not there."""
    value = F.when(ckey() % 3 == 2, "nowhere").otherwise(F.substring("c_name", 9, 9))
    at = spans.aligned(value, F.when(ckey() % 3 == 0, F.lit(4)).otherwise(F.lit(1)), F.lit("chunk"), F.lit(4), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", at.alias("at"))


@query("SELECT c_custkey, 'NAME' AS phi_type, 0 AS start_pos, CAST(c_custkey % 5 AS INTEGER) AS end_pos, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Identified as PHI' END AS reason FROM customer")
def entity_defaults(spark, d):
    none = F.lit(None)
    rows = table(spark, d, "customer").select("c_custkey", none.cast("string").alias("phi_type"), none.cast("int").alias("start_pos"), (ckey() % 5).cast("int").alias("end_pos"), F.when(ckey() % 2 != 0, 0.5).alias("confidence"), F.when(ckey() % 3 == 0, F.col("c_name")).when(ckey() % 3 == 1, "").alias("reason"))
    return Y.with_defaults(rows)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ': ' || p_name || ' (rare) [Source: law]' ELSE 'DATE: ' || p_name END AS d FROM part")
def type_descriptions(spark, d):
    own = F.col("p_partkey") % 2 == 0
    text = Y.description(F.when(own, "CUSTOM").otherwise("DATE"), F.when(own, F.col("p_brand")), F.col("p_name"), F.lit("rare"), F.when(own, "law").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.alias("d"))


@query("SELECT p_partkey, p_name AS text, 'NAME' AS phi_type FROM part UNION ALL SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'ID' ELSE 'DATE' END FROM part")
def parsed_answers(spark, d):
    """Entities of three forms of a model's answer, less those that are not in the source."""
    entity = lambda t, k: F.concat(F.lit('{"text": "'), t, F.lit(f'", "phi_type": "{k}"}}'))
    k = F.col("p_partkey") % 3
    lone = F.concat(entity(F.col("p_name"), "NAME"), F.lit(", "), F.when(k == 0, entity(F.col("p_brand"), "ID")).otherwise(entity(F.col("p_brand"), "DATE")), F.lit(", "), entity(F.lit("!"), "NAME"))
    answer = F.when(k == 0, F.concat(F.lit('```json\n{"entities": ['), lone, F.lit("]}\n```"))).when(k == 1, F.concat(F.lit("["), lone, F.lit("]"))).otherwise(F.concat(F.lit("They are: "), lone))
    rows = table(spark, d, "part").select("p_partkey", evaluation.in_source(evaluation.parse_entities(answer), F.concat("p_name", F.lit(" "), "p_brand")).alias("e"))
    return rows.select("p_partkey", F.explode("e").alias("e")).select("p_partkey", "e.text", "e.phi_type")


# ---------------------------------------------------------------- types


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS prefixed, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Custom PHI: ' || c_name END AS named FROM customer")
def custom_names(spark, d):
    label = F.when(ckey() % 2 == 0, F.concat(F.lit("custom: "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", Y.prefixed_custom(label).alias("prefixed"), Y.custom_name(F.when(ckey() % 3 == 0, F.col("c_mktsegment")).when(ckey() % 3 == 1, " "), F.col("c_name")).alias("named"))


@query("SELECT DISTINCT c_mktsegment AS name, 'custom' AS source, FALSE AS high_risk FROM customer")
def type_registry(spark, d):
    """Registered types, exported and read again; registering again adds nothing."""
    custom = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(False).alias("high_risk")).distinct()
    path = fresh_path(spark, "types")
    types = Y.type_table(spark, custom)
    Y.export_types(types, path)
    return Y.import_types(spark, path, Y.import_types(spark, path, Y.type_table(spark))).filter("source = 'custom'").select("name", "source", "high_risk")


@query("SELECT string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS list, '[\"' || string_agg(DISTINCT c_mktsegment, '\",\"' ORDER BY c_mktsegment) || '\"]' AS json, '- ' || string_agg(DISTINCT c_mktsegment, chr(10) || '- ' ORDER BY c_mktsegment) AS markdown FROM customer")
def rendered_types(spark, d):
    return Y.render_types(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct())


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'NAME' ELSE 'CUSTOM' END AS phi_type FROM part")
def alias_precedence(spark, d):
    """A caller's own mapping comes before type names and aliases."""
    label = F.when(F.col("p_partkey") % 3 == 0, "phone").when(F.col("p_partkey") % 3 == 1, "姓名").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", Y.map_alias(label, {"phone": "DATE"})["phi_type"].alias("phi_type"))


@query("SELECT p_partkey, ['NAME', 'ID', 'FACILITY', 'GPE'][p_partkey % 4 + 1] AS light, ['DOCTOR', 'MRN', 'CLINIC', 'GPE'][p_partkey % 4 + 1] AS plain FROM part")
def short_forms(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("doctor", "mrn", "clinic", "gpe")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", Y.short_form(label, Y.LIGHT_FORMS).alias("light"), F.upper(label).alias("plain"))


@query("SELECT p_partkey, ['NAME', 'ID', 'AGE', 'CLINIC'][p_partkey % 4 + 1] AS form FROM part")
def case_forms(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("doctor_name", "mrn", "age_over_89", "clinic")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", Y.short_form(label, Y.CASE_FORMS).alias("form"))


# ---------------------------------------------------------------- masks


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '≥90 years' WHEN 1 THEN '>90歲' WHEN 2 THEN '[LOCATION]' WHEN 3 THEN '[地區]' ELSE '[GENERALIZED]' END AS masked FROM customer")
def mask_general_forms(spark, d):
    k = ckey() % 5
    value = F.when(k == 0, "95 years").when(k == 1, "95").when(k == 3, "台北").otherwise(F.col("c_name"))
    kind = F.when(k == 0, "AGE_OVER_89").when(k == 1, "AGE_OVER_90").when(k < 4, "LOCATION").otherwise("NAME")
    return table(spark, d, "customer").select("c_custkey", masking.generalization()(value, kind).alias("masked"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN '[DATE]' ELSE strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') END AS masked FROM orders")
def mask_shift_forms(spark, d):
    """The seven forms of dates, and what is none.  Days over 12 leave no doubt between day and month."""
    forms = ("yyyy-MM-dd", "yyyy/M/d", "yyyy年M月d日", "dd-MM-yyyy", "d/M/yyyy")
    date, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = F.lit("soon")
    for i in range(7):
        text = F.when(k == i, F.date_format(date, forms[i] if i < 5 else forms[i - 5])).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", masking.date_shifting(10)(text, F.lit("DATE")).alias("masked"))


@query("SELECT c_custkey, CAST(('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 1 AS INTEGER) AS zero, TRUE AS within, TRUE AS same FROM customer")
def seeded_offsets(spark, d):
    """In the range, the same for the same seed; a range of one number gives it."""
    a = masking.seeded_offset(F.col("c_name"), -30, 30)
    return table(spark, d, "customer").select("c_custkey", masking.seeded_offset(F.col("c_name"), 0, 0).alias("zero"), a.between(-30, 30).alias("within"), (a == masking.seeded_offset(F.concat("c_name", F.lit("")), -30, 30)).alias("same"))


_POLICY = "CASE c_custkey % 4 WHEN 0 THEN 'Patient-' || upper(substr(sha256('s' || c_name), 1, 4)) WHEN 1 THEN left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) WHEN 2 THEN '[GENERALIZED]' ELSE '[REDACTED]' END"


@query(f"SELECT c_custkey, {_POLICY.replace('[GENERALIZED]', '≥90歲')} AS masked FROM customer")
def mask_policy(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("NAME", "PHONE", "AGE_OVER_89", "EMAIL")]), (ckey() % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", masking.recommended(salt="s")(F.col("c_name"), kind).alias("masked"))


@query("SELECT c_custkey, repeat('#', length(c_name)) AS named, '' AS other FROM customer")
def mask_by_name(spark, d):
    """Strategies made by name, one for a type and one for the rest."""
    mask = masking.by_type({"NAME": masking.strategy("redaction", mask_char="#")}, masking.strategy("suppression"))
    return table(spark, d, "customer").select("c_custkey", mask(F.col("c_name"), F.lit("NAME")).alias("named"), mask(F.col("c_name"), F.lit("ID")).alias("other"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'of <' || c_custkey || '> and <S>' WHEN 1 THEN 'of <' || c_custkey || '> and ' || c_mktsegment ELSE 'of ' || c_name || ' and ' || c_mktsegment END AS text FROM customer")
def mask_regenerated(spark, d):
    """Masks at their places; at the first occurrence where the place is wrong; nowhere where the value is not there."""
    text = F.concat(F.lit("of "), "c_name", F.lit(" and "), "c_mktsegment")
    one = lambda v, m, a: F.struct(v.alias("value"), m.alias("masked"), a.alias("start_pos"), (a + F.char_length(v)).alias("end_pos"))
    name = one(F.col("c_name"), F.concat(F.lit("<"), ckey().cast("string"), F.lit(">")), F.when(ckey() % 3 == 0, 3).otherwise(5))
    segment = one(F.col("c_mktsegment"), F.lit("<S>"), 8 + F.char_length("c_name"))
    absent = one(F.lit("nowhere"), F.lit("<N>"), F.lit(0))
    entities = F.when(ckey() % 3 == 0, F.array(name, segment)).when(ckey() % 3 == 1, F.array(name, absent)).otherwise(F.array(absent))
    return table(spark, d, "customer").select("c_custkey", masking.regenerated(text, entities).alias("text"))


@query("SELECT c_custkey, '[REDACTED]' AS text, '' AS reason, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '[REDACTED]' END AS shown, c_custkey % 2 = 0 AS included FROM customer")
def safe_entities(spark, d):
    """What is stored, and what a response shows where it is asked for."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("text"), F.lit("why").alias("reason"))
    stored = masking.storage_safe(rows)
    answer = masking.response_safe(F.array(F.struct(F.col("c_name").alias("text"))), ckey() % 2 == 0, True)
    return stored.withColumn("r", answer).select("c_custkey", "text", "reason", F.col("r.entities")[0]["text"].alias("shown"), F.col("r.raw_included").alias("included"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[NAME_' ELSE '[REDAC' END AS masked FROM part WHERE p_partkey % 4 IN (0, 2)")
def preset_masks(spark, d):
    """The research preset: names are hashed, dates kept out of it, phones redacted, URLs not listed."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("NAME", "DATE", "PHONE", "URL")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    config = masking.from_json(masking.to_json(masking.preset("research_safe")), secret="k")
    rows = table(spark, d, "part").select("p_partkey", kind.alias("phi_type"), F.col("p_name").alias("text"))
    return masking.configured(rows, config).select("p_partkey", F.substring("masked", 1, 6).alias("masked"))


@query("SELECT CASE p_partkey % 4 WHEN 1 THEN 'DATE' ELSE 'URL' END AS phi_type, count(*) AS count FROM part WHERE p_partkey % 4 IN (1, 3) GROUP BY 1")
def preset_rest(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("NAME", "DATE", "PHONE", "URL")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return masking.filtered_out(table(spark, d, "part").select(kind.alias("phi_type")), masking.preset("research_safe"))


@query("SELECT __sheet, count(*) AS n, count(c_name) AS named FROM (SELECT 'a' AS __sheet, c_name FROM customer UNION ALL SELECT 'b', NULL FROM supplier) GROUP BY __sheet")
def masked_sheets(spark, d):
    both = masking.with_sheet({"a": table(spark, d, "customer").select("c_name"), "b": table(spark, d, "supplier").select("s_name")})
    return both.groupBy("__sheet").agg(F.count("*").alias("n"), F.count("c_name").alias("named"))


# ---------------------------------------------------------------- sources, by way of files


@query("SELECT page_id, ['text', 'csv', 'xlsx', 'docx', 'json', 'pdf', 'html', 'xml', 'unknown'][page_id % 9 + 1] AS format FROM pages")
def format_by_name(spark, d):
    ends = F.array(*[F.lit(x) for x in ("TXT", "csv", "xlsx", "docx", "JSON", "pdf", "htm", "xml", "zip")])
    path = F.concat(F.lit("/a.b/"), F.col("page_id").cast("string"), F.lit("."), F.element_at(ends, (F.col("page_id") % 9 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", sources.format_of(path).alias("format"))


@query("SELECT doc_id, sha256(text) AS same FROM documents WHERE lang IN ('de', 'es') AND NOT regexp_matches(text, '[^\\x{0}-\\x{FF}]')")
def latin_decoded(spark, d):
    rows = table(spark, d, "documents").filter("lang in ('de', 'es')").filter(~F.col("text").rlike(r"[^\x{0}-\x{FF}]"))
    return rows.select("doc_id", F.sha2(sources.decoded(F.encode("text", "ISO-8859-1")), 256).alias("same"))


def _files(spark, rows, format, name="file"):
    """A table's rows as files, one folder for each value of ``name``; the folder's path."""
    path = fresh_path(spark, "files")
    rows.write.partitionBy(name).format(format).save(path)
    return path


def _loaded(spark, path, **more):
    found = sources.load(spark, path, recursive=True, **more)
    return found.withColumn("file", F.regexp_extract("path", "file=([^/]+)/", 1).cast("long"))


@query("SELECT n_nationkey AS file, 'text' AS format, n_name || ' of ' || n_regionkey AS content FROM nation")
def load_text(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.concat("n_name", F.lit("  of\n "), F.col("n_regionkey").cast("string")).alias("value"))
    return _loaded(spark, _files(spark, rows, "text"), glob="*.txt").select("file", "format", "content")


@query("SELECT n_nationkey AS file, 'json' AS format, '{' || chr(10) || '  \"name\": \"' || n_name || '\",' || chr(10) || '  \"region\": ' || n_regionkey || chr(10) || '}' AS content FROM nation")
def load_json(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return _loaded(spark, _files(spark, rows, "json"), glob="*.json").select("file", "format", "content")


@query("SELECT n_nationkey AS file, 'fhir' AS format, 'Patient' AS resource_type, n_name AS resource_id FROM nation")
def load_fhir(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.lit("Patient").alias("resourceType"), F.col("n_name").alias("id"))
    return _loaded(spark, _files(spark, rows, "json"), glob="*.json").withColumn("m", sources.fhir_metadata(F.col("content"))).select("file", "format", "m.*")


@query("SELECT n_regionkey AS file, 'csv' AS format, count(*) AS rows, string_agg('name: ' || n_name || ', key: ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def load_csv(spark, d):
    rows = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey").select(F.col("n_regionkey").alias("file"), F.concat(F.col("n_name"), F.lit(","), F.col("n_nationkey").cast("string")).alias("value"))
    path = fresh_path(spark, "files")
    each = rows.groupBy("file").agg(F.concat(F.lit("name,key\n"), F.array_join(F.sort_array(F.collect_list(F.struct(F.split("value", ",")[1].cast("int").alias("k"), "value"))).getField("value"), "\n")).alias("value"))
    each.write.partitionBy("file").text(path)
    found = _loaded(spark, path, format="csv", glob="*.txt")
    return found.select("file", "format", (F.regexp_count("content", F.lit("\n")) + 1).cast("long").alias("rows"), "content")


@query("SELECT n_nationkey AS file, 'row [key=' || n_regionkey || ']' || chr(10) || '  name: ' || n_name AS content FROM nation")
def load_xml(spark, d):
    value = F.concat(F.lit('<row key="'), F.col("n_regionkey").cast("string"), F.lit('"><name> '), "n_name", F.lit(" </name>tail</row>"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), value.alias("value"))
    return _loaded(spark, _files(spark, rows, "text"), format="xml", glob="*.txt").select("file", "content")


@query("SELECT count(*) AS files, 0 AS failed, CAST(sum(CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS read FROM nation")
def load_with_rejects(spark, d):
    """Broken files become rows with an error and do not end the others."""
    value = F.when(F.col("n_nationkey") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"n": "'), "n_name", F.lit('"}')))
    path = _files(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), value.alias("value")), "text")
    found = sources.load(spark, path, format="json", recursive=True, glob="*.txt", max_bytes=1 << 20)
    return found.agg(F.count("*").alias("files"), F.lit(0).alias("failed"), F.count("error").alias("rejected"), F.count("content").alias("read"))


@query("SELECT n_regionkey AS region, count(*) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY n_regionkey")
def folder_sizes(spark, d):
    path = fresh_path(spark, "files")
    table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    listed = sources.files(spark, path, glob="*.txt", recursive=True)
    out = catalogue.directory_stats(listed, F.regexp_extract("path", "n_regionkey=([0-9]+)/", 1).cast("int"))
    return out.withColumnRenamed("folder", "region")


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment AS plain, CAST(c_custkey AS VARCHAR) AS first, c_name AS named, 'Row-' || c_custkey AS numbered FROM customer")
def case_ids(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return t.select("c_custkey", sources.plain(["c_name", "c_mktsegment"]).alias("plain"), sources.case_id(None, ckey(), t.columns).alias("first"), sources.case_id("c_name", ckey()).alias("named"), sources.case_id(None, ckey()).alias("numbered"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS full FROM customer")
def blank_rows(spark, d):
    """Rows with and without a text, over the whole table."""
    full, blank = sources.rows_to_process(table(spark, d, "customer"), F.when(ckey() % 4 != 0, F.col("c_name")).when(ckey() % 8 == 0, "  "))
    return full.select("c_custkey", F.lit(True).alias("full")).unionByName(blank.select("c_custkey", F.lit(False).alias("full")))


@query("SELECT count(*) AS rows, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM orders")
def preview_totals(spark, d):
    return sources.page_totals(table(spark, d, "orders"), 50)


@query("SELECT n_nationkey AS sample_id, n_name AS text, 'FACILITY' AS phi_type, 3 AS start_pos FROM nation")
def annotated_samples(spark, d):
    """An annotated corpus written as JSON lines and read again, its types by their longer names."""
    one = F.struct(F.col("n_name").alias("entity"), F.lit("org").alias("type"), F.lit(3).alias("start_idx"))
    path = fresh_path(spark, "samples") + ".jsonl"
    table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("in "), "n_name").alias("text"), F.array(one).alias("entities")).write.json(path)
    _, gold = annotated.read_annotated(spark, path)
    return gold.select(F.col("sample_id").cast("int").alias("sample_id"), "text", annotated.cblue_types(F.col("phi_type")).alias("phi_type"), F.col("start").alias("start_pos"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'note' AS \"column\" FROM documents WHERE {_FIRST} <> ''")
def tagged_columns(spark, d):
    rows = tagged(spark, d).withColumn("note", F.col("tagged")).select("doc_id", "note", F.lit("plain").alias("other"))
    return annotated.read_tagged(rows, "doc_id").select("sample_id", "column")


# ---------------------------------------------------------------- chunks, estimates, retrieval


@query("SELECT doc_id, CAST(trunc(0.5 * length(text)) AS BIGINT) AS tokens FROM documents WHERE NOT regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]')")
def short_tokens(spark, d):
    return table(spark, d, "documents").filter(~F.col("text").rlike(T.CJK)).select("doc_id", T.short_token_estimate(F.col("text")).alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.04 THEN l_quantity / l_tax ELSE 0 END AS rate FROM lineitem")
def token_rates(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.rate(F.col("l_quantity"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).otherwise(0.0)).alias("rate"))


@query("SELECT n_nationkey, CAST(greatest(1, n_nationkey % 4, n_regionkey) AS BIGINT) AS rules FROM nation")
def regulation_rules(spark, d):
    numbered = F.repeat(F.lit("1. rule\n"), (F.col("n_nationkey") % 4).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", T.rule_count(F.concat(F.lit("Title\n"), numbered, F.repeat(F.lit("  - point\n"), F.col("n_regionkey")))).alias("rules"))


@query("SELECT c_nationkey AS qid, string_agg('[' || c_mktsegment || ']' || chr(10) || c_name, chr(10) || chr(10) ORDER BY c_custkey) AS context FROM customer GROUP BY c_nationkey")
def context_texts(spark, d):
    hits = table(spark, d, "customer").select(F.col("c_nationkey").alias("qid"), ckey().alias("rank"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("content"))
    return retrieval.context(hits)


@query("SELECT p_name AS source, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_name LIMIT 5")
def top_regulations(spark, d):
    return retrieval.top_by_score(table(spark, d, "part").select(F.col("p_name").alias("source"), F.col("p_retailprice").alias("score")), 5)


@query("SELECT count(*) + count(*) FILTER (vec_id % 2 = 0) - 2 * count(*) FILTER (vec_id % 10 = 0) AS vectors, 64 AS dimensions FROM embeddings")
def vector_store(spark, d):
    """Built, added to (the even ones once more), less every tenth."""
    rows = table(spark, d, "embeddings")
    store = retrieval.VectorStore(spark, fresh_path(spark, "store"))
    store.build(rows)
    store.add(rows.filter("vec_id % 2 = 0"))
    left = store.without(rows.filter("vec_id % 10 = 0"))
    return left.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"))


@query("""
WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id AS chunk_id, label AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT doc_id, qid, chunk_id, round(list_cosine_similarity(q, v), 6) AS score FROM q, v)
SELECT doc_id, qid, chunk_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, qid ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 3""")
def document_retrieval(spark, d):
    """Per document (label) and query, its nearest chunks; nothing is stored."""
    queries, store = vectors(spark, d)
    return retrieval.chunk_retrieval(store.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_id"), "embedding"), queries, 3)


@query("SELECT c_custkey, 1.0::DOUBLE AS length, TRUE AS same FROM customer")
def hashed_embeddings(spark, d):
    """Unit vectors; the order of words does not matter."""
    a = retrieval.hashed_terms(F.concat("c_name", F.lit(" "), "c_mktsegment"))
    b = retrieval.hashed_terms(F.concat("c_mktsegment", F.lit(" "), "c_name"))
    return spread(table(spark, d, "customer")).select("c_custkey", F.round(retrieval.norm(a), 6).alias("length"), (a == b).alias("same"))


# ---------------------------------------------------------------- evaluation

_IDS = "SELECT doc_id, '【PHI:NAME:a-' || doc_id || '】 ' || first || ' 【/PHI】 and 【PHI:DATE】x【/PHI】' AS t, first FROM (SELECT doc_id, {} AS first FROM documents) WHERE first <> ''".format(_FIRST)


def id_tagged(spark, d):
    first = F.regexp_extract("text", "([A-Za-z]+)", 1)
    text = F.concat(F.lit("【PHI:NAME:a-"), F.col("doc_id").cast("string"), F.lit("】 "), first, F.lit(" 【/PHI】 and 【PHI:DATE】x【/PHI】"))
    return table(spark, d, "documents").filter(first != "").select("doc_id", first.alias("first"), text.alias("t"))


@query(f"SELECT doc_id, 'NAME' AS phi_type, 'a-' || doc_id AS phi_id, first AS content, first || '  and 【PHI:DATE】x' AS bare FROM ({_IDS})")
def tag_samples(spark, d):
    """Samples of tagged texts, of which only tags with an id count; the others stay."""
    rows = evaluation.samples_of(id_tagged(spark, d), "t")
    return rows.select("doc_id", F.explode("gold").alias("g"), "bare").select("doc_id", "g.*", "bare")


@query(f"SELECT doc_id, '【PHI:NAME】' || first || 's【/PHI】, ' || '【PHI:ID】' || first || '【/PHI】' AS t FROM (SELECT doc_id, {_FIRST} AS first FROM documents) WHERE first <> ''")
def tag_write(spark, d):
    first = F.regexp_extract("text", "([A-Za-z]+)", 1)
    entity = lambda k, t: F.struct(F.lit(k).alias("phi_type"), t.alias("text"))
    rows = table(spark, d, "documents").filter(first != "").select("doc_id", F.concat(first, F.lit("s, "), first).alias("t"), F.array(entity("NAME", F.concat(first, F.lit("s")))).alias("a"), F.array(entity("ID", F.concat(F.lit(", "), first))).alias("b"))
    long = evaluation.with_tags(F.col("t"), F.col("a"))
    return rows.select("doc_id", F.concat(F.substring_index(long, ", ", 1), F.lit(", "), evaluation.with_tags(first_of(F.col("t")), F.array(entity("ID", first_of(F.col("t")))))).alias("t"))


def first_of(t):
    return F.substring_index(t, ", ", -1)


@query(_counts_sql(_G.replace("lower(trim(text)) AS text, ", ""), _P.replace("lower(trim(text)) AS text, ", ""), "phi_type", "phi_type"))
def eval_type_counts(spark, d):
    gold, predicted = (x.withColumn("phi_type", Y.normal_form(F.col("phi_type"))) for x in gold_and_predicted(spark, d))
    return evaluation.type_counts(gold, predicted)


_LISTS = f"""g AS (SELECT sample_id, list(DISTINCT lower(trim(text))) AS u, list(lower(text)) AS g FROM ({_GOLD}) GROUP BY sample_id), p AS (SELECT sample_id, list(DISTINCT lower(trim(text))) AS u, list(DISTINCT lower(text)) AS p, count(*) AS k FROM ({_PRED}) GROUP BY sample_id)"""


@query(f"WITH {_LISTS} SELECT sample_id, CAST(len(list_filter(g, lambda x: list_contains(p, trim(x)))) AS BIGINT) AS correct, k AS extracted, CAST(len(g) AS BIGINT) AS expected FROM g JOIN p USING (sample_id)")
def eval_recalled(spark, d):
    return evaluation.recalled(*gold_and_predicted(spark, d))


@query(f"WITH {_LISTS}, s AS (SELECT sample_id, CAST(len(list_intersect(g.u, p.u)) AS BIGINT) AS tp, CAST(len(p.u) - len(list_intersect(g.u, p.u)) AS BIGINT) AS fp, CAST(len(g.u) - len(list_intersect(g.u, p.u)) AS BIGINT) AS fn FROM g JOIN p USING (sample_id)) SELECT *, {_RATIOS} FROM s")
def eval_fuzzy_sets(spark, d):
    """All words have two characters, so containment is equality here; greedy choice is covered by tests."""
    return evaluation.fuzzy_sets(*gold_and_predicted(spark, d))


@query(_ACCURACY.format(f"""
WITH g AS (SELECT sample_id, text AS t, phi_type AS k, count(*) AS n FROM ({_G}) GROUP BY ALL), p AS (SELECT sample_id, text AS t, phi_type AS k, count(*) AS n FROM ({_P}) GROUP BY ALL),
s AS (SELECT CAST((SELECT sum(p.n) FROM p SEMI JOIN g USING (sample_id, t, k)) AS BIGINT) AS tp, CAST((SELECT sum(p.n) FROM p ANTI JOIN g USING (sample_id, t, k)) AS BIGINT) AS fp,
  CAST((SELECT sum(n) FROM g) - (SELECT count(*) FROM g SEMI JOIN p USING (sample_id, t, k)) AS BIGINT) AS fn) SELECT *, {_RATIOS} FROM s"""))
def eval_same_type(spark, d):
    gold, predicted = (x.withColumn("phi_type", Y.normal_form(F.col("phi_type"))) for x in gold_and_predicted(spark, d))
    return evaluation.same_type_partial(gold, predicted)


@query(f"WITH {_LISTS} SELECT sample_id, array_to_string(list_sort(list_intersect(p.u, g.u)), ',') AS matched, array_to_string(list_sort(list_filter(p.u, lambda x: NOT list_contains(g.u, x))), ',') AS over_detected, array_to_string(list_sort(list_filter(g.u, lambda x: NOT list_contains(p.u, x))), ',') AS missed FROM g JOIN p USING (sample_id)")
def eval_details(spark, d):
    out = evaluation.containment(*gold_and_predicted(spark, d))
    return out.select("sample_id", *[F.array_join(c, ",").alias(c) for c in ("matched", "over_detected", "missed")])


@query("SELECT c_custkey, ['exact', 'content', 'part', 'missed'][c_custkey % 4 + 1] AS tier FROM customer")
def eval_tiers(spark, d):
    one = lambda k, t: F.struct(F.lit(k).alias("phi_type"), t.alias("text"))
    found = F.when(ckey() % 4 == 0, F.array(one("NAME", F.col("c_name")))).when(ckey() % 4 == 1, F.array(one("ID", F.col("c_name")))).when(ckey() % 4 == 2, F.array(one("ID", F.substring("c_name", 3, 9)))).otherwise(F.array(one("NAME", F.lit("C"))))
    return table(spark, d, "customer").select("c_custkey", evaluation.tiered(F.array(one("NAME", F.col("c_name"))), found)[0].alias("tier"))


@query("SELECT count(*) FILTER (doc_id % 2 = 0) AS tp, count(*) FILTER (doc_id % 2 = 1) AS fp, count(*) FILTER (doc_id % 2 = 1) AS fn, round(count(*) FILTER (doc_id % 2 = 0) / count(*), 6) AS precision, round(count(*) FILTER (doc_id % 2 = 0) / count(*), 6) AS recall, round(count(*) FILTER (doc_id % 2 = 0) / count(*), 6) AS f1 FROM documents")
def eval_detector(spark, d):
    """A detector against gold entities that are right in every other document."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(k.alias("sample_id"), F.concat(F.lit("to a"), k.cast("string"), F.lit("@example.org")).alias("text"))
    gold = docs.select("sample_id", F.concat(F.when(F.col("sample_id") % 2 == 0, "A").otherwise("b"), F.col("sample_id").cast("string"), F.lit("@example.org ")).alias("text"), F.lit("email address").alias("phi_type"))
    return evaluation.evaluate_detector(docs, gold, lambda t: spans.scan(t, rules.of_type(rules.PARITY, "EMAIL")))


@query("SELECT l_suppkey AS model, round(0.7 * f + 0.15 * least(1.0, 1000.0 / greatest(q * 40, 1.0)) + 0.15 * least(1.0, 500.0 / greatest(q * 30, 1.0)), 6) AS efficiency FROM (SELECT l_suppkey, round(avg(l_discount) * 15, 4) AS f, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY l_suppkey)")
def added_efficiency(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(F.round(F.avg("l_discount") * 15, 4).alias("f"), F.round(F.avg("l_quantity"), 4).alias("q"))
    return m.select("model", F.round(T.added_efficiency(F.col("f"), F.col("q") * 40, F.col("q") * 30), 6).alias("efficiency"))


@query(f"WITH s AS (SELECT o_orderpriority AS model, count(*) FILTER (o_custkey % 2 = 0) AS tp, count(*) FILTER (o_custkey % 2 = 1) AS fp, count(*) FILTER (o_custkey % 3 = 0) AS fn, round(avg(o_custkey % 7), 6) AS mean_seconds FROM orders GROUP BY 1) SELECT *, {_RATIOS} FROM s")
def model_comparison(spark, d):
    k = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (k % 2 == 0).cast("long").alias("tp"), (k % 2 == 1).cast("long").alias("fp"), (k % 3 == 0).cast("long").alias("fn"), (k % 7).cast("double").alias("seconds"))
    return evaluation.compare_models(rows)


@query("SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END) AS success_rate FROM orders")
def success_share(spark, d):
    return evaluation.success_rate(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "E").alias("error")))


# ---------------------------------------------------------------- reports


@query("SELECT o_orderpriority AS file, count(*) AS total_rows, count(*) FILTER (o_orderstatus <> 'F') AS processed_rows, count(*) FILTER (o_orderstatus = 'F') AS failed_rows, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN o_custkey % 5 ELSE 0 END) AS BIGINT) AS entities, round(sum((o_custkey % 7)::DOUBLE), 6) AS seconds, round(avg(o_custkey % 7), 6) AS mean_seconds, round(count(*) FILTER (o_orderstatus <> 'F') / count(*), 6) AS success_ratio, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_custkey % 5 ELSE 0 END) / count(*) FILTER (o_orderstatus <> 'F'), 6) AS mean_entities FROM orders GROUP BY 1")
def batch_reports(spark, d):
    k = F.col("o_custkey")
    return reports.batch_report(table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), (F.col("o_orderstatus") != "F").alias("ok"), (k % 5).alias("entities"), (k % 7).cast("double").alias("seconds")))


@query("SELECT count(*) AS jobs, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(f) AS BIGINT) AS processed_rows, CAST(sum(n) AS BIGINT) AS entities, round(sum(f) / sum(n), 6) AS success_ratio, string_agg(j || ':' || n, ',' ORDER BY j) AS each FROM (SELECT o_orderpriority AS j, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS f FROM orders GROUP BY 1)")
def summary_reports(spark, d):
    jobs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("job_id")).agg(F.count("*").alias("total_rows"), F.count_if(F.col("o_orderstatus") != "F").alias("processed_rows"), F.count("*").alias("entities"))
    return reports.summary_report(jobs).withColumn("each", F.array_join(F.transform("each", lambda e: F.concat(e["job_id"], F.lit(":"), e["rows"].cast("string"))), ","))


@query("SELECT c_name AS file, c_mktsegment AS phi_type, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '[REDACTED]' END AS value, '[REDACTED]' AS masked, 0.5::DOUBLE AS confidence FROM customer")
def report_rows(spark, d):
    one = F.struct(F.col("c_mktsegment").alias("phi_type"), F.when(ckey() % 2 == 0, F.col("c_name")).otherwise("").alias("value"), F.lit(None).cast("string").alias("masked"), F.lit(0.5).alias("confidence"))
    return reports.entity_rows(table(spark, d, "customer").select(F.col("c_name").alias("file"), F.array(one).alias("entities")))


@query("SELECT p_type AS phi_type, count(*) AS n FROM part GROUP BY 1")
def types_by_count(spark, d):
    return reports.types_by_count(table(spark, d, "part").select(F.col("p_type").alias("phi_type")))


@query(spans_sql("documents", "doc_id", "text", r"\b\d{10,16}\b").replace("SELECT doc_id, m[i] AS text", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS entity_id, 'ACCOUNT_NUMBER' AS phi_type, m[i] AS text") + "")
def audit_rows(spark, d):
    found = spans.with_spans(table(spark, d, "documents").select("doc_id", "text"), [lambda t: spans.scan(t, [r for r in rules.PARITY if r.rule_id == "account_digits"])])
    return reports.audit(found).drop("confidence")


@query("SELECT o_custkey, count(*) AS files, CASE WHEN count(*) > 3 THEN array_to_string(list_sort(list(CAST(o_orderkey AS BIGINT)))[1:3], ', ') || ' etc.' ELSE array_to_string(list_sort(list(CAST(o_orderkey AS BIGINT))), ', ') END AS shown FROM orders GROUP BY o_custkey")
def task_names(spark, d):
    keys = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return keys.select("o_custkey", F.size("k").cast("long").alias("files"), reports.display_names(F.transform("k", lambda x: x.cast("string"))).alias("shown"))


@query("SELECT round(sum(length(p_name)) / sum(p_size::DOUBLE), 6) AS chars_per_second, round(count(*) / sum(p_size::DOUBLE), 6) AS files_per_second FROM part")
def throughput(spark, d):
    return reports.throughput(table(spark, d, "part").select(F.char_length("p_name").alias("chars"), F.lit(1).alias("files"), F.col("p_size").cast("double").alias("seconds")))


@query("SELECT o_orderpriority AS stage, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS failures, round(sum((o_custkey % 7)::DOUBLE), 6) AS seconds, round(avg(o_custkey % 7), 6) AS mean_seconds FROM orders GROUP BY 1")
def stage_summaries(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), (F.col("o_custkey") % 7).cast("double").alias("seconds"))
    return reports.stage_summary(rows)


@query("SELECT count(*) AS documents, count(*) FILTER (doc_id % 7 <> 0) AS succeeded, count(*) FILTER (doc_id % 7 = 0) AS failed, CAST(count(*) FILTER (doc_id % 7 <> 0) AS BIGINT) AS entities, round(count(*) FILTER (doc_id % 7 <> 0) / count(*), 6) AS success_ratio, 'partial' AS status, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents WHERE doc_id % 7 = 0 ORDER BY doc_id LIMIT 10)) AS errors FROM documents")
def job_results(spark, d):
    """Counts of a job and its first ten errors."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "ValueError").alias("error"), F.array(F.lit(1)).alias("spans"))
    out = reports.job_result(docs)
    return out.withColumn("errors", F.array_join(F.transform("errors", lambda e: e["doc_id"].cast("string")), ","))


@query("SELECT p_partkey, p_size * 2.0 AS eta, CASE WHEN p_size >= 25 THEN 100.0 ELSE 4.0 * p_size END AS percent, CASE WHEN p_size < 30 THEN (p_size * 2) || ' 秒' ELSE '1 分 ' || (p_size * 2 - 60) || ' 秒' END AS shown FROM part")
def remaining_times(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", T.eta(F.lit(1.0), 1 + s, F.lit(2.0)).alias("eta"), T.progress(s, F.lit(25.0)).alias("percent"), T.duration(s * 2).alias("shown"))


@query("SELECT c_custkey, 'a_b-' || c_custkey || '.txt' AS stem, 'ValueError' AS told, '| ' || c_custkey || ' | x\\|y z |' AS line FROM customer")
def safe_names(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("a b-"), ckey().cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("ValueError: "), "c_name").alias("error"), F.lit("x|y\nz").alias("cell"))
    lines = outputs.markdown_rows(rows.select("c_custkey", "cell"), ["c_custkey", "cell"])
    own = lines.select(F.regexp_extract("line", r"^\| (\d+)", 1).cast("long").alias("c_custkey"), "line")
    return rows.join(own, "c_custkey").select("c_custkey", T.safe_stem(F.col("name")).alias("stem"), T.safe_error(F.col("error")).alias("told"), "line")


@query("SELECT n_nationkey AS ord, CASE WHEN r > 1 THEN substr(s, 1, 27) || '_' || r ELSE s END AS sheet FROM (SELECT n_nationkey, s, row_number() OVER (PARTITION BY s ORDER BY n_nationkey) AS r FROM (SELECT n_nationkey, substr('a very long name of a sheet_in region ' || n_regionkey, 1, 31) AS s FROM nation))")
def sheet_names(spark, d):
    return outputs.sheet_names(table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("a very long name of a sheet/in region "), F.col("n_regionkey").cast("string")).alias("name")))


@query("SELECT n_nationkey AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'to <N>, from <N>' ELSE 'name,x' || chr(10) || '<N>,1' END AS content FROM nation")
def masked_artifacts(spark, d):
    """Text and delimited files with their values masked, in their own format."""
    key = F.col("n_nationkey")
    text = F.when(key % 2 == 0, F.concat(F.lit("to "), "n_name", F.lit(", from "), "n_name")).otherwise(F.concat(F.lit("name,x\n"), "n_name", F.lit(",1\n")))
    rows = table(spark, d, "nation").select(key.cast("string").alias("path"), F.when(key % 2 == 0, "text").otherwise("csv").alias("format"), F.encode(text, "UTF-8").alias("bytes"), F.col("n_name").alias("value"))
    out = outputs.masked_files(rows.select("path", "format", "bytes"), rows.select("path", "value", F.lit("<N>").alias("masked")))
    content = F.regexp_replace(F.decode("bytes", "UTF-8"), "^﻿|\r|\n$", "")
    return out.select(F.col("path").cast("int").alias("file"), F.trim(content, F.lit("\r\n")).alias("content"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'interrupted' ELSE 'completed' END AS status FROM orders")
def recovered_tasks(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed").alias("status"))
    return catalogue.recovered(rows)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 720 HOUR")
def expired_outputs(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"))
    last = rows.agg(F.max("modified").alias("now"))
    return outputs.expired(rows.crossJoin(F.broadcast(last)), F.col("now"), 720).select("o_orderkey")  # one row


@query("SELECT event_type, max(event_id) AS last, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def running_totals(spark, d):
    """The last of each group's running sums is its total."""
    out = reports.running(table(spark, d, "events"), "event_type", "event_id", "value")
    return out.groupBy("event_type").agg(F.max("event_id").alias("last"), F.round(F.max_by("running", "event_id"), 6).alias("total"))


# ---------------------------------------------------------------- streams


@query("SELECT doc_id, 'EMAIL' AS phi_type, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b')) AS text FROM documents")
def stream_scan(spark, d):
    """Addresses found in a stream of documents that writes JSON lines, up to what is there."""
    source = table(spark, d, "documents").select("doc_id", "text")
    path, out, checkpoint = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    source.write.parquet(path)
    docs = streams.read_stream(spark, path, source.schema)
    found = spans.exploded(spans.with_spans(docs, [lambda t: spans.scan(t, rules.of_type(rules.PARITY, "EMAIL"))])).select("doc_id", "phi_type", "text")
    streams.run_available(found, out, checkpoint)
    streams.run_available(found, out, checkpoint)  # nothing is new: nothing is written twice
    return spark.read.schema("doc_id long, phi_type string, text string").json(out)


@query("SELECT DISTINCT event_type AS name FROM events")
def stream_discovery(spark, d):
    """Types that are not known, told batch by batch."""
    source = table(spark, d, "events").select(F.col("event_type").alias("phi_type"))
    path, out, checkpoint = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    source.write.parquet(path)
    told = streams.on_discovery(Y.type_table(spark), lambda names: names.write.mode("append").parquet(out))
    streams.write_batches(streams.read_stream(spark, path, source.schema), told, checkpoint).awaitTermination()
    return spark.read.schema("name string").parquet(out).distinct()


@query("SELECT doc_id, n AS total, n - n // 2 AS done, round(100.0 * (n - n // 2) / n, 6) AS percent, n - n // 2 >= n AS complete FROM (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(range(0, length(text), 500)) FROM documents) GROUP BY doc_id)")
def stream_progress(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.slices(F.col("text"), 500)).alias("chunk_id", "content"))
    return streams.progress(chunks.filter("chunk_id % 2 = 0"), chunks)


@query("SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 'invalid_chunk' END AS error FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, length(text), NULL FROM documents WHERE doc_id % 3 <> 0")
def chunk_errors(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    out = streams.with_errors(rows, F.char_length("text"), "size", F.col("doc_id") % 3 != 0)
    return out.select("doc_id", F.coalesce("size", F.char_length("text")).cast("long").alias("n"), "error")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 0")
def changed_files(spark, d):
    """Files that are new or changed since a manifest was taken."""
    key = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(key.cast("string").alias("path"), F.octet_length("n_name").alias("length"), F.lit("2024").alias("modified"), F.encode("n_name", "UTF-8").alias("bytes"))
    now = rows.withColumn("modified", F.when(F.col("path").cast("int") % 4 == 0, "2025").otherwise("2024"))
    return streams.to_process(streams.fingerprints(now), streams.fingerprints(rows)).select(F.col("path").cast("int").alias("n_nationkey"))
