import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.operators import identifiers, rules, spans

TEXTS = [
    "ID A123456789 mail a.b@x-y.org see https://a.b/c?d=1 and www.z.tw",
    "IP 10.0.0.1, 2001:0db8:85a3:0000:0000:8a2e:0370:7334 on 2024-03-05 or 5/3/2024",
    "民國112年3月5日 台北市大安區 106 台北市 March 5, 2024 march 6 2024",
    "MRN H12345678 account 123-45-678901-2 1234567890123",
    "傳真: 02-1234-5678 Fax 03 345 6789",
    "身分證A123456789 é A223456781",
    "",
    None,
]


def python_spans(text):
    out = []
    for r in rules.PARITY:
        flags = re.IGNORECASE if "(?Ui)" in r.pattern else 0
        pattern = re.sub(r"^\(\?Ui?\)", "", r.pattern).replace(r"\x{4e00}-\x{9fff}", "一-鿿")
        for m in re.finditer(pattern, text or "", flags):
            out.append((r.rule_id, m.group(r.group), m.start(r.group), m.end(r.group)))
    return sorted(out)


def test_scan_gives_what_python_finds(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = spans.exploded(df.withColumn("spans", spans.scan(F.col("text")))).collect()
    for i, text in enumerate(TEXTS):
        got = sorted((r.rule_id, r.text, r.start_pos, r.end_pos) for r in rows if r.doc_id == i)
        assert got == python_spans(text)
        assert all(text[a:b] == t for _, t, a, b in got)


def test_scan_has_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = spans.with_spans(df, [spans.scan])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_are_checked_and_packs_stay_as_they_are():
    with pytest.raises(ValueError):
        rules.Rule("x", "ID", "a(b)c", 0.5, group=1)
    with pytest.raises(ValueError):
        rules.Rule("x", "ID", "a", 1.5)
    before = rules.PARITY
    assert len(rules.merged(rules.PARITY, [rules.Rule("x", "ID", "a", 0.5)])) == len(before) + 1
    assert rules.PARITY is before


def fold_merge(rows):
    out = []
    for s in sorted(rows, key=lambda s: (s[0], -s[2], s[3])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[2] > out[-1][2] or (s[2] == out[-1][2] and s[1] - s[0] > out[-1][1] - out[-1][0]):
            out[-1] = s
    return [(a, b) for a, b, _, _ in out]


def fold_dedup(rows):
    kept = []
    for a, b, c, n in sorted(rows, key=lambda s: (s[0], s[3])):
        def same(k):
            o = min(k[1], b) - max(k[0], a)
            least = min(k[1] - k[0], b - a)
            return o > 0 and (k[2] == c or (least > 0 and o / least > 0.8))

        if not any(map(same, kept)):
            kept.append((a, b, c))
    return [(a, b) for a, b, _ in kept]


span_lists = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 8), st.sampled_from([0.25, 0.5, 0.75])), max_size=8)


@settings(max_examples=5, deadline=None)
@given(st.lists(span_lists, min_size=15, max_size=15))
def test_resolution_is_the_stated_fold(spark, docs):
    docs = [[(a, a + n, c, i) for i, (a, n, c) in enumerate(d)] for d in docs]
    flat = [(k, a, b, c, i) for k, d in enumerate(docs) for a, b, c, i in d]
    df = spark.createDataFrame([*flat, (99, 0, 1, 0.5, 0)], "k int, a int, b int, c double, i int")
    s = spans.span(F.lit("ID"), F.col("c").cast("string"), F.col("a"), F.col("b"), F.col("c"), F.lit("t"), F.lit("r"), F.col("i"))
    rows = df.groupBy("k").agg(F.collect_list(s).alias("s")).select("k", spans.merge_overlaps(F.col("s")).alias("m"), spans.drop_near_duplicates(F.col("s")).alias("d")).collect()
    for r in rows:
        if r.k != 99:
            assert [(x.start_pos, x.end_pos) for x in r.m] == fold_merge(docs[r.k])
            assert [(x.start_pos, x.end_pos) for x in r.d] == fold_dedup(docs[r.k])


def test_identifier_checksum(spark):
    ids = ["A123456789", "A123456788", "f131104093", "AB12345678", "A12345678", "", None, "Z999999999"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [(r.v.valid, r.v.id_type) for r in df.select(identifiers.validate_id(F.col("id")).alias("v")).collect()]

    def expected(v):
        v = (v or "").strip().upper()
        if re.fullmatch("[A-Z][12][0-9]{8}", v):
            n = identifiers.LETTER_CODES[v[0]]
            digits = [n // 10, n % 10, *map(int, v[1:])]
            return sum(x * w for x, w in zip(digits, identifiers.WEIGHTS, strict=True)) % 10 == 0, "TW_NATIONAL_ID"
        return (True, "TW_ARC") if re.fullmatch("[A-Z]{2}[0-9]{8}", v) else (False, "UNKNOWN")

    assert got == [expected(v) for v in ids]
    assert got[0] == (True, "TW_NATIONAL_ID")


def test_phones_claim_text_in_order_and_take_their_context(spark):
    texts = ["手機 0912-345-678", "fax: (02) 2345-6789", "+886-912-345-678", "on 2024-03-05 1234", "2345-6789", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = spans.exploded(df.withColumn("spans", identifiers.phone_spans(F.col("text")))).collect()
    got = {(r.doc_id, r.text, r.phi_type, r.confidence) for r in rows}
    assert (0, "0912-345-678", "PHONE", 0.99) in got
    assert (1, "(02) 2345-6789", "FAX", 0.99) in got
    assert (2, "+886-912-345-678", "PHONE", 0.98) in got
    assert (4, "2345-6789", "PHONE", 0.7) in got
    assert not [g for g in got if g[0] in (3, 5)]


def test_alignment(spark):
    df = spark.createDataFrame([("bc", 1, "abc", 4, "abcXabc"), ("zz", 0, "abc", 0, "abcabc"), ("bc", 0, "abc", 0, "abcabc")], "v string, p int, c string, s int, t string")
    got = [r.a for r in df.select(spans.aligned(F.col("v"), F.col("p"), F.col("c"), F.col("s"), F.col("t")).alias("a")).collect()]
    assert got == [5, None, 1]
