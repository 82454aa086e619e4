"""Evaluation by containment over texts of different lengths that are parts of each other, with SQL that walks the same choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import evaluation, masking
from maskwright.queries import _ACCURACY, _RATIOS, query, table

#: what gold and predicted texts are cut from: letters repeat, so that parts, equal texts and ties are frequent
_LETTERS = "abcabdabcd"


def parts(spark, d):
    """(gold, predicted) of each customer's orders: sample_id, seq, phi_type, text."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("seq"))
    cut = lambda at, n: F.substr(F.lit(_LETTERS), at.cast("int"), n.cast("int"))
    kind = lambda k: F.when(k % 3 == 0, "NAME").otherwise("DATE").alias("phi_type")
    k = F.col("seq")
    gold = rows.select("sample_id", "seq", kind(k), cut(1 + k % 5, 1 + k % 3).alias("text"))
    predicted = rows.filter(k % 4 != 0).select("sample_id", "seq", kind(F.floor(k / 2)), cut(1 + F.floor(k / 7) % 6, 1 + F.floor(k / 3) % 4).alias("text"))
    return gold, predicted


_G = f"SELECT o_custkey AS sample_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'NAME' ELSE 'DATE' END AS k, substr('{_LETTERS}', CAST(1 + o_orderkey % 5 AS INT), CAST(1 + o_orderkey % 3 AS INT)) AS t FROM orders"
_P = f"SELECT o_custkey AS sample_id, o_orderkey AS seq, CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 'NAME' ELSE 'DATE' END AS k, substr('{_LETTERS}', CAST(1 + (o_orderkey // 7) % 6 AS INT), CAST(1 + (o_orderkey // 3) % 4 AS INT)) AS t FROM orders WHERE o_orderkey % 4 <> 0"


def _both(gold: str, predicted: str) -> str:
    """CTE b: the lists g and p of each sample."""
    return f"""g AS (SELECT sample_id, {gold} AS g FROM ({_G}) GROUP BY sample_id), p AS (SELECT sample_id, {predicted} AS p FROM ({_P}) GROUP BY sample_id),
b AS (SELECT sample_id, coalesce(g, []) AS g, coalesce(p, []) AS p FROM g FULL JOIN p USING (sample_id))"""


_NEAR = "(contains({0}, {1}) OR contains({1}, {0}))"
#: predictions in turn take the first gold text that is free and near
_WALK = f"""r AS (
  SELECT sample_id, g, p, 0 AS i, CAST([] AS BIGINT[]) AS used FROM b
  UNION ALL SELECT sample_id, g, p, i + 1, CASE WHEN place IS NULL THEN used ELSE list_append(used, place) END FROM (
    SELECT *, list_min(list_filter(range(1, len(g) + 1), lambda j: NOT list_contains(used, j) AND {_NEAR.format('g[j]', 'p[i + 1]')})) AS place FROM r WHERE i < len(p))
), s AS (SELECT sample_id, CAST(len(used) AS BIGINT) AS tp, CAST(len(p) - len(used) AS BIGINT) AS fp, CAST(len(g) - len(used) AS BIGINT) AS fn FROM r WHERE i = len(p))"""
_IN_ORDER, _DISTINCT = "list(t ORDER BY seq)", "list_sort(list(DISTINCT t))"


@query(f"WITH RECURSIVE {_both(_IN_ORDER, _IN_ORDER)}, {_WALK} SELECT sample_id, tp, fp, fn, {_RATIOS} FROM s")
def eval_partial_parts(spark, d):
    return evaluation.partial(*parts(spark, d), per_sample=True)


@query(f"WITH RECURSIVE {_both(_DISTINCT, _DISTINCT)}, {_WALK} SELECT sample_id, tp, fp, fn, {_RATIOS} FROM s")
def eval_fuzzy_parts(spark, d):
    return evaluation.fuzzy_sets(*parts(spark, d))


@query(_ACCURACY.format(f"""
WITH {_both('list({k: k, t: t} ORDER BY seq)', 'list({k: k, t: t} ORDER BY seq)')},
f AS (SELECT sample_id, g, p, list_filter(list_transform(p, lambda x: list_min(list_filter(range(1, len(g) + 1), lambda j: g[j].k = x.k AND {_NEAR.format('g[j].t', 'x.t')}))), lambda a: a IS NOT NULL) AS hit FROM b),
s AS (SELECT CAST(sum(len(hit)) AS BIGINT) AS tp, CAST(sum(len(p) - len(hit)) AS BIGINT) AS fp, CAST(sum(len(g) - len(list_distinct(hit))) AS BIGINT) AS fn FROM f) SELECT *, {_RATIOS} FROM s"""))
def eval_same_type_parts(spark, d):
    return evaluation.same_type_partial(*parts(spark, d))


@query(f"""
WITH {_both('list(t)', 'list(t)')}
SELECT sample_id, CAST(len(list_filter(g, lambda x: len(list_filter(p, lambda y: {_NEAR.format('x', 'y')})) > 0)) AS BIGINT) AS correct, CAST(len(p) AS BIGINT) AS extracted, CAST(len(g) AS BIGINT) AS expected FROM b""")
def eval_recalled_parts(spark, d):
    return evaluation.recalled(*parts(spark, d))


_NEAR_P, _NEAR_G = (f"list_filter({a}, lambda x: len(list_filter({b}, lambda y: {_NEAR.format('x', 'y')})) > 0)" for a, b in (("p", "g"), ("g", "p")))


@query(f"""
WITH {_both(_DISTINCT, _DISTINCT)}, n AS (SELECT *, {_NEAR_P} AS np, {_NEAR_G} AS ng FROM b)
SELECT sample_id, CASE WHEN len(p) = 0 THEN 1.0 ELSE len(np) / len(p) END AS precision, CASE WHEN len(g) = 0 THEN 1.0 ELSE len(ng) / len(g) END AS recall,
  array_to_string(np, ',') AS matched, array_to_string(list_filter(p, lambda x: NOT list_contains(np, x)), ',') AS over_detected, array_to_string(list_filter(g, lambda x: NOT list_contains(ng, x)), ',') AS missed FROM n""")
def eval_containment_parts(spark, d):
    out = evaluation.containment(*parts(spark, d))
    return out.withColumns({c: F.array_join(c, ",") for c in ("matched", "over_detected", "missed")})


# ---------------------------------------------------------------- offsets by seed


_CHUNKS = ", ".join(f"('0x' || substr(sha256(c_name), {i + 1}, 8))::BIGINT" for i in range(0, 64, 8))


@query(f"SELECT c_custkey, CAST(list_reduce([0::BIGINT, {_CHUNKS}], lambda a, x: (a * 4294967296 + x) % 731) - 365 AS INTEGER) AS days, CAST(list_reduce([0::BIGINT, {_CHUNKS}], lambda a, x: (a * 4294967296 + x) % 61) - 30 AS INTEGER) AS near_days FROM customer")
def offset_values(spark, d):
    """Day offsets by the hash of a seed, in two ranges."""
    return table(spark, d, "customer").select("c_custkey", masking.seeded_offset(F.col("c_name")).alias("days"), masking.seeded_offset(F.col("c_name"), -30, 30).alias("near_days"))



@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 AS k FROM orders),
m AS (SELECT *, CASE WHEN k IN (5, 6) AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END AS read FROM d)
SELECT o_orderkey, CASE WHEN k = 7 THEN '[DATE]' ELSE strftime(read + INTERVAL 400 DAY, '%Y-%m-%d') END AS masked FROM m""")
def mask_shift_all(spark, d):
    """All seven forms of dates, and what is none; where day and month could be either, the day comes first."""
    date, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = F.lit("soon")
    for i, form in enumerate(masking.DATE_FORMATS):
        text = F.when(k == i, F.date_format(date, form)).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", masking.date_shifting(400)(text, F.lit("DATE")).alias("masked"))
