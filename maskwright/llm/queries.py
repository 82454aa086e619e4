"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import chunk_dedup, collocations, decontaminate, license_scan, line_dedup, minhash_join, mixing, ngram_join, periodic_runs, robust_outliers, surrogates, tool_calls, toxicity

#: production parameters of the mix, also used by the pipeline
MIX = {
    "target_share": 0.5,
    "max_epochs": 3,
    "seed": 17,
    "weights": {"domain": {"d0": 3.0, "d1": 2.0, "d2": 1.0, "d3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
  FROM items, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM patterns),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM lowered, lengths, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m
), hits AS (
  SELECT d.doc_id, d.i, d.m, item_id FROM places d JOIN patterns USING (m, p)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(common.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (k) GROUP BY doc_id
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, threshold=(90, 100))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, **MIX).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def _share_sql(nodes: str, parent: str, name: str) -> str:
    """SQL of the budget of siblings; see the operator."""
    by = f"PARTITION BY {parent} " if parent else ""
    order = f"{by}ORDER BY supply / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""SELECT *, least(supply, weight * max(level) OVER ({by})) AS share FROM (
      SELECT *, greatest(budget - coalesce(sum(supply) OVER ({order}), 0.0), 0.0) / (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({order}), 0.0)) AS level FROM {nodes})"""


OP10_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS d
  FROM documents
), leaves AS (SELECT d, l, s, sum(tokens) AS t FROM base GROUP BY ALL),
goal AS (SELECT CAST(floor(sum(t) * {MIX['target_share']}) AS DOUBLE) AS budget FROM leaves),
parts AS (
  SELECT d, l, s, t, CAST(t * {MIX['max_epochs']} AS DOUBLE) AS supply, CAST(CASE d WHEN 'd0' THEN 3.0 WHEN 'd1' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS wd,
         CAST(CASE l WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS wl FROM leaves WHERE t > 0
), n1 AS (SELECT d, any_value(wd) AS weight, sum(supply) AS supply, any_value(budget) AS budget FROM parts, goal GROUP BY d),
s1 AS ({_share_sql('n1', '', 'd')}),
n2 AS (SELECT parts.d, l, any_value(wl) AS weight, sum(parts.supply) AS supply, any_value(share) AS budget FROM parts JOIN s1 USING (d) GROUP BY parts.d, l),
s2 AS ({_share_sql('n2', 'd', 'l')}),
n3 AS (SELECT parts.d, parts.l, s, t, CAST(1 AS DOUBLE) AS weight, parts.supply, share AS budget FROM parts JOIN s2 USING (d, l)),
s3 AS ({_share_sql('n3', 'd, l', 's')}),
plan AS (SELECT d, l, s, t, CAST(floor(share + 1e-6) AS BIGINT) AS b, CAST(floor(share + 1e-6) AS BIGINT) // CAST(t AS BIGINT) AS whole FROM s3),
keyed AS (SELECT base.*, whole, b - whole * t AS rest, md5(concat_ws('|', '{MIX['seed']}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM base JOIN plan USING (d, l, s)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY k) AS upto FROM keyed)
SELECT doc_id, d AS domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(e AS BIGINT) AS epoch
FROM run, unnest(range(whole + CASE WHEN upto <= rest AND whole < {MIX['max_epochs']} THEN 1 ELSE 0 END)) AS u(e)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_toxicity": op2_toxicity,
    "op4_decontamination": op4_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
}
SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_ngram_join": OP9_SQL, "op10_mixing": OP10_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_outliers.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *robust_outliers.STATISTICS, "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.drop_repeats(docs).select("doc_id", "n_repeated", "n_dropped", "repeated", "dropped", "text")


QUERIES |= {"op1_license_scan": op1_license_scan, "op7_quality": op7_quality, "op8_substring_dedup": op8_substring_dedup}


#: the session's setting with the key, which a deployment fills from its secret store; without it, the key of the test data
SURROGATE_KEY = "spark.maskwright.surrogate.key"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, spark.conf.get(SURROGATE_KEY, "test-data")).select("doc_id", "n_entities", F.array_join("entity_types", ",").alias("entity_types"), "text")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results as the conversations table implies them: each assistant turn calls a tool on its own whole text, the turn after it
    holds the result, and calls refer to the call before them.  Lengths decide which are left faulty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    call_id = F.concat(F.lit("c"), F.col("turn").cast("string"))
    limit = F.when(n % 11 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise((n % 50).cast("string"))
    ref = F.when(F.col("turn") >= 3, F.concat(F.lit(', "after": {"$ref": "c'), (F.col("turn") - 2).cast("string"), F.lit('"}'))).otherwise(F.lit(""))
    arguments = F.concat(F.lit('{"query": '), tool_calls.json_string(text), F.lit(', "limit": '), limit, ref, F.when(n % 97 == 0, F.lit("")).otherwise(F.lit("}")))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("rank")), (n % 3 + 1).cast("int"))
    calls = turns.filter("role = 'assistant'").select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    answer = F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"))
    results = turns.filter("role = 'user' and turn > 0").select("conv_id", "turn", answer.alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(_table(spark, sf_dir, "conversations"))
    types = "map('query','string','limit','integer','after','string')"
    schemas = spark.sql(f"select name, array('query','limit') as required, {types} as types from values ('search'), ('lookup'), ('rank') as t(name)")
    out = tool_calls.link_tool_calls(calls, results, schemas)
    return out.select("conv_id", "turn", "call_id", "name", "level", "status", F.array_join("errors", ",").alias("errors"), "json")


OP5_SQL = r"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations),
c AS (
  SELECT *, CASE WHEN n % 97 = 0 OR turn < 3 THEN NULL ELSE turn - 2 END AS ref, n % 97 = 0 AS broken,
         CASE WHEN n % 11 = 0 THEN '"' || n || '"' ELSE CAST(n % 50 AS VARCHAR) END AS lim, ['search', 'lookup', 'rank'][n % 3 + 1] AS name
  FROM turns WHERE role = 'assistant'
), linked AS (SELECT c.*, c.ref IS NOT NULL AND p.turn IS NULL AS missing, p.turn AS known FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.ref),
lev AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM linked WHERE known IS NULL
  UNION ALL SELECT l.conv_id, l.turn, v.level + 1 FROM lev v JOIN linked l ON l.conv_id = v.conv_id AND l.known = v.turn
), res AS (SELECT conv_id, turn, text FROM turns WHERE role = 'user' AND turn > 0),
made AS (
  SELECT l.conv_id, l.turn, 'c' || l.turn AS call_id, l.name, level,
    CASE WHEN missing THEN 'unknown_reference' WHEN broken THEN 'invalid_json' WHEN n % 11 = 0 THEN 'invalid_arguments' WHEN r.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status,
    CASE WHEN NOT broken AND n % 11 = 0 THEN 'type:limit' ELSE '' END AS errors,
    '{"arguments":' || CASE WHEN broken THEN CAST(to_json('{"query": ' || CAST(to_json(t) AS VARCHAR) || ', "limit": ' || lim || CASE WHEN l.turn >= 3 THEN ', "after": {"$ref": "c' || (l.turn - 2) || '"}' ELSE '' END) AS VARCHAR)
      ELSE '{' || CASE WHEN ref IS NULL THEN '' ELSE '"after":{"$ref":"c' || ref || '"},' END || '"limit":' || lim || ',"query":' || CAST(to_json(t) AS VARCHAR) || '}' END
      || ',"id":"c' || l.turn || '","name":"' || l.name || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
  FROM linked l JOIN lev USING (conv_id, turn) LEFT JOIN res r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1
)
SELECT * FROM made UNION ALL
SELECT r.conv_id, r.turn, 'c' || (r.turn - 1), NULL, NULL, 'orphan_result', '', '{"id":"c' || (r.turn - 1) || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}'
FROM res r LEFT JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE c.turn IS NULL
"""


QUERIES |= {"op3_surrogates": op3_surrogates, "op5_tool_calls": op5_tool_calls}
SQL["op5_tool_calls"] = OP5_SQL


# ---------------------------------------------------------------- the columns of operators 1 and 7 that SQL can express, through the operators


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LICENSE_BASE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(p, label)),
h AS (SELECT doc_id, i, label FROM d, p, unnest(range(1, len(w) - len(p) + 2)) AS u(i) WHERE len(w) >= len(p) AND w[i] = p[1] AND w[i:i + len(p) - 1] = p),
a AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word, coalesce(s, '') AS base_labels
FROM d LEFT JOIN a USING (doc_id)
"""
QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY doc_id),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact phrases of operator 1 alone."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of operator 7 alone, without its estimate."""
    out = robust_outliers.with_statistics(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *robust_outliers.STATISTICS, robust_outliers.base_failed().alias("base_failed"))


QUERIES |= {"license_base": license_base, "quality_base": quality_base}
SQL |= {"license_base": LICENSE_BASE_SQL, "quality_base": QUALITY_BASE_SQL}


# ---------------------------------------------------------------- operator 11


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents get a period from some word on, as their ids' checksums say."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(docs, least_words=6, least_times=4, prepare=planted_period, key="doc_id")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", periodic_runs.longest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.neg")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.neg div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _ranked_stretches(levels: int) -> str:
    """CTEs r0 to r<levels>: the number g of the stretch of 2^k words at each place, null where it would pass the text's end."""
    out = []
    for k in range(levels):
        pair = f"SELECT doc_id, i, g, lead(g, {1 << k}) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM r{k}"
        out.append(f"r{k + 1} AS (SELECT doc_id, i, CASE WHEN after IS NOT NULL THEN dense_rank() OVER (ORDER BY g, after) END AS g FROM ({pair}))")
    return ",\n".join(out)


#: Periods up to 8,192 words, so texts of up to 32,768 words.
_LEVELS = 13
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) AS h FROM d
), a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
words AS (SELECT doc_id, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS w FROM p, unnest(range(n)) AS u(i)),
r0 AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (ORDER BY w) AS g FROM words),
{_ranked_stretches(_LEVELS)},
periods AS ({' UNION '.join(f"SELECT doc_id, q FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id, g ORDER BY i) - i AS q FROM r{k} WHERE g IS NOT NULL) WHERE q <= {1 << k} AND 2 * q > {1 << k}" for k in range(_LEVELS + 1))}),
equal AS (SELECT doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY doc_id, q ORDER BY x.i) AS island FROM periods JOIN r0 x USING (doc_id) JOIN r0 y USING (doc_id) WHERE y.i = x.i + q AND x.g = y.g),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM stretches GROUP BY doc_id, s, m),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(listed.n, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
QUERIES["op11_periodic_runs"] = op11_periodic_runs
SQL["op11_periodic_runs"] = OP11_SQL


# ---------------------------------------------------------------- operator 12


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents").select("text", "lang"), longest=4, min_count=30, top=2000, covered=(80, 100))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS MATERIALIZED (SELECT lang, w[i:i + m - 1] AS g, count(*) AS f FROM words, unnest([1, 2, 3, 4]) AS a(m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY ALL),
phrases AS (SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM phrases) c JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN grams r ON r.lang = c.lang AND r.g = c.g[c.k + 1:len(c.g)]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, g[i:i + m - 1] AS g, a FROM phrases, unnest([2, 3]) AS t(m), unnest(range(1, len(g) - m + 2)) AS u(i) WHERE m < len(g)),
covered AS (SELECT DISTINCT lang, g FROM phrases s JOIN inner_parts x USING (lang, g) WHERE CAST(100 AS HUGEINT) * x.a >= 80 * s.a),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best ANTI JOIN covered USING (lang, g))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
QUERIES["op12_collocations"] = op12_collocations
SQL["op12_collocations"] = OP12_SQL


# ---------------------------------------------------------------- operator 13


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=5, threshold=(85, 100))


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
QUERIES["op13_minhash"] = op13_minhash
SQL["op13_minhash"] = OP13_SQL
