"""Tagged texts, entity matching, and precision, recall and F1 as sums."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import normalised
from maskwright.functions.types import normal_form

TAG = r"【PHI:(\w+):?(\w*)】([^【]+?)【/PHI】"
TAG_WITH_ID = r"【PHI:(\w+):([\w-]+)】([^【]+)【/PHI】"


def tags(text: Column) -> Column:
    """array<struct<phi_type, phi_id, content>> of inline tags, contents stripped; the id is null where there is none."""
    groups = [F.regexp_extract_all(text, F.lit(TAG), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "tic", strict=True)]), lambda x: F.struct(x["t"].alias("phi_type"), F.nullif(x["i"], F.lit("")).alias("phi_id"), stripped(x["c"]).alias("content")))


def tags_with_id(text: Column) -> Column:
    """array<struct<phi_type, phi_id, content>> of the tags that carry an id, which may hold hyphens."""
    groups = [F.regexp_extract_all(text, F.lit(TAG_WITH_ID), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "tic", strict=True)]), lambda x: F.struct(x["t"].alias("phi_type"), x["i"].alias("phi_id"), stripped(x["c"]).alias("content")))


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "$3")


def without_tags_with_id(text: Column) -> Column:
    """The other way to strip: opening tags that carry an id and closing tags go one by one, ends are stripped."""
    return stripped(F.regexp_replace(text, r"【PHI:\w+:[\w-]+】|【/PHI】", ""))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def compared(text: Column) -> Column:
    """The form in which texts are compared: stripped, lower-cased."""
    return F.lower(stripped(text))


def with_tags(text: Column, entities: Column) -> Column:
    """Entities (phi_type, text) tagged at their first occurrence, the longest first."""

    def longest(a: Column, b: Column) -> Column:
        n, m = F.char_length(a["text"]), F.char_length(b["text"])
        return F.when(n != m, m - n).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)

    def put(t: Column, e: Column) -> Column:
        at = F.call_function("locate", e["text"], t)
        tagged = F.concat(F.lit("【PHI:"), e["phi_type"], F.lit("】"), e["text"], F.lit("【/PHI】"))
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), tagged, F.substring(t, at + F.char_length(e["text"]), F.char_length(t)))).otherwise(t)

    return F.aggregate(F.array_sort(entities, longest), text, put)


def ratios(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; 0 where there is nothing to divide by."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f1, digits)})


def _counts(gold: DataFrame, predicted: DataFrame, keys: list[str], out: list[str], count=F.sum) -> DataFrame:
    """tp, fp, fn of multisets: per key the smaller count matches.  Both sides are counted at once, without a join."""
    side = lambda x, g, p: x.select(*keys, F.lit(g).cast("long").alias("g"), F.lit(p).cast("long").alias("p"), F.when(null, g).alias("__own"))
    null = reduce(or_, [F.col(k).isNull() for k in keys])  # such a key matches nothing
    both = side(gold, 1, 0).unionByName(side(predicted, 0, 1)).groupBy(*keys, "__own").agg(count("g").alias("g"), count("p").alias("p"))
    tp = F.least("g", "p")
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((tp, "tp"), (F.col("p") - tp, "fp"), (F.col("g") - tp, "fn"))]
    return both.groupBy(*out).agg(*sums) if out else both.agg(*sums)


def _sides(gold: DataFrame, predicted: DataFrame, g: Column, p: Column, g_agg, p_agg) -> DataFrame:
    """sample_id, g, p: what is gathered of both sides of a sample (arrays, empty without rows), in one aggregation, without a join."""
    side = lambda x, g, p, own: x.select("sample_id", g.alias("g"), p.alias("p"), F.when(F.col("sample_id").isNull(), own).alias("__own"))
    null = F.lit(None)  # gathered by neither; a sample without a name matches nothing
    both = side(gold, g, null, 1).unionByName(side(predicted, null, p, 0))
    return both.groupBy("sample_id", "__own").agg(g_agg(F.col("g")).alias("g"), p_agg(F.col("p")).alias("p")).drop("__own")


def exact(gold: DataFrame, predicted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Matches of equal text (stripped, lower-cased) and normalised type within a sample.  Inputs: sample_id, text, phi_type.  ``by``: sample_id and / or phi_type."""
    g, p = (x.select("sample_id", compared(F.col("text")).alias("text"), normal_form(F.col("phi_type")).alias("phi_type")) for x in (gold, predicted))
    return ratios(_counts(g, p, ["sample_id", "text", "phi_type"], list(by)))


def type_only(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts per type, whatever the texts, and the share of matches in all."""
    return with_accuracy(ratios(_counts(gold, predicted, ["phi_type"], [])))


def with_accuracy(rows: DataFrame, digits: int = 6) -> DataFrame:
    """tp / (tp + fp + fn), 0 where there is nothing."""
    return rows.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), digits))


def type_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per type, the simplified metrics: the smaller number of entities matches, the rest is too much or missing."""
    return ratios(_counts(gold, predicted, ["phi_type"], ["phi_type"]))


def same_type_partial(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sample: each prediction with a gold entity of its type that contains it or is contained counts once; gold entities may serve several.

    Inputs: sample_id, seq, phi_type, text.  fn are the gold entities that are the first fit of no prediction."""
    entity = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("seq", "phi_type", "text"))), lambda s: F.struct(s["phi_type"].alias("k"), compared(s["text"]).alias("t")))
    g, p = (x.groupBy("sample_id").agg(entity(x).alias(n)) for x, n in ((gold, "g"), (predicted, "p")))
    both = g.join(p, "sample_id", "full_outer")
    none = F.array().cast("array<struct<k:string,t:string>>")
    both = both.withColumns({"g": F.coalesce("g", none), "p": F.coalesce("p", none)})
    fits = lambda a, b: (a["k"] == b["k"]) & (F.contains(a["t"], b["t"]) | F.contains(b["t"], a["t"]))
    first = F.transform("p", lambda x: F.array_position(F.transform("g", lambda y: fits(x, y)), F.lit(True)))
    hit = F.filter(first, lambda i: i > 0)
    rows = both.select("sample_id", F.size(hit).cast("long").alias("tp"), (F.size("p") - F.size(hit)).cast("long").alias("fp"), (F.size("g") - F.size(F.array_distinct(hit))).cast("long").alias("fn"))
    return with_accuracy(ratios(rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])))


def fuzzy_sets(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sample: distinct texts (stripped, lower-cased, not empty) matched greedily by containment, in the order of the texts.  Inputs: sample_id, text."""
    texts = lambda x, n: x.select("sample_id", compared(F.col("text")).alias("t")).filter("t <> ''").groupBy("sample_id").agg(F.array_sort(F.collect_set("t")).alias(n))
    both = texts(gold, "g").join(texts(predicted, "p"), "sample_id", "full_outer")
    none = F.array().cast("array<string>")
    rows = both.withColumns({"g": F.coalesce("g", none), "p": F.coalesce("p", none)}).withColumn("tp", greedy_hits(F.col("g"), F.col("p")).cast("long"))
    return ratios(rows.select("sample_id", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("g") - F.col("tp")).alias("fn")))


def recalled(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sample: gold entities some predicted text contains or is contained in (case-folded), and the numbers of both.  Inputs: sample_id, text."""
    g = gold.groupBy("sample_id").agg(F.collect_list(F.lower("text")).alias("g"))
    p = predicted.groupBy("sample_id").agg(F.collect_set(F.when(F.col("text") != "", F.lower("text"))).alias("u"), F.count("*").alias("extracted"))
    both = g.join(p, "sample_id", "full_outer")
    none = F.array().cast("array<string>")
    both = both.withColumns({"g": F.coalesce("g", none), "u": F.coalesce("u", none)})
    hit = F.filter("g", lambda x: F.exists("u", lambda y: F.contains(x, y) | F.contains(y, x)))
    return both.select("sample_id", F.size(hit).cast("long").alias("correct"), F.coalesce("extracted", F.lit(0)).cast("long").alias("extracted"), F.size("g").cast("long").alias("expected"))


def samples_of(tagged: DataFrame, text: str = "text") -> DataFrame:
    """Training or evaluation samples of tagged texts: all columns, ``bare`` (the text without tags) and ``gold`` (its tags)."""
    return tagged.withColumns({"bare": without_tags_with_id(F.col(text)), "gold": tags_with_id(F.col(text))})


def evaluate_detector(docs: DataFrame, gold: DataFrame, detector, key: str = "sample_id", text: str = "text") -> DataFrame:
    """Exact matches of a detector (text column to span array) against gold entities (key, text, phi_type)."""
    found = docs.select(F.col(key).alias("sample_id"), F.explode(detector(F.col(text))).alias("s")).select("sample_id", "s.text", "s.phi_type")
    return exact(gold.withColumnRenamed(key, "sample_id"), found)


def set_metrics(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("phi_type", "text"), fold_case: bool = False) -> DataFrame:
    """Distinct keys on both sides."""
    lower = lambda x: x.withColumn("text", F.lower("text")) if fold_case else x
    return ratios(_counts(lower(gold), lower(predicted), list(keys), [], F.max))


def greedy_hits(gold: Column, predicted: Column) -> Column:
    """Number of predictions, in order, that find an unused gold text they contain or are contained in (the first such)."""

    def step(free: Column, p: Column) -> Column:
        at = F.array_position(F.transform(free, lambda g: F.contains(g, p) | F.contains(p, g)), F.lit(True))
        without = lambda i: F.when(i > 0, F.concat(F.slice(free, F.lit(1), i - 1), F.slice(free, i + 1, F.size(free)))).otherwise(free)
        return F.transform(F.array(at.cast("int")), without)[0]  # so that the place is found once

    return F.aggregate(predicted, gold, step, lambda free: F.size(gold) - F.size(free))


def partial(gold: DataFrame, predicted: DataFrame, per_sample: bool = False) -> DataFrame:
    """Greedy containment matches per sample; types are not looked at.  Inputs: sample_id, seq, text.  A sample's entities form a row."""
    text = lambda e: F.sort_array(F.collect_list(e))["compared"]
    entity = F.struct("seq", "text", compared(F.col("text")).alias("compared"))
    both = _sides(gold, predicted, entity, entity, text, text)
    rows = both.withColumn("tp", greedy_hits(F.col("g"), F.col("p")).cast("long"))
    rows = rows.select("sample_id", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("g") - F.col("tp")).alias("fn"))
    return ratios(rows if per_sample else rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def containment(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sample: share of distinct predictions that contain or are contained in a gold text, and the reverse; 1 on an empty side.

    Inputs: sample_id, text.  The comparison is within a sample.
    """
    g, p = (x.select("sample_id", normalised(F.col("text")).alias("text")).groupBy("sample_id").agg(F.collect_set("text").alias(n)) for x, n in ((gold, "g"), (predicted, "p")))
    both = g.join(p, "sample_id", "full_outer")
    near = lambda a, b: F.filter(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    share = lambda a, b: F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, 1.0).otherwise(F.coalesce(F.size(near(a, b)), F.lit(0)) / F.size(a))
    none = F.array().cast("array<string>")
    both = both.withColumns({"g": F.coalesce("g", none), "p": F.coalesce("p", none)})
    detail = {"matched": near(F.col("p"), F.col("g")), "over_detected": F.array_except("p", near(F.col("p"), F.col("g"))), "missed": F.array_except("g", near(F.col("g"), F.col("p")))}
    return both.select("sample_id", share(F.col("p"), F.col("g")).alias("precision"), share(F.col("g"), F.col("p")).alias("recall"), *[F.array_sort(v).alias(k) for k, v in detail.items()])


def tiered(gold: Column, found: Column) -> Column:
    """Per gold entity (phi_type, text), how it was found: exact, content (other type), part (two characters at least in common as a whole), missed."""
    return F.transform(
        gold,
        lambda g: F.when(F.exists(found, lambda f: (f["phi_type"] == g["phi_type"]) & (f["text"] == g["text"])), "exact")
        .when(F.exists(found, lambda f: f["text"] == g["text"]), "content")
        .when(F.exists(found, lambda f: (F.char_length(f["text"]) >= 2) & (F.contains(g["text"], f["text"]) | F.contains(f["text"], g["text"]))), "part")
        .otherwise("missed"),
    )


def bio_entities(tokens: DataFrame, by: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ("PER", "LOC")) -> DataFrame:
    """Entities of B- / I- / O tagged tokens (pos, token, tag) as islands: a B- opens one, any I- after it goes on with it, whatever its type, an O ends it;
    an I- with nothing to go on with is left out."""
    w = Window.partitionBy(*by).orderBy("pos")
    island = F.sum((F.col("tag").startswith("B-") | (F.col("tag") == "O")).cast("int")).over(w)
    rows = tokens.withColumn("island", island).filter(F.col("tag") != "O")
    each = rows.groupBy(*by, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag"))).alias("r"))
    first = F.regexp_extract(F.col("r")[0]["tag"], "^B-(.+)$", 1)
    each = each.select(*by, first.alias("phi_type"), F.array_join(F.transform("r", lambda x: x["token"]), " ").alias("text"), F.col("r")[0]["pos"].alias("pos"))
    return each.filter(F.col("phi_type").isin(*keep))


def success_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.avg(F.col("error").isNull().cast("double")).alias("success_rate"))


def compare_models(results: DataFrame) -> DataFrame:
    """Per model: sums, ratios and mean seconds, best F1 first.  Inputs: model, tp, fp, fn, seconds."""
    sums = results.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.round(F.avg("seconds"), 6).alias("mean_seconds"))
    return ratios(sums).orderBy(F.desc("f1"), "model")


def parse_entities(response: Column) -> Column:
    """Entities of a model's answer: an object with a list, a list, else all flat objects with text and type.  array<struct<text, phi_type>>."""
    bare = F.regexp_replace(response, r"(?s)^\s*```(?:json)?|```\s*$", "")
    kind = "array<struct<text:string,phi_type:string>>"
    listed = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), f"struct<entities:{kind},phi_entities:{kind}>")
    array = F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), kind)
    texts = F.regexp_extract_all(bare, F.lit(r'"text"\s*:\s*"([^"]*)"'), F.lit(1))
    kinds = F.regexp_extract_all(bare, F.lit(r'"(?:phi_)?type"\s*:\s*"([^"]*)"'), F.lit(1))
    pairs = F.transform(F.arrays_zip(texts.alias("a"), kinds.alias("b")), lambda x: F.struct(x["a"].alias("text"), x["b"].alias("phi_type")))
    return F.coalesce(listed["entities"], listed["phi_entities"], F.when(F.size(array) > 0, array), pairs)


def in_source(entities: Column, source: Column) -> Column:
    """Only entities whose text stands in the source."""
    return F.filter(entities, lambda e: F.contains(source, e["text"]))
