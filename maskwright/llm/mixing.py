"""Mixing sources to target weights over a tree of domains, languages and sources.  DataFrame functions only.

Budgets go from the root down.  Siblings share their parent's budget by weight, a node never gets more than it can supply
(its tokens times ``max_epochs``), and what a short node cannot take goes to its siblings by their weights; only what no
sibling can take goes up, which the top-down order brings about because a node's supply is all that its leaves have.
In closed form: with siblings sorted by supply / weight, a node is full while that ratio is at most
(budget - supplies before it) / (weights from it on), and the largest of these levels is the rate of the others.

A leaf's budget is a prefix, by tokens, of its documents in seeded order, epoch after epoch: whole epochs first, then
the documents of the next epoch's order whose running token sum fits the rest.  The order of an epoch is md5 of seed, epoch
and doc_id.  The cut in the order is found by narrowing it digit by digit (two hexadecimal digits a level, summed before the shuffle), so no
task holds a leaf, however large.

Defined results: null texts and blank texts have 0 tokens; null languages or sources are a leaf of their own, '' ; rows of one
doc_id in a leaf are taken or left together; weights of 0 take nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, without

LEAF = ("domain", "lang", "source")
BROADCAST_LEAVES = 50_000


def token_count(col: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null has 0."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_domain(source: Column) -> Column:
    """Domain of a source: its trailing number modulo 4; sources without one are 'other'."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.try_to_number(digits, F.lit("999999999")).cast("long") % 4).cast("string")))


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    """The name's weight, 1 where none is given."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, name), F.lit(1.0))


def _shared(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent columns, name, supply, weight, budget of the parent) with their own share as ``share``."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(F.col("supply") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0.0))
    rest = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rated = nodes.withColumn("level", F.greatest(left, F.lit(0.0)) / rest)
    return rated.withColumn("share", F.least(F.col("supply"), F.col("weight") * F.max("level").over(group))).drop("level", "budget")


def budgets(leaves: DataFrame, target: Column, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``: tokens to take, a long.

    ``target`` is an aggregate over the leaves' tokens (such as half of their sum).
    """
    supply = (F.col("tokens") * max_epochs).cast("double")
    base = leaves.withColumn("supply", supply).filter("tokens > 0")
    for name in LEAF:
        base = base.withColumn(f"w_{name}", _weight(F.col(name), weights.get(name, {})))
    base = base.filter(" and ".join(f"w_{n} > 0" for n in LEAF))
    root = leaves.agg(target.cast("double").alias("budget"))
    level = base.groupBy("domain", F.col("w_domain").alias("weight")).agg(F.sum("supply").alias("supply")).crossJoin(F.broadcast(root))  # one row
    level = _shared(level, [], "domain").select("domain", F.col("share").alias("budget"))
    nodes = base.groupBy("domain", "lang", F.col("w_lang").alias("weight")).agg(F.sum("supply").alias("supply")).join(level, "domain")
    level = _shared(nodes, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    nodes = base.withColumnRenamed("w_source", "weight").join(level, ["domain", "lang"])
    out = _shared(nodes, ["domain", "lang"], "source")
    return out.select(*LEAF, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame, target_share: float = 0.5, target_tokens: int | None = None, max_epochs: int = 4, seed: int = 17, weights: Mapping[str, Mapping[str, float]] | None = None,
    domain: Column | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The chosen rows: all columns of ``docs``, and domain, tokens and epoch (0 for the first copy of a document).

    The target is ``target_tokens``, or ``target_share`` of all tokens.  ``weights`` has a mapping for each of domain, lang and source.
    Input columns named domain, tokens or epoch give way to the added ones.
    """
    domain = default_domain(F.col(source)) if domain is None else domain
    kept = without(docs.withColumn("__domain", domain), "domain", "tokens", "epoch").withColumnRenamed("__domain", "domain")
    columns = [c for c in kept.columns if c != "domain"]
    name = {c: F.coalesce(F.col(x).cast("string"), F.lit("")) for c, x in zip(LEAF, ("domain", lang, source), strict=True)}
    counted = kept.withColumn("__tokens", token_count(F.col(text)))
    slim = materialize(counted.select(F.col(doc_id).alias("id"), *[name[c].alias(c) for c in LEAF], F.col("__tokens").alias("tokens")), "tokens")
    totals = slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = materialize(totals, "leaves")
    target = F.lit(target_tokens) if target_tokens is not None else F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(target_share))
    own = budgets(totals.select(*LEAF, "tokens"), target, max_epochs, weights or {})
    whole = F.floor(F.col("budget") / F.col("tokens")).cast("long")
    plan = own.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = materialize(plan.withColumn("prefix", F.lit("")), "plan")
    size = totals.agg(F.max("rows"), F.count("*")).first()
    few = (size[1] or 0) <= BROADCAST_LEAVES

    def near(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table) if few else table, list(LEAF))

    keyed = near(slim, plan.select(*LEAF, "whole")).select(*LEAF, "tokens", _order_key(seed, F.col("whole"), F.col("id")).alias("key"))
    keyed = materialize(keyed, "keys")
    # narrow the cut: each level sums the tokens of the next two digits and goes on in the one where the rest runs out
    levels = max(1, math.ceil(math.log(max(size[0] or 1, 1) / 64, 256))) if (size[0] or 0) > 64 else 1
    for k in range(levels):
        inside = near(keyed, plan.select(*LEAF, "prefix")).filter(F.substring("key", 1, 2 * k) == F.col("prefix")) if k else keyed
        sums = inside.groupBy(*LEAF, F.substring("key", 1, 2 * k + 2).alias("digits")).agg(F.sum("tokens").alias("n"))
        running = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("digits"))
        cut = sums.withColumn("upto", running).join(plan.select(*LEAF, "rest"), list(LEAF)).filter(F.col("upto") > F.col("rest"))
        cut = cut.groupBy(*LEAF).agg(F.min(F.struct("digits", (F.col("upto") - F.col("n")).alias("used"))).alias("cut"))
        plan = plan.join(cut, list(LEAF), "left").select(
            *LEAF, "tokens", "budget", "whole", (F.col("rest") - F.coalesce("cut.used", F.lit(0))).alias("rest"), F.coalesce("cut.digits", F.lit("g")).alias("prefix")
        )  # 'g' is above every digit: nothing runs out
        plan = materialize(plan, "plan")
    last = near(keyed, plan.select(*LEAF, "prefix", "rest")).filter(F.substring("key", 1, 2 * levels) == F.col("prefix"))
    last = last.groupBy(*LEAF, "key", "rest").agg(F.sum("tokens").alias("n"))
    last = last.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("key"))).filter("upto <= rest")
    last = last.groupBy(*LEAF).agg(F.max("key").alias("last"))
    plan = materialize(plan.join(last, list(LEAF), "left").select(*LEAF, "whole", "prefix", F.coalesce("last", "prefix").alias("last")), "plan")
    leafed = counted.select("*", *[name[c].alias(f"__{c}") for c in LEAF])
    out = leafed.join(F.broadcast(_named(plan)) if few else _named(plan), [f"__{c}" for c in LEAF])
    more = _order_key(seed, F.col("__whole"), F.col(doc_id)) <= F.col("__last")
    copies = F.col("__whole") + F.when(more & (F.col("__whole") < max_epochs), 1).otherwise(0)
    out = out.withColumn("__copies", copies).filter("__copies > 0")
    return out.select(*columns, "domain", F.col("__tokens").alias("tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("epoch"))


def _named(plan: DataFrame) -> DataFrame:
    return plan.select(*[F.col(c).alias(f"__{c}") for c in LEAF], F.col("whole").alias("__whole"), F.col("last").alias("__last"))
