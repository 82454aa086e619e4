"""Quality rules and robust multivariate outliers.  DataFrame functions only.

Text statistics become a vector per document; per language and source, a minimum-covariance-determinant estimate (the mean and
covariance of the three quarters of documents that lie closest together) is found by concentration steps from four deterministic
starts, whose determinants are compared, until the smallest one falls no more; documents far from it by Mahalanobis distance are
rejected.  Medians and the steps' cuts come from counts per group and bin, summed before the shuffle, so a group may hold any share of
the rows and results do not depend on partitioning; a cut takes its whole bin, so slightly more than three quarters may lie within.

Each group is judged by its own estimate, drawn towards its language's estimate, and that towards the corpus's: an estimate from n documents has the weight
n^2 / (n^2 + ``prior_rows``^2).  So a group of a few documents is judged by little more than its language, a large one by itself, and no size decides between them.

A floor (``FLOOR``) is added to each variance: statistics that are zero in most documents would otherwise have none.  Distances
are scaled so that their median is the chi-squared distribution's.

Defined results: null texts count as empty; texts without words fail the base rules; null languages and sources form groups of their
own; each document that passes the base rules has a distance; repeated rows count each time; texts are taken whole; at the cut a document is kept;
empty tables give empty ones; input columns named like the added ones give way to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, without

BLANK = r"[\x20\x09-\x0D]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: the vector: log words, mean word length, log symbol share, log share of repeated words, log share of repeated lines
DIMENSIONS = 5
FLOOR = (0.05, 0.05, 0.3, 0.3, 0.3)  #: standard deviations added (in square) to the estimate
CHI2_MEDIAN = 4.351  #: of 5 degrees of freedom
CHI2_CUT = 37.33  #: 1 - 1e-6 of 5 degrees of freedom
BROADCAST_GROUPS = 20_000
BINS = 64  #: per unit of a statistic or of a distance's logarithm
TOLERANCE = 1e-3  #: by which a step must lower the logarithm of a determinant for another to follow


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the whole text's statistics: ``STATISTICS`` and n_lines (lines with a word)."""
    docs = without(docs, *STATISTICS, "n_lines")
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK + "+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = docs.withColumns({"__w": words, "__l": lines, "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")})
    n = F.size("__w")
    each = F.transform(F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))
    grams = F.when(n >= 3, each).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns({
        "__g": grams,
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
    }).drop("__w", "__l")
    # windows in the order of their hashes, where there is any repeat; equal neighbours are repeats
    some = F.size("__g") > F.size(F.array_distinct("__g"))
    out = out.withColumn("__s", F.when(some, F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__g")

    def place(e: Column, j: Column) -> Column:
        like = lambda k: F.coalesce(F.get("__s", k)["h"] == e["h"], F.lit(False))
        return F.when(like(j - 1) | like(j + 1), e["i"])

    at = F.sort_array(F.array_compact(F.transform("__s", place)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s")


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def vector() -> list[Column]:
    share = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        share("n_symbols", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"),
    ]


def _near(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, ["lang", "source"])


def _binned_quantile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """The upper edge of the bin in which each group's quantile lies.  Counts per bin are summed before the shuffle."""
    counts = rows.groupBy(*keys, F.floor(value * BINS).alias("bin")).count()
    by = Window.partitionBy(*keys)
    upto = F.sum("count").over(by.orderBy("bin"))
    total = F.sum("count").over(by)
    return counts.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= share * F.col("total")).groupBy(*keys).agg(((F.min("bin") + 1) / BINS).alias(name))


def _distance(m: Column) -> Column:
    """Squared Mahalanobis distance of x0.. from the model's centre by its Cholesky factor: forward substitution."""
    y: list[Column] = []
    for i in range(DIMENSIONS):
        r = F.col(f"x{i}") - m[f"c{i}"]
        for j in range(i):
            r = r - m[f"l{i}{j}"] * y[j]
        y.append(r / m[f"l{i}{i}"])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _modelled(moments: DataFrame, start: bool) -> DataFrame:
    """lang, source, start and the model ``m``: centre c0.., Cholesky factor l00, l10, l11, ... of the covariance v00, v10, v11, ... with the floor added,
    and the logarithm of its determinant (of a start, which is no estimate yet, a number above all)."""
    out, p = moments, DIMENSIONS
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"v{i}{j}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    fields = [f"c{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    logdet = F.lit(1e300) if start else sum((2 * F.log(f"l{i}{i}") for i in range(1, p)), 2 * F.log("l00"))
    return out.select("lang", "source", "start", F.struct(*fields, logdet.alias("logdet")).alias("m"))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Four models of each lang and source to start from: medians with the spread of each statistic alone; mean and covariance of all documents;
    medians with the covariance of squashed (tanh) and of unit-length deviations.  The last two heed outliers little, each in its way."""
    p = DIMENSIONS
    long = rows.select("lang", "source", F.posexplode(F.array(*[f"x{i}" for i in range(p)])).alias("k", "x"))
    middle = _binned_quantile(long, ["lang", "source", "k"], F.col("x"), 0.5, "m").withColumn("m", F.col("m") - 0.5 / BINS)
    middle = materialize(middle.groupBy("lang", "source").agg(*[F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"c{i}") for i in range(p)]), "centres")
    off = _near(rows, middle, few).select("lang", "source", F.posexplode(F.array(*[F.abs(F.col(f"x{i}") - F.col(f"c{i}")) for i in range(p)])).alias("k", "x"))
    spread = _binned_quantile(off, ["lang", "source", "k"], F.col("x"), 0.5, "m").groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("k") == i, F.greatest(1.4826 * F.col("m"), F.lit(FLOOR[i])))).alias(f"s{i}") for i in range(p)]
    )
    centred = materialize(middle.join(spread, ["lang", "source"]), "centred")
    at = _near(rows, centred, few)
    z = [(F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"s{i}") for i in range(p)]
    length = F.greatest(sum((v * v for v in z[1:]), z[0] * z[0]), F.lit(1e-12))
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    both = at.groupBy("lang", "source").agg(
        *[F.avg(z[i]).alias(f"a{i}") for i in range(p)], *[F.avg(z[i] * z[j]).alias(f"q{i}{j}") for i, j in pairs],
        *[F.avg(F.tanh(z[i]) * F.tanh(z[j])).alias(f"t{i}{j}") for i, j in pairs], *[F.avg(z[i] * z[j] / length).alias(f"u{i}{j}") for i, j in pairs],
    )
    both = both.join(centred, ["lang", "source"])
    size = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")

    def model(number: int, centre, covariance) -> Column:
        return F.struct(F.lit(number).alias("start"), *[centre(i).alias(f"c{i}") for i in range(p)], *[covariance(i, j).alias(f"v{i}{j}") for i, j in pairs])

    median = lambda i: F.col(f"c{i}")
    models = F.array(
        model(0, median, lambda i, j: size(i, j) if i == j else F.lit(0.0)),
        model(1, lambda i: F.col(f"c{i}") + F.col(f"s{i}") * F.col(f"a{i}"), lambda i, j: size(i, j) * (F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}"))),
        model(2, median, lambda i, j: size(i, j) * F.col(f"t{i}{j}")),
        model(3, median, lambda i, j: size(i, j) * F.col(f"u{i}{j}") * p),
    )
    return _modelled(both.select("lang", "source", F.explode(models).alias("s")).select("lang", "source", "s.*"), start=True)


def _concentrated(rows: DataFrame, models: DataFrame, few: bool, coverage: float) -> DataFrame:
    """One concentration step of each model: mean and covariance of the ``coverage`` of documents closest to it."""
    p, keys = DIMENSIONS, ["lang", "source", "start"]
    at = _near(rows, models.select(*keys, "m"), few).withColumn("d", F.log(_distance(F.col("m")) + 1e-9))
    cut = _binned_quantile(at, keys, F.col("d"), coverage, "cut")
    core = at.join(F.broadcast(cut) if few else cut, keys).filter(F.floor(F.col("d") * BINS) < F.col("cut") * BINS)
    z = [F.col(f"x{i}") - F.col("m")[f"c{i}"] for i in range(p)]  # from the last centre, for precision
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = core.groupBy(*keys).agg(
        *[F.first(F.col("m")[f"c{i}"]).alias(f"o{i}") for i in range(p)], *[F.avg(z[i]).alias(f"m{i}") for i in range(p)], *[F.avg(z[i] * z[j]).alias(f"q{i}{j}") for i, j in pairs]
    )
    moments = sums.select(
        *keys, *[(F.col(f"o{i}") + F.col(f"m{i}")).alias(f"c{i}") for i in range(p)], *[(F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"v{i}{j}") for i, j in pairs]
    )
    return _modelled(moments, start=False)


def _stepped(rows: DataFrame, best: DataFrame, few: bool, coverage: float) -> DataFrame:
    """The open models after one more step: the new one where its determinant is smaller, done where it is not by more than ``TOLERANCE``."""
    keys = ["lang", "source", "start"]
    step = _concentrated(rows, best.filter(~F.col("done")), few, coverage).withColumnRenamed("m", "n")
    both = best.join(F.broadcast(step) if few else step, keys, "left")
    new, old = F.col("n")["logdet"], F.col("m")["logdet"]
    done = F.col("done") | F.col("n").isNull() | (new > old - TOLERANCE)
    return materialize(both.select(*keys, F.when(F.col("n").isNotNull() & (new < old), F.col("n")).otherwise(F.col("m")).alias("m"), done.alias("done")), "estimate")


def estimate(rows: DataFrame, coverage: float = 0.75, first_steps: int = 2) -> DataFrame:
    """Per lang and source: the model ``m`` of the smallest determinant and ``scale`` of its distances.  ``rows``: lang, source (not null), x0.. (a written table).

    All starts take ``first_steps`` concentration steps; of each group the start with the smallest determinant goes on until a step does not lower it any more.
    Determinants fall with every step that is kept and are bounded by the floor, so the rounds end by themselves."""
    few = rows.select("lang", "source").distinct().count() <= BROADCAST_GROUPS
    best = materialize(_starts(rows, few).withColumn("done", F.lit(False)), "starts")
    for _ in range(first_steps):
        best = _stepped(rows, best, few, coverage)
    least = best.groupBy("lang", "source").agg(F.min_by(F.struct("start", "m", "done"), F.struct(F.col("m")["logdet"], "start")).alias("b"))
    best = materialize(least.select("lang", "source", "b.*"), "estimate")
    while not best.filter(~F.col("done")).isEmpty():
        best = _stepped(rows, best, few, coverage)
    at = _near(rows, best, few)
    median = _binned_quantile(at, ["lang", "source"], F.log(_distance(F.col("m")) + 1e-9), 0.5, "cut")
    scale = median.select("lang", "source", (F.exp("cut") / CHI2_MEDIAN).alias("scale"))
    return materialize(best.join(scale, ["lang", "source"]).select("lang", "source", "m", "scale"), "estimate")


def _dealt(fit: DataFrame) -> DataFrame:
    """The vectors, once for each estimate they take part in, with its key as lang and source: ("=lang", "=source") of the group, ("=lang", "") of the
    language, ("", "") of the corpus."""
    key = lambda a, b: F.struct(a.alias("lang"), b.alias("source"))
    lang, source, none = F.concat(F.lit("="), "lang"), F.concat(F.lit("="), "source"), F.lit("")
    x = [f"x{i}" for i in range(DIMENSIONS)]
    return fit.select(F.explode(F.array(key(lang, source), key(lang, none), key(none, none))).alias("k"), *x).select("k.lang", "k.source", *x)


def _blended(own: Column, above: Column, weight: Column) -> list[Column]:
    """Centre and covariance (less the floor, which the model adds) that lie between two models."""
    mix = lambda a, b: weight * a + (1 - weight) * b
    covariance = lambda m, i, j: sum(m[f"l{i}{k}"] * m[f"l{j}{k}"] for k in range(j + 1))
    centre = [mix(own[f"c{i}"], above[f"c{i}"]).alias(f"c{i}") for i in range(DIMENSIONS)]
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
    return centre + [(mix(covariance(own, i, j), covariance(above, i, j)) - (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"v{i}{j}") for i, j in pairs]


def _shrunk(model: DataFrame, fit: DataFrame, prior_rows: float) -> DataFrame:
    """lang, source, m, scale of each group: its estimate drawn towards its language's, and that towards the corpus's, half way where there are ``prior_rows``
    documents."""

    def towards(rows: DataFrame) -> DataFrame:
        """rows: lang, source, n, m, scale, above, above_scale"""
        w = F.col("n") ** 2 / (F.col("n") ** 2 + prior_rows**2)
        moments = rows.select("lang", "source", F.lit(0).alias("start"), *_blended(F.col("m"), F.col("above"), w))
        scales = rows.select("lang", "source", (w * F.col("scale") + (1 - w) * F.col("above_scale")).alias("scale"))
        return _modelled(moments, start=False).drop("start").join(scales, ["lang", "source"])

    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("n"))
    key = lambda c: F.concat(F.lit("="), c)
    whole = model.filter("lang = ''").select(F.col("m").alias("above"), F.col("scale").alias("above_scale"))  # one row
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n")).withColumns({"lang": key("lang"), "source": F.lit("")})
    langs = materialize(towards(langs.join(model, ["lang", "source"]).crossJoin(F.broadcast(whole))), "languages")
    above = langs.select("lang", F.col("m").alias("above"), F.col("scale").alias("above_scale"))
    groups = sizes.withColumns({"lang": key("lang"), "source": key("source")}).join(model, ["lang", "source"]).join(above, "lang")
    return materialize(towards(groups), "models").withColumns({c: F.substring(c, 2, 1 << 30) for c in ("lang", "source")})


def judge(docs: DataFrame, prior_rows: float = 50.0, cutoff: float = CHI2_CUT, coverage: float = 0.75, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``docs`` but the text, the statistics, base_failed, distance (null if not judged) and kept."""
    docs = without(docs, *STATISTICS, "n_lines", "base_failed", "distance", "kept")
    others = [c for c in docs.columns if c != text]
    rows = with_statistics(docs, text).withColumn("base_failed", base_failed())
    group = {"__lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "__source": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    rows = materialize(rows.withColumns(group).select(*others, *STATISTICS, "n_lines", "base_failed", *group), "statistics")
    fit = rows.filter(~F.col("base_failed")).select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), *[x.alias(f"x{i}") for i, x in enumerate(vector())])
    fit = materialize(fit, "vectors")
    model = _shrunk(estimate(materialize(_dealt(fit), "dealt"), coverage), fit, prior_rows)
    few = model.count() <= BROADCAST_GROUPS
    model = model.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    out = rows.join(F.broadcast(model) if few else model, ["__lang", "__source"], "left").withColumns({f"x{i}": x for i, x in enumerate(vector())})
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance(F.col("m")) / F.greatest(F.col("scale"), F.lit(1.0)))))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= math.sqrt(cutoff))
    return out.select(*others, *STATISTICS, "n_lines", "base_failed", F.round("distance", 6).alias("distance"), kept.alias("kept"))
