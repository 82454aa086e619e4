"""Surrogates for personal data: keyed, type-consistent replacements.  DataFrame functions only.

Entities are found by one pattern per type; cards must pass their checksum.  A surrogate is made character by character from a keyed hash of
(type, value): digits become digits, letters letters of the same script and case, punctuation stays, so formats hold; cards pass their checksum
again, addresses stay addresses.  The same value has the same surrogate everywhere (coreference).

Names are found by their title and replaced part by part: a part's surrogate hangs on the part alone, so "Mrs. Anna Berg", "Mrs. Anna" and, in a
text that names her with a title anywhere, a bare "Berg" stay one person.  A first name that stands behind women's titles more often than behind
men's in the corpus gets a female ending, wherever it occurs.  Names in Latin, Cyrillic and Greek become syllables of their script, in
others letters of it.  Hosts of addresses are values of their own.

Distinctness is checked over all values of the corpus: where two values of a type would share a surrogate, or a surrogate
is itself a value of the corpus, all but the first go to the next attempt (another hash), until none is left; values whose format has no
free surrogate any more are counted in a warning.  Only values of a later attempt than the first, and female first names, are looked up when texts
are rewritten, by a map up to ``MAP_LIMIT`` of them, else by a join.

Defined results: null texts stay null and have no entities; texts without entities are unchanged; repeated rows are rewritten alike;
empty tables give empty ones; texts of any length are read whole; input columns named like the added ones give way to them.  Names without a title
in their text are not found.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, without

MAP_LIMIT = 10_000
ATTEMPTS = 12  #: rounds of one draw each; the values left then draw many at once
IDLE = 4096  #: draws of a value without any success after which its format is taken to be full
DRAWS = 4_000_000  #: of a round, over all values

_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora|Г-жа|Κα|Κυρία"
_MALE = "Mr|Herr|Monsieur|Señor|Г-н|Κος|Κύριος"
_TITLES = f"(?:{_FEMALE}|{_MALE}|Dr|Prof)"
#: types in the order in which they take text; Java patterns without capturing groups.  Values have no upper length, lest their rest stay;
#: repetitions without one are possessive, and an e-mail begins where its run of characters does, or where the last match ended
PATTERNS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+-]))[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251}[A-Za-z0-9])?\.[A-Za-z]{2,24}",
    "secret": r"(?:AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api[_-]?key)(?:\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}+|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{20,}+)",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": rf"\b{_TITLES}\.?[ ]\p{{Lu}}\p{{L}}++(?:[ ]\p{{Lu}}\p{{L}}++)?",
}
#: a bare word that may be part of a name of its text
MENTION = r"(?<![\p{L}\p{N}_])\p{Lu}\p{L}++(?![\p{N}_])"
NAMED = rf"{_TITLES}\.?[ ]\p{{Lu}}"
#: a text without any of these has no entity of ``PATTERNS``: by characters first, which cost little, then by pattern
DIGITS, DIGITS_CLOSE = r"[0-9@]", r"[0-9]{3}|[0-9]\.[0-9]|\+[0-9]|@"
MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "password", "passwd", "secret", "token")
TITLE_STARTS = ("Mr", "Ms", "Miss", "Frau", "Madame", "Señor", "Г-", "Κ", "Herr", "Monsieur", "Dr", "Prof")


def _alphabet(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1) if chr(c).isalpha())


LATIN = _alphabet((0x61, 0x7A))
#: scripts other than Latin by pattern, with the letters their own ones become
SCRIPTS: tuple[tuple[str, str], ...] = (
    (r"\p{IsCyrillic}", _alphabet((0x430, 0x44F))), (r"\p{IsGreek}", _alphabet((0x3B1, 0x3C1), (0x3C3, 0x3C9))), (r"\p{IsHan}", _alphabet((0x4E00, 0x4FFF))),
    (r"\p{IsHiragana}", _alphabet((0x3042, 0x3093))), (r"\p{IsKatakana}", _alphabet((0x30A2, 0x30F3))), (r"\p{IsHangul}", _alphabet((0xAC00, 0xAEFF))),
    (r"\p{IsHebrew}", _alphabet((0x5D0, 0x5EA))), (r"\p{IsArabic}", _alphabet((0x627, 0x63A), (0x641, 0x64A))), (r"\p{IsDevanagari}", _alphabet((0x915, 0x939))),
    (r"\p{IsThai}", _alphabet((0xE01, 0xE2E))),
)
#: script of names in syllables: consonants, vowels, the ending and the female one
SYLLABLES: tuple[tuple[str, str, str, str, str], ...] = (
    (r"\p{IsCyrillic}", "бвгдклмнпрст", "аеиоу", "н", "на"), (r"\p{IsGreek}", "βγδκλμνπρστφ", "αειου", "ς", "να"), (r"\p{IsLatin}", "bdfgklmnprstvz", "aeiou", "n", "na"),
)


def any_pattern(patterns: Mapping[str, str] = PATTERNS) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def type_of(value: Column, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """The first type whose whole pattern the value is (look-arounds hold at its ends); null for numbers like cards that fail their checksum."""
    found = F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in patterns.items()], F.lit("other"))
    return _let(found, lambda t: F.when((t != "card") | (_luhn(F.regexp_replace(value, "[^0-9]", "")) == 0), t))


def _number(key: str, kind: Column, value: Column, at: Column, attempt: Column) -> Column:
    """A keyed 32-bit number for a place of a value."""
    plain = F.concat_ws("\u0001", F.lit(key), kind, value, at.cast("string"), attempt.cast("string"))
    return F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.sha2(plain, 256)), 256), 1, 8), 16, 10).cast("long")


def _letters(text: str, n: Column) -> Column:
    return F.substring(F.lit(text), (n % len(text)).cast("int") + 1, F.lit(1))


def _drawn(c: Column, n: Column, hexadecimal: Column) -> Column:
    """A character of the class of ``c``: a digit, or a letter of its script and case."""

    def letter(low: Column) -> Column:
        latin = F.when(hexadecimal, _letters(LATIN[:6], n)).otherwise(_letters(LATIN, n))
        out = F.when(low.rlike("[a-z]"), latin)
        for script, alphabet in SCRIPTS:
            out = out.when(low.rlike(script), _letters(alphabet, n))
        return _let(out.otherwise(latin), lambda x: F.when(c == low, x).otherwise(F.upper(x)))

    return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{L}"), _let(F.lower(c), letter)).otherwise(c)


def _mapped(key: str, kind: Column, seed: Column, value: Column, attempt: Column, hexadecimal: Column) -> Column:
    """The value with each digit and letter replaced by one of its class, keyed by ``seed`` and place."""
    bound = F.struct(seed.alias("seed"), hexadecimal.alias("hex"), F.split(value, "").alias("each"))
    one = lambda b: F.transform(b["each"], lambda c, i: _let(_number(key, kind, b["seed"], i, attempt), lambda n: _drawn(c, n, b["hex"])))
    return F.array_join(_let(bound, one), "")


def _luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""

    def total(digits: Column) -> Column:
        def add(so_far: Column, d: Column) -> Column:
            value = F.when(so_far["even"], F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
            return F.struct((so_far["sum"] + value).alias("sum"), (~so_far["even"]).alias("even"))

        return F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("even")), add, lambda x: x["sum"] % 10)

    return total(F.split(F.reverse(number), "").cast("array<int>"))


def _ip(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Four numbers from 1 to 254."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(key, kind, value, i, attempt) % 254 + 1).cast("string")), ".")


def _lead(kind: Column, value: Column) -> Column:
    """What stays at the front: a phone's country code, a secret's name or prefix, a card's first digit."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    name = F.regexp_extract(value, r"^(?:AKIA|gh[pousr]_|sk-|(?:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)", 0)
    return F.when(kind == "phone", code).when(kind == "secret", name).when(kind == "card", F.substring(value, 1, 1)).otherwise("")


def _tail(kind: Column, value: Column) -> Column:
    """What stays at the end: an address's host, which is a value of its own; a host's last label, being the registry (two of example hosts)."""
    registry = F.when(value.rlike(r"(?:^|\.)example\.(?:com|org|net)$"), F.substring_index(value, ".", -2)).otherwise(F.substring_index(value, ".", -1))
    return F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(kind == "host", registry).otherwise("")


def _plain(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Character by character between what stays; of a card, the last digit is set so that its checksum holds."""

    def between(e: Column) -> Column:
        body = F.substring(value, F.length(e["lead"]) + 1, F.length(value) - F.length(e["lead"]) - F.length(e["tail"]))
        mapped = lambda x: _mapped(key, kind, F.when(kind == "email", value).otherwise(x), x, attempt, (kind == "secret") & x.rlike("^[0-9a-f]+$"))
        return F.concat(e["lead"], _let(body, mapped), e["tail"])

    def checked(drawn: Column) -> Column:
        most = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        check = (10 - _luhn(F.concat(F.regexp_replace(most, "[^0-9]", ""), F.lit("0")))) % 10
        return F.when(kind == "card", F.concat(most, check.cast("string"))).otherwise(drawn)

    return _let(_let(F.struct(_lead(kind, value).alias("lead"), _tail(kind, value).alias("tail")), between), checked)


def _part(key: str, kind: Column, value: Column, attempt: Column, female: Column) -> Column:
    """Four syllables of the part's script and an ending; in scripts without syllables here, letters of theirs."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: _number(key, kind, value, k, attempt))

    def spelled(n: Column) -> Column:
        out = F.when(F.lit(False), value)
        for script, consonants, vowels, ending, of_women in SYLLABLES:
            each = F.transform(n, lambda x, i: F.when(i % 2 == 0, _letters(consonants, x)).otherwise(_letters(vowels, x)))  # noqa: B023
            out = out.when(F.substring(value, 1, 1).rlike(script), F.initcap(F.concat(F.array_join(each, ""), F.when(female, F.lit(of_women)).otherwise(F.lit(ending)))))
        return out.otherwise(_mapped(key, kind, value, value, attempt, F.lit(False)))

    return _let(numbers, spelled)


def made(key: str, kind: Column, value: Column, attempt: Column, female: Column) -> Column:
    """The surrogate of one value (``host`` and ``part`` are types of their own; of an address, all but its host)."""
    return F.when(kind == "part", _part(key, kind, value, attempt, female)).when(kind == "ip", _ip(key, kind, value, attempt)).otherwise(_plain(key, kind, value, attempt))


def name_parts(value: Column) -> Column:
    """The one or two parts behind a name's title."""
    return F.slice(F.split(value, " "), 2, 2)


def values_in(kind: Column, value: Column) -> Column:
    """array<struct<type, value, vote>>: what of an entity is replaced by itself; a first name votes for its title's gender."""
    one = lambda t, v, n=0: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), v.alias("value"), F.lit(n).cast("long").alias("vote") if isinstance(n, int) else n.alias("vote"))
    parts = name_parts(value)
    gender = F.when(value.rlike(rf"^(?:{_FEMALE})\b"), 1).when(value.rlike(rf"^(?:{_MALE})\b"), -1).otherwise(0).cast("long")
    named = F.transform(parts, lambda p, i: one("part", p, F.when((i == 0) & (F.size(parts) > 1), gender).otherwise(F.lit(0).cast("long"))))
    return F.when(kind == "name", named).when(kind == "email", F.array(one("email", value), one("host", F.substring_index(value, "@", -1)))).otherwise(F.array(one(kind, value)))


Code = Callable[[Column, Column], Column]  #: (type, value) to 2 * attempt + female


def surrogate(key: str, kind: Column, value: Column, code: Code) -> Column:
    """What stands in the text for an entity of a type: its values' surrogates put together."""
    one = lambda v: _let(code(v["type"], v["value"]), lambda c: made(key, v["type"], v["value"], F.shiftright(c, 1), c.bitwiseAND(1) == 1))

    def whole(parts: Column) -> Column:
        name = F.concat(F.substring_index(value, " ", 1), F.lit(" "), F.array_join(parts, " "))
        address = F.concat(F.substring_index(parts[0], "@", 1), F.lit("@"), F.get(parts, F.lit(1)))
        return F.when(kind == "name", name).when(kind == "email", address).otherwise(parts[0])

    return F.when(kind.isNull(), value).otherwise(_let(F.transform(values_in(kind, value), one), whole))


def _key(kind: Column, value: Column) -> Column:
    return F.concat_ws("\u0001", kind, value)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def entities(docs: DataFrame, text: str = "text", patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """All columns of ``docs`` and ``__e``: array<struct<kind, value>> of the matches in order (``kind`` is null where a match is no entity, ``part`` at a bare
    mention of a name), and ``__p``: the pieces of the text between them."""
    t, plain = F.col(text), any_pattern(patterns)
    named = _any_of(t, TITLE_STARTS) & t.rlike(NAMED) if "name" in patterns else F.lit(False)
    wide = f"{plain}|(?:{MENTION})"
    marked = (t.rlike(DIGITS) & t.rlike(DIGITS_CLOSE)) | _any_of(t, MARKS) | (t.contains("api") & t.rlike("api[_-]?key"))
    hit = marked | named if patterns is PATTERNS else t.isNotNull()
    each = lambda f: F.when(hit, F.when(named, f(wide)).otherwise(f(plain)))
    found = docs.withColumn("__m", F.coalesce(each(lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))), F.array().cast("array<string>")))
    found = found.withColumn("__e", F.transform("__m", lambda v: F.struct(type_of(v, patterns).alias("kind"), v.alias("value"))))
    known = F.flatten(F.transform(F.filter("__e", lambda e: e["kind"] == "name"), lambda e: name_parts(e["value"])))
    found = found.withColumn("__n", F.array_distinct(known))
    bare = lambda e: F.when(F.array_contains("__n", e["value"]), F.lit("part"))
    kinds = F.transform("__e", lambda e: F.struct(F.when((e["kind"] == "other") & e["value"].rlike(r"^\p{Lu}\p{L}+$"), bare(e)).otherwise(e["kind"]).alias("kind"), e["value"].alias("value")))
    found = found.withColumn("__e", kinds).withColumn("__p", F.when(F.size("__m") > 0, each(lambda p: F.split(t, p, -1))))
    return found.drop("__m", "__n")


def values_of(docs: DataFrame, text: str = "text", patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """Distinct (type, value) of all texts, and whether it is a female first name."""
    each = entities(docs, text, patterns).select(F.explode("__e").alias("e")).filter("e.kind is not null and e.kind <> 'part'")
    each = each.select(F.explode(values_in(F.col("e.kind"), F.col("e.value"))).alias("v")).select("v.*")
    each = each.filter((F.col("type") != "host") | (F.length("value") > F.length(_tail(F.col("type"), F.col("value")))))  # nothing but a registry stays
    return each.groupBy("type", "value").agg((F.sum("vote") > 0).alias("female"))


def later_codes(values: DataFrame, key: str) -> DataFrame:
    """(type, value, code) of the values whose code is not 0: their surrogate of attempt 0 is taken, or they are female first names.  ``values`` is a written table."""
    spark, own = values.sparkSession, ["type", "value", "female"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draw = lambda df: df.withColumn("s", made(key, F.col("type"), F.col("value"), F.col("attempt"), F.col("female")))
    done = lambda df: df.select("type", "value", (2 * F.col("attempt") + F.col("female").cast("int")).alias("code")).filter("code > 0")
    now = values.withColumn("attempt", F.lit(0))
    for k in range(ATTEMPTS):
        # few bytes and much work each: dealt by number, which adaptive execution leaves so
        drawn = materialize(draw(now.repartition(parts, "value")), "surrogates")
        first = drawn.groupBy("type", "s").agg(F.min(F.struct("attempt", "value")).alias("f"), F.count("*").alias("n"))
        shared = drawn.join(first.filter("n > 1"), ["type", "s"]).filter("f.value <> value").select("type", "value")
        known = drawn.join(values.select("type", F.col("value").alias("s")), ["type", "s"], "left_semi").select("type", "value")
        again = materialize(shared.unionByName(known).distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return done(now)
        now = drawn.drop("s").join(again, ["type", "value"], "left").select(*own, (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    held = materialize(drawn.join(again, ["type", "value"], "left_anti").select(*own, "attempt", "s"), "held")
    left = materialize(drawn.join(again, ["type", "value"], "left_semi").select(*own), "left")
    return done(_settled(held, left, values, key, parts))


def _settled(held: DataFrame, left: DataFrame, values: DataFrame, key: str, parts: int) -> DataFrame:
    """``held`` (type, value, female, attempt, s) and an attempt for the values ``left`` without a surrogate: many are drawn at once and free ones taken.

    Where some value draws a free surrogate, at least one is settled, so rounds go on until none is left or ``IDLE`` draws of
    each value that is left settled nothing: its format is then taken to be full, and the number of such values is given as a warning."""
    first, width, idle = ATTEMPTS, 64, 0
    many = left.count()
    while many and idle < IDLE:
        width = max(1, min(width, DRAWS // many))
        drawn = left.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(first + width - 1)))).repartition(parts, "value", "attempt")
        drawn = drawn.withColumn("s", made(key, F.col("type"), F.col("value"), F.col("attempt"), F.col("female")))
        free = drawn.join(held.select("type", "s"), ["type", "s"], "left_anti").join(values.select("type", F.col("value").alias("s")), ["type", "s"], "left_anti")
        won = free.groupBy("type", "s").agg(F.min(F.struct("attempt", "value", "female")).alias("f")).select("type", "s", "f.*")
        taken = won.groupBy("type", "value", "female").agg(F.min(F.struct("attempt", "s")).alias("f")).select("type", "value", "female", "f.attempt", "f.s")
        taken = materialize(taken, "taken")
        first, idle = first + width, idle + width
        if not taken.isEmpty():
            held, left, idle = held.unionByName(taken), materialize(left.join(taken, ["type", "value"], "left_anti"), "left"), 0
            many = left.count()
        width = min(8 * width, IDLE)
    if many:
        warnings.warn(f"{many} values found no surrogate of their own: their formats are full", stacklevel=2)
    return held.drop("s").unionByName(left.withColumn("attempt", F.lit(ATTEMPTS)))


def with_surrogates(docs: DataFrame, key: str, text: str = "text", patterns: Mapping[str, str] = PATTERNS, map_limit: int = MAP_LIMIT) -> DataFrame:
    """All columns of ``docs`` with entities of the text replaced, and n_entities and entity_types (in order of place; bare mentions are names)."""
    docs = without(docs, "n_entities", "entity_types")
    values = materialize(values_of(docs, text, patterns), "values")
    later = materialize(later_codes(values, key).select(_key(F.col("type"), F.col("value")).alias("k"), "code"), "codes")
    found = entities(docs, text, patterns)
    if later.count() <= map_limit:
        few = later.collect()  # at most map_limit
        table = F.create_map(*[F.lit(x) for r in few for x in (r["k"], r["code"])]) if few else None
        code = lambda t, v: F.coalesce(F.try_element_at(table, _key(t, v)), F.lit(0)) if few else F.lit(0)
    else:
        rows = materialize(found.withColumn("__row", F.expr("uuid()")), "rows")
        keys = F.flatten(F.transform(F.filter("__e", lambda e: e["kind"].isNotNull()), lambda e: F.transform(values_in(e["kind"], e["value"]), lambda v: _key(v["type"], v["value"]))))
        each = rows.select("__row", F.explode(F.array_distinct(keys)).alias("k")).join(later, "k")
        maps = each.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "code"))).alias("__codes"))  # a document's own values
        found = rows.join(maps, "__row", "left")
        code = lambda t, v: F.coalesce(F.try_element_at("__codes", _key(t, v)), F.lit(0))
    new = F.transform("__e", lambda e: surrogate(key, e["kind"], e["value"], code))
    joined = F.array_join(F.zip_with("__p", F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    whole = F.when(F.size("__e") > 0, joined).otherwise(F.col(text))
    kinds = F.transform(F.filter("__e", lambda e: e["kind"].isNotNull()), lambda e: F.when(e["kind"] == "part", F.lit("name")).otherwise(e["kind"]))
    out = found.withColumn("__kinds", kinds)
    return out.select(*[whole.alias(c) if c == text else F.col(c) for c in docs.columns], F.size("__kinds").cast("long").alias("n_entities"), F.col("__kinds").alias("entity_types"))
