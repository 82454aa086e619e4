"""Overlaps and replacement against plain versions."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.operators import masking as M
from maskwright.operators import replacement as R
from maskwright.operators.interval_join import overlapping


def test_overlaps_against_all_pairs(spark):
    r = random.Random(6)

    def spans(n, first):
        for i in range(n):
            start = r.choice([r.randrange(-50, 300), r.randrange(10**6), 2**61])
            yield first + i, r.choice(["a", "a", "a", "b", None]), start, start + r.choice([0, 1, 1, 4, 16, 17, 100, 5000, 10**9, -3])

    left = [*spans(150, 0), (900, "a", None, 5), (901, "a", 5, None), (902, "a", 3, 4), (902, "a", 3, 4)]
    right = list(spans(150, 1000))
    schema = "id long, doc string, start_pos long, end_pos long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    ok = lambda x: x[1] is not None and None not in x and x[2] < x[3]
    expected = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in left for y in right if ok(x) and ok(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    for split in (20_000, 3):  # every bin is hot, too
        got = overlapping(a, b, ["doc"], split=split).select("left.id", F.col("right.id").alias("r"), "overlap")
        assert sorted(map(tuple, got.collect())) == expected
    assert len(expected) > 1000
    whole = overlapping(a, b).count()
    ok = lambda x: None not in (x[2], x[3]) and x[2] < x[3]
    assert whole == sum(x[2] < y[3] and y[2] < x[3] for x in left if ok(x) for y in right if ok(y))
    assert overlapping(a.limit(0), b, ["doc"]).count() == 0


def plain(text, pairs):
    if not text:
        return text
    out, i = "", 0
    while i < len(text):
        v = max((v for v in pairs if v and text.startswith(v, i)), key=len, default=None)
        out, i = (out + pairs[v], i + len(v)) if v else (out + text[i], i + 1)
    return out


def sample(seed, n=300):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé王😀 ") for _ in range(r.randint(1, 5)))
    pairs = {word(): f"<{r.choice(['ab', 'x', ''])}>" for _ in range(n)} | {"": "never", ".*": "[dot]", "\\E": "[e]", "$1": "\\2"}
    texts = ["".join(word() + r.choice(["", ".*", "\\E", "$1", "z"]) for _ in range(r.randint(0, 12))) for _ in range(200)]
    return pairs, [*texts, None, ""]


@pytest.mark.parametrize("size", [1 << 20, 900])
def test_replacement_against_plain_version(spark, size):
    pairs, texts = sample(size)
    df = spark.createDataFrame([(i, t, (t or "")[::-1], i) for i, t in enumerate(texts)], "id long, t string, u string, masked long").repartition(3)
    table = spark.createDataFrame([*pairs.items(), (None, "x"), ("b", None)], "value string, masked string")
    got = {r.id: (r.t, r.u, r.masked) for r in R.replace_all(df, table, ["t", "u"], block_bytes=size).collect()}
    assert got == {i: (plain(t, pairs), plain((t or "")[::-1], pairs), i) for i, t in enumerate(texts)}
    assert R.replace_all(df.limit(0), table, ["t"], block_bytes=size).count() == 0 and R.replace_all(df, table.limit(0), ["t"]).count() == len(texts)


def test_pairs_of_a_row_and_of_a_list(spark):
    pairs, texts = sample(5, 12)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    listed = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(m).alias("masked")) for v, m in pairs.items()])
    expected = {i: plain(t, pairs) for i, t in enumerate(texts)}
    assert {r.id: r.x for r in df.select("id", M.replaced(F.col("t"), listed).alias("x")).collect()} == expected
    assert {int(r.id): r.t for r in M.mask_table(df.select(F.col("id"), "t"), list(pairs.items())).collect()} == expected
    none = F.array().cast("array<struct<value:string,masked:string>>")
    assert df.select(M.replaced(F.lit("a"), none).alias("x")).first().x == "a"


def test_replacing_holds_few_texts_of_a_batch_at_once(spark):
    rows = spark.range(1000).coalesce(1).selectExpr("id", "case when id % 7 = 0 then null when id % 5 = 0 then '' else concat('ab', id, 'ab') end as t")
    replace = R.replacing({"ab": "#"})
    got = rows.select("id", replace(F.col("t")).alias("t")).collect()
    assert [(r.id, r.t) for r in got] == [(i, None if i % 7 == 0 else "" if i % 5 == 0 else f"#{i}#") for i in range(1000)]
    texts = pa.array(["ab" + "x" * 1998] * 20_000)
    replace.func(texts[:1])
    tracemalloc.start()
    out = replace.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 20_000 and out[19_999].as_py() == "#" + "x" * 1998
    assert peak < 10 << 20  # all texts as strings are 40 MB, and 20 MB more replaced
