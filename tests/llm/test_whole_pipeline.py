"""The pipeline's rows against a plain version of all five stages, over documents with odd rows and clashing columns."""

import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F
from test_table_operators import plain_groups, plain_mix
from test_text_operators import plain_hits, plain_lines, words

from maskwright.llm import toxicity
from maskwright.llm.queries import MIX

SF = "/root/testdata/sf0.001"


def plain_run(docs, labels, items):
    """(doc_id, text, epoch) of the mix; ``docs``: doc_id, text, lang, source."""
    toxic = {}
    for d, t in labels:
        if t is not None and __import__("zlib").crc32(str(d).encode()) % 5:
            toxic[d] = max(t, toxic.get(d, 0))
    at = lambda d: (struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", d), 42)))[0], d)
    text = {d: t for d, t, *_ in docs}
    rows = sorted((d for d in toxic if d in text), key=at)
    model = toxicity.train([text[d] for d in rows], [toxic[d] for d in rows], toxicity.TrainConfig())
    scores = toxicity.Scorer(model).scores([t for _, t, *_ in docs])
    docs = [r for r, s in zip(docs, scores, strict=True) if s < 0.5]
    lines = {d: t for d, t, *_ in plain_lines([(d, t) for d, t, *_ in docs], 10)}
    docs = [(d, lines[d], *rest) for d, _, *rest in docs]
    groups = plain_groups([(d, t) for d, t, *_ in docs], 5, 80, 100)
    docs = [r for r in docs if groups[r[0]][1] == r[0]]
    kept = []
    for r in docs:
        hit = plain_hits(r[1], items)[1]
        if not (hit and 20 * hit >= len(words(r[1]))):
            kept.append(r)
    mixed = plain_mix(kept, MIX["target_share"], MIX["max_epochs"], MIX["seed"], MIX["weights"])
    final = {d: t for d, t, *_ in kept}
    return sorted((d, final[d], e) for d, e in mixed)


def test_run_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = docs.orderBy("doc_id").limit(3).withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(200_001, None, "en", "src1", 0), (200_002, "", None, None, 0), (200_003, "two words", "en", "src0", 9)], docs.schema)
    docs = docs.unionByName(first).unionByName(odd).withColumns({"n_lines": F.lit("own"), "items": F.lit("own"), "n_words": F.lit("own"), "toxicity": F.lit("own"), "spans": F.lit("own")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.run(spark, f"file://{tmp_path}")
    assert set(out.columns) == {*docs.columns, "domain", "tokens", "epoch"}
    got = out.collect()
    assert all({r.n_lines, r["items"], r.n_words, r.toxicity, r.spans} == {"own"} for r in got)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_run(rows, labels, items)
    assert sorted((r.doc_id, r.text or "", r.epoch) for r in got) == [(d, t or "", e) for d, t, e in want]
    assert 0 < len({d for d, *_ in want}) < len(rows) and np.mean([r.n_chars == len(r.text or "") for r in got]) == 1
    none = docs.limit(0)
    for _, stage in P.STAGES:
        none = stage(spark, none, f"file://{tmp_path}")
    assert none.count() == 0
