"""Keyed state across restarts, deadlines, and progress of jobs that end well or do not."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.plans import progress
from maskwright.streaming import documents as streams
from maskwright.streaming import state

START = datetime(2024, 1, 1)
SCHEMA = "doc_id long, chunk_id long, total long, fingerprint string, ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_ranges_against_sets():
    r = random.Random(3)
    for _ in range(300):
        ranges, seen = np.zeros((0, 2), np.int64), set()
        for _ in range(6):
            ids = np.array([r.randrange(40) for _ in range(r.randint(1, 12))], np.int64)
            new = state.missing(ranges, ids)
            assert new.tolist() == sorted(set(ids.tolist()) - seen)
            ranges, seen = state.extended(ranges, new), seen | set(new.tolist())
            assert [x for a, b in ranges.tolist() for x in range(a, b + 1)] == sorted(seen)
            assert all(b + 1 < c for (_, b), (c, _) in zip(ranges.tolist(), ranges.tolist()[1:], strict=False))


def test_documents_against_sets():
    def model(known, rows):
        for k in dict.fromkeys(x[0] for x in rows):
            own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[4], x[1]))
            for mark in dict.fromkeys(x[3] for x in own):
                some = [x for x in own if x[3] == mark]
                if k not in known or known[k]["mark"] != mark:
                    known[k] = {"mark": mark, "seen": set(), "deadline": known[k]["deadline"] if k in known else 0}
                known[k]["total"] = max(x[2] for x in some)
                for c in sorted({x[1] for x in some} - known[k]["seen"]):
                    known[k]["seen"].add(c)
                    yield k, c, "chunk", len(known[k]["seen"]), known[k]["total"]
            known[k]["deadline"] = max(known[k]["deadline"], max(x[4] for x in own) + 10)

    for seed in range(60):
        r, documents, known = random.Random(seed), state.Documents.empty(), {}
        for _ in range(6):
            ids = [*range(20), 2**62, 2**62 + 1, -(2**63), 2**63 - 1]
            rows = [(r.choice(["a", "b", "c", None]), r.choice(ids), r.randint(1, 50), r.choice(["x", "x", "x", "y", None]), r.randrange(100)) for _ in range(r.randint(1, 30))]
            got = documents.add(pd.DataFrame(rows, columns=["id", "chunk_id", "total", "fingerprint", "ms"]), 10)
            assert sorted(got.astype(object).itertuples(index=False, name=None), key=repr) == sorted(model(known, rows), key=repr)
            documents = state.Documents.read(documents.bytes())
            limit = r.randrange(80)
            gone = documents.expire(documents.deadline < limit)
            assert {(k, d, t) for k, d, t in zip(gone["id"], gone["done"], gone["total"], strict=True)} == {(k, len(x["seen"]), x["total"]) for k, x in known.items() if x["deadline"] < limit}
            known = {k: x for k, x in known.items() if x["deadline"] >= limit}


def test_state_is_kept_by_groups_of_documents(spark, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    docs = [2**53 + i for i in range(300)] + [None]

    def send(rows, groups=2):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = state.chunks_once(streams.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), delay="1 minute", idle_ms=3_600_000, groups=groups)
        query = state.start_stateful(stream, out, checkpoint)
        query.awaitTermination()
        told = [s for p in query.recentProgress for s in p["stateOperators"]]
        assert {s["numRowsTotal"] for s in told} == {2}  # a call and a state for each group, not for each document
        return sorted(((r.doc_id, r.chunk_id, r.event, r.done, r.total) for r in spark.read.parquet(out).collect()), key=str)

    first = send([(d, c, 2, "a", at(i % 3 * 10)) for i, d in enumerate(docs) for c in (0, 0)])
    assert first == sorted([(d, 0, "chunk", 1, 2) for d in docs], key=str)
    second = send([(d, c, 2, "a", at(30)) for d in docs[::2] for c in (0, 1)])
    assert second == sorted(first + [(d, 1, "chunk", 2, 2) for d in docs[::2]], key=str)
    # the watermark is at the deadline of those last sent at 10: they and those of 0 are overdue, the others of their group are not
    third = send([(d, 1, 2, "a", at(71)) for d in docs[::2]])
    overdue = [(d, -1, "expired", 1, 2) for i, d in enumerate(docs) if i % 2 and i % 3 < 2]
    assert third == sorted(second + overdue, key=str)
    with pytest.raises(Exception, match="in 2 groups, not 3"):
        send([(d, 5, 2, "a", at(72)) for d in docs], groups=3)


def test_each_chunk_once_over_restarts(spark, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    n = 0

    def send(*rows):
        nonlocal n
        n += 1
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = state.chunks_once(streams.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), delay="1 minute", idle_ms=3_600_000)
        state.start_stateful(stream, out, checkpoint).awaitTermination()  # each call is a restart from the checkpoint
        return sorted((r.doc_id, r.chunk_id, r.event, r.done, r.total) for r in spark.read.parquet(out).collect())

    first = send((1, 0, 3, "a", at(0)), (1, 1, 3, "a", at(0)), (1, 1, 3, "a", at(0)), (2, 0, 2, None, at(1)))
    assert first == [(1, 0, "chunk", 1, 3), (1, 1, "chunk", 2, 3), (2, 0, "chunk", 1, 2)]
    again = send((1, 1, 3, "a", at(2)), (1, 2, 3, "a", at(2)), (2, 0, 2, None, at(2)))
    assert again == sorted([*first, (1, 2, "chunk", 3, 3)])
    changed = send((2, 0, 4, "b", at(3)))  # another text under the same id: from the beginning
    assert changed == sorted([*again, (2, 0, "chunk", 1, 4)])
    late = send((3, 0, 1, "c", at(300)))
    late = send((3, 0, 1, "c", at(301)))  # by now the others are overdue
    assert set(late) - set(changed) == {(1, -1, "expired", 3, 3), (2, -1, "expired", 1, 4), (3, 0, "chunk", 1, 1)}
    anew = send((1, 0, 3, "a", at(302)))
    assert len(anew) == len(late) + 1 and anew.count((1, 0, "chunk", 1, 3)) == 2  # forgotten, so it begins again


def test_progress_of_a_job(spark, tmp_path):
    stages = [("half", lambda df: df.filter("id % 2 = 0")), ("thirds", lambda df: df.filter("id % 3 = 0"))]
    p = progress.Progress(spark, f"file://{tmp_path}/log", "job")
    wanted = {"total": ("id", F.col("id")), "none": ("absent", F.col("id"))}
    assert progress.run(p, spark.range(100), stages, lambda df: df.count(), wanted) == 17
    told = [(r.event, r.stage, r.measures) for r in p.events().collect()]
    assert told == [
        ("job_started", None, {}), ("stage_started", "half", {}), ("stage_started", "thirds", {}),
        ("stage_completed", "half", {"rows": 50, "total": 2450}), ("stage_completed", "thirds", {"rows": 17, "total": 816}), ("job_completed", None, {}),
    ]


def test_progress_tells_failures_without_their_text(spark, tmp_path):
    def broken(df):
        raise KeyError("a secret value")

    p = progress.Progress(spark, f"file://{tmp_path}/log", "job")
    with pytest.raises(KeyError):
        progress.run(p, spark.range(3), [("bad", broken)], lambda df: df.count())
    q = progress.Progress(spark, f"file://{tmp_path}/log", "other")
    with pytest.raises(Exception, match="secret"):
        progress.run(q, spark.range(3), [("raise", lambda df: df.select(F.raise_error(F.lit("secret"))))], lambda df: df.collect())
    assert [(r.event, r.stage, r.error) for r in p.events().collect()][-1] == ("stage_failed", "bad", "KeyError")
    last = q.events().collect()[-1]
    assert last.event == "job_failed" and "secret" not in last.error


def test_progress_of_a_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.range(90).repartition(3).write.parquet(source)
    p = progress.Progress(spark, f"file://{tmp_path}/log", "streamed")
    docs = streams.read_stream(spark, source, spark.range(0).schema, files_per_trigger=1)
    progress.run_stream(p, docs, [("small", lambda df: df.filter("id < 45"))], f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    events = p.events().collect()
    batches = [r for r in events if r.event == "stage_completed"]
    assert len(batches) == 3 and {r.batch for r in batches} == {0, 1, 2} and sum(r.measures["rows"] for r in batches) == 45
    assert events[-1].event == "job_completed"
