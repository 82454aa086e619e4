"""Files by byte ranges against the same files read at once, at any split size."""

import random
from glob import glob

import pytest

from maskwright import index_queries
from maskwright.operators.chunking import windows
from maskwright.sources import large_files
from maskwright.sources.large_files import file_chunks, file_lines


def some_files():
    r = random.Random(12)
    letters = "aé王😀\n .\r"
    yield "a.txt", "".join(r.choice(letters) for _ in range(700)).encode()
    yield "b.txt", ("x" * 300 + "\n" + "😀" * 200 + "\n\nlast").encode()
    yield "c.txt", b"caf\xe9 \x80\x80\x80\x80\x80 latin\n" * 20  # not UTF-8
    yield "d.txt", b""
    yield "e.txt", b"\n"
    yield "f.txt", "é".encode() * 100 + b"\xc3"  # a character cut off at the end


@pytest.mark.parametrize("split", [1 << 20, 64, 5])
def test_chunks_and_lines_at_any_split(spark, tmp_path, split):
    files = dict(some_files())
    if split < 10:
        files = {k: v[:120] for k, v in files.items()}  # a task for each range
    texts = {}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        try:
            texts[name] = data.decode()
        except UnicodeDecodeError:
            texts[name] = data.decode("latin-1")
    name = lambda p: p.rsplit("/", 1)[1]
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string")
    for size, overlap in ((50, 10), (40, 0)):
        got = file_chunks(spark, f"file://{tmp_path}", size, overlap, split)
        expected = windows(df, size, overlap, keys=("path",)).collect()
        columns = ("chunk_id", "start_pos", "end_pos", "content", "size", "content_hash")
        assert sorted((name(r.path), *(r[c] for c in columns)) for r in got.collect()) == sorted((r.path, *(r[c] for c in columns)) for r in expected)
    lines = []
    for k, t in texts.items():
        parts, at = t.split("\n"), 0
        for i, x in enumerate(parts):
            if i < len(parts) - 1 or x:
                lines.append((k, at, x))
            at += len(x) + 1
    assert sorted((name(r.path), r.start_pos, r.line) for r in file_lines(spark, f"file://{tmp_path}", split, read_on=16).collect()) == sorted(lines)


@pytest.mark.parametrize("split", [1 << 20, 64, 7])
def test_files_that_follow_one_another_are_one_text(spark, tmp_path, split):
    data = "".join(random.Random(5).choice("aé王😀\n .\r") for _ in range(300)).encode() + b"\n" + "😀".encode() * 60 + b"\nlast"
    for k, utf8 in enumerate((True, False)):
        data = data if utf8 else data + b"\xff"
        text = data.decode("utf-8" if utf8 else "latin-1")
        folder = tmp_path / str(k)
        folder.mkdir()
        cuts = [0, 3, 4, 4, 50, 51, 400, len(data)]  # within characters and lines; one file is empty
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (folder / f"part-{i:05}.txt").write_bytes(data[a:b])
        expected = windows(spark.createDataFrame([(text,)], "text string").selectExpr("'x' as path", "text"), 50, 10, keys=("path",)).collect()
        got = file_chunks(spark, f"file://{folder}", 50, 10, split, joined=True).collect()
        assert sorted((r.chunk_id, r.start_pos, r.end_pos, r.content) for r in got) == sorted((r.chunk_id, r.start_pos, r.end_pos, r.content) for r in expected)
        lines, at = [], 0
        for x in text.split("\n"):
            lines.append((at, x))
            at += len(x) + 1
        assert sorted((r.start_pos, r.line) for r in file_lines(spark, f"file://{folder}", split, read_on=16, joined=True).collect()) == lines


def test_ranges_share_tasks_and_the_text_is_written_by_several(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"x" * 5000)
    assert large_files.ranges(spark, f"file://{tmp_path}", 10).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism  # 500 ranges
    monkeypatch.setattr(large_files, "TASK_BYTES", 100)
    assert large_files.ranges(spark, f"file://{tmp_path}", 10).rdd.getNumPartitions() == 50
    (tmp_path / "in").mkdir()
    rows = spark.range(700).selectExpr("699 - id as doc_id", "repeat(chr(int(65 + id % 26)), 100000) as text")
    rows.write.parquet(f"file://{tmp_path}/in/documents.parquet")
    folder = index_queries._one_text(spark, f"file://{tmp_path}/in")
    parts = sorted(glob(folder.removeprefix("file://") + "/*.txt"))
    assert len(parts) == 3
    assert b"".join(open(p, "rb").read() for p in parts) == b"".join(bytes([65 + i % 26]) * 100000 + b"\n" for i in range(699, -1, -1))
