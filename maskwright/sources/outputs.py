"""Results written out: tables, reports, masked files."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.replacement import Replacer
from maskwright.plans.scratch import written

HELPERS = ("__row", "__sheet")


def output_path(base: str, kind: str, name: str, stamp: str | None = None) -> str:
    """<base>/<kind>/<name>[_<stamp>]"""
    return f"{base.rstrip('/')}/{kind}/{name}" + (f"_{stamp}" if stamp else "")


def write_table(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    df.drop(*HELPERS).write.mode("overwrite").options(**options).format(format).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report's few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a markdown table; bars in cells are escaped, line breaks become spaces."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def sheet_names(names: DataFrame) -> DataFrame:
    """Sheet names of 31 characters at most, numbered where they repeat.  ``names``: ord, name."""
    cut = names.withColumn("sheet", F.substring(F.regexp_replace("name", r"[\[\]:*?/\\]", "_"), 1, 31))
    n = F.row_number().over(Window.partitionBy("sheet").orderBy("ord"))
    made = F.when(F.col("n") > 1, F.concat(F.substring("sheet", 1, 27), F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("sheet"))
    numbered = cut.withColumn("n", n).withColumn("made", made)
    # a numbered name may be another sheet's: of those the first keeps it, the others get their place in the workbook as a name (31 characters, unlike any other)
    again = F.row_number().over(Window.partitionBy("made").orderBy((F.col("n") > 1).cast("int"), "ord"))
    unlike = F.concat(F.substring("made", 1, 15), F.lit("~"), F.lpad(F.col("ord").cast("string"), 15, "0"))
    return numbered.withColumn("again", again).select("ord", F.when(F.col("again") > 1, unlike).otherwise(F.col("made")).alias("sheet"))


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    return Replacer(dict(reversed(pairs)))(text)


def patched_csv(data: bytes, pairs: list[tuple[str, str]]) -> bytes:
    """Cells masked; the dialect and encoding (UTF-8 with or without mark, CP950, Big5) stay, UTF-8 is written with a mark."""
    for encoding in ("utf-8-sig", "utf-8", "cp950", "big5"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("utf-8", "replace")
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:65536], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    out = io.StringIO()
    csv.writer(out, dialect).writerows([[_replaced(c, pairs) for c in r] for r in csv.reader(io.StringIO(text), dialect)])
    return out.getvalue().encode("utf-8-sig")


def patched_zip(data: bytes, pairs: list[tuple[str, str]], parts: dict[str, str], tag: str) -> bytes:
    """An office file with the text of one XML tag masked in the named parts (each with the element whose runs of text belong together); everything else is copied."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as book, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in book.infolist():
            raw = book.read(item.filename)
            for part, unit in parts.items():
                if item.filename.startswith(part):
                    raw = _over_runs(raw.decode("utf-8"), tag, unit, pairs).encode("utf-8")
            new.writestr(item, raw)
    return out.getvalue()


def _over_runs(raw: str, tag: str, unit: str, pairs: list[tuple[str, str]]) -> str:
    """Within each ``unit`` element (a paragraph, a shared string), text elements are masked one by one; where a value stands across several, the whole
    masked text goes into the first and the others are emptied."""
    import re
    from xml.sax.saxutils import escape, unescape

    text = re.compile(rf"(<{tag}(?:\s[^>]*)?>)([^<]*)(</{tag}>)")

    def one(m: re.Match) -> str:
        whole = m.group()
        joined = unescape("".join(t[1] for t in text.findall(whole)))
        alone = "".join(_replaced(unescape(t[1]), pairs) for t in text.findall(whole))
        masked = _replaced(joined, pairs)
        if masked == alone:
            return text.sub(lambda t: t[1] + escape(_replaced(unescape(t[2]), pairs)) + t[3], whole)
        rest = iter([masked])
        return text.sub(lambda t: t[1] + escape(next(rest, "")) + t[3], whole)

    return re.sub(rf"(?s)<{unit}(?:\s[^>]*)?>.*?</{unit}>", one, raw)


def masked_files(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, bytes, error of files with their pairs applied, by format.  ``files``: path, format, bytes.  ``pairs``: path, value, masked.

    Unknown formats come back with null bytes, broken files with null bytes and the failure's class.
    """
    listed = pairs.groupBy("path").agg(F.collect_list(F.struct("value", "masked")).alias("pairs"))

    def patch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, data, some in zip(pdf["format"], pdf["bytes"], pdf["pairs"], strict=True):
                p = [(x["value"], x["masked"]) for x in some] if some is not None else []
                try:
                    out.append((patched(f, bytes(data), p), None))
                except Exception as e:  # one broken file does not end the others
                    out.append((None, type(e).__name__))
            yield pd.DataFrame({"path": pdf["path"], "bytes": [b for b, _ in out], "error": [e for _, e in out]})

    return files.join(listed, "path", "left").select("path", "format", "bytes", "pairs").mapInPandas(patch, "path string, bytes binary, error string")


def patched(format: str, data: bytes, pairs: list[tuple[str, str]]) -> bytes | None:
    """A file's bytes with the pairs applied; None for formats that are not known."""
    if format == "csv":
        return patched_csv(data, pairs)
    if format in ("text", "json", "xml", "html", "fhir"):
        return _replaced(data.decode("utf-8", "replace"), pairs).encode()
    if format == "xlsx":
        return patched_zip(data, pairs, {"xl/sharedStrings.xml": "si", "xl/worksheets/": "is"}, "t")
    if format == "docx":
        return patched_zip(data, pairs, {"word/document.xml": "w:p"}, "w:t")
    return None


def delete_expired(spark, listing: DataFrame, now: Column, hours: float) -> int:
    """Delete the expired files of a listing; how many were deleted.  Their paths pass the driver one partition at a time."""
    gone = 0
    for row in expired(listing, now, hours).select("path").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False))
    return gone


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, bytes) as a file of a folder that all tasks reach by pyarrow; name and path of what was written.

    A file gets its name when it is whole, so a task that runs again replaces it by the same bytes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = arrow_fs.FileSystem.from_uri(folder)
        for pdf in batches:
            paths = []
            for name, data in zip(pdf["name"], pdf["bytes"], strict=True):
                path = f"{root}/{name}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(bytes(data))
                system.move(aside, path)
                paths.append(path)
            yield pd.DataFrame({"name": pdf["name"], "path": paths})

    return written(files.select("name", "bytes").mapInPandas(write, "name string, path string"), "files")


def numbered_names(files: DataFrame) -> DataFrame:
    """Equal names (in any case) told apart: the second ``a.txt`` becomes ``a_2.txt``, and if there is a file of that name, ``a_2_<digest>.txt``.  Columns besides ``name`` order them."""
    by = Window.partitionBy(F.lower("name")).orderBy(*[c for c in files.columns if c != "name"])
    stem, end = (F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", i) for i in (1, 2))
    made = F.concat(stem, F.lit("_"), F.col("__n").cast("string"))
    taken = files.select(F.lower("name").alias("__low"), F.lit(True).alias("__taken")).distinct()
    out = files.withColumn("__n", F.row_number().over(by)).withColumn("__low", F.lower(F.concat(made, end))).join(taken, "__low", "left")
    name = F.when(F.col("__n") == 1, F.col("name")).when(F.col("__taken"), F.concat(made, F.lit("_"), F.substring(F.sha2("name", 256), 1, 8), end)).otherwise(F.concat(made, end))
    return out.withColumn("name", name).select(*files.columns)


def write_archives(files: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Files (name, bytes) as ZIP archives of about ``archive_bytes`` each; archive, files and bytes of each.  Any number of files is taken: archives are written by tasks."""
    size = files.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    parts = max(1, -(-size // archive_bytes))
    named = numbered_names(files.select("name", F.xxhash64("bytes").alias("__h"), "bytes")).withColumn("__p", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = arrow_fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        last, stream, book, aside, count, total = None, None, None, "", 0, 0

        def closed() -> pd.DataFrame:
            book.close()
            stream.close()
            system.move(aside, f"{root}/archive-{last:05d}.zip")
            return pd.DataFrame({"archive": [f"archive-{last:05d}.zip"], "files": [count], "bytes": [total]})

        for pdf in batches:
            for p, name, data in zip(pdf["__p"].tolist(), pdf["name"], pdf["bytes"], strict=True):
                if p != last:
                    if book is not None:
                        yield closed()
                    aside, last, count, total = f"{root}/.{uuid.uuid4().hex}", p, 0, 0
                    stream = system.open_output_stream(aside)
                    book = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                book.writestr(name, bytes(data))
                count, total = count + 1, total + len(data)
        if book is not None:
            yield closed()

    dealt = named.repartition(parts, "__p").sortWithinPartitions("__p", "name").select("__p", "name", "bytes")
    return written(dealt.mapInPandas(pack, "archive string, files long, bytes long"), "archives")


def expired(listing: DataFrame, now: Column, hours: float) -> DataFrame:
    """Files of a listing (path, modified) older than so many hours."""
    return listing.filter(F.col("modified") < now - F.make_dt_interval(hours=F.lit(int(hours))))
