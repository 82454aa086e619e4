"""Documents from files: path, format, content, error, and records where the format has them.

Files of all formats are read as bytes and unpacked in Arrow batches of a few files each; ``read_text`` and ``read_csv`` use Spark's own readers for large
ones.  A file that cannot be read becomes a row with ``error`` (the failure's class, never its message).
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import collapse

FORMATS = {
    "txt": "text", "text": "text", "md": "text", "csv": "csv", "tsv": "csv", "xlsx": "xlsx", "xls": "xls", "docx": "docx", "json": "json",
    "jsonl": "json", "pdf": "pdf", "html": "html", "htm": "html", "xml": "xml", "fhir": "fhir",
}
DOCUMENT = "path string, format string, content string, error string"


def format_of(path: Column) -> Column:
    """Format by extension, 'unknown' otherwise."""
    from maskwright.functions.types import literal_map

    return F.coalesce(F.try_element_at(literal_map(FORMATS), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is not valid."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, max_bytes: int | None = None) -> DataFrame:
    """path, length, modified and bytes of files; larger ones than ``max_bytes`` are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if max_bytes is not None:
        found = found.filter(F.col("length") <= max_bytes)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").alias("bytes"))


# ---------------------------------------------------------------- contents of single files (small helpers of one batch pass)

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> str:
    """Paragraphs with text, then tables, cells joined by ' | '."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = [t for t in map(text, body.findall(f"{_W}p")) if t.strip()]
    rows = [" | ".join(text(c).strip() for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n".join([*lines, *(["--- Tables ---", *rows] if rows else [])])


def xlsx_rows(data: bytes, only: str | None = None) -> dict[str, list[list[str]]]:
    """Cells as text by sheet (``only`` one of them, which must be there); missing cells are ''.  Sheets are found by the workbook's relations."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    titles = [(s.get("name"), s.get(f"{_R}id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    if only is not None and only not in [t for t, _ in titles]:
        raise KeyError(only)
    out = {}
    for i, (title, relation) in enumerate(titles, 1):
        if only not in (None, title):
            continue
        rows, target = [], targets.get(relation, f"worksheets/sheet{i}.xml")
        for r in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for c in r.findall(f"{_S}c"):
                letters = re.match("[A-Z]+", c.get("r", "A")).group()
                column = 0
                for x in letters:
                    column = 26 * column + ord(x) - 64
                value = c.find(f"{_S}v")
                if c.get("t") == "s":
                    cells[column - 1] = shared[int(value.text)]
                elif c.get("t") == "inlineStr":
                    cells[column - 1] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                else:
                    cells[column - 1] = value.text if value is not None else ""
            rows.append([cells.get(k) or "" for k in range(max(cells, default=-1) + 1)])
        out[title] = rows
    return out


def records_of(rows: list[list[str]], skip: int = 0) -> list[dict[str, str]]:
    """Records under the header row after ``skip`` rows; unnamed columns are Column_i."""
    if len(rows) <= skip:
        return []
    head = [h or f"Column_{i}" for i, h in enumerate(rows[skip])]
    return [{h: (r[i] if i < len(r) else "") for i, h in enumerate(head)} for r in rows[skip + 1 :]]


def xml_lines(node: ElementTree.Element, depth: int = 0) -> list[str]:
    """Indented 'tag [attributes]' and text lines; text after child elements is left out."""
    name = node.tag.rpartition("}")[2]
    mark = f" [{', '.join(f'{k}={v}' for k, v in node.attrib.items())}]" if node.attrib else ""
    text = (node.text or "").strip()
    out = ["  " * depth + name + mark + (f": {text}" if text else "")]
    for child in node:
        out += xml_lines(child, depth + 1)
    return out


def xml_value(node: ElementTree.Element):
    """Nested value: '@attributes', '#text', repeated children as lists."""
    out: dict = {"@attributes": dict(node.attrib)} if node.attrib else {}
    for child in node:
        name, value = child.tag.rpartition("}")[2], xml_value(child)
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    text = (node.text or "").strip()
    if text and not out:
        return text
    return out | ({"#text": text} if text else {})


def sheet_reader(only: str | None = None, skip: int = 0) -> Callable[[bytes], str]:
    """A reader of sheets, or of one, whose header row comes after ``skip`` rows: '[sheet] name: value, ...' lines; for ``load(readers=...)``."""

    def read(data: bytes) -> str:
        return "\n".join(f"[{sheet}] " + ", ".join(f"{k}: {v}" for k, v in r.items()) for sheet, rows in xlsx_rows(data, only).items() for r in records_of(rows, skip))

    return read


def csv_reader(header: bool = True, sep: str = ",", quote: str = '"') -> Callable[[bytes], str]:
    """A reader of delimited text: 'name: value, ...' lines under a header, else each row's cells joined."""

    def read(data: bytes) -> str:
        rows = [r for r in csv.reader(io.StringIO(_decode(data)), delimiter=sep, quotechar=quote) if r]
        if not header:
            return "\n".join(", ".join(r) for r in rows)
        return "\n".join(", ".join(f"{h}: {r[i] if i < len(r) else ''}" for i, h in enumerate(rows[0])) for r in rows[1:])

    return read


def _decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _missing(name: str) -> Callable[[bytes], str]:
    def read(data: bytes) -> str:
        raise NotImplementedError(name)  # needs a reader that is registered by the caller

    return read


READERS: dict[str, Callable[[bytes], str]] = {
    "docx": docx_text,
    "xlsx": sheet_reader(),
    "csv": csv_reader(),
    "xml": lambda d: "\n".join(xml_lines(ElementTree.fromstring(d))),
    "json": lambda d: json.dumps(json.loads(_decode(d)), indent=2, ensure_ascii=False),
    "fhir": lambda d: json.dumps(json.loads(_decode(d)), indent=2, ensure_ascii=False),
    "html": lambda d: html_plain(_decode(d)),
    "pdf": _missing("pdf"),
    "xls": _missing("xls"),
}


def html_plain(source: str) -> str:
    out = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", source)
    out = html.unescape(re.sub(r"(?s)<[^>]*>", "\n", out))
    return "\n".join(x for x in (line.strip() for line in out.split("\n")) if x)


def load(spark: SparkSession, path: str, format: str | None = None, glob: str | None = None, recursive: bool = False, max_bytes: int | None = None, keep_spaces: bool = False, readers: dict[str, Callable[[bytes], str]] | None = None, metadata: bool = False) -> DataFrame:
    """path, format, content, error of all files under a path; ``readers`` adds or replaces formats.  With ``metadata`` also length (bytes) and modified."""
    known = {**READERS, **(readers or {})}
    found = files(spark, path, glob, recursive, max_bytes)
    found = found.withColumn("format", F.lit(format) if format else format_of(F.col("path")))

    more = ["length", "modified"] if metadata else []

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, f, data in zip(pdf["path"], pdf["format"], pdf["bytes"], strict=True):
                try:
                    data = bytes(data)
                    if f == "json" and isinstance(value := json.loads(_decode(data)), dict) and "resourceType" in value:
                        f = "fhir"
                    rows.append((p, f, known.get(f, _decode)(data), None))
                except Exception as e:  # one bad file does not end the others
                    rows.append((p, f, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "format", "content", "error"]).assign(**{c: pdf[c].to_numpy() for c in more})

    out = found.select("path", "format", "bytes", *more).mapInPandas(read, DOCUMENT + (", length long, modified timestamp" if metadata else ""))
    return out if keep_spaces else out.withColumn("content", F.when(F.col("format").isin("text", "html"), collapse(F.col("content"))).otherwise(F.col("content")))


def rejects(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("error").isNotNull()).select("path", "format", "error")


# ---------------------------------------------------------------- tables and pages


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", quote: str = '"') -> DataFrame:
    """Every cell as text."""
    return spark.read.csv(path, header=header, sep=sep, quote=quote, multiLine=True, inferSchema=False)


def record_text(columns: list[str]) -> Column:
    """'name: value, name: value' of a record."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def combined(columns: list[str]) -> Column:
    """'[name] value' blocks joined by blank lines; null and blank cells are left out."""
    cell = lambda c: F.col(c).cast("string")
    return F.concat_ws("\n\n", *[F.when(F.trim(cell(c)) != "", F.concat(F.lit(f"[{c}] "), cell(c))) for c in columns])


def plain(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def case_id(column: str | None, row: Column, columns: list[str] | None = None) -> Column:
    """The named column, else the first of the table's ``columns``, else Row-n."""
    column = column or (columns[0] if columns else None)
    numbered = F.concat(F.lit("Row-"), row.cast("string"))
    return F.coalesce(F.col(column).cast("string"), numbered) if column else numbered


def rows_to_process(table: DataFrame, text: Column, limit: int | None = None, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with a text, rows without one) of the first ``limit`` rows in an order; the limit is the caller's."""
    some = table.withColumn("text", text)
    some = some if limit is None else some.orderBy(*(order or table.columns)).limit(limit)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return some.filter(~blank), some.filter(blank)


def page_totals(table: DataFrame, size: int) -> DataFrame:
    """One row: rows and pages of a preview."""
    return table.agg(F.count("*").alias("rows")).select("rows", F.ceil(F.col("rows") / size).cast("long").alias("pages"))


def fhir_metadata(content: Column) -> Column:
    """struct(resource_type, resource_id) of a FHIR resource, nulls for other JSON."""
    v = F.try_parse_json(content)
    return F.struct(F.try_variant_get(v, "$.resourceType", "string").alias("resource_type"), F.try_variant_get(v, "$.id", "string").alias("resource_id"))


def read_text(spark: SparkSession, path: str, keep_spaces: bool = False) -> DataFrame:
    """path, content and size of whole text files, by Spark's own reader."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))
    return found if keep_spaces else found.withColumn("content", collapse(F.col("content")))


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(source: Column) -> Column:
    """Text of a page, by built-in functions: scripts, styles and comments out, tags to line breaks, common entities, blank lines out."""
    out = F.regexp_replace(source, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"<[^>]*>", "\n")
    for mark, char in ENTITIES:
        out = F.replace(out, F.lit(mark), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]*\n[ \t\r\n]*", "\n"), F.lit("\n "))


def html_title(source: Column) -> Column:
    return F.trim(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page(table: DataFrame, number: int, size: int, order: list[str]) -> DataFrame:
    """The number-th page (from 1) in a total order."""
    return table.orderBy(*order).offset((number - 1) * size).limit(size)


def is_fhir(content: Column) -> Column:
    return F.variant_get(F.try_parse_json(content), "$.resourceType", "string").isNotNull()
