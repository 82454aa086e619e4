"""Workbooks and word files as Spark data sources: tables are read from sheets and written as sheets, files and tasks at a time.

    spark.dataSource.register(Workbooks)
    df.write.format("workbooks").mode("overwrite").save("file:///shared/folder")
    spark.read.format("workbooks").schema("id long, name string").option("sheet", "People").load("file:///shared/folder")

Reading has a task per file, or per sheet with ``perSheet``; a sheet is read row by row.  Writing has a file per task and begins a new sheet where one is full or, with
``sheetColumn``, where that column's value changes (``write_sheets`` lays rows out for it).  A task writes under a hidden name; only when all tasks have ended do the files get
their names, and files of tasks that failed or of a job that is given up are removed.  Folders are reached by pyarrow, so all executors and the driver need the
same file system there: a shared mount, HDFS or an object store.
"""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampNTZType, TimestampType

from maskwright.sources.documents import _R, _S, _W

SHEET_ROWS = 1_048_576  #: rows of a sheet, the header included
#: columns that a schema may name besides those of the header
PATH, SHEET, ROW = "__path", "__sheet", "__row"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _files(path: str, suffix: str) -> tuple[arrow_fs.FileSystem, list[str]]:
    """The file system of a path and the files with a suffix there: itself, or those of the folder, by name; hidden ones do not count."""
    system, at = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else arrow_fs.FileSystem.from_uri(f"file:///{path}")
    info = system.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == arrow_fs.FileType.File:
        return system, [at]
    found = system.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    return system, sorted(f.path for f in found if f.is_file and f.path.lower().endswith(suffix) and not re.search(r"(^|/)[._]", f.path[len(at) :].lstrip("/")))


def _bytes(system: arrow_fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as stream:
        return stream.read()


# ---------------------------------------------------------------- sheets


def sheet_targets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    whole = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), whole(links[s.get(f"{_R}id")])) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers (from 1) and cells as text; empty cells are null."""
    with book.open(part) as stream:
        number = 0
        for _, e in ElementTree.iterparse(stream):
            if e.tag != f"{_S}row":
                continue
            number = int(e.get("r", number + 1))
            cells: list[str | None] = []
            for c in e.iter(f"{_S}c"):
                at = 0
                for x in re.match("[A-Z]*", c.get("r", "")).group():
                    at = 26 * at + ord(x) - 64
                at = at - 1 if at else len(cells)
                value = c.find(f"{_S}v")
                if c.get("t") == "inlineStr":
                    text = _plain("".join(t.text or "" for t in c.iter(f"{_S}t")))
                elif value is None or value.text is None:
                    text = None
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else _plain(value.text)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text
            yield number, cells
            e.clear()


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_plain("".join(t.text or "" for t in s.iter(f"{_S}t"))) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_S}si")]


def converted(text: str | None, kind: DataType):
    """A cell as a value of a type; null where it is none."""
    if text is None or isinstance(kind, StringType):
        return text
    try:
        if isinstance(kind, BooleanType):
            return {"1": True, "true": True, "0": False, "false": False}.get(text.strip().lower())
        if isinstance(kind, IntegralType):
            value = Decimal(text)
            return int(value) if value == int(value) else None
        if isinstance(kind, (DoubleType, FloatType)):
            return float(text)
        if isinstance(kind, DateType):
            return datetime.date.fromisoformat(text)
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return datetime.datetime.fromisoformat(text)
    except (ValueError, ArithmeticError):
        return None
    raise TypeError(f"cells cannot be read as {kind.simpleString()}")


class SheetWriter:
    """A workbook written from its first to its last row; nothing but the row at hand is kept."""

    def __init__(self, stream, names: list[str], first: str = "Sheet1", rows: int = SHEET_ROWS):
        self.book, self.names, self.rows, self.sheets, self.sheet, self.used = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), names, rows, [], None, 0
        self.first = first

    def _cell(self, column: int, row: int, value) -> str:
        letters, n = "", column + 1
        while n:
            n, rest = divmod(n - 1, 26)
            letters = chr(65 + rest) + letters
        at = f"{letters}{row}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float, Decimal)) and value == value and abs(value) != float("inf"):
            return f'<c r="{at}"><v>{value!r}</v></c>' if not isinstance(value, Decimal) else f'<c r="{at}"><v>{value}</v></c>'
        text = value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)
        text = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text.encode("utf-8", "replace").decode())
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def _line(self, values) -> None:
        self.used += 1
        cells = "".join(self._cell(i, self.used, v) for i, v in enumerate(values))
        self.sheet.write(f'<row r="{self.used}">{cells}</row>'.encode())

    def begin(self, title: str) -> None:
        """A new sheet with the header; a title that there is gets a number."""
        self._end()
        base = re.sub(r"[\[\]:*?/\\]", "_", title or "Sheet").strip("'")[:31] or "Sheet"
        name, n = base, 1
        while name.lower() in {s.lower() for s in self.sheets}:
            n += 1
            name = f"{base[: 30 - len(str(n))]}_{n}"
        self.sheets.append(name)
        self.sheet, self.used, self.title = self.book.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True), 0, title
        self.sheet.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self._line(self.names)

    def add(self, values) -> None:
        if self.sheet is None:
            self.begin(self.first)
        if self.used >= self.rows:
            self.begin(self.title)
        self._line(values)

    def _end(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        if not self.sheets:
            self.begin(self.first)
        self._end()
        head, office = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org"
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(self.sheets, 1))
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(self.sheets) + 1))
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(self.sheets) + 1))
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{office}/spreadsheetml/2006/main" xmlns:r="{office}/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{office}/package/2006/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        }
        for name, text in parts.items():
            self.book.writestr(name, head + text)
        self.book.close()


# ---------------------------------------------------------------- data sources


@dataclass
class _Piece(InputPartition):
    path: str
    sheet: str | None = None

    def __init__(self, path: str, sheet: str | None = None):
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.where, self.schema = options["path"], schema
        self.only, self.skip, self.header = options.get("sheet"), int(options.get("skip", 0)), options.get("header", "true").lower() == "true"
        self.each = options.get("persheet", "false").lower() == "true"

    def partitions(self) -> list[_Piece]:
        system, paths = _files(self.where, ".xlsx")
        if not self.each:
            return [_Piece(p, self.only) for p in paths]
        titles = {p: [t for t, _ in sheet_targets(zipfile.ZipFile(io.BytesIO(_bytes(system, p))))] for p in paths}
        return [_Piece(p, t) for p in paths for t in titles[p] if self.only in (None, t)]

    def read(self, piece: _Piece) -> Iterator[tuple]:
        system, _ = _files(self.where, ".xlsx")
        book = zipfile.ZipFile(io.BytesIO(_bytes(system, piece.path)))
        shared, kinds = shared_strings(book), [(f.name, f.dataType) for f in self.schema.fields]
        for title, part in sheet_targets(book):
            if piece.sheet not in (None, title):
                continue
            places: dict[str, int] | None = None
            for number, cells in sheet_rows(book, part, shared):
                if number <= self.skip:
                    continue
                if places is None:
                    names = cells if self.header else [f"Column_{i}" for i in range(len(self.schema.fields))]
                    places = {}
                    for i, name in enumerate(names):
                        places.setdefault(name or f"Column_{i}", i)
                    if self.header:
                        continue
                own = {PATH: piece.path, SHEET: title, ROW: number}
                at = lambda name: cells[places[name]] if name in places and places[name] < len(cells) else None  # noqa: B023,E731
                yield tuple(own[name] if name in own else list(cells) if name == "cells" and "cells" not in places else converted(at(name), kind) for name, kind in kinds)


@dataclass
class _Written(WriterCommitMessage):
    aside: str
    name: str


class _SheetsOut(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.where, self.overwrite, self.names, self.job = options["path"], overwrite, schema.names, uuid.uuid4().hex
        self.sheet, self.column, self.rows = options.get("sheet", "Sheet1"), options.get("sheetcolumn"), int(options.get("sheetrows", SHEET_ROWS))
        if self.rows < 2:
            raise ValueError("a sheet has a header and a row at least")

    def _place(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.where)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        system, folder = self._place()
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.xlsx"
        aside = f"{folder}/.{name}.{task.attemptNumber()}-{uuid.uuid4().hex}"
        names = [n for n in self.names if n != self.column]
        try:
            with system.open_output_stream(aside) as stream:
                out, last = SheetWriter(stream, names, self.sheet, self.rows), object()
                for row in rows:
                    if self.column and row[self.column] != last:
                        last = row[self.column]
                        out.begin(str(last))
                    out.add([row[n] for n in names])
                out.close()
        except BaseException:
            if system.get_file_info(aside).type != arrow_fs.FileType.NotFound:
                system.delete_file(aside)
            raise
        return _Written(aside, name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = self._place()
        if self.overwrite:
            for f in system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".xlsx") and not f.base_name.startswith("."):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(m.aside, f"{folder}/{m.name}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = self._place()
        for f in system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)):
            if f.is_file and self.job in f.base_name:
                system.delete_file(f.path)


def _options(source: DataSource) -> dict[str, str]:
    """Names in lower case: Spark takes them in any."""
    return {k.lower(): v for k, v in source.options.items()}


class Workbooks(DataSource):
    """``workbooks``: reads and writes XLSX.  Without a schema a read gives __path, __sheet, __row and the cells as text; dates are written and read as ISO text."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return f"{PATH} string, {SHEET} string, {ROW} long, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(_options(self), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SheetsOut(_options(self), schema, overwrite)


class _WordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]

    def partitions(self) -> list[_Piece]:
        return [_Piece(p) for p in _files(self.where, ".docx")[1]]

    def read(self, piece: _Piece) -> Iterator[tuple]:
        system, _ = _files(self.where, ".docx")
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(_bytes(system, piece.path))).read("word/document.xml")).find(f"{_W}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
        n = 0
        for e in body:
            if e.tag == f"{_W}p":
                yield piece.path, n, "paragraph", text(e)
                n += 1
            elif e.tag == f"{_W}tbl":
                for r in e.findall(f"{_W}tr"):
                    yield piece.path, n, "row", " | ".join(text(c).strip() for c in r.findall(f"{_W}tc"))
                    n += 1


class WordFiles(DataSource):
    """``wordfiles``: paragraphs and table rows of DOCX files in their order: __path, item, kind, text."""

    @classmethod
    def name(cls) -> str:
        return "wordfiles"

    def schema(self) -> str:
        return f"{PATH} string, item long, kind string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WordReader(_options(self))


def register(spark) -> None:
    for source in (Workbooks, WordFiles):
        spark.dataSource.register(source)


def write_sheets(df: DataFrame, path: str, sheet_column: str | None = None, files: int | None = None, mode: str = "overwrite") -> None:
    """A table as workbooks under a path: by ``sheet_column`` with a sheet for each value in a file, over ``files`` files (by default as the table is partitioned)."""
    register(df.sparkSession)
    if files:
        df = df.repartition(files, F.xxhash64(*df.columns))  # a frequent value is spread over all files
    writer = df.write.format("workbooks").mode(mode)
    if sheet_column:
        writer = df.sortWithinPartitions(sheet_column).write.format("workbooks").mode(mode).option("sheetColumn", sheet_column)
    writer.save(path)
