"""A data source for workbooks (.xlsx): sheets of a zip of XML, read in ranges of rows.

`spark.dataSource.register(Workbook)`, then `spark.read.format("workbook").option("sheet", name).load(path)`. Options: sheet (the first one by default),
rowsPerPart (rows of a task's range). All columns are strings, named by the sheet's first row; casts come later, as for CSV files.
A range is read as a stream from the sheet's start, so a task holds one row, the workbook's shared strings and its styles, never a sheet. Paths are opened by
pyarrow, so they may be local or in any store that it knows; every executor must reach them.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from xml.etree.ElementTree import Element, iterparse, parse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# Numbers of the built-in formats that show dates or times, and the name spaces of relations.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _name(e: Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: Element) -> str:
    """The text of a string: its runs joined, without readings."""
    return "".join(t.text or "" for part in e for t in ([part] if _name(part) == "t" else [x for x in part if _name(x) == "t"] if _name(part) == "r" else []))


def _place(ref: str) -> int:
    """The column of a cell such as AB12, from 0."""
    n = 0
    for ch in ref.upper():
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch) - 64
    return n - 1


class Book:
    """An open workbook: its sheets, and the rows of one as lists of strings."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.names = z, set(z.namelist())
        root = parse(z.open("xl/workbook.xml")).getroot()
        target = {e.get("Id"): e.get("Target") for e in parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        at = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
        self.sheets = {e.get("name"): at(target[e.get(_REL)]) for e in root.iter() if _name(e) == "sheet" and e.get(_REL) in target}
        late = any(_name(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root)
        self.day0 = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)

    def path(self, sheet: str | None) -> str:
        if sheet is None:
            return next(iter(self.sheets.values()))
        if sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r} among {list(self.sheets)}")
        return self.sheets[sheet]

    def last_row(self, path: str) -> int | None:
        """What the sheet says its last row is, if it says so. It may be wrong."""
        with self.z.open(path) as f:
            for _, e in iterparse(f, ("start",)):
                if _name(e) == "dimension":
                    found = re.search(r"(\d+)$", e.get("ref", ""))
                    return int(found[1]) if found else None
                if _name(e) == "sheetData":
                    return None
        return None

    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.names:
            return []
        out = []
        with self.z.open("xl/sharedStrings.xml") as f:
            for _, e in iterparse(f):
                if _name(e) == "si":
                    out.append(_text(e))
                    e.clear()
        return out

    def date_styles(self) -> set[int]:
        """The styles of cells that show dates or times."""
        if "xl/styles.xml" not in self.names:
            return set()
        root = parse(self.z.open("xl/styles.xml")).getroot()
        shown = lambda code: re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.split(";")[0].lower())) is not None
        own = {int(e.get("numFmtId")): shown(e.get("formatCode", "")) for e in root.iter() if _name(e) == "numFmt"}
        formats = [int(x.get("numFmtId", 0)) for e in root if _name(e) == "cellXfs" for x in e]
        return {i for i, n in enumerate(formats) if own.get(n, n in _DATES)}

    def rows(self, path: str, first: int, last: int | None) -> Iterator[tuple[int, list[str | None]]]:
        """Rows with their numbers, from first to last, both included; those without a value are left out."""
        strings, dates = self.strings(), self.date_styles()
        number = 0
        with self.z.open(path) as f:
            above: list[Element] = []
            for event, e in iterparse(f, ("start", "end")):
                if event == "start":
                    above.append(e)
                    continue
                above.pop()
                if _name(e) != "row":
                    continue
                number = int(e.get("r", number + 1))
                if last is not None and number > last:
                    return
                if number >= first:
                    values: list[str | None] = []
                    for c in e:
                        if _name(c) == "c":
                            at = _place(c.get("r")) if c.get("r") else len(values)
                            values.extend([None] * (at - len(values)))
                            values.append(self._value(c, strings, dates))
                    if any(v is not None for v in values):
                        yield number, values
                above[-1].remove(e)  # what was read isn't kept

    def top(self, path: str) -> tuple[int, list[str | None]]:
        """The first row with a value, which names the columns."""
        return next(self.rows(path, 1, None), (1, []))

    def _value(self, c: Element, strings: list[str], dates: set[int]) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_text(x) for x in c if _name(x) == "is"), None) or None
        v = next((x.text for x in c if _name(x) == "v"), None)
        if not v or kind == "e":
            return None
        if kind == "s":
            return strings[int(v)] or None
        if kind == "b":
            return "true" if v == "1" else "false"
        if kind == "n" and int(c.get("s", 0)) in dates:
            return str((self.day0 + timedelta(days=float(v)) + timedelta(milliseconds=500)).replace(microsecond=0))
        return v


@contextmanager
def opened(path: str) -> Iterator[Book]:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_file(inside) as f, zipfile.ZipFile(f) as z:
        yield Book(z)


def header(row: list[str | None]) -> list[str]:
    """Names of columns: _c<place> without one; a name that was there before, in any case, gets its place added."""
    out: list[str] = []
    for i, v in enumerate(row):
        name = v.strip() if v and v.strip() else f"_c{i}"
        while name.lower() in {n.lower() for n in out}:
            name = f"{name}_{i}"
        out.append(name)
    return out


class Range(InputPartition):
    def __init__(self, first: int, last: int | None):
        super().__init__((first, last))


class Workbook(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as book:
            _, row = book.top(book.path(self.options.get("sheet")))
        return StructType([StructField(n, StringType()) for n in header(row)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"), int(self.options.get("rowsPerPart", 100_000)), len(schema))


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, size: int, width: int):
        self.path, self.sheet, self.size, self.width = path, sheet, size, width

    def partitions(self) -> list[Range]:
        """Ranges up to the row that the sheet says is the last; the last range has no end, so a wrong statement loses nothing."""
        with opened(self.path) as book:
            end = book.last_row(book.path(self.sheet)) or 1
        starts = list(range(1, max(end, 1) + 1, self.size))
        return [Range(a, a + self.size - 1 if a != starts[-1] else None) for a in starts]

    def read(self, partition: Range) -> Iterator[tuple]:
        first, last = partition.value
        with opened(self.path) as book:
            path = book.path(self.sheet)
            top, _ = book.top(path)
            for _, values in book.rows(path, max(first, top + 1), last):
                values = values[: self.width] + [None] * (self.width - len(values))
                if any(v is not None for v in values):
                    yield tuple(values)
