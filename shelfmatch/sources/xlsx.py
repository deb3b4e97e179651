"""Workbooks (.xlsx), read and written with the standard library, on any file system that Spark reads.

A workbook's bytes come from Spark's own binary reader, so each workbook of a folder or pattern is a task's
work wherever it lies. The first row of a sheet has the headers; all columns are strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.operators.runtime import map_arrow

MOST_ROWS = 1_048_575  # of a sheet, besides its header
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(book: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of each row, as text; rows are read one at a time."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_REL)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}: {sorted(sheets)}")
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at - len(out) + 1)
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if kind == "s" else value.text
                yield out
                row.clear()


def headers(book: bytes, sheet: str | None = None) -> list[str]:
    return [c or f"_c{i}" for i, c in enumerate(next(rows_of(book, sheet), []))]


def parse(books: DataFrame, columns: list[str], sheet: str | None = None) -> DataFrame:
    """Rows of the workbooks in ``books(content binary)``, by the position of their columns; a short row ends in nulls."""
    width, fields = len(columns), [pa.field(c, pa.string()) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(0).to_pylist():
                rows = rows_of(book, sheet)
                next(rows, None)
                some: list[list[str | None]] = []
                for r in chain(rows, [None]):
                    if r is not None:
                        some.append((r + [None] * width)[:width])
                    if some and (r is None or len(some) == 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], schema=pa.schema(fields))
                        some = []

    quoted = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    return map_arrow(books.select("content"), run, quoted)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One workbook, or all of a folder or pattern, which have the same columns; the first gives their names."""
    books = spark.read.format("binaryFile").load(path)
    first = books.select("path", "content").orderBy("path").first()
    if first is None:
        raise ValueError(f"no workbook at {path}")
    return parse(books, headers(first["content"], sheet), sheet)


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


_INVALID = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def workbook(columns: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: cells are texts, null ones are left out. Characters that XML can't hold become U+FFFD."""
    names = [_letters(i) for i in range(len(columns))]

    def line(n: int, row) -> str:
        cells = (f'<c r="{a}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_INVALID.sub(chr(0xFFFD), str(v)), {chr(13): "&#13;"})}</t></is></c>' for a, v in zip(names, row, strict=True) if v is not None)
        return f'<row r="{n}">{"".join(cells)}</row>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{relation}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate(chain([columns], rows), 1):
                f.write(line(n, row).encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame, most: int = 100_000, sheet: str = "Sheet1") -> DataFrame:
    """``df`` as workbooks ``(content binary)`` of at most ``most`` rows each, made where the rows are."""
    if most > MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS} rows")
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                some += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while some and (batch is None or len(some) >= most):
                yield pa.RecordBatch.from_arrays([pa.array([workbook(columns, some[:most], sheet)], pa.binary())], ["content"])
                some = some[most:]

    return map_arrow(df.select(*[F.col(f"`{c}`").cast("string") for c in columns]), run, "content binary")


def read_table(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    """A table by its suffix: .xlsx, .csv (with a header; strings unless a schema is given) or Parquet."""
    if path.endswith(".xlsx"):
        return read_workbooks(spark, path, sheet)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, threshold: float | None = None) -> str:
    """CSV with a header; the threshold, if any, goes into the name. Returns the path."""
    to = path if threshold is None else f"{path}_threshold_{threshold:.2f}"
    df.write.mode("overwrite").option("header", True).csv(to)
    return to
