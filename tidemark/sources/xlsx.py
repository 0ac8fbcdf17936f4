"""Excel workbooks as DataFrames, through a Python data source of which each partition is a sheet.

Planning opens each workbook's directory only; a task reads its own sheet, row by row, and the workbook's shared strings,
which a Python worker keeps for the next sheet. A file that isn't a workbook, or whose sheet is broken, gives a row that
says so instead of ending the job. Paths are those that pyarrow's file systems open."""

from __future__ import annotations

import contextlib
import functools
import json
import logging
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger(__name__)

CELLS = "source_file string, source_sheet string, row_order bigint, cells array<string>, problem string"
#: Rows of a sheet at most: Excel's own bound, with the header.
MOST_ROWS = 1_048_576
#: What reading a file that is no workbook, or half of one, raises.
BROKEN = (OSError, zipfile.BadZipFile, LookupError, ValueError, ElementTree.ParseError)
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that are dates.
_DATES = {14, 15, 16, 17, 22}


def _texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in root.iter(f"{_M}si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_M}numFmt") if re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    styles = root.find(f"{_M}cellXfs")
    return {k for k, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in _DATES | own}


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
        yield s.get("name"), "xl/" + targets[s.get(f"{_R}id")].removeprefix("/xl/")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _value(c: ElementTree.Element, texts: list[str], dates: set[int]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_M}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_M}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return texts[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind in ("str", "e", "d"):
        return v.text
    if int(c.get("s", -1)) in dates:
        return (datetime(1899, 12, 30) + timedelta(days=float(v.text))).isoformat(" ", "seconds")
    number = float(v.text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@contextlib.contextmanager
def _workbook(path: str) -> Iterator[zipfile.ZipFile]:
    system, at = _open(path)
    with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
        yield z


@functools.lru_cache(maxsize=1)
def _shared(path: str, changed: float | None) -> tuple[list[str], set[int]]:
    """A workbook's texts and date styles, as it was then."""
    with _workbook(path) as z:
        return _texts(z), _date_styles(z)


def _changed(path: str) -> float | None:
    system, at = _open(path)
    info = system.get_file_info(at)
    return info.mtime_ns


def rows_of(path: str, entry: str, only: Sequence[int] | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells as text) of a sheet. only: of these columns alone, in this order."""
    texts, dates = _shared(path, _changed(path))
    with _workbook(path) as z, z.open(entry) as f:
        n = 0
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_M}row":
                continue
            n = int(row.get("r", n + 1))
            cells: dict[int, str | None] = {}
            at = -1
            for c in row.iter(f"{_M}c"):
                at = _column(c.get("r", "")) if c.get("r") else at + 1
                if only is None or at in only:
                    cells[at] = _value(c, texts, dates)
            yield n, [cells.get(k) for k in (range(max(cells, default=-1) + 1) if only is None else only)]
            row.clear()


@dataclass
class _Sheet(InputPartition):
    path: str
    name: str | None
    entry: str | None
    problem: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.sheet = json.loads(options["paths"]), options.get("sheet")
        self.only = json.loads(options["columns"]) if "columns" in options else None
        self.head, self.first = options.get("head") == "true", options.get("first") == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            try:
                with _workbook(path) as z:
                    sheets = list(_sheets(z))[: 1 if self.first else None]
                out += [_Sheet(path, name, entry) for name, entry in sheets if self.sheet in (None, name)]
            except BROKEN as e:
                out.append(_Sheet(path, None, None, f"{type(e).__name__}: {e}"))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = partition
        if p.problem:
            yield p.path, None, None, None, p.problem
            return
        try:
            for n, cells in rows_of(p.path, p.entry, self.only):
                yield p.path, p.name, n, cells, None
                if self.head and any(c not in (None, "") for c in cells):
                    return
        except BROKEN as e:
            yield p.path, p.name, None, None, f"{type(e).__name__}: {e}"


class Workbooks(DataSource):
    """Options: paths (JSON), sheet (a name), columns (JSON of column numbers), first (sheets only), head (first row only)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_cells(spark: SparkSession, paths: Sequence[str], **options: object) -> DataFrame:
    """CELLS of workbooks; options as `Workbooks` has them."""
    spark.dataSource.register(Workbooks)
    text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.read.format("tidemark_xlsx").options(paths=json.dumps(list(paths)), **text).load()


def read_xlsx(spark: SparkSession, path: str, first_only: bool = False, columns: Sequence[str] | None = None) -> dict[tuple[str, str], DataFrame]:
    """(file, sheet) -> its rows under the headers of its first row that isn't empty, all as text, with row_order. columns:
    only these headers are read. A workbook or sheet that can't be opened is left out, with a warning; a sheet that breaks
    off further on ends the job, as half a sheet would pass for a whole one."""
    out = {}
    heads = read_cells(spark, [path], head=True, first=first_only).collect()  # a row for each sheet
    for h in heads:
        if h["problem"]:
            log.warning("%s, %s: %s, skipped", h["source_file"], h["source_sheet"], h["problem"])
            continue
        named = [(k, str(c).strip()) for k, c in enumerate(h["cells"]) if c not in (None, "")]
        named = [(k, c) for k, c in named if columns is None or c in columns]
        rows = read_cells(spark, [path], sheet=h["source_sheet"], columns=[k for k, _ in named])
        whole = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "source_file", "source_sheet", "problem"))).otherwise(F.col("row_order"))
        out[(h["source_file"], h["source_sheet"])] = rows.filter(whole > h["row_order"]).select(*(F.get("cells", F.lit(k)).alias(c) for k, (_, c) in enumerate(named)), "row_order")
    return out


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v!r}</v></c>"
    text = escape(str(v), {"\r": "&#13;"})
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _parts() -> Iterator[tuple[str, str]]:
    """What a workbook of one sheet has beside the sheet."""
    main, rel = _M[1:-1], _R[1:-1]
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/{part}.xml" ContentType="{kinds}.{kind}+xml"/>' for part, kind in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet")))
    yield "[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>'
    for name, kind, target in (("_rels/.rels", "officeDocument", "xl/workbook.xml"), ("xl/_rels/workbook.xml.rels", "worksheet", "worksheets/sheet1.xml")):
        yield name, f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/{kind}" Target="{target}"/></Relationships>'
    yield "xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'


def write_xlsx(df: DataFrame, path: str, most: int = MOST_ROWS - 1) -> int:
    """df, in its order, as a workbook of one sheet; the number of rows. One task streams them, as a sheet is one text; it
    is refused over `most` rows."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(path)
        n, part = 0, f"{at}.part"
        with system.open_output_stream(part) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _parts():
                z.writestr(name, _HEAD + text)
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                row = lambda cells: sheet.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())
                sheet.write(f'{_HEAD}<worksheet xmlns="{_M[1:-1]}"><sheetData>'.encode())
                row(names)
                for b in batches:
                    n += b.num_rows
                    if n > most:
                        raise ValueError(f"over {most} rows don't fit a sheet")
                    for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        row(r)
                sheet.write(b"</sheetData></worksheet>")
        system.move(part, at)  # a second attempt writes it anew
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.coalesce(1).mapInArrow(run, "n bigint").first()["n"]
