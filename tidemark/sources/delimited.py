"""CSV files read by splits, with quotes that may hold line breaks.

Lines come from Spark's text reader, so a large file is read by many tasks. Whether a line begins inside a quoted field
depends on all text before it. But a split only maps one of two states at its begin (outside quotes, or inside) to one
at its end. So a first pass tells, for each split and both states, the state at the end and how many records begin; going
through the splits in order then gives each one's true state and the number of its first record. The same pass finds the
first encoding that all bytes are valid in. In the second pass every split cuts its own lines into records; a record
that goes on in later splits is put together from its parts.

Quotes are those of RFC 4180: a field may begin with one, and one inside is doubled; elsewhere a quote is a character like
others. Lines of nothing but white space between records are skipped. Every file has a header, the same one.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

UTF8, CP1252, LATIN1 = "utf-8", "cp1252", "latin-1"
ENCODINGS = (UTF8, CP1252, LATIN1)
_BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the text is inside a quoted field after a line that begins so or not."""
    if b'"' not in line:
        return inside
    text, at = (b'"' + line if inside else line), 0
    while True:
        if text[at : at + 1] == b'"':
            at += 1
            while (at := text.find(b'"', at)) >= 0 and text[at + 1 : at + 2] == b'"':
                at += 2
            if at < 0:
                return True
        if (at := text.find(b",", at)) < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), line; in the order of the file within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, bool]]:
    """(split, line, whether it is the split's first)."""
    last = None
    for b in batches:
        for file, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            split = (file, start)
            if first := split != last:
                last = split
                line = line.removeprefix(_BOM) if start == 0 else line
            yield split, line, first


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: records and end state for both states at its begin, encodings its bytes are not valid in, and the
    first record, if the split begins a file."""
    split, state, records, bad, head = None, [False, True], [0, 0], 0, []

    def told() -> Iterator[pa.RecordBatch]:
        if split:
            header = b"\n".join(head) if split[1] == 0 else None
            yield pa.RecordBatch.from_pylist([{"file": split[0], "start": split[1], "records0": records[0], "records1": records[1], "inside0": state[0], "inside1": state[1], "bad": bad, "header": header}], _MEASURED)

    for own, line, first in _each(batches):
        if first:
            yield from told()
            split, state, records, bad, head = own, [False, True], [0, 0], 0, []
        if not line.isascii():
            for k, encoding in enumerate((UTF8, CP1252)):
                try:
                    line.decode(encoding)
                except UnicodeDecodeError:
                    bad |= 1 << k
        blank = not line.strip()
        for e in (0, 1):
            records[e] += not state[e] and not blank
        if records[0] == 1 and (state[0] or not blank):
            head.append(line)
        state = [ends_inside(line, s) for s in state]
    yield from told()


_MEASURED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("records0", pa.int64()), ("records1", pa.int64()), ("inside0", pa.bool_()), ("inside1", pa.bool_()), ("bad", pa.int32()), ("header", pa.binary())])


def names_of(header: str) -> list[str]:
    """Column names: empty ones are numbered, and so are repeated ones."""
    cells, out = next(csv.reader(io.StringIO(header, newline=""))), []
    for k, c in enumerate(cells):
        name, n = c or f"Unnamed: {k}", 1
        while name in out:
            name, n = f"{c}.{n}", n + 1
        out.append(name)
    return out


def read(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, int]:
    """A frame and its number of rows, which reading has to know first. The frame has the columns of a file, or of all files of a folder, as text, and row_order: a record's number from 0, over all
    files by name. An empty field is null. Fields that a record lacks are null; surplus ones are dropped."""
    lines = _lines(spark, path)
    # a row for each split, as many as the plan of the scan has
    splits = sorted(lines.mapInArrow(_measured, "file string, start bigint, records0 bigint, records1 bigint, inside0 boolean, inside1 boolean, bad int, header binary").collect(), key=lambda r: (r["file"], r["start"]))
    bad = 0
    for s in splits:
        bad |= s["bad"]
    encoding = encoding or ENCODINGS[0 if not bad & 1 else 1 if not bad & 2 else 2]
    headers = {tuple(names_of(s["header"].decode(encoding))) for s in splits if s["header"]}
    if len(headers) != 1:
        raise ValueError(f"{path} has {'no header' if not headers else 'files with different headers'}")
    begins, number, inside = {}, 0, False
    for s in splits:
        if s["start"] == 0:
            inside, number = False, number - 1  # the header is a record too
            first = number
        begins[s["file"], s["start"]] = (inside, number, first)
        number += s["records1" if inside else "records0"]
        inside = s["inside1" if inside else "inside0"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """number, start, text, part: records, and parts of those that several splits share."""
        out: list[tuple[int, int, str, bool]] = []
        split, inside, shared, number, held = None, False, False, 0, []

        def close(part: bool) -> None:
            if held and number - 1 > begins[split][2]:
                out.append((number - 1, split[1], b"\n".join(held).decode(encoding), part))
            held.clear()

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["number", "start", "text", "part"])
                out.clear()

        for own, line, first in _each(batches):
            if first:
                if split:
                    close(inside or shared)
                split, (inside, number, _) = own, begins[own]
                shared = inside
            if not inside:
                close(shared)
                shared = False
                if not line.strip():
                    continue
                number += 1
            held.append(line)
            inside = ends_inside(line, inside)
            yield from flush(2000)
        if split:
            close(inside or shared)
        yield from flush(1)

    records = lines.mapInArrow(cut, "number bigint, start bigint, text string, part boolean")
    parts = records.filter("part").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x.text), "\n").alias("text"))
    total = number
    whole = records.filter("not part").select("number", "text").unionByName(parts)
    names = next(iter(headers))
    cells = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    text = F.regexp_replace("text", "\r$", "")
    row = F.from_csv(text, cells.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return whole.select(row.alias("row"), "number").select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)), F.col("number").alias("row_order")), total
