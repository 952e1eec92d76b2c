"""Small reports in one file: a bar chart (SVG) and a spreadsheet (xlsx).

Only these sinks bring rows to the driver: at most ``ROWS``, and more is an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 10_000

# Fixed values of the spreadsheet format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _rows(df: DataFrame) -> list:
    rows = df.limit(ROWS + 1).collect()
    if len(rows) > ROWS:
        raise ValueError(f"a report holds at most {ROWS} rows")
    return rows


def _write(spark: SparkSession, path: str, content: bytes, overwrite: bool) -> None:
    """One file, on any file system that Spark knows; it must not exist unless ``overwrite``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, overwrite)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_bars(df: DataFrame, label: str, value: str, path: str, title: str = "", overwrite: bool = False) -> None:
    """Horizontal bars in the order of the rows; bars of negative values go left
    of the axis, null values have none.  The value stands beside its bar."""
    rows = [(str(r[0]), None if r[1] is None else float(r[1])) for r in _rows(df.select(label, value))]
    known = [v for _, v in rows if v is not None]
    low, high = min([0.0, *known]), max([0.0, *known])
    scale = 500 / (high - low or 1)
    axis = 220 - low * scale
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="840" height="{40 + 20 * len(rows)}" font-family="sans-serif" font-size="12">']
    lines.append(f'<text x="10" y="18" font-size="14">{escape(title)}</text>')
    for i, (name, v) in enumerate(rows):
        y = 30 + 20 * i
        lines.append(f'<text x="10" y="{y + 12}" class="label">{escape(name)}</text>')
        if v is not None:
            x, width = min(axis, axis + v * scale), abs(v) * scale
            lines.append(f'<rect x="{x:.2f}" y="{y}" width="{width:.2f}" height="15" fill="#4477aa" data-label={quoteattr(name)} data-value="{v!r}"/>')
            lines.append(f'<text x="{x + width + 4:.2f}" y="{y + 12}">{v:g}</text>')
    _write(df.sparkSession, path, "\n".join([*lines, "</svg>\n"]).encode(), overwrite)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """(label, value) of the bars of a chart; labels without markup characters as they were."""
    part = [F.regexp_extract("value", p, 1) for p in ('data-label="([^"]*)"', 'data-value="([^"]*)"')]
    return spark.read.text(path).where(F.startswith("value", F.lit("<rect "))).select(part[0].alias("label"), part[1].cast("double").alias("value"))


def _letters(i: int) -> str:
    """The name of column ``i``, from 0: A to Z, AA and so on."""
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _cell(place: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{place}" t="b"><v>{int(v)}</v></c>'
    if type(v).__name__ in ("int", "float", "Decimal") and v == v and abs(v) != float("inf"):
        return f'<c r="{place}"><v>{v}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(v))  # no XML text holds these
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'


def write_sheet(df: DataFrame, path: str, name: str = "Sheet1", overwrite: bool = False) -> None:
    """A workbook of one sheet: a row of column names, then the rows.  Numbers
    and booleans keep their kind, nulls are empty cells, all else is text."""
    table = [df.columns, *_rows(df)]
    body = "".join(
        f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(table, 1)
    )
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{TYPES}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
    }
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as packed:
        for place, text in files.items():
            packed.writestr(place, head + text)
    _write(df.sparkSession, path, content.getvalue(), overwrite)


def _sheet_rows(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for some in files:
        for content in some["content"]:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as packed:
                sheet = ElementTree.fromstring(packed.read("xl/worksheets/sheet1.xml"))
            rows = []
            for row in sheet.iter(f"{{{MAIN}}}row"):
                cells = {re.sub(r"\d", "", c.get("r")): "".join(c.itertext()) for c in row}
                rows.append((int(row.get("r")), cells))
            yield pd.DataFrame(rows, columns=["place", "cells"])


def read_sheet(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """The rows below the first of workbooks as ``write_sheet`` makes them, by
    the types of ``schema`` in the order of the columns; one file in one task."""
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_sheet_rows, "place int, cells map<string, string>")
    return rows.where("place > 1").select(*(F.element_at("cells", F.lit(_letters(i))).cast(kind).alias(c) for i, (c, kind) in enumerate(schema.items())))
