"""Exports: CSV, XLSX, JSON, backups.  A report is a top-k result, so it is written by the driver."""

from __future__ import annotations

import csv
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame


def export_format(name: str) -> str:
    """``xlsx`` by name or ending, else ``csv``."""
    return "xlsx" if name.lower() == "xlsx" or name.lower().endswith(".xlsx") else "csv"


def _text(value) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def write_csv(df: DataFrame, path: str) -> int:
    """A header and rows in one file; the number of rows written."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(map(_text, row))
            n += 1
    return n


def write_csv_parts(df: DataFrame, path: str) -> None:
    """For results that are no report: one file for each partition."""
    df.write.option("header", True).csv(path)


# The parts of a workbook with one sheet of inline strings.
XLSX_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_xlsx(df: DataFrame, path: str) -> int:
    """A workbook whose cells are all text, empty for null; the number of rows written."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    def line(values) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_text(v))}</t></is></c>' for v in values) + "</row>"

    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in XLSX_PARTS.items():
            z.writestr(name, content)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(line(df.columns).encode())
            for row in df.toLocalIterator():
                f.write(line(row).encode())
                n += 1
            f.write(b"</sheetData></worksheet>")
    return n


def export(df: DataFrame, path: str, format_: str | None = None) -> int:
    return (write_xlsx if export_format(format_ or path) == "xlsx" else write_csv)(df, path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls included."""
    return df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) AS value")


def backup(folder: str, target: str) -> int:
    """A zip of a folder's files, links left out; the number of files."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for top, folders, names in os.walk(folder):
            folders[:] = sorted(d for d in folders if not os.path.islink(os.path.join(top, d)))
            for name in sorted(names):
                path = os.path.join(top, name)
                if not os.path.islink(path):
                    z.write(path, os.path.relpath(path, folder))
                    n += 1
    return n


def restore(source: str, target: str) -> None:
    """Unpacks a backup into a folder that must not be there; names that lead out are refused."""
    if os.path.exists(target):
        raise FileExistsError(target)
    with zipfile.ZipFile(source) as z:
        for name in z.namelist():
            if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name:
                raise ValueError(f"unsafe name: {name}")
        z.extractall(target)
