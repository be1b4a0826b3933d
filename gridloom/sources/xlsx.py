"""XLSX workbooks by the standard library: a writer of sheet rows, a reader, and a Spark data source for both.

Cells are inline strings; page and entry numbers are numbers. Characters that XML forbids are dropped, sheet names are cut
to the format's 31 characters and cleared of its reserved signs, and a sheet of more than 1,048,576 rows is refused.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576
_FORBIDDEN = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def column_name(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def _row(number: int, values: Iterable) -> str:
    cells = []
    for i, v in enumerate(values):
        if v is None or v == "":
            continue
        ref = f"{column_name(i)}{number}"
        if isinstance(v, int):
            cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        else:
            cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", v))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def sheet_names(base: str, n: int) -> list[str]:
    base = re.sub(r"[\\/?*\[\]:]", " ", base) or "Sheet"
    out = []
    for i in range(n):
        tail = "" if n == 1 else f" (Region {i + 1})"
        out.append(base[: 31 - len(tail)] + tail)
    return out


def write_workbook(target, sheets: Iterable[tuple[str, Iterable[list]]]) -> None:
    """Write (name, rows) sheets one after the other; rows are streamed into the archive."""
    names = []
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in sheets:
            names.append(name)
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for i, values in enumerate(rows, 1):
                    if i > MOST_ROWS:
                        raise ValueError(f"sheet {name!r} has more than {MOST_ROWS} rows")
                    f.write(_row(i, values).encode())
                f.write(b"</sheetData></worksheet>")
        if not names:
            names.append("Sheet1")
            z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')


def read_workbook(source) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet; values as text (rich text joined, shared strings resolved), missing ones empty."""
    q = lambda tag: f"{{{MAIN}}}{tag}"
    with zipfile.ZipFile(source) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(q("t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(q("si"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(q("sheet")):
            target = links[sheet.get(f"{{{RELS}}}id")].lstrip("/")
            rows: list[list[str]] = []
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, el in ElementTree.iterparse(f):
                    if el.tag != q("row"):
                        continue
                    number = int(el.get("r") or len(rows) + 1)
                    rows += [[] for _ in range(number - len(rows))]
                    for i, c in enumerate(el.iter(q("c"))):
                        at = column_number(c.get("r")) if c.get("r") else i
                        kind, v = c.get("t"), c.find(q("v"))
                        text = "".join(t.text or "" for t in c.iter(q("t"))) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                        if kind == "s" and text:
                            text = shared[int(text)]
                        rows[-1] += [""] * (at + 1 - len(rows[-1]))
                        rows[-1][at] = text
                    el.clear()
            out.append((sheet.get("name"), rows))
        return out


def to_bytes(sheet_rows: DataFrame, base: str = "Extracted tables", include_page: bool = False, include_entry: bool = False) -> bytes:
    """One document's workbook in memory; its rows pass through the driver, so it is meant for single documents."""
    buffer = io.BytesIO()
    rows = sheet_rows.orderBy("sheet_idx", "row_no").select("sheet_idx", "kind", "page_no", "entry", "values").toLocalIterator()
    write_workbook(buffer, _sheets(((r["sheet_idx"], r["kind"], r["page_no"], r["entry"], r["values"]) for r in rows), base, include_page, include_entry))
    return buffer.getvalue()


def _line(kind: str, page: int | None, entry: str | None, values: list[str], include_page: bool, include_entry: bool) -> list:
    if kind == "separator":
        return []
    front: list = [page] if include_page else []
    if include_entry and kind == "row":
        front.append(entry if entry == "#" else int(entry))
    return front + list(values)


def _sheets(rows: Iterable[tuple], base: str, include_page: bool, include_entry: bool) -> list[tuple[str, list[list]]]:
    sheets: dict[int, list[list]] = {}
    for sheet, *rest in rows:
        sheets.setdefault(sheet, []).append(_line(*rest, include_page, include_entry))
    n = max(sheets, default=-1) + 1
    return [(name, sheets.get(i, [])) for i, name in enumerate(sheet_names(base, n))]


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else [os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f.endswith(".xlsx")]
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, (name, rows) in enumerate(read_workbook(partition.value)):
            for i, values in enumerate(rows, 1):
                yield os.path.basename(partition.value), k, name, i, values


class XlsxWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.options = options["path"], options
        self.at = {f.name: i for i, f in enumerate(schema.fields)}
        self.overwrite = overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Rows arrive sorted by document, sheet and number; each document's file is renamed into place when whole."""
        include = {k: str(self.options.get(k, "false")).lower() == "true" for k in ("includePage", "includeEntry")}
        os.makedirs(self.path, exist_ok=True)
        held, doc = [], None

        def flush() -> None:
            end = os.path.join(self.path, f"{doc}.xlsx")
            part = f"{end}.{os.getpid()}.part"
            write_workbook(part, _sheets(held, self.options.get("sheetName", "Extracted tables"), include["includePage"], include["includeEntry"]))
            os.replace(part, end)

        for r in rows:
            if r[self.at["doc_id"]] != doc and held:
                flush()
                held = []
            doc = r[self.at["doc_id"]]
            held.append(tuple(r[self.at[c]] for c in ("sheet_idx", "kind", "page_no", "entry", "values")))
        if held:
            flush()
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        with open(os.path.join(self.path, "_SUCCESS"), "w"):
            pass

    def abort(self, messages: list) -> None:
        for f in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if f.endswith(".part"):
                os.unlink(os.path.join(self.path, f))


class XlsxSource(DataSource):
    """format("xlsx"): reads workbooks as (file, sheet_idx, sheet_name, row_no, values), writes a workbook for each document."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "file string, sheet_idx int, sheet_name string, row_no int, values array<string>"

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(self.options, schema, overwrite)


def write_workbooks(sheet_rows: DataFrame, path: str, sheet_name: str = "Extracted tables", include_page: bool = False, include_entry: bool = False) -> None:
    """A workbook for each document under `path`, a folder that all executors share."""
    sheet_rows.sparkSession.dataSource.register(XlsxSource)
    dealt = sheet_rows.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "sheet_idx", "row_no")
    dealt.write.format("xlsx").mode("append").option("sheetName", sheet_name).option("includePage", include_page).option("includeEntry", include_entry).save(path)
