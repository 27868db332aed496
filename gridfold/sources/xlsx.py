"""Minimal XLSX cell reader (standard library only), run inside Spark tasks.

Reads the first worksheet of a workbook into ``(row, {col: text})`` records
the way a pandas/openpyxl reading stringifies them:

* shared, inline and cached formula strings as written;
* booleans as ``True`` / ``False``; error cells as missing;
* numbers: integral values without ``.0``, others as Python ``repr(float)``;
* date-formatted numbers and ISO date cells as ``YYYY-MM-DD HH:MM:SS`` text.

It never materialises the sheet: rows stream out of ``iterparse``.
"""

from __future__ import annotations

import datetime as _dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# ---------------------------------------------------------------------------
# Built-in number formats that display dates or times
# (ECMA-376 Part 1, 18.8.30).
# ---------------------------------------------------------------------------
DATE_FORMAT_IDS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])
EXCEL_EPOCH = _dt.datetime(1899, 12, 30)  # 1900 date system (serials below 60 count a false 1900-02-29)
EPOCH_1904 = _dt.datetime(1904, 1, 1)  # 1904 date system (workbookPr date1904)
# ---------------------------------------------------------------------------

_CELL_REF = re.compile(r"^([A-Z]+)([0-9]+)$")
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


class WorkbookError(ValueError):
    """The file is not a readable XLSX workbook."""


def col_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _is_date_format(code: str) -> bool:
    stripped = _QUOTED.sub("", code).lower()
    if "general" in stripped:
        return False
    stripped = stripped.split(";")[0]
    return any(ch in stripped for ch in "dmyhs")


def _number_text(raw: str) -> str | None:
    try:
        if any(ch in raw for ch in ".eE"):
            f = float(raw)
            if f != f or f in (float("inf"), float("-inf")):
                return None
            i = int(f)
            return str(i) if i == f else repr(f)
        return str(int(raw))
    except ValueError:
        return None


def _date_text(serial: str, date1904: bool = False) -> str | None:
    """Text of a date-formatted number: a time of day for serials in [0, 1],
    else a date-time in the workbook's date system."""
    try:
        v = float(serial)
        day, frac = divmod(v, 1)
        diff = _dt.timedelta(milliseconds=round(frac * 86400 * 1000))
        if 0 <= v <= 1 and not date1904:
            return (_dt.datetime.min + diff).time().isoformat()
        if 1 < v < 60 and not date1904:
            day += 1  # the 1900 system counts a day that did not exist
        d = (EPOCH_1904 if date1904 else EXCEL_EPOCH) + _dt.timedelta(days=day) + diff
    except (ValueError, OverflowError):
        return None
    return d.isoformat(sep=" ")


def _iso_text(raw: str) -> str | None:
    try:
        return _dt.datetime.fromisoformat(raw.rstrip("Z")).isoformat(sep=" ")
    except ValueError:
        return None


def _rich_text(elem) -> str:
    """Text of an ``<si>`` / ``<is>`` element: direct ``<t>`` and run ``<r><t>``,
    not phonetic ``<rPh>`` runs."""
    parts = []
    for child in elem:
        if child.tag == _MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == _MAIN + "r":
            for t in child.iter(_MAIN + "t"):
                parts.append(t.text or "")
    return "".join(parts)


def _part_path(base: str, target: str) -> str:
    if target.startswith("/"):
        return target.lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), target))


def _first_worksheet(zf: zipfile.ZipFile) -> tuple[str, str, bool]:
    names = set(zf.namelist())
    wb_path = "xl/workbook.xml"
    if "_rels/.rels" in names:
        with zf.open("_rels/.rels") as f:
            for _, el in iterparse(f):
                if el.tag == _PKG_REL + "Relationship" and el.get("Type", "").endswith("/officeDocument"):
                    wb_path = _part_path("", el.get("Target", wb_path))
    if wb_path not in names:
        raise WorkbookError("no workbook part")
    rels_path = posixpath.join(posixpath.dirname(wb_path), "_rels", posixpath.basename(wb_path) + ".rels")
    targets: dict[str, tuple[str, str]] = {}
    if rels_path in names:
        with zf.open(rels_path) as f:
            for _, el in iterparse(f):
                if el.tag == _PKG_REL + "Relationship":
                    targets[el.get("Id")] = (el.get("Type", ""), _part_path(wb_path, el.get("Target", "")))
    date1904 = False
    with zf.open(wb_path) as f:
        for _, el in iterparse(f):
            if el.tag == _MAIN + "workbookPr":
                date1904 = el.get("date1904", "").lower() in ("1", "true")
            elif el.tag == _MAIN + "sheet":
                rel = targets.get(el.get(_REL + "id"))
                if rel and rel[0].endswith("/worksheet") and rel[1] in names:
                    return el.get("name", ""), rel[1], date1904
    raise WorkbookError("no worksheet")


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" not in zf.namelist():
        return out
    with zf.open("xl/sharedStrings.xml") as f:
        for _, el in iterparse(f):
            if el.tag == _MAIN + "si":
                out.append(_rich_text(el))
                el.clear()
    return out


def _date_styles(zf: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format shows a date."""
    if "xl/styles.xml" not in zf.namelist():
        return set()
    custom: dict[int, str] = {}
    dated: set[int] = set()
    in_xfs = False
    idx = 0
    with zf.open("xl/styles.xml") as f:
        for ev, el in iterparse(f, events=("start", "end")):
            if ev == "start" and el.tag == _MAIN + "cellXfs":
                in_xfs, idx = True, 0
            elif ev == "end" and el.tag == _MAIN + "cellXfs":
                in_xfs = False
            elif ev == "end" and el.tag == _MAIN + "numFmt":
                custom[int(el.get("numFmtId", "0"))] = el.get("formatCode", "")
            elif ev == "end" and in_xfs and el.tag == _MAIN + "xf":
                fid = int(el.get("numFmtId", "0"))
                if fid in DATE_FORMAT_IDS or (fid in custom and _is_date_format(custom[fid])):
                    dated.add(idx)
                idx += 1
    return dated


def read_first_sheet(
    content: bytes, first_col: int = 1, last_col: int | None = None
) -> tuple[str, Iterator[tuple[int, dict[int, str]]]]:
    """Sheet name of the first worksheet and an iterator of its non-empty rows
    as ``(row, {col: text})``, restricted to ``first_col..last_col``."""
    try:
        zf = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"not an xlsx workbook: {e}") from None
    sheet_name, sheet_path, date1904 = _first_worksheet(zf)
    strings = _shared_strings(zf)
    dated = _date_styles(zf)
    hi = last_col if last_col is not None else 1 << 30

    def rows() -> Iterator[tuple[int, dict[int, str]]]:
        next_row = 1
        with zf.open(sheet_path) as f:
            parent = None
            for ev, el in iterparse(f, events=("start", "end")):
                if ev == "start":
                    if el.tag == _MAIN + "sheetData":
                        parent = el
                    continue
                if el.tag != _MAIN + "row":
                    continue
                r_attr = el.get("r")
                r = int(r_attr) if r_attr else next_row
                next_row = r + 1
                cells: dict[int, str] = {}
                next_col = 1
                for c in el.iter(_MAIN + "c"):
                    ref = c.get("r")
                    m = _CELL_REF.match(ref) if ref else None
                    col = col_number(m.group(1)) if m else next_col
                    next_col = col + 1
                    if col < first_col or col > hi:
                        continue
                    text = _cell_text(c, strings, dated, date1904)
                    if text is not None:
                        cells[col] = text
                el.clear()
                if parent is not None:
                    parent.remove(el)  # keep memory flat on long sheets
                if cells:
                    yield r, cells

    return sheet_name, rows()


def _cell_text(c, strings: list[str], dated: set[int], date1904: bool = False) -> str | None:
    t = c.get("t", "n")
    v = c.find(_MAIN + "v")
    raw = v.text if v is not None else None
    if t == "inlineStr":
        is_ = c.find(_MAIN + "is")
        return _rich_text(is_) if is_ is not None else None
    if raw is None:
        return None
    if t == "s":
        try:
            return strings[int(raw)]
        except (ValueError, IndexError):
            return None
    if t == "str":
        return raw
    if t == "b":
        return "True" if raw.strip() in ("1", "true") else "False"
    if t == "e":
        return None
    if t == "d":
        return _iso_text(raw)
    style = int(c.get("s", "0") or 0)
    if style in dated:
        return _date_text(raw, date1904)
    return _number_text(raw)


# ---------------------------------------------------------------------------
# Writing: a minimal single-sheet workbook, used to land test and bench files.
# ---------------------------------------------------------------------------
def col_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _esc(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;"))


def _as_number(text: str) -> bool:
    """Text that the reader gives back unchanged when stored as a number."""
    if not text or text.strip() != text:
        return False
    try:
        f = float(text)
    except ValueError:
        return False
    if f != f or f in (float("inf"), float("-inf")):
        return False
    i = int(f) if f.is_integer() else None
    return text == (str(i) if i is not None else repr(f))


def workbook_bytes(sheet_name: str, rows) -> bytes:
    """XLSX bytes of one sheet; ``rows`` yields ``(row, {col: text})``."""
    strings: list[str] = []
    index: dict[str, int] = {}
    body = []
    for r, cells in sorted(rows, key=lambda x: x[0]):
        cs = []
        for c in sorted(cells):
            text = cells[c]
            if text is None:
                continue
            ref = f"{col_letters(c)}{r}"
            if _as_number(text):
                cs.append(f'<c r="{ref}"><v>{text}</v></c>')
            else:
                if text not in index:
                    index[text] = len(strings)
                    strings.append(text)
                cs.append(f'<c r="{ref}" t="s"><v>{index[text]}</v></c>')
        body.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel_ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            '<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>'
            "</Types>"),
        "_rels/.rels": (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{pkg}">'
            f'<Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        "xl/workbook.xml": (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook {ns} {rel_ns}><sheets>'
            f'<sheet name="{_esc(sheet_name)}" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{pkg}">'
            f'<Relationship Id="rId1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="rId2" Type="{doc}/sharedStrings" Target="sharedStrings.xml"/></Relationships>'),
        "xl/worksheets/sheet1.xml": (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet {ns}><sheetData>'
            + "".join(body) + "</sheetData></worksheet>"),
        "xl/sharedStrings.xml": (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><sst {ns} count="{len(strings)}" '
            f'uniqueCount="{len(strings)}">'
            + "".join(f'<si><t xml:space="preserve">{_esc(s)}</t></si>' for s in strings) + "</sst>"),
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, xml in parts.items():
            zf.writestr(name, xml.encode("utf-8"))
    return buf.getvalue()
