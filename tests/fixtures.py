"""The worked example sheet (FIXTURES.md section 6) and helpers to land it."""

from decimal import Decimal

from gridfold.sources.xlsx import workbook_bytes

HEADERS = {2: "項目 (單位: 百萬)", 3: "Q4 2025", 4: "Q1 2026", 5: "Q2 2026 預估", 6: "Q3 2026 預估",
           7: "FY 2025", 8: "FY 2026 預估", 9: "Notes", 11: "Q5 2026", 12: "Q1 2027 預估"}


def _row(label, values):
    cells = {} if label is None else {2: label}
    for c, v in zip(range(3, 13), values):
        if v is not None:
            cells[c] = v
    return cells


def worked_rows(markers=True):
    rows = {4: dict(HEADERS), 5: _row("ignored before start", ["9"] * 10)}
    if markers:
        rows[6] = {2: "文字版本"}
    rows[7] = _row("Revenue", ["100", "110.5", "120.1234567", "130", "400", "480", "n1", "x", "7", "140"])
    rows[8] = {c: t for c, t in HEADERS.items()}
    rows[9] = _row(" Gross margin ", ["-1.5", "1e3", "1,234", None, "n/a", "0.00000005", "n2", None, "7", "0.00000004"])
    rows[10] = _row("  ", ["5"] * 10)
    rows[11] = _row(None, ["6"] * 10)
    if markers:
        rows[12] = {2: "圖"}
    rows[13] = _row("after end", ["8"] * 10)
    return rows


def write_book(path, sheet, rows):
    path.write_bytes(workbook_bytes(sheet, rows.items()))
    return path


D = Decimal
EXPECTED_11 = sorted([
    ("Revenue", "Q", 2025, 4, False, D("100000000.0000000")),
    ("Revenue", "Q", 2026, 1, False, D("110500000.0000000")),
    ("Revenue", "Q", 2026, 2, True, D("120123456.7000000")),
    ("Revenue", "Q", 2026, 3, True, D("130000000.0000000")),
    ("Revenue", "Q", 2027, 1, True, D("140000000.0000000")),
    ("Revenue", "FY", 2025, None, False, D("400000000.0000000")),
    ("Revenue", "FY", 2026, None, True, D("480000000.0000000")),
    (" Gross margin ", "Q", 2025, 4, False, D("-1500000.0000000")),
    (" Gross margin ", "Q", 2026, 1, False, D("1000000000.0000000")),
    (" Gross margin ", "Q", 2027, 1, True, D("0E-7")),
    (" Gross margin ", "FY", 2026, None, True, D("0.1000000")),
], key=repr)
