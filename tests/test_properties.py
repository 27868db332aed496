"""Properties: the unpivot keeps every numeric cell of kept rows, and only those."""

from decimal import Decimal, InvalidOperation

from hypothesis import given, settings, strategies as st

from gridfold.operators.shape import grid_from_cells, to_long, file_plan
from gridfold.schema import DEFAULT_LAYOUT

HEADERS = {2: "項目 (單位: 百萬)", 3: "Q1 2026", 4: "Q2 2026 預估", 5: "FY 2026", 6: "Notes"}
VALUES = st.sampled_from(["1", "2.5", "-3", "x", "", "1e2", "n/a", "0.00000005", None])
LABELS = st.sampled_from(["Rev", " m ", "", "  ", "nan", None, "文字版本", "圖"])


def brute(rows):
    """Expected rows by reading the rules directly off the Python grid."""
    labels = {r: c.get(2) for r, c in rows.items()}
    body = sorted(r for r in rows if r > 4)
    start = next((r for r in body if (labels[r] or "").strip() == "文字版本"), 4)
    end = next((r for r in body if (labels[r] or "").strip() == "圖"), 10**9)
    out = 0
    for r in body:
        lab = labels[r]
        if not (start < r < end) or lab is None or lab.strip() in ("", ) or lab.strip().lower() == "nan":
            continue
        for c in (3, 4, 5):
            v = rows[r].get(c)
            try:
                if v is not None and Decimal(v.strip()).is_finite():
                    out += 1
            except InvalidOperation:
                pass
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(LABELS, VALUES, VALUES, VALUES, VALUES), min_size=1, max_size=12))
def test_unpivot_keeps_exactly_numeric_cells(spark, body):
    rows = {4: dict(HEADERS)}
    for i, (lab, *vals) in enumerate(body):
        cells = {c: v for c, v in zip((3, 4, 5, 6), vals) if v is not None}
        if lab is not None:
            cells[2] = lab
        rows[5 + i] = cells
    cells = [("f.xlsx", "BLB_260723", r, c, t) for r, cs in rows.items() for c, t in cs.items()]
    grid = grid_from_cells(spark.createDataFrame(cells, "source_file string, sheet_name string, row int, col int, text string"))
    files = spark.createDataFrame([("f.xlsx", "BLB_260723", None, None, None)],
                                  "source_file string, sheet_name string, modified_at timestamp, size_bytes long, scan_error string")
    plan = file_plan(files, grid, DEFAULT_LAYOUT).where("error is null")
    got = to_long(grid, plan, DEFAULT_LAYOUT).count()
    assert got == brute(rows)
