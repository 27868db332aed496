from fixtures import EXPECTED_11, worked_rows, write_book

from gridfold.plans.ingest import build_ingest
from gridfold.sources.workbook import scan_workbooks
from gridfold.sources.xlsx import read_first_sheet


def _facts(spark, landing):
    scan = scan_workbooks(spark, str(landing))
    return build_ingest(scan.grid, scan.files), scan


def test_decoder_round_trip(landing):
    rows = worked_rows()
    p = write_book(landing / "a.xlsx", "BLB_260723", rows)
    sheet, it = read_first_sheet(p.read_bytes(), 2, 12)
    assert sheet == "BLB_260723"
    got = dict(it)
    assert got == {r: c for r, c in rows.items() if c}


def test_worked_example_eleven_rows(spark, landing):
    write_book(landing / "a.xlsx", "BLB_260723", worked_rows())
    ing, _ = _facts(spark, landing)
    rows = ing.incoming.collect()
    got = sorted([(r.metric, r.period_type, r.year, r.quarter, r.is_estimate, r.value) for r in rows], key=repr)
    assert got == EXPECTED_11
    assert {r.data_version for r in rows} == {"V_Q2_2026_ESTIMATE"}
    assert {r.batch_key for r in rows} == {"BLB_260723"}
    assert {r.source_file for r in rows} == {"a.xlsx"}
    assert str(ing.incoming.schema["value"].dataType) == "DecimalType(38,7)"


def test_without_markers_twenty_five_rows(spark, landing):
    write_book(landing / "b.xlsx", "Sheet1", worked_rows(markers=False))
    ing, _ = _facts(spark, landing)
    assert ing.incoming.count() == 25
    chk = ing.checks.collect()[0]
    assert chk.row_count == 25 and chk.not_empty and not chk.key_ok and not chk.passed


def test_bad_files_are_rows_not_failures(spark, landing):
    write_book(landing / "good.xlsx", "BLB_260723", worked_rows())
    (landing / "broken.xlsx").write_bytes(b"not a zip")
    (landing / "legacy.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    (landing / "notes.txt").write_text("ignored")
    rows = worked_rows()
    rows[4] = {c: t for c, t in rows[4].items() if c != 2}
    write_book(landing / "nometric.xlsx", "BLB_260724", rows)
    rows = worked_rows()
    rows[4] = {c: t.replace(" 預估", "") for c, t in rows[4].items()}
    write_book(landing / "noest.xlsx", "BLB_260725", rows)
    write_book(landing / "baddate.xlsx", "BLB_260231", worked_rows())
    ing, scan = _facts(spark, landing)
    errs = {r.source_file: r.error for r in ing.plan.collect()}
    assert errs["good.xlsx"] is None
    assert errs["broken.xlsx"].startswith("unreadable workbook")
    assert "legacy" in errs["legacy.xls"]
    assert "metric" in errs["nometric.xlsx"]
    assert "estimate" in errs["noest.xlsx"]
    assert "real yyMMdd" in errs["baddate.xlsx"]
    assert "notes.txt" not in errs
    assert ing.incoming.select("source_file").distinct().collect()[0][0] == "good.xlsx"
    assert ing.incoming.count() == 11


def test_numbers_dates_booleans_from_xml(landing):
    import zipfile, io
    from gridfold.sources.xlsx import workbook_bytes
    raw = workbook_bytes("S", [(1, {2: "x"})])
    zin = zipfile.ZipFile(io.BytesIO(raw))
    parts = {n: zin.read(n) for n in zin.namelist()}
    sheet = (b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             b'<sheetData><row r="3"><c r="B3"><v>100.0</v></c><c r="C3"><v>1E-8</v></c><c r="D3" t="b"><v>1</v></c>'
             b'<c r="E3" t="e"><v>#DIV/0!</v></c><c r="F3" t="inlineStr"><is><t>in</t></is></c>'
             b'<c r="G3" t="str"><v>f</v></c><c r="H3" s="1"><v>46000</v></c><c r="A3"><v>5</v></c></row></sheetData></worksheet>')
    styles = (b'<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
              b'<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    parts["xl/worksheets/sheet1.xml"] = sheet
    parts["xl/styles.xml"] = styles
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, b in parts.items():
            z.writestr(n, b)
    _, it = read_first_sheet(buf.getvalue(), 2, 12)
    got = dict(it)[3]
    assert got == {2: "100", 3: "1e-08", 4: "True", 6: "in", 7: "f", 8: "2025-12-09 00:00:00"}


def test_body_pass_never_shuffles_the_grid(spark, landing):
    for i in range(3):
        write_book(landing / f"f{i}.xlsx", f"BLB_26072{i}", worked_rows())
    scan = scan_workbooks(spark, str(landing))
    ing = build_ingest(scan.grid, scan.files)
    ing.facts.collect()
    plan = ing.facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    body = plan.split("BroadcastExchange")[0]  # the tree above the broadcast side: the grid path
    assert "BroadcastHashJoin" in body and "Generate explode(periods" in body and "FileScan parquet" in body
    assert "Exchange" not in body.replace("BroadcastHashJoin", "")
    assert "PushedFilters: [IsNotNull(row), GreaterThan(row,0), GreaterThan(row,4)" in body


def test_date_cells_follow_the_date_system():
    from gridfold.sources.xlsx import _date_text
    assert _date_text("46000") == "2025-12-09 00:00:00"
    assert _date_text("59") == "1900-02-28 00:00:00"   # serials below 60 count the false leap day
    assert _date_text("61") == "1900-03-01 00:00:00"
    assert _date_text("0.5") == "12:00:00"
    assert _date_text("46000.25") == "2025-12-09 06:00:00"
    assert _date_text("44538", date1904=True) == "2025-12-09 00:00:00"
