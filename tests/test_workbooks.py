"""Spreadsheets made by hand against the same prices as CSV."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from contestry.operators import pricing
from contestry.sources import files, workbooks

HEADER = ["Date", " Tournament ", "Winner", "Loser", "Best of", "WRank", "PSW", "PSL", "AvgW", "AvgL", "Extra"]


def name(k):
    return chr(65 + k) if k < 26 else chr(64 + k // 26) + chr(65 + k % 26)


def workbook(path, rows, date1904=False, inline=False, sheets=("2024",)):
    """rows: lists of cells: None, numbers, texts or ("e", code)."""
    shared, body = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row):
            if v is None:
                continue
            if isinstance(v, tuple):
                cells.append(f'<c r="{name(k)}{n}" t="e"><v>{v[1]}</v></c>')
            elif isinstance(v, str) and inline:
                cells.append(f'<c r="{name(k)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            elif isinstance(v, str):
                shared.append(f"<si><r><t>{escape(v[:1])}</t></r><r><t xml:space=\"preserve\">{escape(v[1:])}</t></r><rPh sb=\"0\" eb=\"1\"><t>aid</t></rPh></si>")
                cells.append(f'<c r="{name(k)}{n}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{name(k)}{n}"><v>{v}</v></c>')
        body.append(f'<row r="{n}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(
            f'<sheet name="{s}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="rId{k + 1}" Type="t" Target="{"/xl/" if k else ""}worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k in range(len(sheets)):
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet {main}><sheetData>{"".join(body) if k == 0 else "<row r=\"1\"><c t=\"inlineStr\"><is><t>Winner</t></is></c></row><row><c t=\"inlineStr\"><is><t>Other W.</t></is></c></row>"}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(shared)}</sst>")


ROWS = [[45292, "Cup & Co", "Ek C.", "Byron A.", 3, 12, 1.5, 2.7, 1.4, 2.6, "x"], [45293.5, "Cup", "Van Dyk B.", "Ek C.", 5, None, None, None, 1.4, 2.6, None],
        [45294, "Cup", "Byron A.", "Ek C.", 3, "N/A", ("e", "#DIV/0!"), 2.0, 1.9, None, "y"], ["soon", "Cup", "Ek C.", "Byron A.", 3, 1, 1.5, 2.7, 1.4, 2.6, None], [None] * 11]


@pytest.mark.parametrize("inline,date1904", [(False, False), (True, True)])
def test_workbook_equals_its_csv(spark, tmp_path, inline, date1904):
    shift = 1462 if date1904 else 0
    rows = [[r[0] - shift if isinstance(r[0], (int, float)) else r[0], *r[1:]] for r in ROWS]
    workbook(f"{tmp_path}/o.xlsx", [HEADER, *rows], date1904, inline, ("2024", "notes"))
    text = ["2024-01-01", "02/01/2024", "2024-01-03 00:00:00", "soon"]
    lines = [",".join(HEADER)] + [",".join("" if v is None or isinstance(v, tuple) else str(v) for v in [d, *r[1:]]) for d, r in zip(text, ROWS)]
    (tmp_path / "o.csv").write_text("\n".join(lines))
    one, two = (files.load_odds(spark, [f"{tmp_path}/o.{kind}"]) for kind in ("xlsx", "csv"))
    assert one.columns == two.columns and one.dtypes == two.dtypes
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert sorted(str(r.Date) for r in one.collect()) == ["2024-01-01", "2024-01-02", "2024-01-03", "None"]
    assert files.unread_days(one).count() == 1
    clean = pricing.clean_odds(one.unionByName(files.load_odds(spark, [f"{tmp_path}/o.csv", f"{tmp_path}/o.xlsx"])))
    assert clean.count() == 9 and {(r.odds_w, r.odds_l) for r in clean.collect()} == {(1.5, 2.7), (1.4, 2.6), (1.9, 2.0)}


def test_sheets_by_name_and_all(spark, tmp_path):
    workbook(f"{tmp_path}/a.xlsx", [HEADER, *ROWS], sheets=("2024", "notes"))
    workbook(f"{tmp_path}/b.xlsx", [], sheets=("empty",))
    paths = [f"{tmp_path}/a.xlsx", f"{tmp_path}/b.xlsx"]
    get = lambda sheet: sorted((r.sheet, r.row, r.Winner) for r in workbooks.load_sheets(spark, paths, ["Winner", "absent"], sheet).collect())
    assert get("notes") == [("notes", 2, "Other W.")]
    assert [r[:2] for r in get(None)] == [("2024", 2), ("2024", 3), ("2024", 4), ("2024", 5), ("notes", 2)]
    assert len(get(0)) == 4 and workbooks.load_sheets(spark, paths, ["absent"]).count() == 0


def test_days_as_they_are_written(spark):
    df = spark.createDataFrame([("2024-02-29",), ("29/02/2024",), ("1/2/2024",), ("45351",), ("31/02/2024",), ("",), (None,), ("no",)], "d string")
    assert [str(r[0]) for r in df.select(workbooks.typed_day(F.col("d"))).collect()] == ["2024-02-29", "2024-02-29", "2024-02-01", "2024-02-29", "None", "None", "None", "None"]
