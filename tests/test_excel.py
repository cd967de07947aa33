import zipfile

import pytest

from vigil.sources import excel, tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cells(number, values):
    out = []
    for i, v in enumerate(values):
        ref = f"{chr(65 + i)}{number}"
        if v is not None:
            kind, *rest = v if isinstance(v, tuple) else ("inline", v)
            out.append({"inline": f'<c r="{ref}" t="inlineStr"><is><t>{rest[0]}</t></is></c>', "n": f'<c r="{ref}"><v>{rest[0]}</v></c>', "s": f'<c r="{ref}" t="s"><v>{rest[0]}</v></c>',
                        "date": f'<c r="{ref}" s="1"><v>{rest[0]}</v></c>', "own": f'<c r="{ref}" s="2"><v>{rest[0]}</v></c>', "b": f'<c r="{ref}" t="b"><v>{rest[0]}</v></c>', "e": f'<c r="{ref}" t="e"><v>{rest[0]}</v></c>'}[kind])
    return f'<row r="{number}">{"".join(out)}</row>'


def write(path, sheets, dimension=True, strings=(), late=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{R}"><workbookPr date1904="{int(late)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(strings) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            d = f'<dimension ref="A1:Z{max(rows, default=1)}"/>' if dimension else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}>{d}<sheetData>" + "".join(cells(n, v) for n, v in rows.items()) + "</sheetData></worksheet>")


@pytest.fixture(scope="module")
def load(spark):
    spark.dataSource.register(excel.Workbook)

    def f(path, **options):
        return spark.read.format("workbook").options(**options).load(str(path))

    return f


def test_cells_of_all_kinds(load, tmp_path):
    rows = {2: ["Id", "Opened", "Text", None, "id", "Ok"], 3: [("n", 7), ("date", 45292.75), ("s", 0), None, "x", ("b", 1)], 5: [("n", 8.5), ("own", 2), ("s", 1), "d", ("e", "#N/A"), ("b", 0)], 6: [], 7: [None, None, "a &amp; b"]}
    write(tmp_path / "a.xlsx", {"One": {1: ["other"]}, "Two": rows}, strings=["<si><t>plain</t></si>", "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>"])
    df = load(tmp_path / "a.xlsx", sheet="Two")
    assert df.columns == ["Id", "Opened", "Text", "_c3", "id_4", "Ok"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("7", "2024-01-01 18:00:00", "plain", None, "x", "true"), ("8.5", "2", "rich text", "d", None, "false"), (None, None, "a & b", None, None, None)], key=str)
    assert load(tmp_path / "a.xlsx").columns == ["other"] and load(tmp_path / "a.xlsx").count() == 0
    with pytest.raises(Exception, match="no sheet"):
        load(tmp_path / "a.xlsx", sheet="Three").columns


@pytest.mark.parametrize("dimension", [True, False])
def test_ranges_of_rows(load, tmp_path, dimension):
    rows = {1: ["n", "text"]} | {i: [("n", i), f"row {i}"] for i in range(2, 251) if i % 10}
    write(tmp_path / "b.xlsx", {"S": rows}, dimension)
    df = load(tmp_path / "b.xlsx", rowsPerPart=40)
    assert df.rdd.getNumPartitions() == (7 if dimension else 1)
    assert sorted((int(r["n"]), r["text"]) for r in df.collect()) == [(i, f"row {i}") for i in rows if i > 1]


def test_dates_from_1904_and_empty_sheets(load, tmp_path):
    write(tmp_path / "c.xlsx", {"S": {1: ["at"], 2: [("date", 1)]}, "Empty": {}}, late=True)
    assert [r["at"] for r in load(tmp_path / "c.xlsx").collect()] == ["1904-01-02 00:00:00"]
    assert load(tmp_path / "c.xlsx", sheet="Empty").columns == []


def test_roles_are_found_by_content(spark, tmp_path):
    marks = list(tables.EVENT_LOG_MARKERS)
    write(tmp_path / "x.xlsx", {"S": {1: ["Incident", "Description"], 2: ["I1", "The portal is slow"]}})
    spark.createDataFrame([tuple("1234567")], ", ".join(f"{m} string" for m in marks)).coalesce(1).write.csv(str(tmp_path / "log"), header=True)
    spark.createDataFrame([("1",)], "other string").coalesce(1).write.csv(str(tmp_path / "rest"), header=True)
    paths = [str(tmp_path / n) for n in ("x.xlsx", "log", "rest")]
    assert tables.detect(spark, paths) == {"text_rich": paths[0], "structured": paths[1]}
    with pytest.raises(ValueError, match="structured"):
        tables.detect(spark, [paths[0], paths[2]])
