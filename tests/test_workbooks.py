"""Workbooks: types of cells, dates by format, several files, large sheets; hand-made files as other programs write them."""

import datetime as dt
import tracemalloc
import zipfile
from decimal import Decimal

import pytest

from riskloom.errors import ConfigurationError
from riskloom.sources import tables as IO, workbooks as W

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, rows, shared="", styles="", extra="", name="S", part="/xl/worksheets/other.xml"):
    """A workbook whose sheet's part is not named by its place; rows are XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{extra}<sheets><sheet name="first" sheetId="4" r:id="r7"/><sheet name="{name}" sheetId="9" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r2" Target="{part}"/><Relationship Id="r7" Target="worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        z.writestr(part.lstrip("/"), f'<worksheet xmlns="{MAIN}"><cols><col/></cols><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return str(path)


def test_types_of_cells(spark, tmp_path):
    shared = "<si><t>name</t></si><si><r><t>ri</t></r><r><t xml:space='preserve'>ch </t></r><rPh><t>said</t></rPh></si><si><t>a_x000D_b_x005F_x0041_</t></si>"
    rows = """<row r="1"><c r="A1" t="inlineStr"><is><t>left out</t></is></c></row>
    <row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="str"><v>n</v></c><c r="D3" t="inlineStr"><is><t>n</t></is></c><c r="E3" t="inlineStr"><is><t>mixed</t></is></c><c r="F3" t="n"><v>7</v></c></row>
    <row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>123456789012345678</v></c><c r="C4" t="b"><v>1</v></c><c r="D4"><v>1</v></c><c r="E4"><v>2</v></c></row>
    <row r="5"/>
    <row r="9"><c t="s"><v>2</v></c><c t="e"><v>#DIV/0!</v></c><c><v/></c><c><v>2.5</v></c><c t="b"><v>0</v></c><c r="H9" t="str"><v>wide</v></c></row>"""
    path = book(tmp_path / "a.xlsx", rows, shared)
    df = IO.load_excel(spark, path, sheet_name="S", skip_rows=1)
    assert df.dtypes == [("name", "string"), ("n", "bigint"), ("c2", "boolean"), ("n_1", "double"), ("mixed", "string"), ("7", "string"), ("c6", "string"), ("c7", "string")]
    assert [tuple(r) for r in df.collect()] == [
        ("rich ", 123456789012345678, True, 1.0, "2", None, None, None),
        (None,) * 8,
        ("a\rb_x0041_", None, None, 2.5, "false", None, None, "wide"),
    ]
    assert IO.load_excel(spark, path, sheet_id=2, skip_rows=1, n_rows=1, columns=["n_1", "name"]).collect() == [(1, "rich ")]
    assert IO.load_excel(spark, path, sheet_id=2, skip_rows=1, n_rows=0).count() == 0
    assert IO.load_excel(spark, path).columns == [] and IO.load_excel(spark, path).count() == 0
    typed = IO.load_excel(spark, path, "S", skip_rows=1, schema="n_1 int, mixed double, name string, absent date")
    assert [tuple(r) for r in typed.collect()] == [(1, 2.0, "rich ", None), (None,) * 4, (None, 0.0, "a\rb_x0041_", None)]


def test_dates_by_format(spark, tmp_path):
    formats = ["General", "yyyy-mm-dd", "[h]:mm", '0.00" days"', "d/m/yy h:mm", "[$-409]mmmm", "_-* 0\\d"]
    own = "".join(f'<numFmt numFmtId="{170 + k}" formatCode="{f.replace(chr(34), "&quot;")}"/>' for k, f in enumerate(formats))
    styles = f"<numFmts>{own}</numFmts><cellStyleXfs><xf numFmtId='14'/></cellStyleXfs><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='20'/>" + "".join(f"<xf numFmtId='{170 + k}'/>" for k in range(len(formats))) + "</cellXfs>"
    cells = lambda r, v: "".join(f'<c r="{x}{r}" s="{k}"><v>{v}</v></c>' for k, x in enumerate("ABCDEFGHIJ"))
    head = "".join(f'<c t="str"><v>{x}</v></c>' for x in "abcdefghij")
    path = book(tmp_path / "d.xlsx", f"<row>{head}</row><row>{cells(2, 45000)}</row><row>{cells(3, 45000.25)}</row>", styles=styles)
    df = IO.load_excel(spark, path, "S")
    kinds = dict(df.dtypes)
    assert {c for c, k in kinds.items() if k == "timestamp_ntz"} == {"b", "e", "h", "i"} and {c for c, k in kinds.items() if k == "double"} == {"a", "c", "d", "f", "g", "j"}
    assert [r["b"] for r in df.collect()] == [dt.datetime(2023, 3, 15), dt.datetime(2023, 3, 15, 6)]
    since = book(tmp_path / "e.xlsx", f"<row>{head}</row><row>{cells(2, 10)}</row>", styles=styles, extra='<workbookPr date1904="1"/>')
    assert IO.load_excel(spark, since, "S").first()["b"] == dt.date(1904, 1, 11)
    # the calendar of 1900, its missing day, its ends
    assert [W.from_serial(x, False) for x in (1, 59, 61, 2_958_465, 2_958_467, -1)] == [dt.date(1900, 1, 1), dt.date(1900, 2, 28), dt.date(1900, 3, 1), dt.date(9999, 12, 31), None, None]


def test_written_values_come_back(spark, tmp_path):
    rows = [
        (1, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 23, 59, 59, 999000), Decimal("12.50"), True, 'a\r\nb\x07 _x0041_ <&"> ￾', 0.1),
        (2**53 + 1, None, None, None, None, None, None),
        (3, dt.date(1900, 3, 1), dt.datetime(1970, 1, 1), Decimal("-3.00"), False, "", 1e300),
    ]
    schema = "k long, day date, at timestamp_ntz, price decimal(9, 2), yes boolean, text string, x double"
    path = IO.write_xlsx({'q"1"': spark.createDataFrame(rows, schema).orderBy("x")}, str(tmp_path / "t.xlsx"))
    got = IO.load_excel(spark, path)
    assert IO.sheet_names(path) == ['q"1"'] and got.dtypes == [("k", "bigint"), ("day", "date"), ("at", "timestamp_ntz"), ("price", "double"), ("yes", "boolean"), ("text", "string"), ("x", "double")]
    exact = IO.load_excel(spark, path, schema=schema)
    assert exact.dtypes == spark.createDataFrame([], schema).dtypes and sorted(map(tuple, exact.collect())) == sorted(rows)
    # days before the calendar of serial numbers stay text, and a schema makes them dates again
    old = IO.write_xlsx({"t": spark.createDataFrame([(dt.date(1850, 1, 2),)], "day date")}, str(tmp_path / "o.xlsx"))
    assert IO.load_excel(spark, old).first()["day"] == "1850-01-02" and IO.load_excel(spark, old, schema="day date").first()["day"] == dt.date(1850, 1, 2)


def test_many_workbooks(spark, tmp_path):
    for k in range(3):
        df = spark.range(k * 10, k * 10 + 10).withColumnRenamed("id", "k")
        IO.write_xlsx({"s": df.withColumn("only" if k == 1 else "x", df.k / 4)}, str(tmp_path / "in" / f"{k}.xlsx"))
    df = IO.load_excel(spark, str(tmp_path / "in"))
    assert df.dtypes == [("k", "bigint"), ("x", "double"), ("only", "double")]
    assert sorted(map(tuple, df.collect())) == [(k, None, k / 4) if 10 <= k < 20 else (k, k / 4, None) for k in range(30)]
    assert IO.load_excel(spark, [str(tmp_path / "in" / f"{k}.xlsx") for k in (0, 2)], n_rows=3).count() == 6
    IO.write_xlsx({"s": spark.range(1).withColumnRenamed("id", "K")}, str(tmp_path / "in" / "9.xlsx"))
    with pytest.raises(ConfigurationError, match="'k' and 'K'"):
        IO.load_excel(spark, str(tmp_path / "in"))


def test_what_is_no_workbook(spark, tmp_path):
    for name, content, says in (("a", b"\xd0\xcf\x11\xe0 rest", "binary .xls"), ("b", b"plain", "not a workbook"), ("c", b"", "not a workbook")):
        (tmp_path / f"{name}.xlsx").write_bytes(content)
        with pytest.raises(ConfigurationError, match=says):
            IO.load_data(spark, str(tmp_path / f"{name}.xlsx"))
    path = IO.write_xlsx({"t": spark.range(2)}, str(tmp_path / "t.xlsx"))
    for how in ({"sheet_name": "u"}, {"sheet_id": 2}, {"sheet_id": 0}, {"columns": ["absent"]}):
        with pytest.raises(ConfigurationError, match="no (sheet|columns)"):
            IO.load_excel(spark, path, **how)


def test_rows_are_read_one_by_one(tmp_path):
    """Memory does not grow with rows: ten times as many take the compressed file's bytes more, and no more."""

    def peak(n):
        path = tmp_path / f"{n}.xlsx"
        book(path, '<row><c t="str"><v>a</v></c></row>' + "".join(f'<row><c><v>{k}</v></c><c t="str"><v>some text {k % 7}</v></c></row>' for k in range(n)))
        content = path.read_bytes()
        tracemalloc.start()
        assert sum(1 for _ in W.read_rows(content, "S", 1, 0, None)) == n + 1
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top - len(content)

    peak(100)
    assert peak(50_000) < peak(5_000) + 500_000


def test_a_table_of_several_sheets_is_read_whole(spark, tmp_path):
    """Sheets of a full one's name and header go on; a sheet of another header, or after one that is not full, is another table."""
    rows = spark.range(23).selectExpr("id as k", "concat('v', id) as v")
    path = W.write_xlsx({"t": rows.coalesce(1)}, f"{tmp_path}/long.xlsx", most=8)
    assert W.sheet_names(path) == ["t", "t_2", "t_3", "t_4"]
    assert [r["k"] for r in W.load_excel(spark, path, "t", most=8).orderBy("k").collect()] == list(range(23))
    assert W.load_excel(spark, path, "t", n_rows=10, most=8).count() == 10
    assert W.load_excel(spark, path, "t").count() == 7
    other = W.write_xlsx({"t": rows.limit(7), "t_2": rows.selectExpr("k as other")}, f"{tmp_path}/other.xlsx")
    assert W.load_excel(spark, other, "t", most=8).count() == 7


def test_tasks_write_workbooks_of_one_value(spark, tmp_path, monkeypatch):
    """A folder's workbooks are written where the rows are, several for a value, and none passes the driver row by row."""
    rows = [(k, (None, "a/b", "c", "N")[k % 4], None if k % 7 == 0 else k / 2, dt.date(1995, 1, 1 + k % 28), dt.datetime(1995, 1, 1, 0, 0, 1 + k % 50)) for k in range(200)]
    df = spark.createDataFrame(rows, "k bigint, s string, x double, d date, t timestamp_ntz").repartition(3)
    monkeypatch.setattr(W, "write_xlsx", None)
    folder = W.write_workbooks(df, f"file://{tmp_path}/books", "it", "s", book_rows=10)
    names = [p.name for p in (tmp_path / "books").glob("*.xlsx")]
    assert len(names) >= 20 and {n.rsplit("-", 1)[0] for n in names} == {"None", "a%2Fb", "c", "N"}
    got = IO.load_excel(spark, folder, "it")
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == rows
    one = IO.load_excel(spark, f"file://{tmp_path}/books/{sorted(names)[0]}", "it")
    assert one.select("s").distinct().count() == 1 and one.count() <= 10


def test_workbooks_by_status_come_from_several_tasks(spark, tmp_path, monkeypatch):
    """The query's tables are not written by the driver's process."""
    from riskloom import queries

    monkeypatch.setattr(IO, "write_xlsx", None)
    assert queries.workbooks_by_status(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
