import zipfile

import pytest

from graphloom.session import scratch_path
from graphloom.sources import tables as S
from graphloom.sources import xlsx as X


def test_checks(spark, tmp_path):
    with pytest.raises(FileNotFoundError) as error:
        S.require_paths(spark, {"first": str(tmp_path / "a.csv"), "second": str(tmp_path / "b.csv"), "there": str(tmp_path)})
    assert "first" in str(error.value) and "second" in str(error.value) and "there" not in str(error.value)
    with pytest.raises(ValueError, match="not supported"):
        S.load_source(spark, str(tmp_path / "a.json"))
    with pytest.raises(FileNotFoundError):
        S.load_source(spark, str(tmp_path / "a.csv"))
    with pytest.raises(KeyError, match="'y'"):
        S.require_columns(spark.range(1).toDF("x"), ["x", "y"], "here")


def test_encoding_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;nom\n1;Zoé\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id;nom\n2;Zoé\n".encode("latin-1"))
    got = {tuple(r) for r in S.load_source(spark, str(tmp_path / "*.csv"), "csv").collect()}
    assert got == {("1", "Zoé"), ("2", "Zoé")}
    assert {tuple(r) for r in S.load_source(spark, str(tmp_path / "b.csv")).collect()} == {("2", "Zoé")}


def test_csv_keeps_text(spark):
    df = spark.createDataFrame([("007", 'a;"b"\nc', None), ("01/02/2020", "", "x")], "a string, b string, c string")
    path = scratch_path(spark, "t") + ".csv"
    S.write_csv(df, path)
    got = S.read_csv(spark, path, multi_line=True)
    # an empty text is read as missing
    assert {tuple(r) for r in got.collect()} == {("007", 'a;"b"\nc', None), ("01/02/2020", None, "x")}


def test_workbook_cells(spark, tmp_path):
    """Shared and rich texts, numbers, flags, dates by style, gaps, errors."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = dict(X._PARTS)
    parts["xl/sharedStrings.xml"] = f"<sst {main}><si><t>id</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>"
    parts["xl/styles.xml"] = f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="str"><v>d</v></c></row>'
        '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.50</v></c><c r="D2" s="1"><v>43831</v></c></row>'
        '<row><c r="B3" t="b"><v>1</v></c><c r="C3" t="e"><v>#N/A</v></c><c r="D3" s="2"><v>43831.5</v></c></row>'
        '<row><c r="D4" s="3"><v>7</v></c></row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as book:
        for name, xml in parts.items():
            book.writestr(name, xml)
    df = S.load_source(spark, str(tmp_path / "w.xlsx"))
    assert df.columns == ["id", "n", "Unnamed: 2", "d"]
    assert [tuple(r) for r in df.collect()] == [("ab", "1.50", None, "2020-01-01 00:00:00"), (None, "True", None, "2020-01-01 12:00:00"), (None, None, None, "7")]


def test_workbook_folder(spark, tmp_path):
    df = spark.range(0, 50, 1, 2).selectExpr("id", "concat('<', id, '> & \"x\" ') t", "cast(null as string) z")
    assert X.write_xlsx(df, str(tmp_path), rows_per_file=10) == 50
    assert len(list(tmp_path.iterdir())) == 6
    got = X.read_xlsx(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(str(r["id"]), r["t"], None) for r in df.collect()}
    X.write_xlsx(spark.range(0, 9, 1, 9).toDF("other"), str(tmp_path))
    with pytest.raises(Exception, match="expected"):
        X.read_xlsx(spark, str(tmp_path)).collect()


def test_workbook_rows_longer_than_the_header(spark, tmp_path, monkeypatch):
    real = X._row_xml
    monkeypatch.setattr(X, "_row_xml", lambda values: real([*values, "more"] if list(values) != ["id"] else values))
    X.write_xlsx(spark.range(0, 2, 1, 1).toDF("id"), str(tmp_path))
    with pytest.raises(Exception, match="longer than its header"):
        X.read_xlsx(spark, str(tmp_path)).collect()


def test_conversion_replaces_or_reuses(spark, tmp_path):
    target = str(tmp_path / "out.csv")
    for k, reuse in ((1, False), (2, True), (3, False)):
        source = str(tmp_path / f"w{k}.xlsx")
        X.write_xlsx(spark.range(k).toDF(" id "), source)
        S.convert_table(spark, source, target, reuse=reuse)
        got = S.load_source(spark, target, sep=",")
        assert got.columns == ["id"] and got.count() == (1 if reuse else k)


def test_csv_faults_are_errors(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("a;b\n1;2;3\n")
    (tmp_path / "quoted.csv").write_text('a;b\n1;"x\ny"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.load_source(spark, str(tmp_path / "ragged.csv")).collect()
    assert [tuple(r) for r in S.load_source(spark, str(tmp_path / "ragged.csv"), mode="PERMISSIVE").collect()] == [("1", "2")]
    assert [tuple(r) for r in S.load_source(spark, str(tmp_path / "quoted.csv")).collect()] == [("1", "x\ny")]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "1.csv").write_text("id;name\n1;Ann\n")
    (tmp_path / "two" / "2.csv").write_text("name;id\nBob;2\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.load_source(spark, str(tmp_path / "two"), "csv").collect()
