import pytest

from examlake.operators import quality, reports
from examlake.operators.quality import Check
from examlake.sources.lake import Lake


def tables(spark, top=900.0):
    stats = spark.createDataFrame([(2020, 500.0), (2021, top)], "ANO int, NOTA_MATEMATICA_mean double")
    states = spark.createDataFrame([(2020, "SP"), (2020, "RJ")], "ANO int, SG_UF_PROVA string")
    boxes = spark.createDataFrame([("Sem Renda", 0.0, 990.0)], "CLASSE string, LOW double, HIGH double")
    return {"tb_notas_stats": stats, "tb_notas_geo_uf": states, "tb_socio_economico": boxes}


def test_dashboard_checks(spark):
    results = quality.run_checks(tables(spark)).collect()
    assert len(results) == 11 and all(r.passed for r in results)
    quality.assert_checks(tables(spark))
    with pytest.raises(RuntimeError, match="max"):
        quality.assert_checks(tables(spark, top=1001.0))


def test_duplicate_missing_and_empty_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    checks = [
        Check("t", "duplicate_count", "=", 0, ("k", "v")),
        Check("t", "missing_count", "=", 0, ("v",)),
        Check("e", "min", ">=", 0, ("k",)),
    ]
    got = {r.check_name: (r.value, r.passed) for r in quality.run_checks({"t": df, "e": df.filter("false")}, checks).collect()}
    assert got == {
        "duplicate_count(k, v) = 0": (1.0, False),
        "missing_count(v) = 0": (1.0, False),
        "min(k) >= 0": (None, False),
    }


def test_audits(spark):
    df = spark.createDataFrame([("1", 2016, "x"), ("2", 2016, "y")], "ID_INSCRICAO string, ANO int, COL_EXTRA string")
    row = quality.audit_dataset(df, "silver", "p", 2016, ["ID_INSCRICAO", "ANO"]).first()
    assert (row.row_count, row.column_count, row.missing_expected_columns) == (2, 3, None)
    assert row.columns_not_in_metadata == ["COL_EXTRA"] and row.has_ano_column
    meta = spark.createDataFrame([(2016, "ID_INSCRICAO"), (2016, "NOTA_CN"), (2017, "ANO")], "ano int, nome_padrao string")
    by_year = quality.audit_years(df, meta).first()
    assert by_year.missing_expected_columns == ["NOTA_CN"]
    assert by_year.columns_not_in_metadata == ["ANO", "COL_EXTRA"]
    assert quality.metadata_coverage(meta, [2016, 2017]) == "Metadados cobrem todos os anos configurados."
    note = quality.metadata_coverage(meta, range(2010, 2020))
    assert note == "Metadados sem cobertura para anos: [2010, 2011, 2012, 2013, 2014]..."


def test_masking_by_role(spark):
    df = spark.createDataFrame([("123456", "a@b", 7)], "NU_INSCRICAO string, email string, n int")
    assert reports.mask_personal(df, "admin").first().NU_INSCRICAO == "123456"
    row = reports.mask_personal(df).first()
    assert (row.NU_INSCRICAO, row.email, row.n) == ("12**56", "***", 7)


def test_sanitize_report(spark):
    df = spark.createDataFrame(
        [(" a\nb ", "1", 3048.0, 1.25, None), ("]|", "2,5", None, 2.0, 4)],
        "name string, code string, whole double, part double, n int",
    )
    out = reports.sanitize_report(df)
    rows = out.orderBy("part").collect()
    assert [tuple(r) for r in rows] == [("a b", 1.0, 3048, 1.2, 0), ("", 2.5, 0, 2.0, 4)]
    assert dict(out.dtypes)["whole"] == "bigint"


def test_filter_summary():
    assert reports.filter_summary() == "Filtros: Todos os registros"
    assert reports.filter_summary([2023, 2021], ["SP", "BA"]) == "Anos: 2021, 2023 | UFs: BA, SP"
    long = reports.filter_summary(towns=["x" * 40, "y" * 40])
    assert long.endswith("...") and len(long) == len("Municípios: ") + 60


def test_number_formats(spark):
    df = spark.createDataFrame([(2020, 12.0, 512.25, None)], "Ano int, Inscritos double, Nota double, Outra double")
    assert tuple(reports.format_numbers(df).first()) == ("2020", "12", "512,3", "")


def test_head_with_flag(spark):
    df = spark.range(50)
    cut = reports.head_with_flag(df, ["id"], 10)
    assert [(r.id, r.truncated) for r in cut.collect()] == [(i, True) for i in range(10)]
    assert {r.truncated for r in reports.head_with_flag(df, ["id"], 50).collect()} == {False}


CHECK_FILE = """
# what the dashboard needs
checks for tb_notas_stats:
  - row_count > 0
  - missing_count(ANO) = 0   # no year
checks for tb_other:
  - duplicate_count(ANO, SG_UF_PROVA) = 0
  - max( HIGH ) <= 1000.5
"""


def test_checks_from_a_file(spark, tmp_path):
    path = tmp_path / "checks.yml"
    path.write_text(CHECK_FILE)
    checks = quality.load_checks(spark, str(path))
    assert checks == (
        Check("tb_notas_stats", "row_count", ">", 0),
        Check("tb_notas_stats", "missing_count", "=", 0, ("ANO",)),
        Check("tb_other", "duplicate_count", "=", 0, ("ANO", "SG_UF_PROVA")),
        Check("tb_other", "max", "<=", 1000.5, ("HIGH",)),
    )
    assert quality.parse_checks(quality.checks_text(quality.DASHBOARD_CHECKS)) == quality.DASHBOARD_CHECKS


@pytest.mark.parametrize("bad", ["- row_count > 0", "checks for t:\n- row_count", "checks for t:\n- mean(A) > 0", "checks for t:\n- min > 0", "checks for t:\n- row_count(A) > 0", "t:"])
def test_bad_check_files_are_refused(bad):
    with pytest.raises(ValueError, match="line"):
        quality.parse_checks(bad)


def test_checks_are_measured_while_writing(spark, tmp_path):
    checks = [
        Check("t", "row_count", ">", 2), Check("t", "missing_count", "=", 0, ("a",)), Check("t", "min", ">=", 0, ("b",)), Check("t", "max", "<=", 5, ("b",)),
        Check("t", "duplicate_count", "=", 0, ("a",)), Check("other", "row_count", ">", 0),
    ]
    df = spark.createDataFrame([("x", 1.0), ("x", 9.0), (None, 2.0)], "a string, b double").orderBy("b")
    store = Lake(str(tmp_path)).begin()
    found = quality.checked_write(store, df, "t", checks)
    assert {(o.check_name, o.value, o.passed) for o in found} == {
        ("row_count > 2", 3.0, True), ("missing_count(a) = 0", 1.0, False), ("min(b) >= 0", 1.0, True), ("max(b) <= 5", 9.0, False), ("duplicate_count(a) = 0", 1.0, False),
    }
    assert not Lake(str(tmp_path)).exists(spark, "t") and store.read(spark, "t").count() == 3
    with pytest.raises(RuntimeError, match="max"):
        quality.assert_outcomes(found)
    empty = quality.checked_write(store, df.limit(0), "t", checks)
    assert {o.check_name for o in empty if not o.passed} == {"row_count > 2", "min(b) >= 0", "max(b) <= 5"}


def test_a_written_report_equals_the_sanitized_one(spark, tmp_path):
    rows = [("1,5", "x\x07y", 2.0, 2.5, None, 1), ("7", None, 3.0, float("nan"), None, None), (None, " a ", None, 1.0, None, 3)]
    df = spark.createDataFrame(rows, "n string, t string, w double, f double, e string, i int")
    for name, frame in {"rows": df, "none": df.limit(0)}.items():
        plain, written = reports.sanitize_report(frame), reports.write_report(frame, str(tmp_path / name))
        assert written.dtypes == plain.dtypes
        assert sorted(map(str, written.collect())) == sorted(map(str, plain.collect()))
    assert reports.write_report(df.select("i"), str(tmp_path / "ints")).count() == 3
