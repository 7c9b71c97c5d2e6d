import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from examlake.fixed_values import DISPLAY_BANDS, SCORES
from examlake.operators import serving, views

GEO = "ANO int, SG_UF_PROVA string, CO_MUNICIPIO_PROVA bigint, NO_MUNICIPIO_PROVA string, INSCRITOS bigint" + "".join(
    f", {s}_count bigint, {s}_mean double" for s in SCORES
)


def towns(spark):
    def row(year, uf, code, name, people, count, mean):
        return (year, uf, code, name, people, *[count, mean] * 5)

    return spark.createDataFrame(
        [
            row(2022, "BA", 1, "AMELIA RODRIGUES", 100, 90, 500.0),
            row(2023, "BA", 1, "AMÉLIA RODRIGUES", 110, 95, 520.0),
            row(2023, "BA", 2, "AMELIA RODRIGUES", 10, 5, 400.0),
            row(2023, "SP", 3, "SÃO PAULO", 1000, 900, 620.0),
            row(2023, "SP", 4, "SANTA BÁRBARA D'OESTE", 40, 31, None),
        ],
        GEO,
    )


def test_page_order_paging_and_names(spark):
    first = serving.town_page(towns(spark), limit=2)
    assert [r.NO_MUNICIPIO_PROVA for r in first.collect()] == ["Amélia Rodrigues", "Santa Bárbara D'Oeste"]
    second = serving.town_page(towns(spark), limit=2, page=2)
    assert [(r.ANO, r.NO_MUNICIPIO_PROVA) for r in second.collect()] == [(2023, "São Paulo"), (2022, "Amelia Rodrigues")]
    assert dict(first.dtypes)["CO_MUNICIPIO_PROVA"] == "string"


def test_page_filters(spark):
    page = serving.town_page(towns(spark), [2023], ["ba"], [" amélia rodrigues"], min_count=0)
    assert {r.CO_MUNICIPIO_PROVA for r in page.collect()} == {"1", "2"}
    assert serving.town_count(towns(spark), years=[2023]).first().total == 3
    assert serving.check_export_size(towns(spark), ceiling=4, min_count=10) == 4
    with pytest.raises(ValueError, match="limit is 3"):
        serving.check_export_size(towns(spark), ceiling=3, min_count=10)


def test_town_list_prefers_accents(spark):
    got = [r.NO_MUNICIPIO_PROVA for r in serving.town_list(towns(spark)).collect()]
    assert got == ["Amélia Rodrigues", "Santa Bárbara D'Oeste", "São Paulo"]
    assert [r[0] for r in serving.town_list(towns(spark), "sp").collect()] == ["Santa Bárbara D'Oeste", "São Paulo"]


def test_evolution_uses_one_name_and_one_row_per_year(spark):
    rows = serving.town_evolution(towns(spark), "ba").collect()
    assert [(r.NO_MUNICIPIO_PROVA, r.ANO, r.QTD_ALUNOS) for r in rows] == [
        ("Amélia Rodrigues", 2022, 100),
        ("Amélia Rodrigues", 2023, 10),
    ]
    missing = serving.town_evolution(towns(spark), "SP", "santa barbara d'oeste").first()
    assert missing.MEDIA_FINAL == 0.0 and missing.MEDIA_CN is None
    assert serving.town_evolution(towns(spark), "SP", start=2024).count() == 0


def test_race_means(spark):
    cols = "ANO int, TP_COR_RACA int, SG_UF_PROVA string, NO_MUNICIPIO_PROVA string" + "".join(f", {s} double" for s in SCORES)
    rows = [(2022, r, "SP", "São Paulo", *[500.0] * 5) for r in (1, None, 9) for _ in range(101)]
    rows += [(2021, 1, "SP", "X", *[400.0] * 5)] * 102 + [(2022, 2, "SP", "X", *[1.0] * 5)] * 100
    df = spark.createDataFrame(rows, cols)
    out = serving.race_means(df).collect()
    assert [(r.ANO, r.RACA, r.COUNT) for r in out] == [
        (2022, "Branca", 101),
        (2022, "Não Disp.", 101),
        (2022, "Outros (9)", 101),
        (2021, "Branca", 102),
    ]
    one = serving.race_means(df, year=2022, state="sp", town="SAO PAULO").collect()
    assert {r.ANO for r in one} == {None} and len(one) == 3


def test_radar_and_years(spark):
    stats = spark.createDataFrame(
        [(2023, 9, *[10, 500.0] * 5), (2022, 9, *[0, 0.0] * 5), (2021, 9, *[None, None] * 5)],
        "ANO int, TOTAL_INSCRITOS bigint" + "".join(f", {s}_count bigint, {s}_mean double" for s in SCORES),
    )
    assert [r.ANO for r in serving.years_available(stats).collect()] == [2023]
    assert [r.ANO for r in serving.stats_range(stats, 2021).collect()] == [2022, 2023]
    states = towns(spark).drop("CO_MUNICIPIO_PROVA", "NO_MUNICIPIO_PROVA")
    rows = {r.metric: r for r in serving.radar(stats, states, 2023, "ba").collect()}
    assert len(rows) == 5
    r = rows["Redação"]
    assert (r.br_mean, r.uf_mean, r.best_uf_mean, r.full_mark) == (500.0, 520.0, 620.0, 1000)
    empty = serving.radar(stats, states, 1999).collect()
    assert len(empty) == 5 and {x.br_mean for x in empty} == {None}


def test_band_shares(spark):
    bands = spark.createDataFrame(
        [(2023, "SP", "Abaixo de 400", 1), (2023, "SP", "Alto desempenho", 2), (2022, "SP", "Alto desempenho", 5), (2023, "SP", "Intermediário alto", 0)],
        "ANO int, SG_UF_PROVA string, DESCRICAO_FAIXA string, QTD_ALUNOS bigint",
    )
    shares = serving.band_shares(serving.state_band_counts(bands, "sp", 2023))
    rows = shares.collect()
    assert [r.FAIXA for r in rows] == DISPLAY_BANDS
    assert [(r.QTD_ALUNOS, r.PERCENTUAL) for r in rows] == [(1, 33.33), (0, 0.0), (0, 0.0), (2, 66.67)]
    assert views.band_total(shares).first().total == 3
    none = serving.band_shares(serving.state_band_counts(bands, "RJ")).collect()
    assert [r.PERCENTUAL for r in none] == [0.0] * 4


def test_town_bands_do_not_round_or_cap(spark):
    cols = "ANO int, SG_UF_PROVA string, NO_MUNICIPIO_PROVA string" + "".join(f", {s} double" for s in SCORES)
    df = spark.createDataFrame(
        [(2023, "SP", "São Paulo", *[399.999] * 5), (2023, "SP", "SAO PAULO", *[1200.0] * 5), (2023, "SP", "SAO PAULO", None, *[1.0] * 4)],
        cols,
    )
    got = {r.FAIXA: r.QTD_ALUNOS for r in serving.town_band_counts(df, "SP", "são paulo", 2023).collect()}
    assert got == {"Abaixo de 400": 1, "Acima de 800": 1}


def test_guarded_sql(spark):
    towns(spark).createOrReplaceTempView("t_geo")
    assert serving.run_query(spark, "SELECT * FROM t_geo;", row_limit=2).count() == 2
    assert serving.run_query(spark, "SELECT * FROM t_geo LIMIT 4", row_limit=2).count() == 2
    assert serving.run_query(spark, "SELECT id, 'limit' AS x FROM range(60000)").count() == 60_000
    assert serving.run_query(spark, "SELECT 'drop table' AS x -- insert").count() == 1
    with pytest.raises(ValueError):
        serving.run_query(spark, "WITH x AS (SELECT 1) INSERT\nOVERWRITE DIRECTORY '/tmp/x' SELECT * FROM x")
    assert serving.run_query(spark, "SELECT * FROM t_geo WHERE ANO = :y", {"y": 2022}).count() == 1
    assert serving.preview(spark, "SELECT * FROM t_geo", 3).count() == 3
    for bad in ("DROP TABLE t_geo", "select 1; delete from t_geo", "CREATE TABLE x AS SELECT 1", "INSERT INTO t_geo VALUES (1)"):
        with pytest.raises(ValueError):
            serving.run_query(spark, bad)


@pytest.mark.parametrize(
    "hidden",
    [
        r"WITH x AS (SELECT r'\' AS c) INSERT OVERWRITE DIRECTORY '/tmp/p' USING parquet SELECT c FROM x",
        r"SELECT r'\' AS c, java_method('java.lang.System', 'getProperty', 'user.dir'), '",
        "SELECT * FROM t_geo WHERE ANO IN (SELECT `reflect`('java.lang.Math', 'abs', 1))",
        "WITH x AS (SELECT try_reflect('java.lang.Math', 'abs', 1)) SELECT * FROM x",
        "FROM t_geo SELECT TRANSFORM(ANO) USING 'cat' AS (x)",
        "WITH x AS (SELECT 1) SELECT * FROM x; SELECT 2",
    ],
)
def test_guard_goes_by_the_parsed_plan(spark, hidden):
    """No spelling of a literal hides a command, and no function reaches beyond Spark."""
    towns(spark).createOrReplaceTempView("t_geo")
    with pytest.raises((ValueError, ParseException)):
        serving.run_query(spark, hidden)


def test_guard_lets_lookups_pass(spark):
    towns(spark).createOrReplaceTempView("t_geo")
    for good in (
        "DESCRIBE t_geo",
        "SHOW TABLES",
        "SHOW COLUMNS IN t_geo",
        "EXPLAIN SELECT * FROM t_geo",
        "VALUES (1, 'insert into')",
        r"SELECT r'\' AS c, 'it''s' AS d",
        "WITH x AS (SELECT ANO FROM t_geo WHERE ANO IN (SELECT max(ANO) FROM t_geo)) SELECT count(*) FROM x",
        "SELECT ANO, row_number() OVER (ORDER BY ANO) FROM t_geo ORDER BY ANO LIMIT 1",
    ):
        assert serving.run_query(spark, good).count() > 0


def test_chart_views(spark):
    states = towns(spark).drop("CO_MUNICIPIO_PROVA", "NO_MUNICIPIO_PROVA")
    weighted = {r.uf: r for r in views.state_weighted_means(states).collect()}
    assert weighted["SP"].mat == 620.0 and weighted["SP"].inscritos == 1040
    assert weighted["BA"].mat == round((500 * 100 + 520 * 110 + 400 * 10) / 220, 1)
    yearly = views.yearly_unweighted_means(states, 2021, 2023).collect()
    assert [r.ANO for r in yearly] == [2021, 2022, 2023]
    assert [r.NOTA_REDACAO_mean for r in yearly] == [None, 500.0, pytest.approx((520 + 400 + 620) / 3)]
    assert views.metric_matrix(states, "NOTA_REDACAO_mean", 2023, 2023).count() == 3
    assert {r.id for r in views.map_keys(states, "NOTA_REDACAO_mean").collect()} == {"BR-BA", "BR-SP"}
    extent = views.map_values(states, "NOTA_REDACAO_mean", 2023).first()
    assert (extent.min_value, extent.max_value) == (400.0, 620.0)
    kpi = views.town_kpis(towns(spark).filter("SG_UF_PROVA = 'BA'")).first()
    assert (kpi.total_inscritos, kpi.total_provas) == (220, 190)
    assert kpi.media_geral == pytest.approx((500 + 520 + 400) / 3)
    last = views.last_row_per_year(states, ["SG_UF_PROVA", "INSCRITOS"]).collect()
    assert [(r.ANO, r.SG_UF_PROVA, r.INSCRITOS) for r in last] == [("2022", "BA", 100), ("2023", "SP", 1000)]
    series = {r.series: r for r in views.subject_series(serving.town_evolution(towns(spark), "BA")).collect()}
    assert series["MEDIA_CN"].years == [2022, 2023] and series["QTD_ALUNOS"].data == [100.0, 10.0]
    years = spark.createDataFrame([(y,) for y in (2008, 2009, 2021, 2022, 2023)], "ANO int")
    assert [r.ANO for r in views.default_years(years).collect()] == [2023, 2022, 2021]
    assert [r.ANO for r in views.year_choices(years).collect()] == [2023, 2022, 2021, 2009]


def test_race_views(spark):
    rows = spark.createDataFrame(
        [(2010, "Branca", 0.0, 500.0, 600.0, None, 0.0, 300), (2010, None, *[None] * 5, 5), (2012, "Branca", *[510.26] * 5, 7), (2012, "Branca", *[100.0] * 5, 3)],
        "ANO int, RACA string, NOTA_MATEMATICA double, NOTA_CIENCIAS_NATUREZA double, NOTA_CIENCIAS_HUMANAS double, "
        "NOTA_LINGUAGENS_CODIGOS double, NOTA_REDACAO double, COUNT bigint",
    )
    out = {r.year: r for r in views.race_history(rows, ["Branca", "Não declarada"], 2010, 2012).collect()}
    assert sorted(out) == ["2010", "2011", "2012"]
    assert out["2010"].Branca_value == 366.7 and out["2010"].Branca_discipline_count == 3
    assert out["2010"].Branca_linguagens == "s/d" and out["2010"].Nao_declarada_count == 5
    assert out["2011"].Branca_value is None
    assert out["2012"].Branca_value == 100.0
    ranked = views.race_ranking(rows.filter("ANO = 2010")).collect()
    assert [r.score for r in ranked] == [275.0, 0.0]
    filled = views.race_chart_rows(rows).filter(F.col("COUNT") == 5).first()
    assert (filled.RACA, filled.NOTA_REDACAO) == ("Não Informado", 0.0)


def test_histogram_peak_is_first_maximum(spark):
    df = spark.createDataFrame([(2020, "X", 0.0, 3), (2020, "X", 20.0, 7), (2020, "X", 40.0, 7)], "ANO int, DISCIPLINA string, BIN_START double, CONTAGEM bigint")
    assert [r.BIN_START for r in views.mark_peak(df).filter("is_peak").collect()] == [20.0]


def test_history_aligns_columns(spark):
    df = spark.createDataFrame([(2008, 1), (2010, 2)], "ANO int, TOTAL_INSCRITOS bigint")
    assert [r.INSCRITOS for r in views.history(df).collect()] == [2]
    assert [r.ANO for r in views.text_years(df).collect()] == ["2008", "2010"]


def test_rows_that_do_not_fit_are_left_out(spark):
    fields = "ANO int, SG_UF_PROVA string, INSCRITOS double" + "".join(f", {s}_count bigint" for s in SCORES)
    df = spark.createDataFrame(
        [(2023, "SP", 1000.0, *[5] * 5), (2023, "RJ", 100.5, *[5] * 5), (2023, None, 900.0, *[5] * 5), (2023, "BA", 900.0, *[None] * 5)],
        fields,
    )
    rows = serving.state_page(df).collect()
    assert [(r.SG_UF_PROVA, r.INSCRITOS, r.NOTA_REDACAO_mean) for r in rows] == [("SP", 1000, None)]


def test_rejected_rows_are_the_rest(spark):
    rows = towns(spark).withColumn("SG_UF_PROVA", F.when(F.col("CO_MUNICIPIO_PROVA") != 3, F.col("SG_UF_PROVA")))
    rows = rows.withColumn(f"{SCORES[0]}_count", F.when(F.col("CO_MUNICIPIO_PROVA") == 4, 31.5).otherwise(90.0))
    rejected = serving.rejected_rows(rows, serving.TOWN_ROW)
    assert sorted(r["CO_MUNICIPIO_PROVA"] for r in rejected.collect()) == [3, 4]
    assert rejected.columns == rows.columns
    assert serving.conforming_rows(rows, serving.TOWN_ROW).count() + rejected.count() == rows.count()
