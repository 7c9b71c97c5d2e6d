import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlake.fixed_values import SCORES
from examlake.operators import gold
from examlake.operators.quantiles import exact_quantiles


def scores_frame(spark, rows, extra="ANO int, ID_INSCRICAO string, TP_SEXO string, NU_IDADE int"):
    return spark.createDataFrame(rows, extra + "".join(f", {s} double" for s in SCORES))


def two_years(spark):
    rows = []
    for year in (2019, 2020):
        rows.append((year, f"{year}1", "M", 18, 500.0, 550.0, 580.0, 520.0, 600.0))
        rows.append((year, f"{year}2", "F", 19, 600.0, 650.0, 680.0, 720.0, 700.0))
    return scores_frame(spark, rows)


def test_year_stats(spark):
    stats = gold.year_stats(two_years(spark))
    assert len(stats.columns) == 37
    row = stats.filter("ANO = 2019").first()
    assert (row.TOTAL_INSCRITOS, row.IDADE_median, row.NOTA_MATEMATICA_mean) == (2, 18.5, 620.0)
    assert row.NOTA_MATEMATICA_std == pytest.approx(np.std([520, 720], ddof=1))


def test_year_stats_with_nothing_valid(spark):
    rows = [(2001, "a", "M", 7, None, 1000.1, -1.0, 10.0, None), (2001, None, "M", 121, None, None, None, None, None)]
    row = gold.year_stats(scores_frame(spark, rows)).first()
    assert row.IDADE_mean is None and row.IDADE_median is None
    assert (row.NOTA_REDACAO_count, row.NOTA_REDACAO_mean, row.NOTA_REDACAO_max) == (0, 0.0, 0.0)
    # One value: its sample deviation is undefined and shown as zero.
    assert (row.NOTA_MATEMATICA_count, row.NOTA_MATEMATICA_std) == (1, 0.0)
    assert row.TOTAL_INSCRITOS == 1


def test_unique_ids_shortcut_agrees(spark):
    df = two_years(spark)
    assert gold.year_stats(df).orderBy("ANO").collect() == gold.year_stats(df, unique_ids=True).orderBy("ANO").collect()


def place_frame(spark):
    extra = (
        "ANO int, ID_INSCRICAO string, SG_UF_PROVA string, CO_MUNICIPIO_PROVA string, NO_MUNICIPIO_PROVA string, "
        "TP_PRESENCA_CN int, TP_PRESENCA_LC int"
    )
    rows = [
        (2020, "1", "SP", "35", "A", 1, 1, 500.0, 500.0, 500.0, 500.0, 500.0),
        (2020, "1", "SP", "35", "A", 0, 0, 700.0, 700.0, 700.0, 700.0, 700.0),
        (2020, "2", "SP", "35", "A", 1, None, 600.0, 1200.0, 600.0, 600.0, 600.0),
        (2020, None, "SP", None, "A", 1, 1, 100.0, 100.0, 100.0, 100.0, 100.0),
        (2020, "9", None, "35", "A", 1, 1, 100.0, 100.0, 100.0, 100.0, 100.0),
    ]
    return scores_frame(spark, rows, extra)


def test_town_scores_need_presence_and_a_full_place(spark):
    row = gold.town_scores(place_frame(spark)).collect()
    assert len(row) == 1
    row = row[0]
    assert row.INSCRITOS == 2
    assert (row.NOTA_CIENCIAS_NATUREZA_count, row.NOTA_CIENCIAS_NATUREZA_mean) == (2, 550.0)
    assert row.NOTA_CIENCIAS_HUMANAS_count == 2  # no CH flag column: range only
    assert (row.NOTA_LINGUAGENS_CODIGOS_count, row.NOTA_REDACAO_count) == (1, 1)


def test_state_scores_check_the_range_only(spark):
    row = gold.state_scores(place_frame(spark)).first()
    assert (row.INSCRITOS, row.NOTA_CIENCIAS_NATUREZA_count, row.NOTA_CIENCIAS_HUMANAS_count) == (2, 4, 3)


def test_missing_columns_give_a_typed_empty_table(spark):
    df = spark.createDataFrame([(2020, "SP")], "ANO int, SG_UF_PROVA string")
    for table in (gold.town_scores(df), gold.state_scores(df)):
        assert table.count() == 0 and "NOTA_REDACAO_mean" in table.columns


def test_without_ids_rows_are_counted(spark):
    assert gold.state_scores(place_frame(spark).drop("ID_INSCRICAO")).first().INSCRITOS == 4


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    xs = [*rng.uniform(-20, 1020, 400), 0.0, 20.0, 980.0, 1000.0]
    rows = [(2020, str(i), "M", 20, float(x), None, None, None, None) for i, x in enumerate(xs)]
    out = gold.score_histogram(scores_frame(spark, rows)).orderBy("BIN_START").collect()
    assert {r.DISCIPLINA for r in out} == {"NOTA_CIENCIAS_NATUREZA"}
    inside = [x for x in xs if 0 <= x <= 1000]
    assert [r.CONTAGEM for r in out] == np.histogram(inside, bins=np.linspace(0, 1000, 51))[0].tolist()
    assert [r.BIN_START for r in out] == [i * 20.0 for i in range(50)]


def test_income_boxes(spark):
    extra = (
        "ANO int, ID_INSCRICAO string, Q006 string, TP_PRESENCA_CN int, TP_PRESENCA_CH int, TP_PRESENCA_LC int, "
        "TP_PRESENCA_MT int, TP_STATUS_REDACAO int"
    )
    people = [("Q", 1, 800.0), ("Q", 1, 700.0), ("B", 1, 400.0), ("B", 0, 0.0), ("Z", 1, 500.0)]
    rows = [(2023, str(i), q, p, p, p, p, 1, *[s] * 5) for i, (q, p, s) in enumerate(people)]
    out = {r.CLASSE: r for r in gold.income_boxes(scores_frame(spark, rows, extra)).collect()}
    assert set(out) == {"Classe A (> 20 SM)", "Classe E (< 2 SM)"}
    a, e = out["Classe A (> 20 SM)"], out["Classe E (< 2 SM)"]
    assert (a.COUNT, a.MEDIAN, a.LOW, a.HIGH, a.Q1, a.Q3) == (2, 750.0, 700.0, 800.0, 725.0, 775.0)
    assert (e.COUNT, e.MEDIAN) == (1, 400.0)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_pandas(spark, seed):
    """Ties, outliers, one value holding a third of the rows, tiny groups."""
    rng = np.random.default_rng(seed)
    parts = [
        ("a", rng.uniform(0, 1000, 700)),
        ("b", np.where(rng.random(600) < 0.34, 512.5, rng.normal(500, 400, 600))),
        ("c", np.array([3.0])),
        ("d", np.array([5.0, 900.0])),
        ("e", rng.integers(0, 4, 300) * 1.0),
        ("f", 250 + rng.random(500) * 1e-6),
    ]
    pdf = pd.concat([pd.DataFrame({"g": g, "v": x}) for g, x in parts])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", None)], "g string, v double"))
    wanted = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0}
    got = exact_quantiles(df, ["g"], "v", wanted, 0, 1000, 20).toPandas().set_index("g")
    for name, q in wanted.items():
        assert np.allclose(got[name].sort_index(), pdf.groupby("g")["v"].quantile(q), rtol=0, atol=1e-9)


def test_five_score_mean_and_bands(spark):
    rows = [
        (2020, "1", "SP", 20, 400.0, 400.0, 400.0, 400.0, 399.975),
        (2020, "2", "SP", 20, 600.0, 600.0, 600.0, 600.0, 600.0),
        (2020, "3", None, 20, 1000.0, 1000.0, 1000.0, 1000.0, 1000.0),
        (2020, "4", "SP", 20, 600.0, 600.0, 600.0, 600.0, None),
        (2020, "5", "SP", 20, 600.0, 600.0, 600.0, 600.0, 1001.0),
    ]
    df = scores_frame(spark, rows, "ANO int, ID_INSCRICAO string, SG_UF_PROVA string, NU_IDADE int")
    means = {r.ID_INSCRICAO: r.MEDIA_5_DISC for r in gold.five_score_means(df).collect()}
    assert means == {"1": pytest.approx(np.round((400.0 * 4 + 399.975) / 5, 2)), "2": 600.0, "3": 1000.0}
    bands = {(r.SG_UF_PROVA, r.ID_FAIXA): r.QTD_ALUNOS for r in gold.state_bands(df).collect()}
    assert bands[("SP", 3)] == 1 and bands[("XX", 4)] == 1 and sum(bands.values()) == 3
    dense = gold.state_bands(df, dense=True)
    assert dense.count() == 8 and dense.agg(F.sum("QTD_ALUNOS")).first()[0] == 3


def test_custom_bands(spark):
    df = scores_frame(spark, [(2020, "1", "SP", 20, *[700.0] * 5)], "ANO int, ID string, SG_UF_PROVA string, NU_IDADE int")
    row = gold.state_bands(df, [(1, 0, 650, "low"), (2, 650, 1000, "high")]).first()
    assert (row.ID_FAIXA, row.DESCRICAO_FAIXA) == (2, "high")


def test_town_dimension(spark):
    rows = [("3550308", "São Paulo")] * 2 + [("3550308", "Sao Paulo")] * 2 + [("3550308", "SP")] + [("9900000", "X")]
    df = spark.createDataFrame([*rows, (None, "Y"), ("1", None)], "CO_MUNICIPIO_PROVA string, NO_MUNICIPIO_PROVA string")
    dim = gold.town_dimension(df)
    assert [tuple(r) for r in dim.collect()] == [(3550308, "Sao Paulo", "SP")]
    gold.assert_unique(dim, ["CO_MUNICIPIO_PROVA"])
    with pytest.raises(ValueError):
        gold.assert_unique(dim.union(dim), ["CO_MUNICIPIO_PROVA"])


def test_year_counts(spark):
    assert {r.ANO: r.n_linhas_silver for r in gold.year_counts(two_years(spark)).collect()} == {2019: 2, 2020: 2}


def test_hot_town_is_combined_before_the_shuffle(spark):
    plan = gold.town_scores(place_frame(spark), unique_ids=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_bands_from_a_file(spark, tmp_path):
    path = tmp_path / "bands.json"
    path.write_text('[{"id": 2, "min": 650, "max": 1000, "descricao": "high"}, {"id": 1, "min": 0, "max": 650, "descricao": "low"}]')
    assert gold.load_bands(spark, str(path)) == [(1, 0, 650, "low"), (2, 650, 1000, "high")]
    assert len(gold.load_bands(spark)) == 4


def test_bands_from_a_file(spark, tmp_path):
    path = tmp_path / "bands.yaml"
    path.write_text("# x\r\nfaixas:\r\n  - id: 7\r\n    min: 100\r\n    max: 400 # y\r\n    descricao: \"A: b\"\r\n  - id: 8\r\n    cor: z\r\n    min: 400\r\n    max: 1000\r\n    descricao: Alto\r\n", "utf-8")
    bands = gold.bands_from_file(spark, str(path))
    assert [tuple(r) for r in bands.orderBy("place").collect()] == [(1, 7, 100.0, 400.0, "A: b"), (2, 8, 400.0, 1000.0, "Alto")]
    values = [50.0, 100.0, 399.99, 400.0, 1000.0]
    df = scores_frame(spark, [(2020, str(i), "SP", 20, *[v] * 5) for i, v in enumerate(values)], "ANO int, ID_INSCRICAO string, SG_UF_PROVA string, NU_IDADE int")
    got = {r.ID_FAIXA: r.QTD_ALUNOS for r in gold.state_bands_joined(df, bands).collect()}
    assert got == {7: 3, 8: 2}  # 50 lies in no band and falls to the first


def test_bands_joined_equal_the_default_ones_and_overlap(spark):
    rng = np.random.default_rng(4)
    rows = [(2019 + i % 2, str(i), ["SP", "BA", None][i % 3], 20, *map(float, rng.uniform(0, 1000, 5).round(1))) for i in range(300)]
    df = scores_frame(spark, rows, "ANO int, ID_INSCRICAO string, SG_UF_PROVA string, NU_IDADE int")
    table = spark.createDataFrame([(i, b[0], float(b[1]), float(b[2]), b[3]) for i, b in enumerate(gold.MEAN_BANDS)], gold.BANDS)
    assert sorted(map(tuple, gold.state_bands_joined(df, table).collect()), key=str) == sorted(map(tuple, gold.state_bands(df).collect()), key=str)
    twice = table.unionByName(table.withColumn("place", F.col("place") + 10).withColumn("id", F.lit(99)))
    assert gold.state_bands_joined(df, twice).agg(F.sum("QTD_ALUNOS")).first()[0] == 300
    assert not gold.state_bands_joined(df, twice).filter("ID_FAIXA = 99").count()
    assert gold.state_bands_joined(df.limit(0), table).count() == 0


def test_exact_summary_of_odd_groups(spark):
    """Null groups, groups without values, single values, values out of the range; two reads of the rows."""
    from examlake.operators.quantiles import exact_summary

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(500, 300, 2000)] + [("one", 5.0), ("none", None), ("none", None), (None, 1.0), (None, 3.0), ("same", 7.0), ("same", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in exact_summary(df, ["g"], "v", {"q1": 0.25, "median": 0.5}, 0, 1000, 50).collect()}
    values = np.array([v for g, v in rows if g == "a"])
    assert (got["a"]["count"], got["a"]["min"], got["a"]["max"]) == (2000, values.min(), values.max())
    assert got["a"]["mean"] == pytest.approx(values.mean(), rel=1e-12) and got["a"]["std"] == pytest.approx(values.std(ddof=1), rel=1e-12)
    assert got["a"]["q1"] == pytest.approx(np.quantile(values, 0.25), rel=1e-12)
    assert tuple(got["none"])[1:] == (0, None, None, None, None, None, None)
    assert tuple(got["one"])[1:] == (1, 5.0, None, 5.0, 5.0, 5.0, 5.0)
    assert tuple(got[None])[1:4] == (2, 2.0, pytest.approx(2**0.5)) and got[None]["median"] == 2.0
    assert got["same"]["std"] == 0.0
    assert exact_summary(df.limit(0), ["g"], "v", {"median": 0.5}, 0, 1000).count() == 0
    found = exact_summary(df, ["g"], "v", {"median": 0.5}, 0, 1000)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan ExistingRDD") <= 2
