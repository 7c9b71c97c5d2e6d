"""Raw files to gold on disk, exports, and the published tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from examlake.operators import metadata
from examlake.operators.cleaning import CleaningPlan, DomainRule
from examlake.operators.quality import Check
from examlake.plans import build
from examlake.sources import exports, raw_files
from examlake.sources.lake import ConcurrentCommit, Lake, missing_years, only_years, select_years

HEAD = (
    "NU_INSCRICAO;{uf};CO_MUNICIPIO_PROVA;NO_MUNICIPIO_PROVA;TP_SEXO;NU_IDADE;Q006;TP_PRESENCA_CN;TP_PRESENCA_CH;"
    "TP_PRESENCA_LC;TP_PRESENCA_MT;TP_STATUS_REDACAO;NU_NOTA_CN;NU_NOTA_CH;NU_NOTA_LC;NU_NOTA_MT;NU_NOTA_REDACAO;EXTRA\n"
)


def line(n, town="São Paulo", score="500,5", age=18, income="Q"):
    return f"{n};sp;3550308;{town};m;{age};{income};1;1;1;1;1;{score};600;700;650;800;z\n"


@pytest.fixture(scope="module")
def raw_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    years = {
        2019: HEAD.format(uf="SG_UF_PROVA") + line(1) + line(1, score="900") + line(2, age=200) + line(3, score="1200"),
        2020: HEAD.format(uf="SG_UF_RESIDENCIA") + line(1) + line(2, town="Sao Paulo") + line(4, income="B"),
    }
    for year, text in years.items():
        folder = root / f"microdados_x_{year}" / "Dados"
        folder.mkdir(parents=True)
        (folder / f"MICRODADOS_X_{year}.csv").write_bytes(text.encode("latin-1"))
    return str(root)


@pytest.fixture(scope="module")
def lake(spark, raw_root, tmp_path_factory):
    made = Lake(str(tmp_path_factory.mktemp("lake")))
    plan = CleaningPlan(domains=(DomainRule("Q006", ("Q",)),))
    build.build_lake(spark, raw_root, made, [2019, 2020], plan)
    return made


def test_silver_and_cleaned(spark, lake):
    assert lake.years(spark, "silver") == [2019, 2020]
    silver = lake.read(spark, "silver")
    assert silver.count() == 7 and {r.SG_UF_PROVA for r in silver.select("SG_UF_PROVA").distinct().collect()} == {"SP"}
    cleaned = lake.read(spark, "cleaned")
    first = cleaned.filter("ANO = 2019 AND ID_INSCRICAO = '1'").collect()
    assert [r.NOTA_CIENCIAS_NATUREZA for r in first] == [500.5]  # the first copy in the file is kept
    assert cleaned.filter("ANO = 2020").count() == 3
    assert cleaned.filter("Q006 = 'UNKNOWN'").count() == 1
    report = {(r.ANO, r.rule): r.affected_rows for r in lake.read(spark, "cleaning_report").collect()}
    assert report == {(2019, "duplicates"): 1, (2020, "domain:Q006"): 1}
    assert lake.read(spark, "cleaning_duplicates").count() == 1


def test_year_filter_prunes_folders(spark, lake):
    plan = only_years(lake.read(spark, "cleaned", ["ANO", "NU_IDADE"]), [2020])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ANO" in plan or "PartitionFilters: [ANO" in plan or "PartitionFilters: [(ANO" in plan
    assert "ReadSchema: struct<NU_IDADE:bigint>" in plan


def test_gold_tables(spark, lake):
    stats = {r.ANO: r for r in lake.read(spark, "tb_notas_stats").collect()}
    assert stats[2019].TOTAL_INSCRITOS == 3 and stats[2019].NOTA_CIENCIAS_NATUREZA_count == 2
    towns = lake.read(spark, "tb_notas_geo").collect()
    assert {(r.ANO, r.NO_MUNICIPIO_PROVA, r.INSCRITOS) for r in towns} == {
        (2019, "São Paulo", 3),
        (2020, "São Paulo", 2),
        (2020, "Sao Paulo", 1),
    }
    assert lake.read(spark, "dim_municipio").first().NO_MUNICIPIO_PROVA == "São Paulo"
    assert {r.CLASSE for r in lake.read(spark, "tb_socio_economico").collect()} == {"Classe A (> 20 SM)"}
    assert lake.read(spark, "classes").filter("CLASS_RENDA_FAMILIAR IS NULL").count() == 6
    assert lake.read(spark, "tb_notas").count() == 6


def test_skip_existing_and_one_year_again(spark, lake, raw_root, monkeypatch):
    cleaned = []
    real = build.silver_to_cleaned
    monkeypatch.setattr(build, "silver_to_cleaned", lambda s, l, y, p: cleaned.append(list(y)) or real(s, l, y, p))
    build.build_lake(spark, raw_root, lake, [2019, 2020], skip_existing=True)
    assert cleaned == []
    before = lake.read(spark, "cleaned").filter("ANO = 2019").count()
    build.raw_to_silver(spark, lake, raw_root, [2020])
    assert lake.read(spark, "silver").count() == 7
    assert lake.read(spark, "cleaned").filter("ANO = 2019").count() == before
    wanted = spark.createDataFrame([(2018,), (2019,)], "ANO int")
    assert [r.ANO for r in missing_years(wanted, lake.read(spark, "cleaned")).collect()] == [2018]


def test_publish_describe_and_audit(spark, lake):
    build.publish_dashboard(spark, lake)
    assert spark.table("tb_notas_stats").count() == 2
    described = exports.describe_tables(spark).filter("table_name = 'gold_tb_notas_geo_uf'")
    assert described.count() == 13
    meta = spark.createDataFrame(
        [(y, c, c, "", "string", None) for y in (2019, 2020) for c in ("ID_INSCRICAO", "MISSING")], metadata.METADATA_SCHEMA
    )
    metadata.save_metadata(meta, lake.path("variaveis_meta"))
    report = build.audit_lake(spark, lake, meta, [2019, 2020], save_as="parquet_audit_report")
    silver = report.filter("layer = 'silver'").collect()
    assert {(r.ano, r.row_count) for r in silver} == {(2019, 4), (2020, 3)}
    assert all(r.missing_expected_columns == ["MISSING"] for r in silver)
    gold = {Path(r.parquet_path).name: r for r in report.filter("layer = 'gold'").collect()}
    assert gold["tb_notas_stats"].row_count == 2
    assert gold["variaveis_meta"].notes.startswith("Metadados sem cobertura")
    assert lake.read(spark, "parquet_audit_report").count() == report.count()


def test_missing_required_view_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="silver"):
        exports.publish_views(spark, Lake(str(tmp_path)))


def read_parts(path):
    return [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text("utf-8").splitlines()]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a;b", None, 1.25), ('q"t', "x", None)], "NO_MUNICIPIO_PROVA string, SG_UF_PROVA string, v double").coalesce(1)
    exports.export_csv(df, str(tmp_path / "csv"))
    assert read_parts(tmp_path / "csv") == ["NO_MUNICIPIO_PROVA;SG_UF_PROVA;v", "a,b;;1.25", 'q"t;x;']
    exports.export_json(df, str(tmp_path / "json"))
    assert read_parts(tmp_path / "json")[0] == '{"NO_MUNICIPIO_PROVA":"a;b","SG_UF_PROVA":null,"v":1.25}'
    scores = ", ".join(f"{s} double" for s in exports.TABLE_SCORE_HEADERS)
    town = spark.createDataFrame([(2020, "SP", 'A "B"', 512.26, None, 1.0, 2.0, 3.0)], f"ANO int, SG_UF_PROVA string, NO_MUNICIPIO_PROVA string, {scores}")
    exports.export_labelled_csv(town.coalesce(1), str(tmp_path / "table"))
    assert read_parts(tmp_path / "table") == [
        '"Ano";"UF";"Município";"Natureza";"Humanas";"Linguagens";"Matemática";"Redação"',
        '"2020";"SP";"A ""B""";"512.3";"";"1.0";"2.0";"3.0"',
    ]


def test_year_lists():
    assert select_years([2020, 2019, 2020]) == [2019, 2020]
    assert select_years(year=2001) == [2001]
    assert select_years(start=2022) == [2022, 2023, 2024]
    assert len(select_years()) == 27


def test_append_and_empty_results_keep_the_schema(spark, tmp_path):
    made = Lake(str(tmp_path))
    df = spark.createDataFrame([(2020, "a")], "ANO int, v string")
    made.write(df, "cleaned")
    made.write(df, "cleaned", append=True)
    assert made.read(spark, "cleaned").count() == 2
    made.write(df.filter(F.lit(False)), "empty", partition_by=[])
    assert made.read(spark, "empty").columns == ["ANO", "v"]


# ------------------------------------------------------------------ snapshots
def test_stale_years_go_and_others_stay(spark, tmp_path):
    made = Lake(str(tmp_path))
    made.write(spark.createDataFrame([(2020, "a"), (2021, "b"), (2022, "c")], "ANO int, v string"), "silver")
    made.write(spark.createDataFrame([(2020, "x")], "ANO int, v string"), "silver", years=[2020, 2021])
    assert sorted(map(tuple, made.read(spark, "silver", ["ANO", "v"]).collect())) == [(2020, "x"), (2022, "c")]
    assert made.years(spark, "silver") == [2020, 2022]
    assert made.read(spark, "silver", version=1).count() == 3  # the first snapshot is still whole
    made.write(spark.createDataFrame([], "ANO int, v string"), "silver", years=[2020, 2022])
    assert made.read(spark, "silver").columns == ["v", "ANO"] and made.read(spark, "silver").count() == 0


def test_nothing_is_seen_before_commit(spark, tmp_path):
    made = Lake(str(tmp_path))
    made.write(spark.range(3), "a")
    own = made.begin()
    own.write(spark.range(5), "a")
    own.write(spark.range(7), "b")
    own.mark_complete([2020])
    assert own.read(spark, "a").count() == 5 and made.read(spark, "a").count() == 3
    assert not made.exists(spark, "b") and made.complete_years(spark) == []
    assert own.commit(spark) == 2
    assert (made.read(spark, "a").count(), made.read(spark, "b").count(), made.complete_years(spark)) == (5, 7, [2020])


def test_two_writers_of_one_table(spark, tmp_path):
    made = Lake(str(tmp_path))
    one, two, three = made.begin(), made.begin(), made.begin()
    one.write(spark.range(1), "a")
    two.write(spark.range(2), "a")
    three.write(spark.range(3), "b")
    one.commit(spark)
    with pytest.raises(ConcurrentCommit):
        two.commit(spark)
    three.commit(spark)  # another table: both commits hold
    assert (made.read(spark, "a").count(), made.read(spark, "b").count()) == (1, 3)
    assert not made._publish(spark, {"version": 1, "tables": {}, "complete": []})  # a version is never written over
    gone = made.vacuum(spark, keep=1)
    assert len(gone) == 1 and gone[0].startswith("a/") and made.read(spark, "a").count() == 1


def test_one_write_as_several_tables(spark, tmp_path):
    made = Lake(str(tmp_path))
    rows = spark.createDataFrame([(2020, "x", 1), (2020, "y", 2), (2021, "x", 3)], "ANO int, kind string, v int")
    folder = made.write_split(rows, "all", "kind", {"x": "xs", "y": "ys", "z": "zs"}, hide=["v"], years=[2020, 2021])
    assert sorted(r.ANO for r in made.read(spark, "xs").collect()) == [2020, 2021]
    assert made.read(spark, "ys").columns == ["ANO"] and made.read(spark, "zs").count() == 0
    assert spark.read.parquet(folder).count() == 3 and made.read(spark, "xs", position=True).columns[-1] == "_POS"


def test_columns_that_came_later(spark, tmp_path):
    made = Lake(str(tmp_path))
    made.write(spark.createDataFrame([(2020, "a")], "ANO int, v string"), "cleaned")
    made.write(spark.createDataFrame([(2021, "b", 5)], "ANO int, v string, w int"), "cleaned", append=True)
    assert sorted(map(tuple, made.read(spark, "cleaned", ["ANO", "w"]).collect()), key=str) == [(2020, None), (2021, 5)]
    assert set(made.read(spark, "cleaned", merge_schema=True).columns) == {"ANO", "v", "w"}


def test_a_build_that_stops_leaves_the_lake_as_it_was(spark, raw_root, tmp_path, monkeypatch):
    made = Lake(str(tmp_path / "lake"))
    build.build_lake(spark, raw_root, made, [2019], with_gold=False)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(build, "cleaned_to_classes", stop)
        with pytest.raises(RuntimeError):
            build.build_lake(spark, raw_root, made, [2019, 2020], skip_existing=True, with_gold=False)
    assert made.years(spark, "cleaned") == made.complete_years(spark) == [2019]
    build.build_lake(spark, raw_root, made, [2019, 2020], skip_existing=True, with_gold=False)
    assert made.years(spark, "classes") == made.complete_years(spark) == [2019, 2020]


def test_a_failed_check_stops_the_build(spark, raw_root, tmp_path):
    made = Lake(str(tmp_path / "lake"))
    with pytest.raises(RuntimeError, match="tb_notas_stats"):
        build.build_lake(spark, raw_root, made, [2019], checks=[Check("tb_notas_stats", "row_count", ">", 5)])
    assert made.versions(spark) == []
    build.build_lake(spark, raw_root, made, [2019], checks=[Check("tb_notas_stats", "row_count", "=", 1)])
    assert made.read(spark, "tb_notas_stats").count() == 1


# ------------------------------------------------------------------ the catalog of raw files
def test_catalog_lists_files_and_folders_of_parts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "Microdados_A_2019.CSV").write_bytes("\ufeffNU_INSCRICAO;Município\r\n1;2\r\n".encode("utf-8"))
    spark.createDataFrame([("1", "2")], '`NU_NOTA_CN` string, `q;uoted` string').coalesce(1).write.options(header=True, sep=";").csv(str(tmp_path / "resultados_2019.csv"))
    (tmp_path / "notes.txt").write_text("x")
    files = {f.name: f for f in raw_files.catalog(spark, str(tmp_path), "utf-8")}
    assert files["Microdados_A_2019.CSV"].columns == ("NU_INSCRICAO", "Município")
    assert files["resultados_2019.csv"].columns == ("NU_NOTA_CN", "q;uoted") and len(files) == 2
    assert [f.name for f in raw_files.files_of_year(list(files.values()), 2019, "")] == ["Microdados_A_2019.CSV"]
    assert raw_files.catalog(spark, str(tmp_path / "absent")) == []


def test_the_same_file_in_two_places_is_refused(spark, tmp_path):
    for folder in ("DADOS", "copy"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"microdados_x_2019.{'csv' if folder == 'copy' else 'CSV'}").write_text("A;B\n1;2\n")
    with pytest.raises(ValueError, match="several places"):
        raw_files.catalog(spark, str(tmp_path))


def test_catalog_runs_no_job(spark, raw_root):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert len(raw_files.catalog(spark, raw_root)) == 2
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
