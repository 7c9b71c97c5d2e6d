import pytest
from pyspark.sql import functions as F

from examlake.fixed_values import CANONICAL_COLUMNS
from examlake.operators import gold, metadata, standardize
from examlake.sources import raw_files


def write(path, text, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_raw_year_file(spark, tmp_path):
    path = write(
        tmp_path / "MICRODADOS_X_2022.csv",
        "NU_INSCRICAO;SEXO;UF_PROVA;NU_ANO;NU_NOTA_CN;NU_IDADE;EXTRA_COLUMN\n"
        "1;m;sp;2022;550,5;18;A\n2;F;RJ;2022;1200;200;B\n",
    )
    silver = standardize.standardize(raw_files.read_delimited(spark, path), 2022)
    assert silver.columns == list(CANONICAL_COLUMNS)
    rows = silver.orderBy("ID_INSCRICAO").collect()
    assert [r.TP_SEXO for r in rows] == ["M", "F"]
    assert [r.SG_UF_PROVA for r in rows] == ["SP", "RJ"]
    assert [r.NOTA_CIENCIAS_NATUREZA for r in rows] == [550.5, None]
    assert [r.NU_IDADE for r in rows] == [18, None]
    assert [r.ANO for r in rows] == [2022, 2022]
    assert [r.ID_INSCRICAO for r in rows] == ["1", "2"]


def test_aliases_ranges_and_default_year(spark):
    df = spark.createDataFrame(
        [("001", "700,2", "SAO PAULO"), ("002", "1010", "RIO")], "INSCRICAO string, NOTA_MT string, MUNICIPIO_PROVA string"
    )
    rows = standardize.standardize(df, 2010).orderBy("ID_INSCRICAO").collect()
    assert [r.ID_INSCRICAO for r in rows] == ["001", "002"]
    assert [r.NOTA_MATEMATICA for r in rows] == [700.2, None]
    assert [r.NO_MUNICIPIO_PROVA for r in rows] == ["SAO PAULO", "RIO"]
    assert {r.ANO for r in rows} == {2010}


def test_the_row_of_the_generator_is_made_of_finished_columns(spark):
    df = spark.createDataFrame([("1", "700,2", " 18 "), ("2", "1010", "7"), ("3", "x", "2,5e1")], "INSCRICAO string, NT_MT string, IDADE string")
    found = standardize.standardize(df, 2010).filter("NOTA_MATEMATICA > 1 OR NU_IDADE > 1")
    assert [(r.NOTA_MATEMATICA, r.NU_IDADE) for r in found.orderBy("ID_INSCRICAO").collect()] == [(700.2, 18), (None, 25)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.splitlines() if "Generate inline" in line)
    assert "lambda" not in made and "regexp_extract" not in made and "trim" not in made


def test_alias_order_prefers_first_name(spark):
    df = spark.createDataFrame([("a", "b")], "NU_INSCRICAO string, NU_SEQUENCIAL string")
    assert standardize.standardize(df, 2010).first().ID_INSCRICAO == "b"


def test_latin1_text_bad_lines_and_missing_markers(spark, tmp_path):
    path = write(
        tmp_path / "sample.csv",
        'COL_A;COL_B;COL_C\nJoão;1;x\nMaria;2;y;too;long\nJosé;3\n"A;B";4;z\nNA;5;w\n',
    )
    rows = raw_files.read_delimited(spark, path).orderBy("COL_B").collect()
    assert [tuple(r) for r in rows] == [
        ("João", "1", "x"),
        ("José", "3", None),
        ("A;B", "4", "z"),
        (None, "5", "w"),
    ]
    assert [r.COL_B for r in raw_files.read_delimited(spark, path, columns=["COL_B"]).collect()] == ["1", "3", "4", "5"]


def test_bad_bytes_are_replaced(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_bytes(b"A;B\nok\xff;1\n")
    row = raw_files.read_delimited(spark, str(path), encoding="UTF-8").first()
    assert row.A == "ok�"


def test_row_position_follows_the_file(spark, tmp_path):
    path = write(tmp_path / "order.csv", "ID\n" + "".join(f"{i}\n" for i in range(500)))
    df = raw_files.read_delimited(spark, path, position=True)
    assert [int(r.ID) for r in df.orderBy("_POS").collect()] == list(range(500))


def test_find_files_in_any_case_and_results_fallback(spark, tmp_path):
    lower = tmp_path / "microdados_x_2016" / "DADOS" / "microdados_x_2016.csv"
    write(lower, "ID;VAL\n1;foo\n")
    assert [p.rsplit("/", 1)[1] for p in raw_files.year_files(spark, str(tmp_path), 2016)] == [lower.name]
    write(tmp_path / "y" / "MICRODADOS_X_2024.csv", "NU_SEQUENCIAL;Q006\n1;A\n")
    results = tmp_path / "y" / "RESULTADOS_2024.csv"
    write(results, "NU_SEQUENCIAL;NU_NOTA_CN;NU_NOTA_CH;NU_NOTA_LC;NU_NOTA_MT;NU_NOTA_REDACAO\n1;1;2;3;4;5\n")
    assert [p.rsplit("/", 1)[1] for p in raw_files.year_files(spark, str(tmp_path), 2024)] == [results.name]
    with pytest.raises(FileNotFoundError):
        raw_files.year_files(spark, str(tmp_path), 2001)


def test_year_from_path(spark):
    paths = ["/raw2020/microdados_x_2016.csv", "/data/2009/part.csv", "/data/none.csv"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(raw_files.year_from_path(F.col("p"))).collect()]
    assert got == [2016, 2009, None]


def test_required_columns(spark):
    df = spark.createDataFrame([("1",)], "INSCRICAO string")
    standardize.validate_required(df, ("NU_INSCRICAO",), 2016)
    with pytest.raises(ValueError, match="NU_NOTA_MT"):
        standardize.validate_required(df, ("NU_INSCRICAO", "NU_NOTA_MT"), 2016)
    with pytest.raises(ValueError, match="empty"):
        standardize.validate_required(df.filter("false"), ("NU_INSCRICAO",), 2016)


def test_rename_map():
    names = standardize.rename_map()
    assert names["NT_CN"] == "NOTA_CIENCIAS_NATUREZA" and names["INSCRICAO"] == "ID_INSCRICAO"


def test_unified_scores_over_drifting_sources(spark):
    first = spark.createDataFrame([(1998, 1, 600), (1998, 2, 700)], "ANO int, ID_INSCRICAO int, NOTA_REDACAO int")
    second = spark.createDataFrame([(1999, 3, 650.5), (1999, 4, 750.0)], "ANO int, ID_INSCRICAO int, NOTA_REDACAO double")
    both = gold.unified_scores([(first, 1998), (second, 1999)])
    assert both.count() == 4 and dict(both.dtypes)["NOTA_REDACAO"] == "double"
    old = spark.createDataFrame([(10, 450, 500), (11, 470, 510)], "NU_INSCRICAO int, NU_NOTA_CN int, NU_NOTA_MT int")
    rows = gold.unified_scores([(old, 2005)]).orderBy("ID_INSCRICAO").collect()
    assert [r.ANO for r in rows] == [2005, 2005]
    assert [r.NOTA_CIENCIAS_NATUREZA for r in rows] == [450.0, 470.0]
    assert [r.NOTA_MATEMATICA for r in rows] == [500.0, 510.0]


def test_gold_normalizer_keeps_extras_and_drops_the_rest(spark):
    df = spark.createDataFrame(
        [("SP", 3, 200, "A", "x")], "SG_UF_PROVA string, TP_COR_RACA int, NU_IDADE int, Q006 string, EXTRA_TRASH string"
    )
    out = standardize.normalize_for_gold(df, 2020, extra=("SG_UF_PROVA", "Q006"))
    row = out.first()
    assert "EXTRA_TRASH" not in out.columns
    assert (row.SG_UF_PROVA, row.Q006, row.TP_COR_RACA, row.NU_IDADE) == ("SP", "A", 3, None)


def test_contract_and_metadata_round_trip(spark, tmp_path):
    rows = [
        (2016, "A", "ID", "", "string", None),
        (2016, "B", "AGE", "", "Int64", None),
        (2016, "C", "INCOME", "", "string", ["A", "B"]),
        (2017, "D", "OTHER", "", "float", None),
    ]
    metadata.save_metadata(spark.createDataFrame(rows, metadata.METADATA_SCHEMA), str(tmp_path / "meta"))
    loaded = metadata.load_metadata(spark, str(tmp_path / "meta"))
    contract = metadata.build_contract(loaded, 2016)
    assert set(contract) == {"ID", "AGE", "INCOME"} and contract["INCOME"].domain == ("A", "B")
    assert metadata.type_map(contract) == {"AGE": "bigint"}
    df = spark.createDataFrame([("7", "x")], "AGE string, Z string")
    assert metadata.select_known(df, contract).columns == ["AGE"]
    assert metadata.apply_types(metadata.select_known(df, contract), contract).first().AGE == 7
    unknown = df.select("Z")
    assert metadata.select_known(unknown, contract).columns == ["Z"]


def test_small_domains(spark):
    data = [(i, v, f"v{i}") for i, v in enumerate(["A", "B", "A", None, "B", "C"])]
    df = spark.createDataFrame(data, "i int, few string, many string")
    got = {r.column: r.domain for r in metadata.small_domains(df, ["few", "many"], F.col("i"), 3).collect()}
    assert got == {"few": ["A", "B", "C"], "many": None}


def test_filters_do_not_repeat_the_parsing(spark):
    raw = spark.createDataFrame([("1", "2019", "20", "550,5")], "NU_INSCRICAO string, NU_ANO string, IDADE string, NT_CN string")
    silver = standardize.standardize(raw, 2019)
    kept = silver.filter("NU_IDADE >= 8 AND NU_IDADE <= 120 AND NOTA_CIENCIAS_NATUREZA <= 1000 AND ANO > 0")
    assert [(r.NU_IDADE, r.NOTA_CIENCIAS_NATUREZA) for r in kept.collect()] == [(20, 550.5)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2  # one parser for whole numbers, one for scores


def test_small_domains_compare_whole_positions_only_at_the_start(spark):
    rows = [(2, 1, "b", "x"), (1, 2, "a", "x"), (1, 1, "c", "y"), (None, 5, "d", None), (None, 4, "e", "z")]
    df = spark.createDataFrame(rows, "p int, q int, v string, w string")
    found = metadata.small_domains(df, ["v", "w"], F.struct("p", "q"))
    assert {r.column: r.domain for r in found.collect()} == {"v": ["e", "d", "c", "a", "b"], "w": ["z", "y", "x"]}
    found = metadata.small_domains(df, ["v", "w"], F.struct("p", "q"), max_size=4)
    assert {r.column: r.domain for r in found.collect()} == {"v": None, "w": ["z", "y", "x"]}
