import random

import pytest
from pyspark.sql import functions as F

from examlake.operators import cleaning
from examlake.operators.cleaning import CleaningPlan, DomainRule, RangeRule

SCHEMA = (
    "pos int, ID_INSCRICAO string, NU_IDADE int, NOTA_MATEMATICA double, "
    "NOTA_LINGUAGENS_CODIGOS double, RENDA_FAMILIAR string"
)
PLAN = CleaningPlan(domains=(DomainRule("RENDA_FAMILIAR", ("A", "B", "C")),), order=("pos",))


def sample(spark):
    return spark.createDataFrame(
        [
            (0, "1", 16, 500.0, 550.0, "A"),
            (1, "1", 16, 500.0, 550.0, "A"),
            (2, "2", 17, 600.0, 580.0, "Z"),
            (3, "3", 18, 650.0, 620.0, "C"),
            (4, "4", 200, 700.0, 580.0, "B"),
        ],
        SCHEMA,
    )


def test_clean_splits_rows_and_reports(spark):
    result = cleaning.clean(sample(spark), PLAN)
    assert [r.pos for r in result.valid.orderBy("pos").collect()] == [0, 2, 3]
    assert [r.pos for r in result.invalid.collect()] == [4]
    assert [r.pos for r in result.duplicates.collect()] == [1]
    assert {r.RENDA_FAMILIAR for r in result.valid.collect()} == {"A", "UNKNOWN", "C"}
    report = {r.rule: r.affected_rows for r in result.report.collect()}
    assert report == {"invalid_rows": 1, "duplicates": 1, "domain:RENDA_FAMILIAR": 1}


def test_clean_row_without_problems_has_empty_report(spark):
    result = cleaning.clean(sample(spark).filter("pos = 0"), PLAN)
    assert result.report.isEmpty() and result.duplicates.isEmpty()


def test_null_ids_are_one_key_and_nan_passes(spark):
    df = spark.createDataFrame(
        [(2, None, 20, float("nan"), None, None), (1, None, 20, 5.0, 1.0, None), (3, "x", None, None, None, "A")],
        SCHEMA,
    )
    result = cleaning.clean(df, PLAN)
    assert [r.pos for r in result.valid.orderBy("pos").collect()] == [1, 3]
    assert [r.pos for r in result.duplicates.collect()] == [2]
    assert result.invalid.isEmpty()


@pytest.mark.parametrize("age, bad", [(0, True), (7, True), (8, False), (120, False), (121, True), (None, False)])
def test_age_limits(spark, age, bad):
    df = spark.createDataFrame([(0, "1", age, None, None, "A")], SCHEMA)
    assert cleaning.quarantine(df)[1].count() == int(bad)


@pytest.mark.parametrize(
    "score, bad", [(-1.0, True), (0.0, False), (1000.0, False), (1000.1, True), (float("inf"), True), (float("nan"), False)]
)
def test_score_limits(spark, score, bad):
    df = spark.createDataFrame([(0, "1", 20, score, None, "A")], SCHEMA)
    assert cleaning.quarantine(df)[1].count() == int(bad)


def test_scope_separates_years(spark):
    df = spark.createDataFrame([(1, "a", 2019), (2, "a", 2020), (3, "a", 2020)], "pos int, ID_INSCRICAO string, ANO int")
    result = cleaning.clean(df, CleaningPlan(order=("pos",)))
    assert [r.pos for r in result.valid.orderBy("pos").collect()] == [1, 2]
    assert [(r.ANO, r.rule, r.affected_rows) for r in result.report.collect()] == [(2020, "duplicates", 1)]


def test_year_specific_and_numeric_domains(spark):
    df = spark.createDataFrame([(2019, "Q", 1), (2020, "Q", 9)], "ANO int, Q006 string, TP_COR_RACA int")
    rules = [DomainRule("Q006", ("A",), year=2019), DomainRule("TP_COR_RACA", ("0", "1"))]
    got = [tuple(r) for r in cleaning.repair_domains(df, rules).orderBy("ANO").collect()]
    assert got == [(2019, "UNKNOWN", 1), (2020, "Q", None)]


def test_first_broken_rule_in_order(spark):
    df = spark.createDataFrame([(5, 2000.0), (20, 2000.0), (20, 10.0)], "NU_IDADE int, NOTA_MATEMATICA double")
    rules = [RangeRule("NU_IDADE", 8, 120), RangeRule("NOTA_MATEMATICA", 0, 1000), RangeRule("ABSENT", 0, 1)]
    passing, broken, report = cleaning.enforce_ranges(df, rules)
    assert passing.count() == 1
    assert sorted(r._reason for r in broken.collect()) == ["range_NOTA_MATEMATICA", "range_NU_IDADE"]
    assert {(r.column, r.affected_rows, r.issue) for r in report.collect()} == {
        ("NU_IDADE", 1, "Valores fora do range (8, 120)"),
        ("NOTA_MATEMATICA", 1, "Valores fora do range (0, 1000)"),
    }


def test_enforce_domains_fills_missing_values(spark):
    df = spark.createDataFrame([("A", 1), ("Z", 2), (None, 3)], "RENDA_FAMILIAR string, n int")
    repaired, report = cleaning.enforce_domains(df, [DomainRule("RENDA_FAMILIAR", ("A",)), DomainRule("NONE", ("x",))])
    assert [r.RENDA_FAMILIAR for r in repaired.orderBy("n").collect()] == ["A", "UNKNOWN", "UNKNOWN"]
    assert [(r.column, r.affected_rows) for r in report.collect()] == [("RENDA_FAMILIAR", 2)]


def test_hot_key_matches_brute_force(spark):
    """A key holding a third of the rows: same split as pandas, and no task gets all of its rows."""
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.34 else str(rng.randrange(900))) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pos int, ID_INSCRICAO string").repartition(6)
    first, rest = cleaning.split_duplicates(df, ["ID_INSCRICAO", "ABSENT"], ["pos"])
    best = {}
    for pos, key in sorted(rows):
        best.setdefault(key, pos)
    assert {r.pos for r in first.collect()} == set(best.values())
    assert {r.pos for r in rest.collect()} == {p for p, _ in rows} - set(best.values())
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_plan_builder():
    plan = cleaning.cleaning_plan({"Q006": ["A", "B"]})
    assert plan.domains == (DomainRule("Q006", ("A", "B")),)
    assert plan.keys == ("ID_INSCRICAO", "NU_INSCRICAO", "ANO")


def test_domains_from_metadata(spark):
    meta = spark.createDataFrame(
        [("RENDA_FAMILIAR", ["A"], 2016), ("NU_IDADE", None, 2016), ("RENDA_FAMILIAR", ["B"], 2017)],
        "nome_padrao string, dominio_valores array<string>, ano int",
    )
    assert cleaning.domains_from_metadata(meta, [2016]) == (DomainRule("RENDA_FAMILIAR", ("A",), year=2016),)


def test_duplicates_join_is_not_forced_to_broadcast(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") % 3).cast("string").alias("ID_INSCRICAO"))
    plan = cleaning.later_copies(df, ["ID_INSCRICAO"], ["pos"])._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()


# ------------------------------------------------------------------ one marked pass
MARKED = "pos int, ANO int, ID_INSCRICAO string, NU_IDADE int, NOTA_MATEMATICA double, RENDA_FAMILIAR string, GRUPO int"
MARKED_ROWS = [
    (0, 2016, "1", 16, 500.0, "A", 1), (1, 2016, "1", 16, 510.0, "Z", 9), (2, 2016, "2", 17, 600.0, "Z", 9), (3, 2016, None, 17, 600.0, None, 2),
    (4, 2016, "4", 250, 700.0, "Z", 9), (5, 2017, "1", 30, 650.0, "C", 3), (6, 2016, None, 40, 1.0, "B", 1), (7, 2016, "4", 25, float("nan"), "Z", None),
]


def test_marked_pass_equals_the_separate_ones(spark, tmp_path):
    df = spark.createDataFrame(MARKED_ROWS, MARKED)
    plan = CleaningPlan(domains=(DomainRule("RENDA_FAMILIAR", ("A", "B", "C")), DomainRule("GRUPO", ("1", "2", "3"), year=2016)), order=("pos",))
    one, separate = cleaning.write_marked(df, str(tmp_path / "marked"), plan), cleaning.clean(df, plan)
    for name in ("valid", "invalid", "duplicates", "report"):
        got, expected = getattr(one, name), getattr(separate, name)
        assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect())), name
    folders = {p.name for p in (tmp_path / "marked").iterdir() if p.is_dir()}
    assert folders == {"_VERDICT=valid", "_VERDICT=invalid", "_VERDICT=duplicate"}


def test_marked_pass_without_keys_and_without_rows(spark, tmp_path):
    plan = CleaningPlan(order=("pos",))
    df = spark.createDataFrame(MARKED_ROWS, MARKED).drop("ID_INSCRICAO")
    one = cleaning.write_marked(df, str(tmp_path / "a"), plan)
    assert (one.valid.count(), one.invalid.count(), one.duplicates.count()) == (7, 1, 0)
    none = cleaning.write_marked(df.limit(0), str(tmp_path / "b"), plan)
    assert [t.count() for t in none] == [0, 0, 0, 0] and none.valid.columns == df.columns


def test_domains_of_the_metadata_hold_in_their_year(spark, tmp_path):
    schema = "ano int, nome_padrao string, dominio_valores array<string>"
    declared = [
        (2016, "RENDA_FAMILIAR", ["A", "B"]), (2017, "RENDA_FAMILIAR", ["A"]), (2016, "GRUPO", ["1", "2.0", "x"]), (2016, "NU_IDADE", None),
        (2016, "ABSENT", ["1"]), (2016, "", ["1"]), (2016, "RENDA_FAMILIAR", ["A", "B", "Z"]),
    ]
    domains = cleaning.domains_by_year(spark.createDataFrame(declared, schema))
    df = spark.createDataFrame(MARKED_ROWS, MARKED)
    one = cleaning.write_marked(df, str(tmp_path / "a"), CleaningPlan(order=("pos",)), domains=domains)
    got = {r.pos: (r.RENDA_FAMILIAR, r.GRUPO) for r in one.valid.collect()}
    assert got == {0: ("A", 1), 2: ("UNKNOWN", None), 3: (None, 2), 5: ("UNKNOWN", 3), 7: ("UNKNOWN", None)}
    report = {(r.ANO, r.rule): r.affected_rows for r in one.report.collect()}
    assert report[2016, "domain:RENDA_FAMILIAR"] == 2 and report[2016, "domain:GRUPO"] == 1 and report[2017, "domain:RENDA_FAMILIAR"] == 1
    assert not cleaning.write_marked(df.limit(0), str(tmp_path / "b"), CleaningPlan(order=("pos",)), domains=domains).valid.count()


def test_only_rows_of_repeated_keys_are_compared(spark):
    df = spark.range(20000).select((F.col("id") % 19800).cast("string").alias("ID_INSCRICAO"), F.col("id").alias("pos"))
    df = df.unionByName(spark.createDataFrame([(None, 30000), (None, 30001)], "ID_INSCRICAO string, pos bigint"))
    single, compared = cleaning.split_repeated(df, ["ID_INSCRICAO"])
    assert single.count() + compared.count() == 20002
    assert compared.count() < 500  # 201 keys twice, and rows that share a bit with them
    twice = compared.groupBy("ID_INSCRICAO").count().filter("count = 2")
    assert twice.count() == 201
    stored = cleaning.clean(df, PLAN, stored=True).valid
    assert sorted(r.pos for r in stored.collect()) == sorted(r.pos for r in cleaning.clean(df, PLAN).valid.collect())
