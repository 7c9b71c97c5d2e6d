"""Incremental runs over several arrivals give the batch result."""

import pytest
from pyspark.sql import functions as F

from examlake.fixed_values import SCORES
from examlake.operators import classes, cleaning, standardize
from examlake.operators.cleaning import CleaningPlan, DomainRule
from examlake.streaming import incremental

SCHEMA = "pos int, ANO int, ID_INSCRICAO string, NU_IDADE int, NOTA_MATEMATICA double, RENDA_FAMILIAR string"
PLAN = CleaningPlan(domains=(DomainRule("RENDA_FAMILIAR", ("A", "B", "C")),), order=("pos",))
ROWS = [
    (0, 2016, "1", 16, 500.0, "A"),
    (1, 2016, "1", 16, 510.0, "A"),
    (2, 2016, "2", 17, 600.0, "Z"),
    (3, 2016, None, 17, 600.0, "B"),
    (4, 2016, "4", 250, 700.0, "B"),
    (5, 2016, "1", 30, 650.0, "C"),
    (6, 2017, "1", 30, 650.0, "C"),
    (7, 2016, None, 40, 1.0, "B"),
    (8, 2016, "4", 25, 700.0, "Z"),
]


@pytest.fixture
def arrivals(spark, tmp_path):
    """Writes slices of the rows as files, in order."""
    folder = tmp_path / "in"

    def arrive(start, stop):
        spark.createDataFrame(ROWS[start:stop], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    arrive.folder = str(folder)
    return arrive


def stream(spark, arrivals):
    schema = spark.createDataFrame([], SCHEMA).schema
    return incremental.file_stream(spark, schema, arrivals.folder, max_files=1)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_stream_clean_equals_batch(spark, arrivals, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for start, stop in ((0, 3), (3, 5), (5, 9)):
        arrivals(start, stop)
        incremental.stream_clean(stream(spark, arrivals), out, checkpoint, PLAN)
    batch = cleaning.clean(spark.createDataFrame(ROWS, SCHEMA), PLAN)
    columns = batch.valid.columns
    assert rows_of(incremental.read_cleaned(spark, out).select(columns), "pos") == rows_of(batch.valid, "pos")
    report = incremental.read_report(spark, out).select(batch.report.columns)
    assert rows_of(report, "ANO", "rule") == rows_of(batch.report, "ANO", "rule")
    for name in ("invalid", "duplicates"):
        got = spark.read.parquet(f"{out}/{name}").select("pos")
        assert rows_of(got, "pos") == rows_of(getattr(batch, name).select("pos"), "pos")


def test_first_batch_without_valid_rows(spark, arrivals, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for start, stop in ((4, 5), (5, 7)):
        arrivals(start, stop)
        incremental.stream_clean(stream(spark, arrivals), out, checkpoint, PLAN)
    assert rows_of(incremental.read_cleaned(spark, out).select("pos"), "pos") == [(5,), (6,)]


def test_repeated_batch_overwrites_itself(spark, arrivals, tmp_path):
    """A batch run again from the start (its checkpoint lost) must not see its own first attempt."""
    out = str(tmp_path / "out")
    arrivals(0, 5)
    for attempt in ("a", "b"):
        incremental.stream_clean(stream(spark, arrivals), out, str(tmp_path / attempt), PLAN)
    assert rows_of(incremental.read_cleaned(spark, out).select("pos"), "pos") == [(0,), (2,), (3,)]


def test_stream_standardize_equals_batch(spark, tmp_path):
    raw_schema = "NU_INSCRICAO string, NT_MT string, SEXO string, NU_ANO string"
    folder = str(tmp_path / "raw")
    rows = [("1", "500,5", "m", "2019"), ("2", "1200", "f", None), ("3", "x", "F", "2020")]
    for row in rows:
        spark.createDataFrame([row], raw_schema).coalesce(1).write.mode("append").parquet(folder)
    raw = incremental.file_stream(spark, spark.createDataFrame([], raw_schema).schema, folder, max_files=1)
    incremental.stream_standardize(raw, 2018, str(tmp_path / "silver"), str(tmp_path / "cp"))
    batch = standardize.standardize(spark.read.parquet(folder), 2018)
    got = spark.read.parquet(str(tmp_path / "silver")).select(batch.columns)
    assert rows_of(got, "ID_INSCRICAO") == rows_of(batch, "ID_INSCRICAO")
    assert {r.ANO for r in got.select("ANO").collect()} == {2018, 2019, 2020}


def test_stream_classes_and_summary_equal_batch(spark, arrivals, tmp_path):
    out = tmp_path / "out"
    for start, stop in ((0, 4), (4, 9)):
        arrivals(start, stop)
        incremental.stream_classes(stream(spark, arrivals), str(out / "rows"), str(out / "cp1"))
        incremental.stream_class_summary(stream(spark, arrivals), str(out / "sum"), str(out / "cp2"))
    batch = classes.apply_classes(spark.createDataFrame(ROWS, SCHEMA))
    got = spark.read.parquet(str(out / "rows")).select(batch.columns)
    assert rows_of(got, "pos") == rows_of(batch, "pos")
    summary = incremental.read_class_summary(spark, str(out / "sum"))
    # Age classes are listed even when empty, as in a batch summary.
    assert rows_of(summary.select("class_name", "class_value", "total"), "class_name", "class_value") == rows_of(
        classes.class_summary(batch), "class_name", "class_value"
    )
    assert ("CLASS_FAIXA_ETARIA", "18_A_24", 0) in [tuple(r) for r in summary.select("class_name", "class_value", "total").collect()]
    assert summary.agg(F.sum("total")).first()[0] == 3 * len(ROWS) and SCORES


def test_readers_never_see_half_a_summary(spark, arrivals, tmp_path):
    """Each batch is a version; an unfinished one is not read, and only the last two stay."""
    out, checkpoint = str(tmp_path / "sum"), str(tmp_path / "checkpoint")
    with pytest.raises(FileNotFoundError):
        incremental.read_class_summary(spark, out)
    for start, stop in ((0, 3), (3, 5), (5, 9)):
        arrivals(start, stop)
        incremental.stream_class_summary(stream(spark, arrivals), out, checkpoint)
    assert incremental.published_versions(spark, out) == [1, 2]
    (tmp_path / "sum" / "batch_id=3").mkdir()
    assert incremental.read_class_summary(spark, out).agg(F.sum("total")).first()[0] == 3 * len(ROWS)


def test_state_holds_what_was_seen_in_any_batch(spark, arrivals, tmp_path):
    """Copies come back after batches without them; hot and missing identifiers; the checkpoint is all that is read of the past."""
    rows = [(i, 2016, "hot" if i % 3 else None, 20, 500.0, "A") for i in range(30)] + [(30, 2016, "new", 20, 500.0, "A"), (31, 2017, "hot", 20, 500.0, "A")]
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (rows[:10], rows[30:31], rows[10:30] + rows[31:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        incremental.stream_clean(incremental.file_stream(spark, schema, folder), out, checkpoint, PLAN)
    assert sorted(r.pos for r in incremental.read_cleaned(spark, out).select("pos").collect()) == [0, 1, 30, 31]
    batch = cleaning.clean(spark.createDataFrame(rows, SCHEMA), PLAN)
    report = incremental.read_report(spark, out).select(batch.report.columns)
    assert rows_of(report, "ANO", "rule") == rows_of(batch.report, "ANO", "rule")
    from pathlib import Path

    assert any("RocksDB" in f.read_text() for f in Path(checkpoint, "offsets").glob("*") if f.is_file() and not f.name.startswith("."))


def test_rows_without_an_identifier_column(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(0, 2016, 250), (1, 2016, 20), (2, 2016, 20)], "pos int, ANO int, NU_IDADE int")
    df.coalesce(1).write.parquet(folder)
    incremental.stream_clean(incremental.file_stream(spark, df.schema, folder), out, str(tmp_path / "cp"), CleaningPlan(order=("pos",)))
    assert sorted(r.pos for r in incremental.read_cleaned(spark, out).select("pos").collect()) == [1, 2]


def test_only_counts_above_one_leave_the_query(spark, tmp_path):
    """A key's only row so far needs no comparison: neither its count is stored nor is the row shuffled."""
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = spark.createDataFrame([], SCHEMA).schema
    first = [(i, 2016, str(i), 20, 500.0, "A") for i in range(50)] + [(50, 2016, "7", 20, 500.0, "Z"), (51, 2016, "8", 250, 500.0, "A")]
    later = [(52, 2016, "9", 20, 500.0, "A"), (53, 2016, "new", 20, 500.0, "Z"), (54, 2017, "9", 20, 500.0, "A")]
    staged = []
    for part in (first, later):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        incremental.stream_clean(incremental.file_stream(spark, schema, folder), out, checkpoint, PLAN)
        rows = spark.read.parquet(f"{out}/staged").filter("_VERDICT = 'keys'")
        staged.append([tuple(r) for r in rows.select("ID_INSCRICAO", incremental.RUNNING).collect()])
    assert staged == [[("7", 2)], [("9", 2)]]
    batch = cleaning.clean(spark.createDataFrame(first + later, SCHEMA), PLAN)
    assert rows_of(incremental.read_cleaned(spark, out).select(batch.valid.columns), "pos") == rows_of(batch.valid, "pos")
    report = incremental.read_report(spark, out).select(batch.report.columns)
    assert rows_of(report, "ANO", "rule") == rows_of(batch.report, "ANO", "rule")
