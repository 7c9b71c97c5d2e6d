"""The batch build: raw files to silver, cleaned, classes and gold, then the published tables."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.fixed_values import MEAN_BANDS
from examlake.operators import gold
from examlake.operators.classes import DEFAULT_CLASSES, ClassRule, apply_classes, class_summary_by_year
from examlake.operators.cleaning import DUPLICATE, INVALID, REPAIRED, VALID, VERDICT, CleaningPlan, flag, mark, marked_report
from examlake.operators.quality import (
    DASHBOARD_CHECKS,
    Check,
    assert_checks,
    assert_outcomes,
    audit_gold,
    audit_report,
    audit_years,
    checked_write,
)
from examlake.operators.standardize import standardize, validate_required
from examlake.sources.exports import DASHBOARD_TABLES, materialize_tables, publish_views
from examlake.sources.lake import Lake, only_years
from examlake.sources.raw_files import (
    POSITION,
    catalog,
    files_of_year,
    read_delimited,
    year_from_path,
)

def raw_to_silver(
    spark: SparkSession,
    lake: Lake,
    raw_root: str,
    years: Sequence[int],
    required: tuple[str, ...] = ("NU_INSCRICAO",),
    encoding: str = "ISO-8859-1",
) -> None:
    """Standardise the years' raw files into the silver table.

    One catalog of the raw files gives all paths and headers. Files with the same header are one scan, so the number of scans
    follows the number of layouts, and all of them are written by one job. There is no shuffle: a task reads a split of a file and
    writes that file's year. The folder is the year of the file, so writing a year can never
    replace another year's folder because of a stray row.
    """
    files = catalog(spark, raw_root, encoding)
    layouts: dict[tuple[str, ...], list[str]] = {}
    # Each file is read by its own header: files of a year may hold their columns in other orders.
    for file in [f for year in years for f in files_of_year(files, year, raw_root)]:
        layouts.setdefault(file.columns, []).append(file.path)
    file_year = year_from_path(F.col(f"{POSITION}.file"))
    parts = []
    for paths in layouts.values():
        raw = read_delimited(spark, paths, encoding=encoding, position=True)
        validate_required(raw, required, sorted(years))
        # The year of the file replaces the year of the row, so none has to be filled in.
        parts.append(standardize(raw, F.lit(None).cast("int"), carry=(POSITION,)).withColumn("ANO", file_year))
    lake.write(reduce(DataFrame.unionByName, parts), "silver", years=years)


CLEANING_TABLES = {VALID: "cleaned", INVALID: "cleaning_invalid", DUPLICATE: "cleaning_duplicates"}


def silver_to_cleaned(
    spark: SparkSession, lake: Lake, years: Sequence[int], plan: CleaningPlan = CleaningPlan()
) -> None:
    """Clean all requested years in one job chain; year is part of the de-duplication key.

    Rows are written once, by verdict and year; the cleaned, invalid and duplicate rows are tables of that one
    write, and the report is read off the marks.
    """
    silver = only_years(lake.read(spark, "silver"), list(years))
    marked = mark(flag(silver, plan), plan).drop(POSITION)
    own = lake if lake.pending is not None else lake.begin()
    folder = own.write_split(marked, "cleaned_rows", VERDICT, CLEANING_TABLES, hide=[REPAIRED], compact=True, years=years)
    written = spark.read.schema(marked.schema).parquet(folder)
    own.write(marked_report(written, plan), "cleaning_report", partition_by=["ANO"], years=years)
    if own is not lake:
        own.commit(spark)


def cleaned_to_classes(
    spark: SparkSession, lake: Lake, years: Sequence[int], rules: Sequence[ClassRule] = DEFAULT_CLASSES
) -> None:
    classes = apply_classes(only_years(lake.read(spark, "cleaned"), list(years)), rules)
    lake.write(classes, "classes", years=years)
    summary = class_summary_by_year(only_years(lake.read(spark, "classes"), list(years)), list(years), [r.name for r in rules])
    # A folder for each year: building one year leaves the summaries of the others.
    lake.write(summary, "classes_summary", partition_by=["ANO"], years=years)


def gold_tables(cleaned: DataFrame, bands: list[tuple] = MEAN_BANDS) -> dict[str, DataFrame]:
    """Every gold table over a cleaned frame. Cleaning left identifiers unique within a year, so
    enrolment is a plain count."""
    return {
        "tb_notas": gold.unified_scores([(cleaned, None)]),
        "tb_notas_stats": gold.year_stats(cleaned, unique_ids=True),
        "tb_notas_geo": gold.town_scores(cleaned, unique_ids=True),
        "tb_notas_geo_uf": gold.state_scores(cleaned, unique_ids=True),
        "tb_notas_histogram": gold.score_histogram(cleaned),
        "tb_socio_economico": gold.income_boxes(cleaned).orderBy(gold.income_order(F.col("CLASSE"))),
        "tb_media_uf": gold.state_bands(cleaned, bands).orderBy("ANO", "SG_UF_PROVA", "ID_FAIXA"),
        "dim_municipio": gold.town_dimension(cleaned).orderBy("CO_MUNICIPIO_PROVA"),
    }


def build_gold(
    spark: SparkSession, lake: Lake, years: Sequence[int], bands: list[tuple] = MEAN_BANDS, checks: Sequence[Check] = ()
) -> None:
    """Write the gold tables. ``checks`` are measured while their table is written, and a failed one stops the build."""
    cleaned = only_years(lake.read(spark, "cleaned"), list(years))
    for name, table in gold_tables(cleaned, bands).items():
        # Row-level gold is partitioned by year; the aggregates are small single folders.
        by = ["ANO"] if name == "tb_notas" else []
        assert_outcomes(checked_write(lake, table, name, checks, partition_by=by))
    gold.assert_unique(lake.read(spark, "dim_municipio"), ["CO_MUNICIPIO_PROVA"])


def build_lake(
    spark: SparkSession,
    raw_root: str,
    lake: Lake,
    years: Sequence[int],
    plan: CleaningPlan = CleaningPlan(),
    skip_existing: bool = False,
    publish: bool = False,
    with_gold: bool = True,
    checks: Sequence[Check] = (),
) -> None:
    """Everything from raw files to gold, published by one commit: a build that stops leaves the lake as it was.

    ``skip_existing`` leaves out years whose whole build was committed; gold always covers all requested years.
    Nothing is published if one of ``checks`` fails on the gold tables.
    """
    done = set(lake.complete_years(spark)) if skip_existing else set()
    todo = [y for y in years if y not in done]
    own = lake.begin()
    if todo:
        raw_to_silver(spark, own, raw_root, todo)
        silver_to_cleaned(spark, own, todo, plan)
        cleaned_to_classes(spark, own, todo)
        own.mark_complete(todo)
    if with_gold:
        build_gold(spark, own, years, checks=checks)
    own.commit(spark)
    if publish:
        publish_dashboard(spark, lake)


def publish_dashboard(spark: SparkSession, lake: Lake) -> None:
    """Register the views, copy the dashboard tables and hold them to the quality checks."""
    publish_views(spark, lake)
    materialize_tables(spark)
    names = {c.table for c in DASHBOARD_CHECKS}
    assert_checks({name: spark.table(name) for name in names})


def audit_lake(
    spark: SparkSession, lake: Lake, metadata: DataFrame, years: Sequence[int], save_as: str | None = None
) -> DataFrame:
    """Audit of silver by year and of every gold table, optionally written to the lake."""
    silver = only_years(lake.read(spark, "silver"), list(years)).drop(POSITION)
    tables = ["tb_notas", *DASHBOARD_TABLES, "dim_municipio", "classes_summary", "variaveis_meta"]
    report = audit_report(
        [
            audit_years(silver, metadata.filter(F.col("ano").isin(list(years))), lake.path("silver")),
            audit_gold(spark, lake, tables, metadata),
        ]
    )
    if save_as:
        lake.write(report, save_as)
    return report
