"""Chart-ready shapes of served rows."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.fixed_values import (
    CHART_FIRST_YEAR,
    CHART_LAST_YEAR,
    SCORES,
    SUBJECT_SLUGS,
)
from examlake.functions.numeric import row_mean
from examlake.functions.text import one_decimal, slug, slug_text
from examlake.operators.serving import STATE

# Short names of the subjects in the state chart, and of the evolution series.
STATE_SERIES = {
    "mat": "NOTA_MATEMATICA_mean",
    "nat": "NOTA_CIENCIAS_NATUREZA_mean",
    "hum": "NOTA_CIENCIAS_HUMANAS_mean",
    "lin": "NOTA_LINGUAGENS_CODIGOS_mean",
    "red": "NOTA_REDACAO_mean",
}
EVOLUTION_SERIES = ["MEDIA_CN", "MEDIA_CH", "MEDIA_LC", "MEDIA_MT", "MEDIA_RED", "MEDIA_FINAL"]
UNKNOWN_STATE = "UNKNOWN"
UNNAMED_RACE = "Não declarada"
MISSING_RACE_NAME = "Não Informado"
NO_DATA = "s/d"


def year_spine(df: DataFrame, first: int, last: int) -> DataFrame:
    """One row per year of the window, built by the session of ``df``."""
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("ANO"))


def on_spine(df: DataFrame, first: int, last: int) -> DataFrame:
    """Every year of the window once, with nulls where ``df`` (one row per year) has none."""
    return year_spine(df, first, last).join(df, "ANO", "left")


def year_window(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.col("ANO").between(first, last))


def state_weighted_means(states: DataFrame) -> DataFrame:
    """Enrolment-weighted subject means per state over the served years, one decimal.

    A missing mean drops out of its own subject's weight only.
    """
    weight = F.coalesce(F.col("INSCRITOS"), F.lit(0))

    def weighted(column: str) -> Column:
        mean = F.col(column)
        total = F.sum(F.when(mean.isNotNull(), weight))
        return F.when(total > 0, F.round(F.sum(mean * weight) / total, 1)).otherwise(0.0)

    return (
        states.filter(F.col(STATE).isNotNull() & (F.col(STATE) != ""))
        .groupBy(F.col(STATE).alias("uf"))
        .agg(
            F.sum(weight).alias("inscritos"),
            *[weighted(c).alias(name) for name, c in STATE_SERIES.items()],
        )
        .orderBy(F.desc("inscritos"), "uf")
    )


def race_history(
    race_rows: DataFrame,
    races: list[str],
    first: int = CHART_FIRST_YEAR,
    last: int = CHART_LAST_YEAR,
) -> DataFrame:
    """One row per year with, for each race, its mean, count and subject scores.

    A zero is no valid score except in the essay. If a race label occurs twice in a year the
    smaller group, which is served later, is shown. Naming the ``races`` makes this one
    aggregation instead of a scan for the labels followed by another.
    """
    valid = [
        F.col(s) if slug_ == "redacao" else F.when(F.col(s) != 0, F.col(s))
        for s, slug_ in SUBJECT_SLUGS.items()
    ]
    used = reduce(add, [c.isNotNull().cast("int") for c in valid])
    race = F.when(F.coalesce("RACA", F.lit("")) == "", UNNAMED_RACE).otherwise(F.col("RACA"))
    cells = year_window(race_rows, first, last).select(
        "ANO",
        slug(race).alias("race"),
        F.struct(
            F.coalesce("COUNT", F.lit(0)).alias("count"),
            F.round(F.coalesce(row_mean(valid), F.lit(0.0)), 1).alias("value"),
            used.alias("discipline_count"),
            *[
                F.coalesce(one_decimal(F.col(s)), F.lit(NO_DATA)).alias(name)
                for s, name in SUBJECT_SLUGS.items()
            ],
        ).alias("cell"),
    )
    slugs = [slug_text(r) for r in races]
    per_year = cells.groupBy("ANO").agg(
        *[F.min(F.when(F.col("race") == r, F.col("cell"))).alias(r) for r in slugs]
    )
    parts = ["value", "count", "discipline_count", *SUBJECT_SLUGS.values()]
    return (
        on_spine(per_year, first, last)
        .select(
            F.col("ANO").cast("string").alias("year"),
            *[F.col(f"{r}.{p}").alias(f"{r}_{p}") for r in slugs for p in parts],
        )
        .orderBy("year")
    )


def yearly_unweighted_means(
    states: DataFrame, first: int = CHART_FIRST_YEAR, last: int = CHART_LAST_YEAR
) -> DataFrame:
    """Plain mean over the state rows of each year; every year of the window listed."""
    means = year_window(states, first, last).groupBy("ANO").agg(
        *[F.avg(f"{s}_mean").alias(f"{s}_mean") for s in SCORES]
    )
    return on_spine(means, first, last).orderBy("ANO")


def metric_matrix(
    states: DataFrame, metric: str, first: int = CHART_FIRST_YEAR, last: int = CHART_LAST_YEAR
) -> DataFrame:
    """Year, state and one metric, unknown states and missing values left out."""
    return (
        year_window(states, first, last)
        .filter((F.coalesce(STATE, F.lit("")) != UNKNOWN_STATE) & F.col(metric).isNotNull())
        .select(
            F.col("ANO").cast("string").alias("year"),
            F.col(STATE).alias("uf"),
            F.col(metric).alias("value"),
        )
    )


def mark_peak(histogram: DataFrame) -> DataFrame:
    """Flag the first fullest bin of each year and subject."""
    order = Window.partitionBy("ANO", "DISCIPLINA").orderBy(F.desc("CONTAGEM"), "BIN_START")
    return histogram.withColumn("is_peak", F.row_number().over(order) == 1)


def race_ranking(race_rows: DataFrame, subject: str | None = None) -> DataFrame:
    """Races by their overall (or one subject's) score, best first; missing scores are zero."""
    score = row_mean([F.col(s) for s in SCORES]) if subject is None else F.col(subject)
    return race_rows.select(
        "RACA", F.coalesce(score, F.lit(0.0)).alias("score"), "COUNT"
    ).orderBy(F.desc("score"), "RACA")


def town_kpis(towns: DataFrame) -> DataFrame:
    """Total enrolment, total exams and the mean of the rows' five-subject means."""
    rounded = [F.round(F.coalesce(F.col(f"{s}_mean"), F.lit(0.0)), 1) for s in SCORES]
    return towns.agg(
        F.coalesce(F.sum(F.coalesce("INSCRITOS", F.lit(0))), F.lit(0)).alias("total_inscritos"),
        F.coalesce(F.sum(F.coalesce("NOTA_REDACAO_count", F.lit(0))), F.lit(0)).alias("total_provas"),
        F.coalesce(F.avg(reduce(add, rounded) / 5), F.lit(0.0)).alias("media_geral"),
    )


def subject_series(evolution: DataFrame) -> DataFrame:
    """One aligned array per subject over the sorted years, plus the people per year.

    Takes the first row of a year in name order. Arrays are as long as the exam has years.
    """
    first = Window.partitionBy("ANO").orderBy("NO_MUNICIPIO_PROVA")
    one_per_year = evolution.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    people = F.col("QTD_ALUNOS").cast("double").alias("QTD_ALUNOS")
    names = [*EVOLUTION_SERIES, "QTD_ALUNOS"]
    long = one_per_year.select("ANO", *EVOLUTION_SERIES, people).unpivot(
        ["ANO"], names, "series", "value"
    )
    ordered = F.sort_array(F.collect_list(F.struct("ANO", "value")))
    return (
        long.groupBy("series")
        .agg(ordered.alias("points"))
        .select(
            "series",
            F.transform("points", lambda p: p["ANO"]).alias("years"),
            F.transform("points", lambda p: p["value"]).alias("data"),
        )
    )


def last_row_per_year(rows: DataFrame, order: list) -> DataFrame:
    """The last row of each year in the given order, by year, with the year as text."""
    backwards = [F.desc(c) for c in order]
    window = Window.partitionBy("ANO").orderBy(*backwards)
    return (
        rows.withColumn("_nth", F.row_number().over(window))
        .filter("_nth = 1")
        .drop("_nth")
        .orderBy("ANO")
        .withColumn("ANO", F.col("ANO").cast("string"))
    )


def map_values(states: DataFrame, metric: str, year: int) -> DataFrame:
    """State values of one year with the extent of the colour scale on each row.

    At most one row per state reaches the window.
    """
    everything = Window.partitionBy("ANO")
    return (
        states.filter(
            (F.col("ANO") == year)
            & F.col(metric).isNotNull()
            & (F.coalesce(STATE, F.lit("")) != UNKNOWN_STATE)
        )
        .select("ANO", F.col(STATE).alias("uf"), F.col(metric).alias("value"))
        .withColumn("min_value", F.min("value").over(everything))
        .withColumn("max_value", F.max("value").over(everything))
        .drop("ANO")
    )


def map_keys(states: DataFrame, metric: str) -> DataFrame:
    """Map feature ids ("BR-SP") with their value; rows without one are left out."""
    return states.filter(F.col(metric).isNotNull()).select(
        F.concat(F.lit("BR-"), F.col(STATE)).alias("id"), "ANO", F.col(metric).alias("value")
    )


def history(
    rows: DataFrame, first: int = CHART_FIRST_YEAR, last: int = CHART_LAST_YEAR
) -> DataFrame:
    """National or state rows of the year window under the same enrolment column."""
    rows = year_window(rows, first, last)
    if "INSCRITOS" not in rows.columns and "TOTAL_INSCRITOS" in rows.columns:
        rows = rows.withColumn("INSCRITOS", F.col("TOTAL_INSCRITOS"))
    return rows


def band_total(shares: DataFrame) -> DataFrame:
    return shares.agg(F.coalesce(F.sum("QTD_ALUNOS"), F.lit(0)).alias("total"))


def race_chart_rows(race_rows: DataFrame) -> DataFrame:
    """Race rows without gaps: a default label, zero for missing numbers."""
    return race_rows.select(
        F.when(F.coalesce("RACA", F.lit("")) == "", MISSING_RACE_NAME)
        .otherwise(F.col("RACA"))
        .alias("RACA"),
        *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SUBJECT_SLUGS],
        F.coalesce("COUNT", F.lit(0)).alias("COUNT"),
    )


def text_years(rows: DataFrame) -> DataFrame:
    """Rows by year, the year as axis text."""
    return rows.orderBy("ANO").withColumn("ANO", F.col("ANO").cast("string"))


def year_choices(years: DataFrame, first: int = CHART_FIRST_YEAR) -> DataFrame:
    """Selectable years, newest first."""
    return years.filter(F.col("ANO") >= first).select("ANO").orderBy(F.desc("ANO"))


def default_years(years: DataFrame, first: int = CHART_FIRST_YEAR, latest: int = 3) -> DataFrame:
    return year_choices(years, first).limit(latest)
