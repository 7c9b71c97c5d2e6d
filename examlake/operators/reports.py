"""Masking, the report projection, its clean-up and number formats."""

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlake.fixed_values import PERSONAL_COLUMNS, REPORT_LABELS
from examlake.functions.numeric import drop_nan, parse_number, round_half_even
from examlake.functions.text import clean_cell, mask, title_case

ADMIN = "admin"


def mask_personal(df: DataFrame, role: str = "user", columns: list[str] = PERSONAL_COLUMNS) -> DataFrame:
    """Partially mask personal columns unless the role is admin."""
    if role == ADMIN:
        return df
    hidden = [c for c in df.columns if c.upper() in columns]
    return df.withColumns({c: mask(F.col(c)) for c in hidden}) if hidden else df


def report_rows(towns: DataFrame, role: str = "user") -> DataFrame:
    """Municipality rows as a report shows them: title-cased, masked, ten labelled columns."""
    masked = mask_personal(towns.withColumn("NO_MUNICIPIO_PROVA", title_case(F.col("NO_MUNICIPIO_PROVA"))), role)
    return masked.select(
        *[F.col(c).alias(label) for c, label in REPORT_LABELS.items() if c in masked.columns]
    )


def _kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return text, [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def tidy_cells(df: DataFrame) -> DataFrame:
    """Text cells cleaned and missing numbers 0, before anything is known of whole columns."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = clean_cell(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.coalesce(drop_nan(c), F.lit(0.0))
        elif isinstance(field.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)


def column_facts(tidy: DataFrame) -> dict[str, Column]:
    """Per text column whether all its cells are numbers, per floating column whether all are whole: one aggregate each."""
    text, floats = _kinds(tidy)
    facts = {c: F.bool_and(F.col(f"`{c}`").isNull() | parse_number(F.col(f"`{c}`")).isNotNull()) for c in text}
    return facts | {c: F.bool_and(F.col(f"`{c}`") % 1 == 0) for c in floats}


def typed_cells(tidy: DataFrame, decided: dict[str, bool | None]) -> DataFrame:
    """Tidy cells under the types their columns' facts call for."""
    text, floats = _kinds(tidy)
    out = []
    for name in tidy.columns:
        c = F.col(f"`{name}`")
        if name in text and decided[name]:
            c = parse_number(c)
        elif name in floats:
            c = c.cast("bigint") if decided[name] else round_half_even(c, 1)
        out.append(c.alias(name))
    return tidy.select(*out)


def sanitize_report(df: DataFrame) -> DataFrame:
    """Clean text cells; turn all-numeric text columns into numbers; tidy number columns.

    Missing numbers become 0. A column of whole numbers becomes integers, others keep one decimal.
    What a column becomes depends on all of its values, so one aggregation over the whole frame
    (one row of flags) decides that first.
    """
    tidy = tidy_cells(df)
    facts = column_facts(tidy)
    found = tidy.agg(*[f.alias(f"f{i}") for i, f in enumerate(facts.values())]).first() if facts else ()
    return typed_cells(tidy, dict(zip(facts, found)))


def write_report(df: DataFrame, path: str) -> DataFrame:
    """``sanitize_report`` of a report that is written: the facts are observed while the tidy cells are, in one pass over the input.

    What is returned reads the written cells under the types decided.
    """
    tidy = tidy_cells(df)
    facts, seen = column_facts(tidy), Observation()
    watched = tidy.observe(seen, *[f.alias(f"f{i}") for i, f in enumerate(facts.values())]) if facts else tidy
    watched.write.parquet(path)
    decided = dict(zip(facts, seen.get.values())) if facts else {}
    return typed_cells(df.sparkSession.read.schema(tidy.schema).parquet(path), decided)


SUMMARY_WIDTH = 60  # fixed display length of the list of towns


def filter_summary(
    years: list[int] | None = None, states: list[str] | None = None, towns: list[str] | None = None
) -> str:
    """One line of text naming the filters a report was made with."""
    shown = {
        label: ", ".join(map(str, sorted(values or ())))
        for label, values in {"Anos": years, "UFs": states, "Municípios": towns}.items()
    }
    if len(shown["Municípios"]) > SUMMARY_WIDTH:
        shown["Municípios"] = shown["Municípios"][: SUMMARY_WIDTH - 3] + "..."
    named = [f"{label}: {text}" for label, text in shown.items() if text]
    return " | ".join(named) or "Filtros: Todos os registros"


def format_numbers(df: DataFrame) -> DataFrame:
    """Numbers as report text: counts and integers plain, other numbers with one decimal comma."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        name = field.name.lower()
        if not isinstance(field.dataType, T.NumericType):
            out.append(c)
            continue
        if any(word in name for word in ("inscritos", "provas", "qtd")) or isinstance(
            field.dataType, T.IntegralType
        ):
            shown = c.cast("bigint").cast("string")
        else:
            shown = F.translate(F.format_string("%.1f", c), ".", ",")
        out.append(F.when(c.isNotNull(), shown).otherwise("").alias(field.name))
    return df.select(*out)


def head_with_flag(df: DataFrame, order: list, rows: int) -> DataFrame:
    """The first rows in the given order, each with a flag telling whether any were cut off.

    One row past the limit is read to know, so the windows never see more than ``rows + 1`` rows.
    """
    whole = Window.partitionBy(F.lit(0))
    return (
        df.orderBy(*order)
        .limit(rows + 1)
        .withColumn("truncated", F.count("*").over(whole) > rows)
        .withColumn("_n", F.row_number().over(whole.orderBy(*order)))
        .filter(F.col("_n") <= rows)
        .drop("_n")
    )
