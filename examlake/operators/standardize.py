"""Any year's raw columns to the canonical schema."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.fixed_values import (
    AGE_MAX,
    AGE_MIN,
    CANONICAL_COLUMNS,
    DEMOGRAPHY,
    GOLD_RENAMES,
    SCORE_MAX,
    SCORE_MIN,
    SCORES,
)
from examlake.functions.numeric import drop_nan, parse_integer, parse_number, within
from examlake.functions.text import strip

KIND_TYPES = {"string": "string", "upper": "string", "integer": "bigint", "numeric": "double"}


def pick_source(columns: Iterable[str], names: list[str]) -> str | None:
    """First of the accepted names that the source has."""
    present = set(columns)
    return next((n for n in names if n in present), None)


def coerce(c: Column, kind: str) -> Column:
    if kind == "string":
        return strip(c.cast("string"))
    if kind == "upper":
        return F.upper(strip(c.cast("string")))
    return parse_integer(c) if kind == "integer" else parse_number(c)


def standardize(df: DataFrame, year: int | Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Project a raw frame to the canonical columns, in order and typed.

    Missing sources become typed nulls, unknown source columns are dropped and ``year`` fills in
    where the row has none; scores and ages outside their range become null. ``carry`` passes technical columns (the row position) through. No
    shuffle is added and only the picked source columns are scanned.
    """
    plain, whole, scores = {}, {}, {}
    for target, (kind, names) in CANONICAL_COLUMNS.items():
        source = pick_source(df.columns, names)
        if source is None:
            plain[target] = F.lit(None).cast(KIND_TYPES[kind])
        elif kind in ("integer", "numeric"):
            (scores if target in SCORES else whole)[target] = F.col(f"`{source}`").cast("string")
        else:
            plain[target] = coerce(F.col(f"`{source}`"), kind)
    # One parser for all numbers of a kind keeps the code of a row small; all else is left out of the functions of array
    # elements, as Spark generates no code for what is inside of one.
    texts = [c.alias(n) for n, c in plain.items()]
    default_year = year if isinstance(year, Column) else F.lit(year)
    numbers = [numbers_of(whole).alias("_whole"), numbers_of(scores).alias("_scores")]
    made = df.select(*carry, *texts, *numbers, default_year.alias("_year"))
    values = {n: F.col(n) for n in plain}
    values |= {n: F.rint(F.get("_whole", F.lit(i))).try_cast("bigint") for i, n in enumerate(whole)}
    values |= {n: F.get("_scores", F.lit(i)) for i, n in enumerate(scores)}
    values["ANO"] = F.coalesce(values["ANO"], F.col("_year")).cast("int")
    made = made.select(*carry, *[values[n].alias(n) for n in CANONICAL_COLUMNS])
    # The row of a generator is made once: filters on its columns are not pushed below it, where each would parse its
    # numbers again.
    limits = {"NU_IDADE": (AGE_MIN, AGE_MAX)} | {s: (SCORE_MIN, SCORE_MAX) for s in SCORES}
    checked = [within(F.col(n), *limits[n]) if n in limits else F.col(n) for n in CANONICAL_COLUMNS]
    row = F.struct(*[c.alias(n) for n, c in zip(CANONICAL_COLUMNS, checked)])
    return made.select(*carry, F.inline(F.array(row))).select(*CANONICAL_COLUMNS, *carry)


def numbers_of(texts: dict[str, Column]) -> Column:
    """Text columns as one array of doubles (``parse_number``)."""
    if not texts:
        return F.array().cast("array<double>")
    return F.transform(F.array(*texts.values()), parse_number)


def rename_map() -> dict[str, str]:
    """Every accepted source name with its canonical name."""
    return {name: target for target, (_, names) in CANONICAL_COLUMNS.items() for name in names}


def normalize_for_gold(
    df: DataFrame, year: int | Column | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Older cleaned frames to gold-ready columns.

    Renames the historic names, fills the year, types scores, ages and codes, nulls impossible
    ages and keeps the known columns (plus ``extra``) that are present. Score columns always exist.
    """
    for old, new in GOLD_RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    fallback = F.lit(None).cast("int") if year is None else year
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    out = {"ANO": F.coalesce(number_of(df, "ANO"), fallback).cast("int") if "ANO" in have else fallback}
    if "ID_INSCRICAO" in have:
        out["ID_INSCRICAO"] = F.col("ID_INSCRICAO").cast("string")
    for name in [*DEMOGRAPHY, *extra]:
        if name not in have or name in out:
            continue
        if name == "NU_IDADE":
            out[name] = within(number_of(df, name), AGE_MIN, AGE_MAX).cast("int")
        elif name in ("TP_COR_RACA", "TP_FAIXA_ETARIA"):
            out[name] = number_of(df, name).cast("int")
        elif name == "CO_MUNICIPIO_PROVA":
            out[name] = number_of(df, name).cast("bigint")
        else:
            out[name] = F.col(name)
    for score in SCORES:
        out[score] = number_of(df, score) if score in have else F.lit(None).cast("double")
    return df.select(*[c.alias(n) for n, c in out.items()])


def number_of(df: DataFrame, name: str) -> Column:
    """A column as a double: numbers are cast, text is parsed, NaN is null."""
    if dict(df.dtypes)[name] == "string":
        return parse_number(F.col(name))
    return drop_nan(F.col(name).cast("double"))


def validate_required(df: DataFrame, required: tuple[str, ...] = ("NU_INSCRICAO",), year=None) -> None:
    """Raise unless the frame has rows and every required column under one of its names."""
    if df.isEmpty():
        raise ValueError(f"raw data for {year} is empty")
    missing = []
    for column in required:
        accepted = next(
            (names for target, (_, names) in CANONICAL_COLUMNS.items() if column in [target, *names]),
            [column],
        )
        if pick_source(df.columns, accepted) is None:
            missing.append(column)
    if missing:
        raise ValueError(f"required columns missing for {year}: {missing}")
