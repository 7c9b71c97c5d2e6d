"""Parameterised queries over the gold tables."""

import re
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.fixed_values import (
    DISPLAY_BANDS,
    FORBIDDEN_SQL_VERBS,
    MEAN_BANDS,
    RACE_LABELS,
    RACE_MISSING_LABEL,
    SCORE_MAX,
    SCORES,
    SUBJECT_LABELS,
)
from examlake.functions.numeric import lookup, round_half_even
from examlake.functions.text import fold, fold_text, is_ascii, title_case

TOWN = "NO_MUNICIPIO_PROVA"
STATE = "SG_UF_PROVA"


# Columns of the served rows; a trailing "?" marks those that may be missing.
_MEANS = {f"{s}_{x}": t for s in SCORES for x, t in (("count", "int"), ("mean", "float?"))}
STATE_ROW = {"ANO": "int", "SG_UF_PROVA": "text", "INSCRITOS": "int", **_MEANS}
TOWN_ROW = {
    "ANO": "int",
    "SG_UF_PROVA": "text",
    "CO_MUNICIPIO_PROVA": "text",
    "NO_MUNICIPIO_PROVA": "text",
    "INSCRITOS": "int?",
    **_MEANS,
}
STATS_ROW = {
    "ANO": "int",
    "TOTAL_INSCRITOS": "int",
    **{f"IDADE_{x}": "float?" for x in ("mean", "std", "min", "median", "max")},
    **{
        f"{s}_{x}": "int" if x == "count" else "float?"
        for s in SCORES
        for x in ("count", "mean", "std", "min", "median", "max")
    },
}


def conforming_rows(df: DataFrame, row: dict[str, str]) -> DataFrame:
    """Rows fit to be served: the row's columns in order, absent optional ones as nulls.

    A row with a missing required value or a fractional count is left out; ``rejected_rows`` gives those.
    """
    checks, out = _row_contract(df, row)
    return df.filter(_all(checks)).select(*out)


def rejected_rows(df: DataFrame, row: dict[str, str]) -> DataFrame:
    """Rows that ``conforming_rows`` leaves out, as they are."""
    return df.filter(~_all(_row_contract(df, row)[0]))


def _row_contract(df: DataFrame, row: dict[str, str]) -> tuple[list[Column], list[Column]]:
    """What a row must meet, never null, and its columns in order."""
    types = {"int": "bigint", "float": "double", "text": "string"}
    have = dict(df.dtypes)
    checks, out = [], []
    for name, kind in row.items():
        base, required = kind.rstrip("?"), not kind.endswith("?")
        c = F.col(name) if name in have else F.lit(None).cast(types[base])
        if required:
            checks.append(c.isNotNull())
        if base == "int" and have.get(name) in ("double", "float"):
            checks.append(c.isNull() | (c % 1 == 0))
        wanted = "int" if name == "ANO" and have.get(name) == "int" else types[base]
        out.append((c if have.get(name) == wanted else c.cast(wanted)).alias(name))
    return checks, out


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def _same_town(value: str) -> Column:
    return fold(F.col(TOWN)) == fold_text(value)


# ------------------------------------------------------------------ race and income
def race_label(code: Column) -> Column:
    known = lookup(RACE_LABELS, code.cast("int"))
    other = F.concat(F.lit("Outros ("), code.cast("string"), F.lit(")"))
    return F.when(code.isNull(), RACE_MISSING_LABEL).otherwise(F.coalesce(known, other))


def race_means(
    classes: DataFrame,
    year: int | None = None,
    state: str | None = None,
    town: str | None = None,
    more_than: int = 100,
) -> DataFrame:
    """Mean scores per race, and per year unless one is given (then ANO is null).

    Groups of ``more_than`` rows or fewer are left out. Newest year first, largest group first.
    """
    filters = []
    if year is not None:
        filters.append(F.col("ANO") == year)
    if state:
        filters.append(F.col(STATE) == state.upper())
    if town:
        filters.append(_same_town(town))
    keys = ["TP_COR_RACA"] if year is not None else ["ANO", "TP_COR_RACA"]
    means = (
        classes.filter(_all(filters))
        .groupBy(*keys)
        .agg(*[F.avg(s).alias(s) for s in SUBJECT_LABELS], F.count("*").alias("COUNT"))
        .filter(F.col("COUNT") > more_than)
    )
    shown_year = F.lit(None).cast("int") if year is not None else F.col("ANO")
    return means.select(
        shown_year.alias("ANO"),
        race_label(F.col("TP_COR_RACA")).alias("RACA"),
        *SUBJECT_LABELS,
        "COUNT",
    ).orderBy(F.desc("ANO"), F.desc("COUNT"), "RACA")


def income_year(boxes: DataFrame, year: int) -> DataFrame:
    return (
        boxes.filter(F.col("ANO") == year)
        .select("CLASSE", "LOW", "Q1", "MEDIAN", "Q3", "HIGH")
        .orderBy("CLASSE")
    )


# ------------------------------------------------------------------ lists
def town_list(towns: DataFrame, state: str | None = None) -> DataFrame:
    """Display names, one per accent-folded name; accented spellings win, then the first in order.

    Works on the municipality dimension or, when there is none, on the municipality table.
    """
    rows = towns if state is None else towns.filter(F.col(STATE) == state.upper())
    named = rows.filter(F.col(TOWN) != "").select(
        F.col(TOWN).alias("raw"), title_case(F.col(TOWN)).alias("display")
    )
    chosen = named.groupBy(F.trim(fold(F.col("display"))).alias("key")).agg(
        F.min(F.struct(is_ascii(F.col("display")).alias("plain"), "raw", "display")).alias("best")
    )
    return chosen.select(F.col("best.display").alias(TOWN)).orderBy(TOWN)


def published_towns(spark: SparkSession) -> DataFrame:
    """The municipality dimension, or the municipality table where it was not published."""
    known = spark.catalog.tableExists("dim_municipio")
    return spark.table("dim_municipio" if known else "gold_tb_notas_geo")


def years_available(stats: DataFrame) -> DataFrame:
    counts = reduce(add, [F.coalesce(F.col(f"{s}_count"), F.lit(0)) for s in SCORES])
    return stats.filter(counts > 0).select("ANO").distinct().orderBy("ANO")


def stats_range(stats: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    filters = []
    if start is not None:
        filters.append(F.col("ANO") >= start)
    if end is not None:
        filters.append(F.col("ANO") <= end)
    return conforming_rows(stats.filter(_all(filters)), STATS_ROW).orderBy("ANO")


# ------------------------------------------------------------------ municipalities and states
def filter_towns(
    towns: DataFrame,
    years: list[int] | None = None,
    states: list[str] | None = None,
    names: list[str] | None = None,
    min_count: int = 30,
) -> DataFrame:
    filters = []
    if years:
        filters.append(F.col("ANO").isin(years))
    if states:
        filters.append(F.col(STATE).isin([s.upper() for s in states]))
    if names:
        filters.append(fold(F.col(TOWN)).isin([fold_text(n) for n in names]))
    if min_count > 0:
        filters += [F.col(f"{s}_count") >= min_count for s in SCORES]
    return towns.filter(_all(filters)).select(
        *[F.col(c).cast("string").alias(c) if c == "CO_MUNICIPIO_PROVA" else c for c in TOWN_ROW]
    )


def order_towns(df: DataFrame) -> DataFrame:
    """Newest year first, then state and name; the code makes the order total, so pages are stable."""
    return df.orderBy(F.desc("ANO"), STATE, TOWN, "CO_MUNICIPIO_PROVA")


def town_page(
    towns: DataFrame,
    years: list[int] | None = None,
    states: list[str] | None = None,
    names: list[str] | None = None,
    min_count: int = 30,
    limit: int = 5000,
    page: int = 1,
) -> DataFrame:
    """One page of municipality rows with title-cased names."""
    # Rows unfit to be served go before the page is cut, so that pages are full.
    rows = conforming_rows(filter_towns(towns, years, states, names, min_count), TOWN_ROW)
    rows = order_towns(rows).offset((page - 1) * limit).limit(limit)
    return order_towns(rows).withColumn(TOWN, title_case(F.col(TOWN)))


def town_count(towns: DataFrame, **filters) -> DataFrame:
    return filter_towns(towns, **filters).agg(F.count("*").alias("total"))


def check_export_size(towns: DataFrame, ceiling: int, **filters) -> int:
    """Row count of an export; raises when a format built in one piece would exceed the ceiling."""
    total = town_count(towns, **filters).first()["total"]
    if total > ceiling:
        raise ValueError(f"export has {total} rows, the limit is {ceiling}; filter more or use CSV")
    return total


def state_page(
    states: DataFrame, year: int | None = None, min_enrolled: int = 100, state: str | None = None
) -> DataFrame:
    filters = [F.col("INSCRITOS") >= min_enrolled]
    if year is not None:
        filters.append(F.col("ANO") == year)
    if state is not None:
        filters.append(F.col(STATE) == state.upper())
    return conforming_rows(states.filter(_all(filters)), STATE_ROW).orderBy("ANO", STATE)


def histogram_one(histogram: DataFrame, year: int, subject: str) -> DataFrame:
    return histogram.filter((F.col("ANO") == year) & (F.col("DISCIPLINA") == subject)).orderBy("BIN_START")


def radar(stats: DataFrame, states: DataFrame, year: int, state: str | None = None) -> DataFrame:
    """Per subject: national mean, one state's mean and the best state mean of the year.

    The best value is taken per subject, so it need not come from a single state. The three rows
    are unpivoted and stacked; aggregating by subject lines them up without a join.
    """
    metrics = [f"{s}_mean" for s in SUBJECT_LABELS]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*metrics).unpivot([], metrics, "column", name)

    in_year = states.filter(F.col("ANO") == year)
    one_state = in_year.filter(F.col(STATE) == state.upper() if state else F.lit(False))
    subjects = states.sparkSession.createDataFrame(
        [(c,) for c in metrics], "column string"
    )
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            subjects,
            long(stats.filter(F.col("ANO") == year), "br_mean"),
            long(one_state, "uf_mean"),
            long(in_year, "best_uf_mean"),
        ],
    )
    labels = {f"{s}_mean": label for s, label in SUBJECT_LABELS.items()}
    return stacked.groupBy("column").agg(
        *[F.max(c).alias(c) for c in ("br_mean", "uf_mean", "best_uf_mean")]
    ).select(
        lookup(labels, F.col("column")).alias("metric"),
        "br_mean",
        "uf_mean",
        "best_uf_mean",
        F.lit(SCORE_MAX).alias("full_mark"),
    )


def town_evolution(
    towns: DataFrame,
    state: str,
    town: str | None = None,
    start: int | None = None,
    end: int | None = None,
    min_people: int = 1,
) -> DataFrame:
    """Yearly means per municipality, one row per folded name and year.

    Every year of a name shows the same spelling: the first accented one in (year, name) order,
    else the first. The final mean counts a missing subject as zero.
    """
    filters = [F.col(STATE) == state.upper(), F.col("NOTA_REDACAO_count") >= min_people]
    if town:
        filters.append(_same_town(town))
    if start:
        filters.append(F.col("ANO") >= start)
    if end:
        filters.append(F.col("ANO") <= end)
    rows = towns.filter(_all(filters)).filter(F.col(TOWN) != "")
    total = reduce(add, [F.coalesce(F.col(f"{s}_mean"), F.lit(0.0)) for s in SCORES])
    display = title_case(F.col(TOWN))
    rows = rows.select(
        display.alias("display"),
        F.trim(fold(display)).alias("key"),
        F.col(TOWN).alias("raw"),
        "CO_MUNICIPIO_PROVA",
        "ANO",
        F.col("NOTA_CIENCIAS_NATUREZA_mean").alias("MEDIA_CN"),
        F.col("NOTA_CIENCIAS_HUMANAS_mean").alias("MEDIA_CH"),
        F.col("NOTA_LINGUAGENS_CODIGOS_mean").alias("MEDIA_LC"),
        F.col("NOTA_MATEMATICA_mean").alias("MEDIA_MT"),
        F.col("NOTA_REDACAO_mean").alias("MEDIA_RED"),
        (total / 5.0).alias("MEDIA_FINAL"),
        F.col("INSCRITOS").alias("QTD_ALUNOS"),
    )
    same_name = Window.partitionBy("key")
    rows = rows.withColumn(
        "shown",
        F.min(F.struct(is_ascii(F.col("display")).alias("plain"), "ANO", "raw", "display")).over(
            same_name
        )["display"],
    )
    first = Window.partitionBy("key", "ANO").orderBy("raw", "CO_MUNICIPIO_PROVA")
    return (
        rows.withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .select(
            F.col("shown").alias(TOWN),
            "ANO",
            *[f"MEDIA_{x}" for x in ("CN", "CH", "LC", "MT", "RED", "FINAL")],
            "QTD_ALUNOS",
        )
        .orderBy("ANO", TOWN)
    )


# ------------------------------------------------------------------ band distribution
def town_band_counts(cleaned: DataFrame, state: str, town: str, year: int | None = None) -> DataFrame:
    """People per display band in one municipality, counted from the rows (no rounding)."""
    filters = [F.col(STATE) == state.upper(), *[F.col(s).isNotNull() for s in SCORES]]
    if year is not None:
        filters.append(F.col("ANO") == year)
    filters.append(_same_town(town))
    mean = reduce(add, [F.col(s) for s in SCORES]) / 5.0
    labels = DISPLAY_BANDS
    band = (
        F.when(mean < 400, labels[0])
        .when((mean >= 400) & (mean < 600), labels[1])
        .when((mean >= 600) & (mean < 800), labels[2])
        .otherwise(labels[3])
    )
    return (
        cleaned.filter(_all(filters)).groupBy(band.alias("FAIXA")).agg(F.count("*").alias("QTD_ALUNOS"))
    )


def state_band_counts(bands: DataFrame, state: str, year: int | None = None) -> DataFrame:
    """The same for a state, from the pre-aggregated band table."""
    filters = [F.col(STATE) == state.upper(), F.col("QTD_ALUNOS") > 0]
    if year is not None:
        filters.append(F.col("ANO") == year)
    relabel = {band[3]: shown for band, shown in zip(MEAN_BANDS, DISPLAY_BANDS)}
    shown = F.coalesce(lookup(relabel, F.col("DESCRICAO_FAIXA")), F.col("DESCRICAO_FAIXA"))
    return (
        bands.filter(_all(filters))
        .groupBy(shown.alias("FAIXA"))
        .agg(F.sum("QTD_ALUNOS").alias("QTD_ALUNOS"))
    )


def band_shares(counts: DataFrame) -> DataFrame:
    """All four display bands in order, with their share of everybody counted."""
    total = F.sum("QTD_ALUNOS")
    one_row = counts.agg(
        F.coalesce(total, F.lit(0)).alias("total"),
        *[
            F.coalesce(
                F.sum(F.when(F.col("FAIXA") == label, F.col("QTD_ALUNOS"))), F.lit(0)
            ).alias(f"n{i}")
            for i, label in enumerate(DISPLAY_BANDS)
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(label).alias("FAIXA"), F.col(f"n{i}").alias("QTD_ALUNOS"))
            for i, label in enumerate(DISPLAY_BANDS)
        ]
    )
    share = F.when(F.col("total") > 0, F.col("QTD_ALUNOS") / F.col("total") * 100).otherwise(0.0)
    return (
        one_row.select("total", F.inline(rows))
        .orderBy("i")
        .select("FAIXA", "QTD_ALUNOS", round_half_even(share, 2).alias("PERCENTUAL"))
    )


# ------------------------------------------------------------------ ad-hoc SQL
LITERAL_OR_COMMENT = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
# Statements that only look something up, by the name of their parsed node.
LOOKUPS = re.compile(r"Describe\w+|Show\w+|ExplainCommand")
# Functions that call any Java method by its name.
CALLS_JAVA = {"java_method", "reflect", "try_reflect"}


def _parts(jvm, *found) -> list:
    return [x for seq in found for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq.toSeq())]


def refused_node(spark: SparkSession, sql: str) -> str | None:
    """Name of the first node of the parsed statement that does more than query, or None.

    Every node is looked at, also in common table expressions and subqueries: commands, statements that write, scripts,
    and functions that call Java methods. What the parser makes of the text decides, so no spelling of a literal hides a verb.
    """
    jvm = spark._jvm
    catalyst = "org.apache.spark.sql.catalyst"

    def kind(name: str):
        return jvm.java.lang.Class.forName(f"{catalyst}.{name}")

    commands = [kind("plans.logical.Command"), kind("plans.logical.ParsedStatement")]
    plan_kind, function, subquery = kind("plans.logical.LogicalPlan"), kind("analysis.UnresolvedFunction"), kind("expressions.PlanExpression")
    root = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    todo = [root]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if plan_kind.isInstance(node):
            writes = any(c.isInstance(node) for c in commands) or re.match(r"Insert|\w*ScriptTransformation|CompoundBody", name)
            if writes and not (node.equals(root) and LOOKUPS.fullmatch(name)):
                return name
            todo += _parts(jvm, node.children(), node.innerChildren(), node.expressions())
            continue
        if function.isInstance(node) and CALLS_JAVA & {x.lower() for x in _parts(jvm, node.nameParts())}:
            return name
        if subquery.isInstance(node):
            todo.append(node.plan())
        todo += _parts(jvm, node.children())
    return None


def run_query(spark: SparkSession, sql: str, params: dict | list | None = None, row_limit: int | None = None):
    """Read-only SQL over the published views; every row of the result, or the first ``row_limit``.

    Statements with a verb that could change data are refused, whatever stands around the verb; literals and
    comments don't count. What is left must be a query, and nothing in its parsed plan may be a command.
    """
    text = sql.strip().rstrip(";").strip()
    words = re.findall(r"[a-z_]+", LITERAL_OR_COMMENT.sub(" ", text).lower())
    if {v.strip() for v in FORBIDDEN_SQL_VERBS} & set(words):
        raise ValueError(f"statement refused in read-only mode: {sql[:50]}")
    if not words or words[0] not in ("select", "with", "describe", "desc", "show", "explain", "values", "from"):
        raise ValueError(f"only queries are allowed: {sql[:50]}")
    refused = refused_node(spark, text)
    if refused is not None:
        raise ValueError(f"statement refused in read-only mode ({refused}): {sql[:50]}")
    result = spark.sql(text, args=params) if params else spark.sql(text)
    return result if row_limit is None else result.limit(row_limit)


def preview(spark: SparkSession, sql: str, rows: int = 20) -> DataFrame:
    """First rows of an ad-hoc query."""
    return run_query(spark, sql).limit(rows)
