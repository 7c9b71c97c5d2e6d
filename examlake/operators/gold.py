"""Gold tables: yearly statistics, place aggregates, histogram, income box plot, score bands."""

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.fixed_values import (
    AGE_MAX,
    AGE_MIN,
    GEO,
    INCOME_CLASS_BY_LETTER,
    INCOME_CLASS_ORDER,
    MEAN_BANDS,
    PRESENCE,
    SCORE_MAX,
    SCORE_MIN,
    SCORES,
    UF_BY_CODE,
)
from examlake.functions.numeric import (
    band_case,
    bin_index,
    drop_nan,
    lookup,
    round_half_even,
    row_mean,
    within,
)
from examlake.operators.quantiles import exact_summary
from examlake.operators.standardize import normalize_for_gold

STATE_KEYS = ["ANO", "SG_UF_PROVA"]
TOWN_KEYS = ["ANO", *GEO]
GEO_COLUMNS = [*TOWN_KEYS, "INSCRITOS", *[f"{s}_{x}" for s in SCORES for x in ("count", "mean")]]


def valid_score(df: DataFrame, score: str, presence: bool = False) -> Column:
    """Score in range (and, if asked and known, of someone present), else null."""
    if score not in df.columns:
        return F.lit(None).cast("double")
    value = within(drop_nan(F.col(score).cast("double")), SCORE_MIN, SCORE_MAX)
    flag = PRESENCE[score]
    if presence and flag in df.columns:
        value = F.when(F.col(flag) == 1, value)
    return value


def unified_scores(frames: list[tuple[DataFrame, int | None]]) -> DataFrame:
    """One score table over sources with different column names and types."""
    parts = [normalize_for_gold(df, year) for df, year in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ------------------------------------------------------------------ enrolment
def enrolment(df: DataFrame, keys: list[str], name: str, unique_ids: bool = False) -> DataFrame | None:
    """Distinct enrolments per key, or None when the plain aggregate can count them.

    A distinct count inside a wide aggregation would carry every partial sum per identifier
    through the shuffle, so it is computed on the keys and the identifier alone. Frames whose
    identifiers are already unique (cleaned data) need no distinct step at all.
    """
    if unique_ids or "ID_INSCRICAO" not in df.columns:
        return None
    return (
        df.select(*keys, "ID_INSCRICAO").distinct().groupBy(*keys).agg(
            F.count("ID_INSCRICAO").alias(name)
        )
    )


def enrolled_here(df: DataFrame) -> Column:
    return F.count("ID_INSCRICAO") if "ID_INSCRICAO" in df.columns else F.count("*")


# ------------------------------------------------------------------ yearly statistics
def year_stats(df: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Enrolment, age and score statistics per year (37 columns).

    A year without a valid score shows zeros; a year without a valid age shows nulls.
    """
    scores = df.select(
        "ANO",
        *[c for c in ["ID_INSCRICAO"] if c in df.columns],
        (
            within(drop_nan(F.col("NU_IDADE").cast("double")), AGE_MIN, AGE_MAX)
            if "NU_IDADE" in df.columns
            else F.lit(None).cast("double")
        ).alias("IDADE"),
        *[valid_score(df, s).alias(s) for s in SCORES],
    )
    measures = ["IDADE", *SCORES]
    total = enrolment(scores, ["ANO"], "TOTAL_INSCRITOS", unique_ids)
    if total is None:
        total = scores.groupBy("ANO").agg(enrolled_here(scores).alias("TOTAL_INSCRITOS"))
    pairs = [x for m in measures for x in (F.lit(m), F.col(m))]
    long = scores.select("ANO", F.stack(F.lit(len(measures)), *pairs).alias("measure", "value"))
    found = exact_summary(long, ["ANO", "measure"], "value", {"median": 0.5}, SCORE_MIN, SCORE_MAX, few_groups=True)
    stats = found.groupBy(F.col("ANO").alias("_ANO")).agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{m}_{x}")
            for m in measures
            for x in ("count", "mean", "std", "min", "median", "max")
        ]
    )
    out = [F.col("ANO"), F.col("TOTAL_INSCRITOS")]
    out += [F.col(f"IDADE_{x}") for x in ("mean", "std", "min", "median", "max")]
    for s in SCORES:
        out.append(F.col(f"{s}_count"))
        out += [
            F.coalesce(F.col(f"{s}_{x}"), F.lit(0.0)).alias(f"{s}_{x}")
            for x in ("mean", "std", "min", "median", "max")
        ]
    return total.join(stats, F.col("ANO").eqNullSafe(F.col("_ANO")), "left").select(*out)


# ------------------------------------------------------------------ places
def _place_scores(df: DataFrame, keys: list[str], presence: bool, unique_ids: bool) -> DataFrame:
    known = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    narrow = known.select(
        *keys,
        *[c for c in ["ID_INSCRICAO"] if c in df.columns],
        *[valid_score(df, s, presence).alias(s) for s in SCORES],
    )
    measures = []
    for s in SCORES:
        measures += [F.count(s).alias(f"{s}_count"), F.avg(s).alias(f"{s}_mean")]
    total = enrolment(narrow, keys, "INSCRITOS", unique_ids)
    if total is None:
        measures.insert(0, enrolled_here(narrow).alias("INSCRITOS"))
    places = narrow.groupBy(*keys).agg(*measures)
    if total is not None:
        # Both sides are already partitioned by the keys, so this adds no shuffle.
        places = places.join(total, keys, "left")
    score_columns = [c for c in GEO_COLUMNS if c.startswith("NOTA_")]
    return places.select(*keys, "INSCRITOS", *score_columns)


def town_scores(df: DataFrame, unique_ids: bool = False, presence: bool = True) -> DataFrame:
    """Per year and municipality: enrolment, and count and mean of each score of those present.

    Rows without a year or a complete place are left out. If a place or score column is missing altogether
    the result is empty but typed.
    """
    if not set([*GEO, *SCORES]) <= set(df.columns):
        return empty_places(df, TOWN_KEYS)
    return _place_scores(df, TOWN_KEYS, presence, unique_ids)


def state_scores(df: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Per year and state: enrolment, and count and mean of each in-range score."""
    if not {"SG_UF_PROVA", *SCORES} <= set(df.columns):
        return empty_places(df, STATE_KEYS)
    return _place_scores(df, STATE_KEYS, False, unique_ids)


def empty_places(df: DataFrame, keys: list[str]) -> DataFrame:
    fields = ", ".join(
        [f"{k} {'int' if k == 'ANO' else 'string'}" for k in keys]
        + ["INSCRITOS bigint"]
        + [f"{s}_count bigint, {s}_mean double" for s in SCORES]
    )
    return df.sparkSession.createDataFrame([], fields)


# ------------------------------------------------------------------ histogram
def score_histogram(
    df: DataFrame, bins: int = 50, low: float = SCORE_MIN, high: float = SCORE_MAX
) -> DataFrame:
    """Equal-width histogram per year and subject, empty bins included.

    Rows are counted per bin before anything is widened. Each subject's counts then fit a map of
    at most ``bins`` entries, from which the full row of bins is read off.

    Scores that are missing as columns have no bins; without any score column the result is empty but typed.
    """
    width = (high - low) / bins
    present = [s for s in SCORES if s in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "ANO int, DISCIPLINA string, BIN_START double, BIN_END double, CONTAGEM bigint"
        )
    long = (
        df.select("ANO", *[within(drop_nan(F.col(s).cast("double")), low, high).alias(s) for s in present])
        .unpivot(["ANO"], present, "DISCIPLINA", "value")
        .filter(F.col("value").isNotNull())
    )
    counts = long.groupBy(
        "ANO", "DISCIPLINA", bin_index(F.col("value"), low, high, bins).alias("bin")
    ).agg(F.count("*").alias("n"))
    filled = counts.groupBy("ANO", "DISCIPLINA").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found")
    )
    return filled.select(
        "ANO",
        "DISCIPLINA",
        "found",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    ).select(
        "ANO",
        "DISCIPLINA",
        (F.lit(float(low)) + F.col("bin") * width).alias("BIN_START"),
        (F.lit(float(low)) + (F.col("bin") + 1) * width).alias("BIN_END"),
        F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0)).alias("CONTAGEM"),
    )


# ------------------------------------------------------------------ income
def income_boxes(df: DataFrame) -> DataFrame:
    """Five-number summary of the general score per year and income class.

    Only people present at all four exams with a regular essay count. If a column this needs is missing
    altogether, the result is empty but typed.
    """
    flags = ["TP_PRESENCA_CN", "TP_PRESENCA_CH", "TP_PRESENCA_LC", "TP_PRESENCA_MT", "TP_STATUS_REDACAO"]
    if not {"ANO", "Q006", *flags, *SCORES} <= set(df.columns):
        return df.sparkSession.createDataFrame(
            [], "CLASSE string, LOW double, Q1 double, MEDIAN double, Q3 double, HIGH double, COUNT bigint, ANO int"
        )
    complete = df.filter(reduce(and_, [F.col(c) == 1 for c in flags]))
    scored = complete.select(
        "ANO",
        lookup(INCOME_CLASS_BY_LETTER, F.col("Q006")).alias("CLASSE"),
        row_mean([drop_nan(F.col(s).cast("double")) for s in SCORES]).alias("score"),
    ).filter(F.col("CLASSE").isNotNull())
    found = exact_summary(
        scored, ["ANO", "CLASSE"], "score", {"Q1": 0.25, "MEDIAN": 0.5, "Q3": 0.75}, SCORE_MIN, SCORE_MAX, few_groups=True
    )
    return found.select(
        "CLASSE", F.col("min").alias("LOW"), "Q1", "MEDIAN", "Q3", F.col("max").alias("HIGH"), F.col("count").alias("COUNT"), "ANO"
    )


def income_order(c: Column) -> Column:
    """Ordinal of the income class in its declared order."""
    return lookup({label: i for i, label in enumerate(INCOME_CLASS_ORDER)}, c)


# ------------------------------------------------------------------ bands
def five_score_means(df: DataFrame) -> DataFrame:
    """Rows with every score valid, plus their mean rounded half-even to two decimals."""
    present = [s for s in SCORES if s in df.columns]
    if not present:
        return df
    valid = df.select(
        *[valid_score(df, c).alias(c) if c in present else F.col(c) for c in df.columns]
    ).filter(reduce(and_, [F.col(s).isNotNull() for s in present]))
    mean = reduce(add, [F.col(s) for s in present]) / len(present)
    return valid.withColumn("MEDIA_5_DISC", round_half_even(mean, 2))


def load_bands(spark: SparkSession, path: str | None = None) -> list[tuple]:
    """Band table from a JSON file of {id, min, max, descricao} records, else the default bands."""
    if path is None:
        return MEAN_BANDS
    rows = spark.read.option("multiLine", True).json(path).select("id", "min", "max", "descricao")
    return sorted(tuple(r) for r in rows.collect())


BANDS = "place int, id int, low double, high double, label string"


def bands_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Band table (``place, id, low, high, label``) from the YAML form ``- id: 1``, ``min:``, ``max:``, ``descricao:``.

    Each band is a list item of ``key: value`` lines; other keys, comments and quotes around values are left out.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    items = text.select(F.posexplode(F.split("text", r"(?m)^\s*-\s+")).alias("place", "item")).filter("place > 0")

    def field(name: str) -> Column:
        quoted, bare = (F.regexp_extract("item", rf"(?m)^\s*{name}\s*:\s*{v}", 1) for v in ("[\"']([^\"'\n]*)[\"']", r"([^#\n\"']*)"))
        return F.trim(F.when(quoted != "", quoted).otherwise(bare))

    return items.select(
        "place",
        field("id").cast("int").alias("id"),
        field("min").cast("double").alias("low"),
        field("max").cast("double").alias("high"),
        field("descricao").alias("label"),
    )


def state_bands_joined(df: DataFrame, bands: DataFrame) -> DataFrame:
    """``state_bands`` by a band table of any size, given as a DataFrame (``bands_from_file``).

    People are counted by state and mean first (means have two decimals). The counts are joined to the bands by the whole number
    below the mean, which each band lists, and then by its limits; of overlapping bands the first in the table holds.
    A mean in no band falls to the first.
    """
    if "SG_UF_PROVA" not in df.columns or not set(SCORES) & set(df.columns):
        return state_bands(df)
    state = F.coalesce("SG_UF_PROVA", F.lit("XX")).alias("SG_UF_PROVA")
    means = five_score_means(df.select("ANO", "SG_UF_PROVA", *[s for s in SCORES if s in df.columns]))
    counts = means.groupBy("ANO", state, "MEDIA_5_DISC").agg(F.count("*").alias("n"))
    counts = counts.withColumn("cell", F.floor("MEDIA_5_DISC").cast("int"))
    inside = (F.col("high") > SCORE_MIN) & (F.col("low") <= SCORE_MAX)
    ends = [F.greatest(F.lit(SCORE_MIN), F.least(F.lit(SCORE_MAX), F.floor(c))).cast("int") for c in ("low", "high")]
    cells = bands.filter(inside).withColumn("_cell", F.explode(F.sequence(*ends)))
    mean = F.col("MEDIA_5_DISC")
    below = F.when(F.col("high") == SCORE_MAX, mean <= F.col("high")).otherwise(mean < F.col("high"))
    held = counts.join(cells, (F.col("cell") == F.col("_cell")) & (mean >= F.col("low")) & below, "left")
    band = F.struct("place", "id", "label")
    held = held.groupBy("ANO", "SG_UF_PROVA", "MEDIA_5_DISC", "n").agg(F.min(F.when(F.col("place").isNotNull(), band)).alias("band"))
    first = bands.agg(F.min(band).alias("first")).scalar()
    held = held.withColumn("band", F.coalesce("band", first))
    by = ["ANO", "SG_UF_PROVA", F.col("band.id").alias("ID_FAIXA"), F.col("band.label").alias("DESCRICAO_FAIXA")]
    return held.groupBy(*by).agg(F.sum("n").alias("QTD_ALUNOS"))


def state_bands(df: DataFrame, bands: list[tuple] = MEAN_BANDS, dense: bool = False) -> DataFrame:
    """People per year, state and band of the five-score mean; unknown states are "XX".

    ``dense`` lists every band of each state and year, with zero where nobody falls in it. Without the state
    or any score column the result is empty but typed.
    """
    if "SG_UF_PROVA" not in df.columns or not set(SCORES) & set(df.columns):
        return df.sparkSession.createDataFrame(
            [], "ANO int, SG_UF_PROVA string, ID_FAIXA int, DESCRICAO_FAIXA string, QTD_ALUNOS bigint"
        )
    mean = F.col("MEDIA_5_DISC")
    keys = ["ANO", "SG_UF_PROVA"]
    counts = (
        five_score_means(df.select("ANO", "SG_UF_PROVA", *[s for s in SCORES if s in df.columns]))
        .groupBy(
            "ANO",
            F.coalesce("SG_UF_PROVA", F.lit("XX")).alias("SG_UF_PROVA"),
            band_case(mean, bands, 0).alias("ID_FAIXA"),
            band_case(mean, bands, 3).alias("DESCRICAO_FAIXA"),
        )
        .agg(F.count("*").alias("QTD_ALUNOS"))
    )
    if not dense:
        return counts
    by_state = counts.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("ID_FAIXA") == b[0], F.col("QTD_ALUNOS"))), F.lit(0)).alias(
                f"band_{b[0]}"
            )
            for b in bands
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(b[0]).alias("ID_FAIXA"),
                F.lit(b[3]).alias("DESCRICAO_FAIXA"),
                F.col(f"band_{b[0]}").alias("QTD_ALUNOS"),
            )
            for b in bands
        ]
    )
    return by_state.select(*keys, F.inline(rows))


# ------------------------------------------------------------------ dimension and counts
def town_dimension(df: DataFrame) -> DataFrame:
    """Municipality code, its most frequent name (ties alphabetical) and the code's state."""
    code = F.col("CO_MUNICIPIO_PROVA").try_cast("bigint")
    names = (
        df.select(code.alias("CO_MUNICIPIO_PROVA"), "NO_MUNICIPIO_PROVA")
        .dropna()
        .groupBy("CO_MUNICIPIO_PROVA", "NO_MUNICIPIO_PROVA")
        .agg(F.count("*").alias("n"))
    )
    best = names.groupBy("CO_MUNICIPIO_PROVA").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "NO_MUNICIPIO_PROVA")).alias("best")
    )
    prefix = F.substring(F.col("CO_MUNICIPIO_PROVA").cast("string"), 1, 2).try_cast("int")
    return best.select(
        "CO_MUNICIPIO_PROVA",
        F.col("best.NO_MUNICIPIO_PROVA").alias("NO_MUNICIPIO_PROVA"),
        lookup(UF_BY_CODE, prefix).alias("SG_UF_PROVA"),
    ).filter(F.col("SG_UF_PROVA").isNotNull())


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate keys {keys}")


def year_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ANO").agg(F.count("*").alias("n_linhas_silver"))
