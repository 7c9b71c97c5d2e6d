"""Registered queries: one per operator, each over the whole given tables."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.fixed_values import RACE_LABELS, RAW_SCORE_COLUMNS, SCORES
from examlake.functions import text
from examlake.operators import classes, cleaning, gold, metadata, quality, reports, serving, standardize, views
from examlake.plans import build
from examlake.plans.build import gold_tables
from examlake.plans.exam_view import (
    EXAM_COLUMNS,
    LINE_ONLY,
    NO_ORDER,
    NO_PLACE,
    RAW_LAYOUT,
    ROW_KEY,
    exam_from,
    exam_rows,
    raw_text,
    table,
)
from examlake.session import shared_folder
from examlake.sources import exports, lake
from examlake.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the served queries; the derived exam years are 1995 to 2001.
YEAR, STATE, TOWN, OTHER_TOWN = 1998, "CE", "sao tome d'oeste 14", "São Tomé d'Oeste 12"
FIRST, LAST = 1996, 2000
RACE_STATE = "MA"
METRIC = "NOTA_MATEMATICA_mean"
SUBJECT = "NOTA_MATEMATICA"
DEFAULT_YEAR = 1990
INCOME_DOMAIN = {"RENDA_FAMILIAR": ("A", "B", "C"), "TP_COR_RACA": (0, 1, 2, 3, 4, 5)}
PLAN = cleaning.CleaningPlan(
    domains=tuple(cleaning.DomainRule(c, v) for c, v in INCOME_DOMAIN.items()),
    order=tuple(ROW_KEY),
)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating results rounded, so that engines summing in another order agree."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[F.round(F.col(f"`{c}`"), digits).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    )


REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name, rounding its floating columns."""
    REGISTRY[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
    return fn


# ------------------------------------------------------------------ standardise
@query
def std_typed(spark, sf):
    raw = raw_text(exam_rows(spark, sf, keyed=True))
    return standardize.standardize(raw, DEFAULT_YEAR)


@query
def gold_normalized(spark, sf):
    """Rows under historic names through the gold-side normaliser."""
    rows = exam_rows(spark, sf)
    old = rows.select(
        F.col("ID_INSCRICAO").alias("NU_INSCRICAO"),
        F.col("ANO").cast("string").alias("ANO"),
        "TP_SEXO",
        F.col("NU_IDADE").cast("string").alias("NU_IDADE"),
        F.replace(F.col("NOTA_CIENCIAS_NATUREZA").cast("string"), F.lit("."), F.lit(",")).alias("NU_NOTA_CN"),
        F.col("NOTA_MATEMATICA").alias("NU_NOTA_MT"),
    )
    return standardize.normalize_for_gold(old, DEFAULT_YEAR)


@query
def unified_scores(spark, sf):
    """Two layouts, one with historic names and fewer columns, under one schema."""
    rows = exam_rows(spark, sf)
    old = rows.filter(F.col("ANO") < YEAR).select(
        F.col("ID_INSCRICAO").alias("NU_INSCRICAO"), "ANO", F.col("NOTA_REDACAO").cast("int").alias("NU_NOTA_REDACAO")
    )
    return gold.unified_scores([(rows.filter(F.col("ANO") >= YEAR), None), (old, None)])


@query
def small_domain(spark, sf):
    rows = exam_rows(spark, sf, keyed=True, wanted=LINE_ONLY)
    found = metadata.small_domains(
        rows, ["TP_SEXO", "Q006", "RENDA_FAMILIAR", "NO_MUNICIPIO_PROVA", "TP_COR_RACA"], F.struct(*ROW_KEY)
    )
    return found.select("column", F.concat_ws(",", "domain").alias("domain"), F.col("domain").isNull().alias("too_many"))


@query
def contract_typed(spark, sf):
    """Text columns cast to the types a contract declares, columns outside it dropped."""
    contract = {
        n: metadata.ColumnContract(n, metadata.contract_type(t))
        for n, t in {"TP_ETNIA": "string", "IDADE": "Int64", "NU_ANO": "int32", "MUNICIPIO_PROVA": "text"}.items()
    }
    raw = raw_text(exam_rows(spark, sf, keyed=True))
    return metadata.apply_types(metadata.select_known(raw, contract), contract)


@query
def renamed_columns(spark, sf):
    """Raw columns under the canonical names that their many names stand for."""
    names = standardize.rename_map()
    raw = raw_text(exam_rows(spark, sf, keyed=True))
    renamed = raw.withColumnsRenamed({c: names[c] for c in raw.columns if c in names})
    return renamed.select("ID_INSCRICAO", "NO_MUNICIPIO_PROVA", "NU_IDADE", "TP_SEXO")


@query
def required_columns(spark, sf):
    """Which raw tables pass the check for required columns, by any of their names."""
    raw = raw_text(exam_rows(spark, sf, keyed=True))
    cases = {
        "complete": (raw, ("NU_INSCRICAO", "NO_MUNICIPIO_PROVA")),
        "other name": (raw.withColumnRenamed("NU_INSCRICAO", "ID_INSCRICAO"), ("NU_INSCRICAO",)),
        "no identifier": (raw.drop("NU_INSCRICAO"), ("NU_INSCRICAO",)),
        "no rows": (raw.filter("l_partkey < 0"), ("NU_INSCRICAO",)),
    }

    def refusal(df, required):
        try:
            standardize.validate_required(df, required, YEAR)
        except ValueError as e:
            return str(e)
        return ""

    return spark.createDataFrame([(name, refusal(*case)) for name, case in cases.items()], "name string, refusal string")


@query
def metadata_year(spark, sf):
    """Metadata written, read back and limited to a year."""
    path = shared_folder(spark, "metadata")
    metadata.save_metadata(exam_metadata(spark, sf), path)
    rows = metadata.metadata_for_year(metadata.load_metadata(spark, path), YEAR)
    return rows.select("ano", "nome_padrao", "tipo_padrao", F.concat_ws(",", "dominio_valores").alias("domain"))


@query
def contract_from_metadata(spark, sf):
    """The contract of one year, read from the metadata table, on the raw rows of that year."""
    contract = metadata.build_contract(exam_metadata(spark, sf), YEAR)
    raw = raw_text(exam_rows(spark, sf, keyed=True, years=(YEAR, YEAR))).drop("SEXO")
    typed = metadata.apply_types(metadata.select_known(raw, contract), contract)
    return typed.withColumn("allowed", F.lit(",".join(contract["TP_ETNIA"].domain)))


@query
def year_selection(spark, sf):
    years = lake.select_years(start=FIRST, end=LAST, known=range(1990, 2010))
    rows = exam_rows(spark, sf, wanted=["ANO"], years=(years[0], years[-1]))
    return lake.only_years(rows, years).groupBy("ANO").agg(F.count("*").alias("n"))


@query
def skip_existing(spark, sf):
    wanted = spark.range(1990, 2010).select(F.col("id").cast("int").alias("ANO"))
    return lake.missing_years(wanted, exam_rows(spark, sf, wanted=["ANO"]))


# ------------------------------------------------------------------ clean
def cleaned(spark, sf):
    """The four tables as views of one write."""
    return cleaning.write_marked(exam_rows(spark, sf, keyed=True), shared_folder(spark, "cleaned"), PLAN)


@query
def clean_valid(spark, sf):
    return cleaned(spark, sf).valid.drop(*ROW_KEY)


@query
def clean_invalid(spark, sf):
    return cleaned(spark, sf).invalid.select(*EXAM_COLUMNS)


@query
def clean_duplicates(spark, sf):
    return cleaned(spark, sf).duplicates.select(*EXAM_COLUMNS)


@query
def clean_report(spark, sf):
    return cleaned(spark, sf).report


def exam_metadata(spark, sf):
    """A declaration of the raw and canonical variables for each year there is, with domains that differ by year."""
    years = exam_rows(spark, sf, wanted=["ANO"]).select(F.col("ANO").alias("ano")).distinct()
    letters = F.when(F.col("ano") < YEAR, F.array(*map(F.lit, "ABC"))).otherwise(F.array(*map(F.lit, "AB")))
    races = F.when(F.col("ano") % 2 == 0, F.array(*map(F.lit, "012345")))
    declared = {
        "RENDA_FAMILIAR": ("string", letters),
        "TP_COR_RACA": ("Int64", races),
        "TP_ETNIA": ("string", races),
        "TP_SEXO": ("string", F.array(F.lit("F"), F.lit("M"))),
        "IDADE": ("Int64", F.lit(None).cast("array<string>")),
        "NU_ANO": ("int32", F.lit(None).cast("array<string>")),
        "MUNICIPIO_PROVA": ("text", F.lit(None).cast("array<string>")),
    }
    rows = [
        F.struct(F.lit(n).alias("nome_original"), F.lit(n).alias("nome_padrao"), F.lit("").alias("descricao"), F.lit(t).alias("tipo_padrao"), d.alias("dominio_valores"))
        for n, (t, d) in declared.items()
    ]
    return years.select("ano", F.inline(F.array(*rows)))


@query
def clean_metadata(spark, sf):
    """Domains from the metadata of each row's year."""
    domains = cleaning.domains_by_year(exam_metadata(spark, sf))
    plan = cleaning.CleaningPlan(order=tuple(ROW_KEY))
    rows = exam_rows(spark, sf, keyed=True)
    return cleaning.write_marked(rows, shared_folder(spark, "cleaned"), plan, domains=domains).valid.select(*EXAM_COLUMNS)


@query
def clean_plan(spark, sf):
    """Valid rows by year under a plan made of allowed values and further keys, of which some are absent."""
    plan = cleaning.cleaning_plan(INCOME_DOMAIN, order=tuple(ROW_KEY))
    valid = cleaning.clean(exam_rows(spark, sf, keyed=True), plan).valid
    return valid.groupBy("ANO").agg(F.count("*").alias("n"), F.count_if(F.col("RENDA_FAMILIAR") == "UNKNOWN").alias("unknown"))


@query
def rule_valid(spark, sf):
    return cleaning.enforce_ranges(exam_rows(spark, sf))[0]


@query
def rule_first_reason(spark, sf):
    return cleaning.enforce_ranges(exam_rows(spark, sf))[1].select("_reason", *EXAM_COLUMNS)


@query
def rule_report(spark, sf):
    return cleaning.enforce_ranges(exam_rows(spark, sf))[2]


DOMAIN_RULES = [
    cleaning.DomainRule("SG_UF_PROVA", ("PA", "SP", "RJ", "BA")),
    cleaning.DomainRule("RENDA_FAMILIAR", ("A", "B", "C")),
]


@query
def domain_null_repair(spark, sf):
    rows = exam_rows(spark, sf, wanted=["ID_INSCRICAO", "SG_UF_PROVA", "RENDA_FAMILIAR"])
    return cleaning.enforce_domains(rows, DOMAIN_RULES)[0]


@query
def domain_report(spark, sf):
    return cleaning.enforce_domains(exam_rows(spark, sf, wanted=NO_ORDER), DOMAIN_RULES)[1]


@query
def dedup_two_keys(spark, sf):
    """Keep-first over whichever of several keys exist (the missing one is ignored)."""
    keys = ["TP_COR_RACA", "NU_INSCRICAO", "CO_MUNICIPIO_PROVA"]
    rows = exam_rows(spark, sf, keyed=True, first_of=keys)
    return cleaning.split_duplicates(rows, keys, ROW_KEY)[0].drop(*ROW_KEY)


@query
def dedup_two_keys_rest(spark, sf):
    rows = exam_rows(spark, sf, keyed=True)
    keys = ["TP_COR_RACA", "NU_INSCRICAO", "CO_MUNICIPIO_PROVA"]
    return cleaning.split_duplicates(rows, keys, ROW_KEY)[1].drop(*ROW_KEY)


# ------------------------------------------------------------------ classify
@query
def class_rows(spark, sf):
    rows = exam_rows(spark, sf, wanted=NO_PLACE)
    return classes.apply_classes(rows).select("ID_INSCRICAO", "ANO", "NU_IDADE", *SCORES, *classes.CLASS_COLUMNS)


@query
def class_summary(spark, sf):
    return classes.class_summary(classes.apply_classes(exam_rows(spark, sf, wanted=NO_PLACE)))


@query
def class_alt(spark, sf):
    rows = exam_rows(spark, sf, wanted=NO_PLACE)
    out = classes.apply_classes(rows, classes.ALTERNATIVE_CLASSES)
    return out.select("ID_INSCRICAO", "ANO", *classes.CLASS_COLUMNS)


@query
def class_custom(spark, sf):
    """A user-defined class that builds on a built-in one."""
    rules = [
        *classes.DEFAULT_CLASSES,
        classes.ClassRule(
            "CLASS_PERFIL", lambda _: F.concat_ws("/", "CLASS_FAIXA_ETARIA", "CLASS_NOTA_GLOBAL")
        ),
    ]
    rows = classes.apply_classes(exam_rows(spark, sf, wanted=NO_PLACE), rules)
    return rows.groupBy("ANO", "CLASS_PERFIL").agg(F.count("*").alias("total"))


# ------------------------------------------------------------------ gold
def stats(spark, sf):
    return gold.year_stats(exam_rows(spark, sf, wanted=NO_PLACE))


def towns(spark, sf):
    return gold.town_scores(exam_rows(spark, sf))


def states(spark, sf):
    return gold.state_scores(exam_rows(spark, sf))


def histogram(spark, sf):
    return gold.score_histogram(exam_rows(spark, sf, wanted=NO_PLACE))


def boxes(spark, sf):
    return gold.income_boxes(exam_rows(spark, sf, wanted=NO_PLACE))


def bands(spark, sf):
    return gold.state_bands(exam_rows(spark, sf))


@query
def year_stats(spark, sf):
    return stats(spark, sf)


@query
def geo_municipality(spark, sf):
    return towns(spark, sf)


@query
def geo_state(spark, sf):
    return states(spark, sf)


@query
def score_histogram(spark, sf):
    return histogram(spark, sf)


@query
def income_box(spark, sf):
    return boxes(spark, sf)


@query
def income_ordered(spark, sf):
    """Box plots with the ordinal of their class in the declared order."""
    return boxes(spark, sf).select(
        "ANO", "CLASSE", "COUNT", gold.income_order(F.col("CLASSE")).alias("ordinal")
    ).orderBy("ordinal", "ANO")


@query
def mean5_rows(spark, sf):
    return gold.five_score_means(exam_rows(spark, sf, wanted=NO_PLACE)).select("ID_INSCRICAO", "ANO", *SCORES, "MEDIA_5_DISC")


@query
def state_bands(spark, sf):
    return bands(spark, sf)


# Bands as users write them.
BAND_FILE = """# faixas de uma escola
faixas:
  - id: 10
    min: 0
    max: 300
    descricao: "Até 300"
    cor: "#ef4444" # vermelho
  - id: 20
    min: 300
    max: 452.5
    descricao: 'De 300 a 452,5'
  - id: 30
    min: 452.5
    max: 700
    descricao: Meio
  - id: 40
    min: 700
    max: 1000
    descricao: "Alto # topo"
"""


@query
def state_bands_file(spark, sf):
    """Bands read from a file and joined by their limits."""
    path = shared_folder(spark, "bands")
    spark.createDataFrame([(BAND_FILE,)], "value string").coalesce(1).write.text(path)
    return gold.state_bands_joined(exam_rows(spark, sf), gold.bands_from_file(spark, path))


@query
def state_bands_dense(spark, sf):
    return gold.state_bands(exam_rows(spark, sf), dense=True)


@query
def dim_municipality(spark, sf):
    return gold.town_dimension(exam_rows(spark, sf, wanted=NO_ORDER))


@query
def year_counts(spark, sf):
    return gold.year_counts(exam_rows(spark, sf, wanted=["ANO"]))


@query
def gold_missing_columns(spark, sf):
    """Rows of gold tables built from rows without an income answer, without any place and without any score."""
    old = [c for c in LINE_ONLY if c not in ("Q006", *SCORES)]
    rows = exam_rows(spark, sf, wanted=old)
    tables = {
        "income": gold.income_boxes(rows),
        "bands": gold.state_bands(rows),
        "histogram": gold.score_histogram(rows),
        "towns": gold.town_scores(rows),
        "years": gold.year_counts(rows),
    }
    counts = [
        df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), F.lit(len(df.columns)).alias("columns"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def pipeline_states(spark, sf):
    """Raw text to the state table: standardise, clean, aggregate."""
    raw = raw_text(exam_rows(spark, sf, keyed=True))
    silver = standardize.standardize(raw, DEFAULT_YEAR, carry=tuple(ROW_KEY))
    valid = cleaning.clean(silver, PLAN).valid
    return gold_tables(valid)["tb_notas_geo_uf"]


# ------------------------------------------------------------------ serve
@query
def race_means(spark, sf):
    return serving.race_means(exam_rows(spark, sf, wanted=NO_PLACE))


@query
def race_means_filtered(spark, sf):
    return serving.race_means(exam_rows(spark, sf, years=(YEAR, YEAR)), YEAR, RACE_STATE.lower())


@query
def race_means_town(spark, sf):
    return serving.race_means(exam_rows(spark, sf, wanted=NO_PLACE), town=TOWN, more_than=5)


@query
def income_year(spark, sf):
    return serving.income_year(boxes(spark, sf), YEAR)


@query
def municipality_list(spark, sf):
    """From the municipality table, which knows both spellings of a name."""
    return serving.town_list(towns(spark, sf))


@query
def municipality_list_state(spark, sf):
    return serving.town_list(gold.town_dimension(exam_rows(spark, sf, wanted=NO_ORDER)), STATE)


@query
def years_available(spark, sf):
    return serving.years_available(stats(spark, sf))


@query
def stats_range(spark, sf):
    return serving.stats_range(stats(spark, sf), FIRST, LAST)


@query
def geo_page(spark, sf):
    return serving.town_page(
        towns(spark, sf), years=[1997, YEAR, 1999], states=["ce", "to", "ma"], min_count=5, limit=20, page=2
    )


@query
def geo_page_names(spark, sf):
    return serving.town_page(towns(spark, sf), names=[TOWN, OTHER_TOWN], min_count=1)


@query
def geo_page_count(spark, sf):
    return serving.town_count(towns(spark, sf), years=[1997, YEAR], min_count=5)


@query
def state_page(spark, sf):
    return serving.state_page(states(spark, sf))


@query
def state_page_one(spark, sf):
    return serving.state_page(states(spark, sf), YEAR, 10, STATE.lower())


@query
def histogram_one(spark, sf):
    return serving.histogram_one(histogram(spark, sf), YEAR, SUBJECT)


@query
def radar(spark, sf):
    return serving.radar(stats(spark, sf), states(spark, sf), YEAR, STATE)


@query
def radar_no_state(spark, sf):
    return serving.radar(stats(spark, sf), states(spark, sf), YEAR)


@query
def municipal_evolution(spark, sf):
    return serving.town_evolution(towns(spark, sf), STATE, start=FIRST, end=LAST)


@query
def bands_municipality(spark, sf):
    return serving.band_shares(serving.town_band_counts(exam_rows(spark, sf), STATE, TOWN))


@query
def bands_state(spark, sf):
    return serving.band_shares(serving.state_band_counts(bands(spark, sf), STATE, YEAR))


@query
def top_states(spark, sf):
    """Best states of a year by one subject."""
    return serving.state_page(states(spark, sf), YEAR).select("SG_UF_PROVA", METRIC).orderBy(
        F.desc(METRIC), "SG_UF_PROVA"
    ).limit(5)


@query
def adhoc_sql(spark, sf):
    states(spark, sf).createOrReplaceTempView("gold_tb_notas_geo_uf")
    return serving.run_query(
        spark,
        "SELECT ANO, max(NOTA_REDACAO_mean) AS best, sum(INSCRITOS) AS enrolled "
        "FROM gold_tb_notas_geo_uf WHERE ANO >= :first GROUP BY ANO;",
        {"first": FIRST},
    )


@query
def adhoc_sql_all(spark, sf):
    """A plain SELECT returns every row."""
    exam_rows(spark, sf, wanted=LINE_ONLY).createOrReplaceTempView("exam_rows_view")
    return serving.run_query(spark, "SELECT ID_INSCRICAO, ANO, NU_IDADE FROM exam_rows_view")


# ------------------------------------------------------------------ chart views
@query
def state_weighted(spark, sf):
    return views.state_weighted_means(states(spark, sf))


@query
def race_history(spark, sf):
    rows = serving.race_means(exam_rows(spark, sf, wanted=NO_PLACE))
    return views.race_history(rows, list(RACE_LABELS.values()), FIRST, 2003)


@query
def year_unweighted(spark, sf):
    return views.yearly_unweighted_means(states(spark, sf), FIRST, 2003)


@query
def metric_matrix(spark, sf):
    return views.metric_matrix(states(spark, sf), METRIC, FIRST, LAST)


@query
def histogram_peak(spark, sf):
    return views.mark_peak(histogram(spark, sf))


@query
def race_rank(spark, sf):
    return views.race_ranking(serving.race_means(exam_rows(spark, sf, wanted=NO_PLACE, years=(YEAR, YEAR)), YEAR))


@query
def race_rank_subject(spark, sf):
    return views.race_ranking(serving.race_means(exam_rows(spark, sf, wanted=NO_PLACE, years=(YEAR, YEAR)), YEAR), SUBJECT)


@query
def municipality_kpi(spark, sf):
    return views.town_kpis(serving.filter_towns(towns(spark, sf), names=[TOWN], min_count=0))


@query
def subject_series(spark, sf):
    evolution = serving.town_evolution(towns(spark, sf), STATE, TOWN)
    points = views.subject_series(evolution)
    return points.select("series", F.posexplode(F.arrays_zip("years", "data")).alias("pos", "p")).select(
        "series", "pos", F.col("p.years").alias("ANO"), F.col("p.data").alias("value")
    )


@query
def year_last(spark, sf):
    return views.last_row_per_year(states(spark, sf), ["SG_UF_PROVA"])


@query
def map_extent(spark, sf):
    return views.map_values(states(spark, sf), METRIC, YEAR)


@query
def map_keys(spark, sf):
    return views.map_keys(states(spark, sf), METRIC)


@query
def national_history(spark, sf):
    return views.text_years(views.history(stats(spark, sf), FIRST, LAST)).select(
        "ANO", "INSCRITOS", *[f"{s}_mean" for s in SCORES]
    )


@query
def band_total(spark, sf):
    shares = serving.band_shares(serving.state_band_counts(bands(spark, sf), STATE))
    return views.band_total(shares)


@query
def race_chart(spark, sf):
    return views.race_chart_rows(serving.race_means(exam_rows(spark, sf, wanted=NO_PLACE, years=(YEAR, YEAR)), YEAR))


@query
def year_choices(spark, sf):
    return views.year_choices(serving.years_available(stats(spark, sf)), FIRST)


@query
def default_years(spark, sf):
    return views.default_years(serving.years_available(stats(spark, sf)), FIRST)


# ------------------------------------------------------------------ quality, protection, exports
@query
def checks(spark, sf):
    return quality.run_checks(
        {
            "tb_notas_stats": stats(spark, sf),
            "tb_notas_geo_uf": states(spark, sf),
            "tb_socio_economico": boxes(spark, sf),
        }
    )


@query
def audit(spark, sf):
    rows = exam_rows(spark, sf)
    expected = ["ID_INSCRICAO", "ANO", "TP_FAIXA_ETARIA", *SCORES]
    years = rows.select(F.col("ANO").alias("ano")).distinct()
    known = years.select("ano", F.explode(F.array(*[F.lit(c) for c in expected])).alias("nome_padrao"))
    report = quality.audit_years(rows, known, "exam")
    arrays = ["missing_expected_columns", "columns_not_in_metadata", "column_sample"]
    return report.select(*[F.concat_ws(",", c).alias(c) if c in arrays else c for c in report.columns])


@query
def gate(spark, sf):
    """Checks from a file, measured while the tables are written, before anything is published."""
    folder = shared_folder(spark, "gate")
    rules = spark.createDataFrame([(quality.checks_text(quality.DASHBOARD_CHECKS),)], "value string")
    rules.coalesce(1).write.text(f"{folder}/checks")
    checks = quality.load_checks(spark, f"{folder}/checks")
    stored = lake.Lake(f"{folder}/lake").begin()
    tables = {"tb_notas_stats": stats, "tb_notas_geo_uf": states, "tb_socio_economico": boxes}
    found = [o for name, make in tables.items() for o in quality.checked_write(stored, make(spark, sf), name, checks)]
    quality.assert_outcomes(found)
    stored.commit(spark)
    return spark.createDataFrame(found, quality.OUTCOMES)


def stored_rows(rows):
    """The rows written once, for several tables made of them: the joins behind them run once."""
    path = shared_folder(rows.sparkSession, "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query
def audit_gold(spark, sf):
    """Row and column counts of every gold table of a lake."""
    stored = lake.Lake(shared_folder(spark, "lake"))
    rows = stored_rows(exam_rows(spark, sf))
    for name, df in gold_tables(rows).items():
        stored.write(df, name)
    report = quality.audit_gold(spark, stored, [*gold_tables(rows), "tb_missing"])
    table = F.substring_index("parquet_path", "/", -1).alias("parquet_path")
    return report.select("layer", table, "row_count", "column_count", "has_ano_column")


def published_lake(spark, sf):
    """A lake with every table a view is published of, but the optional town means."""
    stored = lake.Lake(shared_folder(spark, "lake")).begin()
    rows = stored_rows(exam_rows(spark, sf, keyed=True))
    stored.write(rows.drop(*ROW_KEY), "silver")
    valid = cleaning.clean(rows, PLAN, stored=True).valid.drop(*ROW_KEY)
    stored.write(valid, "cleaned")
    stored.write(classes.apply_classes(stored.read(spark, "cleaned")), "classes")
    for name, df in gold_tables(stored.read(spark, "cleaned")).items():
        stored.write(df, name)
    stored.commit(spark)
    return stored


@query
def published_views(spark, sf):
    """Rows of each published view; an optional one without its table is not there."""
    views_ = exports.publish_views(spark, published_lake(spark, sf))
    counts = [spark.table(v).groupBy().agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "n") for v in views_]
    return reduce(DataFrame.unionByName, counts)


@query
def published_columns(spark, sf):
    """Columns of the published tables, with type and order."""
    exports.publish_views(spark, published_lake(spark, sf))
    return exports.describe_tables(spark)


@query
def audit_saved(spark, sf):
    """Audit of a lake by year and table, written to the lake and read back."""
    stored = published_lake(spark, sf)
    build.audit_lake(spark, stored, exam_metadata(spark, sf), range(FIRST, LAST + 1), save_as="audit")
    report = stored.read(spark, "audit")
    table = F.substring_index("parquet_path", "/", -1).alias("parquet_path")
    missing = F.concat_ws(",", "missing_expected_columns").alias("missing_expected_columns")
    return report.select("layer", "ano", table, "row_count", "column_count", missing)


@query
def report_summary(spark, sf):
    """Report rows with a line of text that names the filters."""
    chosen = {"years": [YEAR, FIRST], "states": [STATE]}
    rows = reports.report_rows(serving.filter_towns(towns(spark, sf), **chosen))
    return rows.select("Ano", "UF", "Município", "Inscritos", F.lit(reports.filter_summary([YEAR, FIRST], [STATE])).alias("Filtros"))


@query
def mask(spark, sf):
    rows = exam_rows(spark, sf, wanted=LINE_ONLY).select(
        F.col("ID_INSCRICAO").alias("NU_INSCRICAO"), "ID_INSCRICAO", F.col("Q006").alias("email"), "ANO"
    )
    masked = reports.mask_personal(rows)
    return masked.withColumn("digest", text.mask(F.col("ID_INSCRICAO"), "hash"))


@query
def report_rows(spark, sf):
    report = reports.report_rows(serving.filter_towns(towns(spark, sf), years=[YEAR]))
    return reports.write_report(report, shared_folder(spark, "report"))


@query
def report_text(spark, sf):
    """Report numbers as text, first rows only, flagged as cut off."""
    rows = reports.report_rows(serving.filter_towns(towns(spark, sf), years=[YEAR], min_count=0))
    head = reports.head_with_flag(rows, ["UF", "Município"], 25)
    return reports.format_numbers(head.select("Ano", "UF", "Município", "Inscritos", "Provas Aplicadas", "truncated"))


@query
def export_cells(spark, sf):
    rows = exam_rows(spark, sf, wanted=NO_ORDER).select(
        "ID_INSCRICAO",
        "ANO",
        "SG_UF_PROVA",
        F.concat_ws(";", "NO_MUNICIPIO_PROVA", "TP_SEXO").alias("NO_MUNICIPIO_PROVA"),
        "TP_COR_RACA",
    )
    return exports.text_cells(rows)


@query
def export_labelled(spark, sf):
    return exports.labelled_table(serving.filter_towns(towns(spark, sf), min_count=1))


@query
def export_labelled_states(spark, sf):
    return exports.labelled_table(states(spark, sf), by_state=True)


# ------------------------------------------------------------------ files written and read back
@query
def csv_round_trip(spark, sf):
    """Raw text written as delimited files, read back and standardised."""
    from examlake.sources.raw_files import read_delimited

    folder = shared_folder(spark, "csv")
    raw = raw_text(exam_rows(spark, sf, keyed=True)).drop(*ROW_KEY)
    raw.write.options(header=True, sep=";", encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False,
                      ignoreTrailingWhiteSpace=False).csv(folder)
    return standardize.standardize(read_delimited(spark, folder), DEFAULT_YEAR)


@query
def lake_round_trip(spark, sf):
    """Written by year, one year appended a second time, two years read back with pruned columns."""
    stored = lake.Lake(shared_folder(spark, "lake"))
    rows = exam_rows(spark, sf)
    stored.write(rows, "cleaned", compact=True)
    stored.write(lake.only_years(rows, [YEAR]), "cleaned", append=True)
    found = stored.read(spark, "cleaned", ["ANO", "SG_UF_PROVA", SUBJECT])
    return lake.only_years(found, [FIRST, YEAR]).groupBy("ANO", "SG_UF_PROVA").agg(
        F.count("*").alias("n"), F.avg(SUBJECT).alias("mean")
    )


def write_raw(df, path):
    """A raw file as a folder of parts."""
    how = {"header": True, "sep": ";", "encoding": "ISO-8859-1", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.drop(*ROW_KEY).write.options(**how).csv(path)


@query
def raw_layouts(spark, sf):
    """A year in two layouts, and a year whose scores stand in a results file, by one catalog."""
    root = shared_folder(spark, "raw")
    first, later = (raw_text(exam_rows(spark, sf, keyed=True, years=(y, y))) for y in (FIRST, YEAR))
    write_raw(first.filter("l_linenumber <= 4"), f"{root}/a/DADOS/MICRODADOS_EXAM_{FIRST}.csv")
    turned = first.filter("l_linenumber > 4").drop("EXTRA_COLUMN")
    write_raw(turned.select(*reversed(turned.columns)), f"{root}/a/dados/microdados_again_{FIRST}.csv")
    scores = {RAW_LAYOUT[s]: name for s, name in zip(SCORES, RAW_SCORE_COLUMNS)}
    write_raw(later.drop(*scores), f"{root}/microdados_exam_{YEAR}.csv")
    write_raw(later.withColumnsRenamed(scores), f"{root}/b/Resultados_{YEAR}.csv")
    stored = lake.Lake(shared_folder(spark, "lake"))
    build.raw_to_silver(spark, stored, root, [FIRST, YEAR])
    return stored.read(spark, "silver").drop("_POS")


@query
def lake_rebuild(spark, sf):
    """Two years built, one of them again from fewer rows, a third stopped in the middle, then what is missing."""
    folder = shared_folder(spark, "rebuild")
    for year in (FIRST, YEAR, LAST):
        write_raw(raw_text(exam_rows(spark, sf, keyed=True, years=(year, year))), f"{folder}/raw/microdados_exam_{year}.csv")
    fewer = exam_rows(spark, sf, keyed=True, years=(YEAR, YEAR)).filter("TP_SEXO = 'F'")
    write_raw(raw_text(fewer), f"{folder}/again/microdados_exam_{YEAR}.csv")
    stored = lake.Lake(f"{folder}/lake")
    build.build_lake(spark, f"{folder}/raw", stored, [FIRST, YEAR], with_gold=False)
    build.build_lake(spark, f"{folder}/again", stored, [YEAR], with_gold=False)
    stopped = stored.begin()
    build.raw_to_silver(spark, stopped, f"{folder}/raw", [LAST])
    build.silver_to_cleaned(spark, stopped, [LAST])
    build.build_lake(spark, f"{folder}/raw", stored, [FIRST, YEAR, LAST], skip_existing=True, with_gold=False)
    tables = ["silver", "cleaned", "cleaning_duplicates", "classes"]
    counts = [stored.read(spark, t, ["ANO"]).groupBy("ANO").agg(F.count("*").alias("n")).select(F.lit(t).alias("dataset"), "ANO", "n") for t in tables]
    return reduce(DataFrame.unionByName, counts)


@query
def json_export(spark, sf):
    folder = shared_folder(spark, "json")
    page = serving.filter_towns(towns(spark, sf), min_count=1)
    exports.export_json(page, folder)
    return spark.read.schema(page.schema).json(folder)


@query
def csv_export(spark, sf):
    folder = shared_folder(spark, "export")
    page = serving.filter_towns(towns(spark, sf), min_count=1)
    exports.export_csv(page, folder)
    return spark.read.options(header=True, sep=";").schema(page.schema).csv(folder)


# ------------------------------------------------------------------ incremental
def line_stream(spark, sf):
    """The line items as a file stream, joined to the static tables.

    A pattern, because a stream takes no single file by its name; it matches a folder of part files as well.
    """
    schema = table(spark, sf, "lineitem").schema
    lines = incremental.file_stream(spark, schema, f"{sf}/lineitem.parque[t]")
    return exam_from(lines, table(spark, sf, "orders"), table(spark, sf, "supplier"))


@query
def stream_standardize(spark, sf):
    folder = shared_folder(spark, "stream-standardize")
    raw = raw_text(line_stream(spark, sf))
    incremental.stream_standardize(raw, DEFAULT_YEAR, f"{folder}/silver", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/silver")


ARRIVALS = 3


def arriving(spark, sf, folder, run):
    """The candidates in three arrivals, by part number, so that copies of an identifier come one after the other in the order
    of the row key; ``run`` is started anew on the stream after each. They arrive as files of silver rows."""
    lines = table(spark, sf, "lineitem")
    limits = lines.agg(F.min("l_partkey"), F.max("l_partkey")).first()
    step = (limits[1] - limits[0]) // ARRIVALS + 1
    for i in range(ARRIVALS):
        part = lines.filter(F.floor((F.col("l_partkey") - limits[0]) / step) == i)
        rows = exam_from(part, table(spark, sf, "orders"), table(spark, sf, "supplier"))
        rows.write.mode("append").parquet(f"{folder}/in")
        run(incremental.file_stream(spark, rows.schema, f"{folder}/in"))


@query
def stream_clean(spark, sf):
    folder = shared_folder(spark, "stream-clean")
    arriving(spark, sf, folder, lambda rows: incremental.stream_clean(rows, f"{folder}/out", f"{folder}/checkpoint", PLAN))
    return incremental.read_cleaned(spark, f"{folder}/out").drop(*ROW_KEY)


@query
def stream_clean_report(spark, sf):
    folder = shared_folder(spark, "stream-report")
    arriving(spark, sf, folder, lambda rows: incremental.stream_clean(rows, f"{folder}/out", f"{folder}/checkpoint", PLAN))
    return incremental.read_report(spark, f"{folder}/out")


@query
def stream_classes(spark, sf):
    folder = shared_folder(spark, "stream-classes")
    incremental.stream_classes(line_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select(
        "ID_INSCRICAO", "ANO", "NU_IDADE", *SCORES, *classes.CLASS_COLUMNS
    )


@query
def stream_class_summary(spark, sf):
    folder = shared_folder(spark, "stream-summary")
    arriving(spark, sf, folder, lambda rows: incremental.stream_class_summary(rows, f"{folder}/out", f"{folder}/checkpoint"))
    return incremental.read_class_summary(spark, f"{folder}/out")
