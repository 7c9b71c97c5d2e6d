"""Exports: delimited text, JSON lines, label-headed tables, published views and tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.fixed_values import TABLE_SCORE_HEADERS
from examlake.functions.text import one_decimal
from examlake.sources.lake import Lake

# view name -> (table, whether publishing may skip it when the table is missing)
PUBLISHED_VIEWS = {
    "silver_microdados": ("silver", False),
    "gold_cleaned": ("cleaned", False),
    "gold_classes": ("classes", False),
    "gold_tb_notas": ("tb_notas", False),
    "gold_tb_notas_stats": ("tb_notas_stats", False),
    "gold_tb_notas_geo": ("tb_notas_geo", False),
    "gold_tb_notas_geo_uf": ("tb_notas_geo_uf", False),
    "gold_tb_notas_histogram": ("tb_notas_histogram", False),
    "gold_tb_socio_economico": ("tb_socio_economico", True),
    "gold_tb_media_uf": ("tb_media_uf", True),
    "gold_tb_media_municipal": ("tb_media_municipal", True),
    "dim_municipio": ("dim_municipio", True),
}
DASHBOARD_TABLES = [
    "tb_notas_stats",
    "tb_notas_geo",
    "tb_notas_geo_uf",
    "tb_notas_histogram",
    "tb_socio_economico",
    "tb_media_uf",
]


def text_cells(df: DataFrame, sep: str = ";") -> DataFrame:
    """Every column as text, with the separator inside values replaced and null left empty."""
    return df.select(
        *[
            F.coalesce(F.replace(F.col(c).cast("string"), F.lit(sep), F.lit(",")), F.lit("")).alias(c)
            for c in df.columns
        ]
    )


def export_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited files with a header. Written by all tasks in parallel, in the frame's order."""
    (
        text_cells(df, sep)
        .write.mode("overwrite")
        .options(header=True, sep=sep, quote="", emptyValue="", nullValue="")
        .csv(path)
    )


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def labelled_table(df: DataFrame, by_state: bool = False) -> DataFrame:
    """Display headers and one-decimal scores, for the municipality or the state table."""
    keys = (
        {"ANO": "Ano", "SG_UF_PROVA": "UF", "INSCRITOS": "Inscritos"}
        if by_state
        else {"ANO": "Ano", "SG_UF_PROVA": "UF", "NO_MUNICIPIO_PROVA": "Município"}
    )
    return df.select(
        *[F.col(c).alias(label) for c, label in keys.items()],
        *[
            F.coalesce(one_decimal(F.col(c)), F.lit("")).alias(label)
            for c, label in TABLE_SCORE_HEADERS.items()
        ],
    )


def export_labelled_csv(df: DataFrame, path: str, by_state: bool = False) -> None:
    text = labelled_table(df, by_state)
    text = text.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in text.columns])
    text.write.mode("overwrite").options(
        header=True, sep=";", quoteAll=True, escape='"', emptyValue="", encoding="UTF-8"
    ).csv(path)


def publish_views(spark: SparkSession, lake: Lake) -> list[str]:
    """Register a view per lake table; returns the names, raises if a required table is absent."""
    published = []
    for view, (table, optional) in PUBLISHED_VIEWS.items():
        if not lake.exists(spark, table):
            if optional:
                continue
            raise FileNotFoundError(f"view {view} needs {lake.path(table)}")
        lake.read(spark, table).createOrReplaceTempView(view)
        published.append(view)
    return published


def materialize_tables(spark: SparkSession) -> list[str]:
    """Copy the dashboard views into tables of the session catalog."""
    for table in DASHBOARD_TABLES:
        spark.table(f"gold_{table}").write.mode("overwrite").saveAsTable(table)
    return DASHBOARD_TABLES


def describe_tables(
    spark: SparkSession,
    tables: tuple[str, ...] = (
        "gold_tb_notas_stats",
        "gold_tb_notas_geo",
        "gold_tb_notas_geo_uf",
        "gold_tb_notas_histogram",
    ),
) -> DataFrame:
    """Table, column, type and column order of the published tables that exist."""
    rows = [
        (name, field.name, field.dataType.simpleString(), position)
        for name in tables
        if spark.catalog.tableExists(name)
        for position, field in enumerate(spark.table(name).schema)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, column_type string, position int"
    )
