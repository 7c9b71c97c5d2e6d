"""Variable metadata: contracts, declared types, small-domain discovery."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_SCHEMA = (
    "ano int, nome_original string, nome_padrao string, descricao string, "
    "tipo_padrao string, dominio_valores array<string>"
)
# declared type name -> contract type
TYPE_NAMES = {
    "int": ["int", "int64", "int32"],
    "float": ["float", "float32", "float64"],
    "bool": ["bool", "boolean"],
    "datetime": ["datetime", "timestamp"],
}
SPARK_TYPES = {"int": "bigint", "float": "double", "bool": "boolean"}


@dataclass(frozen=True)
class ColumnContract:
    name: str
    type: str
    domain: tuple[str, ...] | None = None


def contract_type(declared: str | None) -> str:
    declared = (declared or "").lower()
    return next((t for t, names in TYPE_NAMES.items() if declared in names), "string")


def save_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metadata_for_year(metadata: DataFrame, year: int) -> DataFrame:
    return metadata.filter(F.col("ano") == year) if "ano" in metadata.columns else metadata


def build_contract(metadata: DataFrame, year: int) -> dict[str, ColumnContract]:
    """Contract of one year. Metadata has one row per variable, so it is small by nature."""
    rows = (
        metadata_for_year(metadata, year)
        .filter((F.col("nome_padrao").isNotNull()) & (F.col("nome_padrao") != ""))
        .select("nome_padrao", "tipo_padrao", "dominio_valores")
        .collect()
    )
    return {
        name: ColumnContract(name, contract_type(kind), None if domain is None else tuple(domain))
        for name, kind, domain in rows
    }


def select_known(df: DataFrame, contract: dict[str, ColumnContract]) -> DataFrame:
    """Keep the contract's columns in source order; all columns when none match."""
    known = [c for c in df.columns if c in contract]
    return df.select(*known) if known else df


def type_map(contract: dict[str, ColumnContract]) -> dict[str, str]:
    """Spark types for the contract's typed columns."""
    return {n: SPARK_TYPES[c.type] for n, c in contract.items() if c.type in SPARK_TYPES}


def apply_types(df: DataFrame, contract: dict[str, ColumnContract]) -> DataFrame:
    types = type_map(contract)
    return df.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )


def small_domains(
    df: DataFrame, columns: list[str], position: Column, max_size: int = 20
) -> DataFrame:
    """Distinct values per column in order of first appearance; null when over ``max_size``.

    Values are reduced to the first field of their first position before the shuffle, which needs no sort of the rows, and
    at most ``max_size + 1`` of them per column are ever ranked together, so a high-cardinality column costs one
    aggregation. Whole positions are compared only between rows that share the first field of a small column's value.
    """
    long = df.select(
        position.alias("_at"), *[F.col(c).cast("string").alias(c) for c in columns]
    ).unpivot(["_at"], columns, "column", "value")
    long = long.filter(F.col("value").isNotNull())
    kind = long.schema["_at"].dataType
    start = F.col("_at").getField(kind.names[0]) if isinstance(kind, T.StructType) else F.col("_at")
    first = long.groupBy("column", "value").agg(F.min(start).alias("_start"), F.bool_or(start.isNull()).alias("_null"))
    few = first.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("column").orderBy("value"))
    ).filter(F.col("_rank") <= max_size + 1)
    values = F.collect_list(F.struct(F.col("value").alias("_value"), "_start", "_null"))
    found = few.groupBy(F.col("column").alias("_column")).agg(values.alias("_values"))
    small = found.filter(F.size("_values") <= max_size).select("_column", F.inline("_values"))
    at_start = F.when(F.col("_null"), start.isNull()).otherwise(start == F.col("_start"))
    same = (F.col("column") == F.col("_column")) & (F.col("value") == F.col("_value")) & at_start
    # Of a column at most max_size rows, so the broadcast does not grow.
    places = long.join(F.broadcast(small), same).groupBy("column", "value").agg(F.min("_at").alias("_at"))
    domains = places.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]).alias("domain")
    )
    return found.join(domains, F.col("_column") == F.col("column"), "left").select(F.col("_column").alias("column"), "domain")
