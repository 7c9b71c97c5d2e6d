"""The exam tables derived from the order tables that queries are checked on.

A line item plays a candidate, its order supplies one score and its supplier the place. The same
projection is written once for Spark (here) and once in SQL (``oracle``).
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.fixed_values import SCORES, UF_BY_CODE
from examlake.functions.numeric import lookup
from examlake.operators.cleaning import keep_first

# Total order over the rows, deciding which copy of an identifier is first.
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
EXAM_COLUMNS = [
    "ID_INSCRICAO", "ANO", "SG_UF_PROVA", "CO_MUNICIPIO_PROVA", "NO_MUNICIPIO_PROVA", "TP_SEXO",
    "TP_COR_RACA", "NU_IDADE", "Q006", "RENDA_FAMILIAR", "TP_PRESENCA_CN", "TP_PRESENCA_CH",
    "TP_PRESENCA_LC", "TP_PRESENCA_MT", "TP_STATUS_REDACAO", *SCORES,
]

# What each joined table gives.
FROM_SUPPLIER = ["SG_UF_PROVA", "CO_MUNICIPIO_PROVA"]
FROM_ORDERS = ["NOTA_MATEMATICA"]
NO_PLACE = [c for c in EXAM_COLUMNS if c not in FROM_SUPPLIER]
NO_ORDER = [c for c in EXAM_COLUMNS if c not in FROM_ORDERS]
LINE_ONLY = [c for c in NO_PLACE if c not in FROM_ORDERS]


def _letter(letters: str, index: Column) -> Column:
    return F.substring(F.lit(letters), index.cast("int") + 1, F.lit(1))


def _absent_when_divisible(by: int) -> Column:
    return F.when(F.col("l_partkey") % by == 0, 0).otherwise(1)


def exam_from(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, wanted: Sequence[str] = EXAM_COLUMNS, carry: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Line items (batch or stream) as candidates with the ``wanted`` columns, row key (or other columns to ``carry``) included.

    A table is joined only if a wanted column reads it: Spark cannot know that its key is unique, so it would keep
    the join. Both joins keep every line item. They are plain equi-joins: the optimizer broadcasts a side
    only when its measured size allows, and splits skewed keys otherwise.
    """
    uf_code = F.col("s_nationkey") + 10
    rows = lineitem
    if set(wanted) & set(FROM_SUPPLIER):
        rows = rows.join(
            supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
        )
    if set(wanted) & set(FROM_ORDERS):
        rows = rows.join(
            orders.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"), "left"
        )
    score_lc = F.when(F.col("l_partkey") % 23 != 0, F.round(F.col("l_discount") * 10000, 2))
    place = F.when(F.col("l_linenumber") <= 4, "São Tomé d'Oeste ").otherwise("Sao Tome d'Oeste ")
    columns = {
        "ID_INSCRICAO": F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")),
        "ANO": F.year("l_shipdate"),
        "SG_UF_PROVA": lookup(UF_BY_CODE, uf_code),
        "CO_MUNICIPIO_PROVA": uf_code.cast("bigint") * 100000 + F.col("l_suppkey"),
        "NO_MUNICIPIO_PROVA": F.concat(place, F.col("l_suppkey").cast("string")),
        "TP_SEXO": F.when(F.col("l_linestatus") == "F", "F").otherwise("M"),
        "TP_COR_RACA": F.when(F.col("l_partkey") % 50 != 0, F.col("l_linenumber") - 1),
        "NU_IDADE": (F.col("l_quantity") + 5).cast("int"),
        "Q006": _letter("ABCDEFGHIJKLMNOPQRST", F.col("l_partkey") % 20),
        "RENDA_FAMILIAR": _letter("ABCZ", F.col("l_partkey") % 4),
        "TP_PRESENCA_CN": _absent_when_divisible(11),
        "TP_PRESENCA_CH": _absent_when_divisible(13),
        "TP_PRESENCA_LC": _absent_when_divisible(17),
        "TP_PRESENCA_MT": _absent_when_divisible(19),
        "TP_STATUS_REDACAO": F.when(F.col("l_suppkey") % 9 == 0, 4).otherwise(1),
        "NOTA_CIENCIAS_NATUREZA": F.col("l_extendedprice") / F.lit(99.7),
        "NOTA_CIENCIAS_HUMANAS": F.col("l_quantity") * 20,
        "NOTA_LINGUAGENS_CODIGOS": score_lc,
        "NOTA_MATEMATICA": F.col("o_totalprice") / F.lit(499.3),
        "NOTA_REDACAO": F.round(F.col("l_tax") * 10000, 2),
    }
    return rows.select(*[columns[c].alias(c) for c in wanted], *carry)


def first_lines(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line items that hold the first row of a key, found before the columns that no key needs are joined and derived.

    Repeated rows of a joined table may give a key more than one first row here.
    """
    keys = [k for k in keys if k in EXAM_COLUMNS]
    return keep_first(exam_from(lineitem, orders, supplier, keys, lineitem.columns), keys, ROW_KEY).select(*lineitem.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exam_rows(
    spark: SparkSession,
    sf_dir: str,
    keyed: bool = False,
    wanted: Sequence[str] = EXAM_COLUMNS,
    years: tuple[int, int] | None = None,
    first_of: Sequence[str] = (),
) -> DataFrame:
    """Candidates of the batch tables with the ``wanted`` columns; ``keyed`` keeps the row key.

    ``first_of``: for a caller that keeps the first row per key, only line items that hold one.
    ``years``, the first and the last, become a range of dates, which reaches the scan as a derived year would not.
    """
    lines = table(spark, sf_dir, "lineitem")
    if years is not None:
        kind = lines.schema["l_shipdate"].dataType
        low, high = (F.lit(f"{y}-01-01").cast(kind) for y in (years[0], years[1] + 1))
        lines = lines.filter((F.col("l_shipdate") >= low) & (F.col("l_shipdate") < high))
    orders, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    if first_of:
        lines = first_lines(lines, orders, supplier, first_of)
    rows = exam_from(lines, orders, supplier, wanted)
    return rows if keyed else rows.drop(*ROW_KEY)


# Text layout of the raw rows: canonical column -> (name in the raw file, how it is written there)
RAW_LAYOUT = {
    "ID_INSCRICAO": "NU_INSCRICAO",
    "ANO": "NU_ANO",
    "SG_UF_PROVA": "UF_PROVA",
    "CO_MUNICIPIO_PROVA": "CO_MUNICIPIO_RESIDENCIA",
    "NO_MUNICIPIO_PROVA": "MUNICIPIO_PROVA",
    "TP_SEXO": "SEXO",
    "TP_COR_RACA": "TP_ETNIA",
    "NU_IDADE": "IDADE",
    "Q006": "Q06",
    "TP_PRESENCA_CN": "TP_PRESENCA_CN",
    "TP_PRESENCA_CH": "TP_PRESENCA_CH",
    "TP_PRESENCA_LC": "TP_PRESENCA_LC",
    "TP_PRESENCA_MT": "TP_PRESENCA_MT",
    "TP_STATUS_REDACAO": "TP_STATUS_REDACAO",
    "NOTA_CIENCIAS_NATUREZA": "NT_CN",
    "NOTA_CIENCIAS_HUMANAS": "NU_NOTA_CH",
    "NOTA_LINGUAGENS_CODIGOS": "NOTA_LC",
    "NOTA_MATEMATICA": "NOTA_MT",
    "NOTA_REDACAO": "NU_NOTA_COMP5",
}


def raw_text(rows: DataFrame) -> DataFrame:
    """Candidates as the text of a raw year file: other names, padding, lower case, decimal commas.

    Every 29th part has no year, and an unknown column is added, to be dropped again.
    """

    def written(column: str) -> Column:
        c = F.col(column).cast("string")
        if column in SCORES:
            return F.replace(c, F.lit("."), F.lit(","))
        if column in ("SG_UF_PROVA", "TP_SEXO"):
            return F.concat(F.lit(" "), F.lower(c))
        if column == "ID_INSCRICAO":
            return F.concat(F.lit("  "), c, F.lit(" "))
        if column == "TP_COR_RACA":
            return F.concat(c, F.lit(",0"))
        if column == "ANO":
            return F.when(F.col("l_partkey") % 29 != 0, c)
        return c

    return rows.select(
        *[written(c).alias(name) for c, name in RAW_LAYOUT.items()],
        F.lit("x").alias("EXTRA_COLUMN"),
        *ROW_KEY,
    )
