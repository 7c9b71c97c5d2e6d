"""What the document operators share: splitting text, naming rows, intermediate tables, running totals."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlake.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

# Rows of an Arrow batch that holds texts, or a number for each of their words.
TEXT_ROWS = 1_000

# A table of at most so many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def full_text(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between runs of blank characters."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def text_key(text: Column | str = "text") -> Column:
    """Tells rows with one id but different texts apart."""
    return F.xxhash64(full_text(text))


def fresh(name: str) -> str:
    """A column name no caller can have in their table."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, its size known, its lineage cut.

    ``rows``: Arrow batches have at most so many while it is written. Batches of whole texts are held by the JVM and by Python at once.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    with arrow_rows(spark, rows):
        df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows; the session's own limit holds if it is less, and again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is None or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if its counted rows allow it; else the join is the optimizer's."""
    return F.broadcast(df) if df.count() <= limit else df


def id_order(seed: int, doc_id: Column | str = "doc_id") -> Column:
    """A seeded pseudo-random place of an id in [0, 2**60), the same in every engine that has MD5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


ORDER_RANGE = 1 << 60


def running_totals(df: DataFrame, by: list[str], order: list[str], value: str, per_bucket: int = 10_000) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over rows of the same ``by`` that come earlier by ``order``.

    ``order[0]`` is an ``id_order``, so ranges of it are even: each group is cut into buckets of about
    ``per_bucket`` rows, whose sums are added up first. No task gets more than a bucket, however large a
    group is. Rows equal in all of ``order`` share one value.
    """
    place = order[0]
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))

    def with_right(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in names})
        test = F.lit(True)
        for k in names:
            test = test & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        return left.join(renamed, test, "left").drop(*[f"_right_{k}" for k in names])

    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / per_bucket).alias("_buckets"))
    cut = with_right(rows, counts, keys).withColumn(
        "_bucket", F.floor(F.col(place).cast("double") / ORDER_RANGE * F.col("_buckets"))
    ).drop("_buckets")
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    totals = with_right(cut, starts, [*keys, "_bucket"]).withColumn("_through", F.sum(value).over(inside))
    return totals.select(*df.columns, (F.col("_start") + F.col("_through") - F.col(value)).alias("before"))
