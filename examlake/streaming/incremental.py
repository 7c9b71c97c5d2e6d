"""Silver, cleaned and class tables kept up to date as files arrive.

Each step is a streaming query with a checkpoint, run with ``availableNow``: it takes the files
that arrived since the last run and stops. All steps survive a restart in the middle of a batch:
file sinks commit through their own log, and ``foreachBatch`` writers own one folder per batch,
which a repeated batch overwrites.
"""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from examlake.fixed_values import CLASS_COLUMNS
from examlake.operators.classes import DEFAULT_CLASSES, ClassRule, apply_classes, class_counts, with_empty_classes
from examlake.operators.cleaning import RUNNING, VALID, VERDICT, CleaningPlan, by_verdict, flag, mark, split_repeated, unique_keys
from examlake.operators.standardize import standardize
from examlake.sources.lake import hadoop_folder
from examlake.sources.raw_files import POSITION

BATCH = "batch_id"


def file_stream(
    spark: SparkSession, schema, path: str, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """Stream over the files arriving in a folder; ``max_files`` bounds a micro-batch."""
    reader: DataStreamReader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_standardize(
    raw: DataFrame, year: int | Column, output: str, checkpoint: str, carry: tuple[str, ...] = ()
) -> None:
    """New raw rows to the silver table, partitioned by year."""
    _finish(
        standardize(raw, year, carry)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .partitionBy("ANO")
        .trigger(availableNow=True)
        .start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # Counting the keys of the store costs one more lookup for each row written to it.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
KEYS = "keys"


@contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    before = {setting: spark.conf.get(setting, None) for setting in STATE_SETTINGS}
    for setting, value in STATE_SETTINGS.items():
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value) if value else spark.conf.unset(setting)


def stream_clean(silver: DataFrame, output: str, checkpoint: str, plan: CleaningPlan = CleaningPlan()) -> None:
    """New silver rows cleaned against themselves and against all rows cleaned before.

    Writes ``valid``, ``invalid``, ``duplicates`` and ``report`` below ``output``. The keys seen so far are the state of a
    streaming aggregation that counts the valid rows of each key: a batch looks up its own keys there, whatever the size of
    the tables, and gets their running counts. A count of one is a key's only row so far, which needs no comparison, so just
    the other counts leave the query; a key whose running count exceeds its rows in the batch was seen before. Rows and
    counts leave together and are stored once (``staged``); verdicts, repairs and the four tables are made of the
    stored rows, of which only those whose key may have such a count are shuffled and compared
    (``split_repeated``). A repeated batch starts from the same state and replaces its folders.
    """
    spark = silver.sparkSession
    flagged = flag(silver, plan)
    keys = unique_keys(flagged, plan)
    both = flagged.withColumn(RUNNING, F.lit(None).cast("bigint"))
    if keys:
        counts = flagged.filter(F.col(VERDICT) == VALID).groupBy(*keys).agg(F.count("*").alias(RUNNING))
        repeated = counts.filter(F.col(RUNNING) > 1).withColumn(VERDICT, F.lit(KEYS))
        both = both.unionByName(repeated, allowMissingColumns=True)
    by_year = ["ANO"] if "ANO" in unique_keys(flagged, plan) else []

    def clean_batch(batch: DataFrame, batch_id: int) -> None:
        staged = f"{output}/staged"
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(VERDICT).parquet(staged)
        stored = spark.read.schema(both.schema).parquet(staged)
        rows = stored.filter(F.col(VERDICT) != KEYS).select(*flagged.columns)
        compared = rows.limit(0)
        if keys:
            running = stored.filter(F.col(VERDICT) == KEYS)
            valid, hashes = rows.filter(F.col(VERDICT) == VALID), running.select(F.xxhash64(*keys).alias("_hash"))
            single, compared = split_repeated(valid, keys, hashes)
            rows = rows.filter(F.col(VERDICT) != VALID).unionByName(single)
            running = running.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], RUNNING)
            compared = mark(compared, plan, running).persist()
        try:
            alone = mark(rows, replace(plan, keys=()))
            marked = alone.unionByName(compared) if keys else alone
            for name, table in by_verdict(marked, plan)._asdict().items():
                out = table.drop(POSITION).write.mode("overwrite").option("partitionOverwriteMode", "static")
                if name == "valid" and by_year:
                    out = out.partitionBy(*by_year)
                out.parquet(f"{output}/{name}/{BATCH}={batch_id}")
        finally:
            compared.unpersist()

    with on_disk_state(spark):
        query = silver_query(both, clean_batch, checkpoint)
    _finish(query)


def silver_query(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_cleaned(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/valid").drop(BATCH)


def read_report(spark: SparkSession, output: str) -> DataFrame:
    """Report summed over the batches."""
    report = spark.read.parquet(f"{output}/report").drop(BATCH)
    by = [c for c in report.columns if c != "affected_rows"]
    return report.groupBy(*by).agg(F.sum("affected_rows").alias("affected_rows"))


def stream_classes(
    cleaned: DataFrame,
    output: str,
    checkpoint: str,
    rules: Sequence[ClassRule] = DEFAULT_CLASSES,
) -> None:
    """New cleaned rows with their class columns, appended to the class table."""
    _finish(
        apply_classes(cleaned, rules)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_class_summary(
    cleaned: DataFrame,
    output: str,
    checkpoint: str,
    rules: Sequence[ClassRule] = DEFAULT_CLASSES,
    columns: Sequence[str] = CLASS_COLUMNS,
) -> None:
    """Running class counts, age classes listed even when empty. The state holds one number per class value.

    Every batch writes a version of its own; ``read_class_summary`` reads the last whole one, and the version
    before stays for readers that have opened it.
    """
    spark = cleaned.sparkSession

    def publish(counts: DataFrame, batch_id: int) -> None:
        with_empty_classes(counts, columns).write.mode("overwrite").parquet(f"{output}/{BATCH}={batch_id}")
        fs, folder = hadoop_folder(spark, output)
        for version in published_versions(spark, output)[:-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{BATCH}={version}"), True)

    counts = class_counts(apply_classes(cleaned, rules), columns)
    _finish(
        counts.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def published_versions(spark: SparkSession, output: str) -> list[int]:
    """Numbers of the wholly written versions, in order."""
    fs, folder = hadoop_folder(spark, output)
    if not fs.exists(folder):
        return []
    found = [e.getPath() for e in fs.listStatus(folder) if e.getPath().getName().startswith(f"{BATCH}=")]
    whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix(f"{BATCH}=")) for p in whole)


def read_class_summary(spark: SparkSession, output: str) -> DataFrame:
    """The last whole version of the running summary."""
    versions = published_versions(spark, output)
    if not versions:
        raise FileNotFoundError(f"no class summary below {output}")
    return spark.read.parquet(f"{output}/{BATCH}={versions[-1]}")
