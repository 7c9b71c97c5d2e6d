"""Lake datasets: Parquet folders that a log of snapshots brings to life."""

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlake.fixed_values import FIRST_YEAR, LAST_YEAR
from examlake.sources.raw_files import POSITION, parquet_position

FACT_TABLES = ["silver", "cleaned", "classes"]
LOG, WRITE = "_log", "_WRITE"
NO_YEAR = ""  # the only part of a table that is not partitioned


def hadoop_folder(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop objects."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def folder_names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = hadoop_folder(spark, path)
    return sorted(e.getPath().getName() for e in fs.listStatus(folder)) if fs.exists(folder) else []


class ConcurrentCommit(RuntimeError):
    """Another writer changed one of the same tables first."""


@dataclass
class Lake:
    """A lake below a root folder. Row-level tables are partitioned by year, so year filters prune folders.

    Data is never changed in place: each write makes a folder of its own (``table/_WRITE=...``), which nobody reads until a
    snapshot in ``_log`` names it. A snapshot lists the live folders of every table by year and the years whose build is
    complete. It is published by one rename that fails if the version exists, so readers see all of a commit or
    nothing, and a writer that stops leaves only folders that ``vacuum`` removes. The rename must be atomic in the store
    (HDFS and local file systems are; plain object stores need a committer that makes it so).

    ``Lake(root)`` commits each write by itself. ``begin()`` gives a lake that reads its own writes and publishes them together
    with ``commit``. A folder ``table`` written by others, without any snapshot, is read as it is.
    """

    root: str
    pending: dict | None = field(default=None, compare=False)

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # -------------------------------------------------------------- snapshots
    def versions(self, spark: SparkSession) -> list[int]:
        names = folder_names(spark, self.path(LOG))
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]

    def snapshot(self, spark: SparkSession, version: int | None = None) -> dict:
        """The tables and complete years of a version, the last by default."""
        if version is None:
            version = max(self.versions(spark), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "complete": []}
        fs, file = hadoop_folder(spark, f"{self.path(LOG)}/{version:012d}.json")
        stream = fs.open(file)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _tables(self, spark: SparkSession, version: int | None = None) -> dict:
        return {**self.snapshot(spark, version)["tables"], **(self.pending or {}).get("tables", {})}

    def begin(self) -> "Lake":
        """The same lake for several writes that become visible together."""
        return Lake(self.root, {"tables": {}, "complete": set(), "base": {}})

    def complete_years(self, spark: SparkSession) -> list[int]:
        """Years whose whole build was committed."""
        return sorted(self.snapshot(spark)["complete"])

    def mark_complete(self, years: Iterable[int]) -> None:
        """Years to call complete with the commit of this lake's writes."""
        self.pending["complete"] |= set(years)

    def commit(self, spark: SparkSession) -> int:
        """Publish the pending writes as the next version."""
        while True:
            last = self.snapshot(spark)
            for table, base in self.pending["base"].items():
                if last["tables"].get(table) != base:
                    raise ConcurrentCommit(f"{table} was changed by another writer")
            following = {
                "version": last["version"] + 1,
                "tables": {**last["tables"], **self.pending["tables"]},
                "complete": sorted({*last["complete"], *self.pending["complete"]}),
            }
            if self._publish(spark, following):
                self.pending = {"tables": {}, "complete": set(), "base": {}}
                return following["version"]

    def _publish(self, spark: SparkSession, snapshot: dict) -> bool:
        """Write the snapshot aside and rename it to its version; False if that version has come meanwhile."""
        fs, log = hadoop_folder(spark, self.path(LOG))
        fs.mkdirs(log)
        hadoop = spark._jvm.org.apache.hadoop.fs
        aside, final = (hadoop.Path(log, n) for n in (f".{uuid.uuid4().hex}", f"{snapshot['version']:012d}.json"))
        stream = fs.create(aside, False)
        stream.write(json.dumps(snapshot).encode())
        stream.close()
        never_over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never_over[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(log.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, final, never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.toString():
                raise
            fs.delete(aside, False)
            return False
        return True

    def vacuum(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Remove write folders that none of the last ``keep`` snapshots names. Only while nobody writes."""
        live = {
            "/".join(folder.split("/")[:2])
            for version in self.versions(spark)[-keep:]
            for entry in self.snapshot(spark, version)["tables"].values()
            for folders in entry["parts"].values()
            for folder in folders
        }
        gone = []
        for table in folder_names(spark, self.root):
            for name in folder_names(spark, self.path(table)) if table != LOG else []:
                if name.startswith(f"{WRITE}=") and f"{table}/{name}" not in live:
                    fs, folder = hadoop_folder(spark, self.path(f"{table}/{name}"))
                    fs.delete(folder, True)
                    gone.append(f"{table}/{name}")
        return gone

    # -------------------------------------------------------------- tables
    def read(
        self,
        spark: SparkSession,
        table: str,
        columns: list[str] | None = None,
        position: bool = False,
        merge_schema: bool = False,
        version: int | None = None,
    ) -> DataFrame:
        """Read a table. ``merge_schema`` opens every file's footer, so it is only for datasets
        written by different versions of a schema."""
        entry = self._tables(spark, version).get(table)
        if entry is None:
            df, names = spark.read.option("mergeSchema", merge_schema).parquet(self.path(table)), None
        else:
            schema = T.StructType.fromJson(json.loads(entry["schema"]))
            names, folders = schema.names, [self.path(f) for part in entry["parts"].values() for f in part]
            if not folders:
                return spark.createDataFrame([], schema).select(*(names if columns is None else columns))
            reader = spark.read.option("basePath", self.path(entry["base"])).option("mergeSchema", merge_schema)
            if not merge_schema:
                hidden = [n for n in entry["hidden"] if n not in names]
                reader = reader.schema(T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in hidden]]))
            df = reader.parquet(*folders)
            if merge_schema:
                names = [c for c in df.columns if c not in entry["hidden"]]
        if position:
            df = df.withColumn(POSITION, parquet_position())
            names = names and [*[n for n in names if n != POSITION], POSITION]
        names = names if columns is None else columns
        return df if names is None else df.select(*names)

    def write(
        self,
        df: DataFrame,
        table: str,
        *,
        append: bool = False,
        partition_by: list[str] | None = None,
        compact: bool = False,
        years: Sequence[int] | None = None,
    ) -> None:
        """Write a table. Overwriting replaces the years present in ``df``, and all of ``years``: those without a row are gone.

        ``compact`` adds a rebalancing shuffle on the partition columns. It evens out file sizes
        (a hot year is split, not funnelled into one task) after a wide shuffle has mixed years.
        """
        if partition_by is None:
            partition_by = ["ANO"] if table in FACT_TABLES else []
        self._write(df, table, {None: table}, partition_by, append, compact, years)

    def write_split(
        self,
        df: DataFrame,
        folder: str,
        by: str,
        tables: dict[str, str],
        *,
        hide: Sequence[str] = (),
        compact: bool = False,
        years: Sequence[int] | None = None,
    ) -> str:
        """One write of ``df``, in folders by the text column ``by`` and year, as several tables: those of each of its values.

        The tables do not show the columns ``hide``. Returns the folder, where all of it can be read.
        """
        return self._write(df, folder, tables, [by, "ANO"], False, compact, years, hide)

    def _write(self, df, folder, tables, partition_by, append, compact, years, hide=()) -> str:
        if compact and partition_by:
            df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        write = f"{WRITE}=w{uuid.uuid4().hex[:16]}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(self.path(f"{folder}/{write}"))
        spark, own = df.sparkSession, self if self.pending is not None else self.begin()
        for value, table in tables.items():
            at = f"{folder}/{write}" if value is None else f"{folder}/{write}/{partition_by[0]}={value}"
            inside = partition_by if value is None else partition_by[1:]
            found = [n for n in folder_names(spark, self.path(at)) if "=" in n] if inside else []
            parts = {n.partition("=")[2]: [f"{at}/{n}"] for n in found} if inside else {NO_YEAR: [at]}
            last = own._tables(spark).get(table)
            old = last["parts"] if last else {}
            if append:
                parts = {k: old.get(k, []) + parts.get(k, []) for k in [*old, *[k for k in parts if k not in old]]}
            elif inside:
                parts = {k: v for k, v in old.items() if k not in parts and k not in {str(y) for y in years or ()}} | parts
            hidden = [WRITE] if value is None else [WRITE, partition_by[0]]
            fields = [f for f in df.schema.fields if f.name not in {*hidden, *inside, *hide}]
            schema = T.StructType([*fields, *[df.schema[c] for c in inside]])
            own.pending["base"].setdefault(table, self.snapshot(spark)["tables"].get(table))
            own.pending["tables"][table] = {"base": folder, "schema": schema.json(), "hidden": hidden, "parts": parts}
        if own is not self:
            own.commit(spark)
        return self.path(f"{folder}/{write}")

    def exists(self, spark: SparkSession, table: str) -> bool:
        if table in self._tables(spark):
            return True
        fs, folder = hadoop_folder(spark, self.path(table))
        return fs.exists(folder) and any(not n.startswith(f"{WRITE}=") for n in folder_names(spark, self.path(table)))

    def years(self, spark: SparkSession, table: str) -> list[int]:
        """Years present, from the snapshot alone."""
        entry = self._tables(spark).get(table)
        names = list(entry["parts"]) if entry else [n[4:] for n in folder_names(spark, self.path(table)) if n.startswith("ANO=")]
        return sorted(int(n) for n in names if n.isdigit())


def select_years(
    years: list[int] | None = None,
    year: int | None = None,
    start: int | None = None,
    end: int | None = None,
    known: range = range(FIRST_YEAR, LAST_YEAR + 1),
) -> list[int]:
    """Requested years: an explicit list, one year, an open range, or all known years."""
    if years:
        return sorted(set(years))
    if year is not None:
        return [year]
    first = known[0] if start is None else start
    last = known[-1] if end is None else end
    return [y for y in known if first <= y <= last]


def only_years(df: DataFrame, years: list[int], column: str = "ANO") -> DataFrame:
    """Filter on the partition column, so other years' files are never opened."""
    return df.filter(F.col(column).isin(years))


def missing_years(requested: DataFrame, existing: DataFrame, column: str = "ANO") -> DataFrame:
    """Requested years that have no rows yet."""
    return requested.join(existing.select(column).distinct(), column, "left_anti")
