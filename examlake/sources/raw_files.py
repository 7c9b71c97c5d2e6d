"""Raw year files: finding them, reading delimited text, choosing the file that has scores."""

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlake.fixed_values import MISSING_MARKERS, RAW_SCORE_COLUMNS

CORRUPT = "_corrupt_record"
POSITION = "_POS"
YEAR_IN_PATH = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"


def header_columns(
    spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "ISO-8859-1"
) -> list[str]:
    """Column names from the first line of the file; reads nothing else."""
    return (
        spark.read.options(header=True, sep=sep, encoding=encoding, escape='"', inferSchema=False)
        .csv(path)
        .columns
    )


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    columns: list[str] | None = None,
    missing: list[str] = MISSING_MARKERS,
    position: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header, every column read as text.

    Lines with more fields than the header are dropped, shorter lines are padded with nulls and
    undecodable bytes replaced. ``position`` adds where each row stood (file, split offset, row),
    which later decides which copy of a duplicated row came first. Files stay splittable unless
    ``multi_line`` is set for quoted line breaks. Lines are always parsed whole: with pruned
    columns the parser no longer sees that a line is too long.
    """
    names = header_columns(spark, path, sep, encoding)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = (
        spark.read.options(
            header=True,
            sep=sep,
            encoding=encoding,
            escape='"',
            mode="PERMISSIVE",
            multiLine=multi_line,
            enforceSchema=True,
            columnPruning=False,
            columnNameOfCorruptRecord=CORRUPT,
        )
        .schema(schema)
        .csv(path)
    )
    # A flagged line is either too long or too short; separators inside quotes do not count. The
    # first column is named because Spark refuses to count rows by the corrupt text alone.
    line = F.coalesce(F.col(CORRUPT), F.col(f"`{names[0]}`"))
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    raw = raw.filter(F.col(CORRUPT).isNull() | (fields <= len(names)))
    kept = [n for n in names if columns is None or n in columns]
    out = [F.when(~F.col(f"`{n}`").isin(missing), F.col(f"`{n}`")).alias(n) for n in kept]
    if position:
        out.append(file_position().alias(POSITION))
    return raw.select(*out)


def file_position() -> Column:
    """Order of a text row in its source: file, byte offset of the split, running row number."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def parquet_position() -> Column:
    """Order of a Parquet row in its source: file and row index."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )


MAIN, RESULTS = "microdados_*_{year}.csv", "resultados_{year}.csv"
HEADER_BYTES = 1 << 16
READERS = 16  # headers read at a time


@dataclass(frozen=True)
class RawFile:
    """A delimited file, or a folder of part files under a file's name, with the columns of its header."""

    path: str
    name: str
    columns: tuple[str, ...] = ()

    def has(self, wanted: Sequence[str]) -> bool:
        return set(wanted) <= set(self.columns)


def list_files(spark: SparkSession, root: str) -> dict[str, str]:
    """Every data file below ``root`` and the file or folder of parts it belongs to, from one recursive listing.

    A folder whose name ends like a file's (``x_2019.csv/part-0``) is one file. Hidden files are left out.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    top = fs.makeQualified(folder).toString().rstrip("/")
    files, found = fs.listFiles(folder, True), {}
    while files.hasNext():
        path = files.next().getPath().toString()
        parts = path.removeprefix(top).split("/")
        if parts[-1].startswith(("_", ".")):
            continue
        named = next((i for i, x in enumerate(parts) if x.lower().endswith(".csv")), len(parts) - 1)
        found[path] = top + "/".join(parts[: named + 1])
    return dict(sorted(found.items()))


def first_line(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> str:
    """The first line of a file by one read of its first bytes, through Spark's file systems and without a job."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEADER_BYTES)))
    finally:
        stream.close()
    return re.split(r"\r\n|\r|\n", data.decode(encoding, "replace"), maxsplit=1)[0]


def catalog(spark: SparkSession, root: str, encoding: str = "ISO-8859-1", sep: str = ";", wanted: str = r".*\.csv") -> list[RawFile]:
    """The raw files below ``root`` whose name matches ``wanted`` in any letter case, with their headers.

    One listing and a read of the first bytes of each file, side by side; no Spark job. A file that stands in two folders under
    one name is refused, as nobody can say which of them holds the rows.
    """
    by_path: dict[str, str] = {}
    for file, whole in list_files(spark, root).items():
        if re.fullmatch(wanted, whole.rsplit("/", 1)[1], re.IGNORECASE):
            by_path.setdefault(whole, file)
    named = defaultdict(list)
    for path in by_path:
        named[path.rsplit("/", 1)[1].lower()].append(path)
    twice = [paths for paths in named.values() if len(paths) > 1]
    if twice:
        raise ValueError(f"the same raw file in several places: {twice}")

    def header(path: str) -> RawFile:
        line = first_line(spark, by_path[path], encoding).removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf")
        columns = next(csv.reader([line], delimiter=sep), [])
        if "" in columns or len({c.lower() for c in columns}) < len(columns):
            columns = header_columns(spark, path, sep, encoding)  # Spark names blank and repeated columns
        return RawFile(path, path.rsplit("/", 1)[1], tuple(columns))

    with ThreadPoolExecutor(READERS) as pool:
        return list(pool.map(header, by_path))


def glob_pattern(name: str, year: int) -> str:
    return re.escape(name.format(year=year)).replace(r"\*", ".*")


def files_of_year(files: Sequence[RawFile], year: int, root: str, main: str = MAIN, results: str = RESULTS) -> list[RawFile]:
    """The files holding a year's rows: the main files, or the results files when only those
    carry the score columns."""

    def named(pattern: str) -> list[RawFile]:
        return [f for f in files if re.fullmatch(glob_pattern(pattern, year), f.name, re.IGNORECASE)]

    def scored(found: list[RawFile]) -> bool:
        return any(f.has(RAW_SCORE_COLUMNS) for f in found)

    main_files, result_files = named(main), named(results)
    if not scored(main_files) and scored(result_files):
        return result_files
    if not main_files:
        raise FileNotFoundError(f"no raw file for {year} below {root}")
    return main_files


def find_files(spark: SparkSession, root: str, name: str) -> list[str]:
    """Files below ``root`` whose name equals ``name`` in any letter case (globs allowed)."""
    pattern = re.escape(name).replace(r"\*", ".*")
    found = set(list_files(spark, root).values())
    return sorted(p for p in found if re.fullmatch(pattern, p.rsplit("/", 1)[1], re.IGNORECASE))


def year_files(spark: SparkSession, root: str, year: int, main: str = MAIN, results: str = RESULTS) -> list[str]:
    """Paths of the files holding a year's rows (``files_of_year`` over a catalog of that year)."""
    names = "|".join(glob_pattern(n, year) for n in (main, results))
    return [f.path for f in files_of_year(catalog(spark, root, wanted=names), year, root, main, results)]


def year_from_path(path: Column | None = None) -> Column:
    """Year written in a file's name (or the name of its folder of parts), else in its folders."""
    path = F.col("_metadata.file_path") if path is None else path
    # Only the last two names can match; on a whole path the pattern would be tried at every character.
    name = F.regexp_extract(F.substring_index(path, "/", -2), r"(?i)([^/]*\.csv)(?:/[^/]*)?$", 1)
    found = [F.regexp_extract(text, YEAR_IN_PATH, 1).try_cast("int") for text in (name, F.substring_index(path, "/", -1), path)]
    return F.coalesce(*found)
