"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches, those with the largest ids first. A batch's line hashes are anti-joined with the runs: new
ones become a run of their own, known ones are counted as sightings. Runs of a level are merged
into one of the next as soon as there are ``fanout`` of them. Runs are bucketed and sorted by hash, so the joins read
them without a shuffle.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm.common import BLANKS, ascii_lower, fresh, full_text, small, stored, text_key
from examlake.session import shared_folder

LEAST_CHARS, LEAST_DOCS = 20, 3
HASH = ["h1", "h2"]  # 128 bits


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, ASCII-lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text_key, at, h1, h2`` of every line whose key has ``least_chars`` code points."""
    lines = docs.select("doc_id", text_key().alias("text_key"), F.posexplode_outer(F.split(full_text(), "\n", -1)).alias("at", "line"))
    keyed = lines.select("doc_id", "text_key", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return keyed.select("doc_id", "text_key", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """A log-structured set of line hashes with, for each, its documents when it was first met and the largest id."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.name = shared_folder(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.sightings: list[DataFrame] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def _known(self) -> DataFrame | None:
        runs, known = self.runs(), None
        for r in runs:
            known = r if known is None else known.unionByName(r)
        return known

    def add(self, hashes: DataFrame) -> None:
        """Take in a batch of ``doc_id, h1, h2``: merge-anti-join the runs, add a run of what is new."""
        own = stored(
            hashes.groupBy(*HASH, "doc_id").agg(F.lit(1).alias("one")).groupBy(*HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")),
            "line-batch",
        )
        new = own
        for run in self.runs():  # one merge join per run; there are about log(batches) of them
            new = new.join(run, HASH, "left_anti")
            self.sightings.append(own.join(run, HASH, "left_semi"))
        self._place(0, self._write(new.repartition(self.buckets, *HASH)))

    def _place(self, level: int, run: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for n in self.levels[level]:
                t = self.spark.table(n)
                merged = t if merged is None else merged.unionByName(t)
            # A run holds only hashes that earlier runs lack, so a merge adds nothing up.
            self.levels[level] = []
            self._place(level + 1, self._write(merged.repartition(self.buckets, *HASH)))

    def totals(self) -> DataFrame:
        """``h1, h2, n, owner``: documents of each line over all batches, and the largest id."""
        parts = self._known()
        for s in self.sightings:
            parts = parts.unionByName(s)
        return parts.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))


def repeated_lines(docs: DataFrame, batches: int = 4, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, text_key, drop``: the places of lines to drop, for documents that have any."""
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 10_000)).first()[0] or []
    batch = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        batch = F.when(F.col("doc_id") > bound, F.lit(i)).otherwise(batch)
    folder = shared_folder(spark, "line-hashes")
    line_hashes(docs).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    hashes = spark.read.schema("doc_id bigint, text_key bigint, at int, h1 bigint, h2 bigint, batch int").parquet(folder)
    runs = LineRuns(spark)
    for i in range(len(bounds) + 1):
        runs.add(hashes.filter(F.col("batch") == i).select("doc_id", *HASH))
    # Stored, so that its rows are counted before a broadcast; else both sides are plain shuffles, whose hot hashes can be split.
    spread = small(stored(runs.totals().filter(F.col("n") >= least_docs).select(*HASH, "owner"), "spread-lines"))
    drops = hashes.join(spread, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return drops.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("drop"))


def dedup_lines(docs: DataFrame, batches: int = 4, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and ``n_lines``, ``n_dropped`` added.

    A line whose key is found in ``least_docs`` documents stays only in the one with the largest id, everywhere it stands there. A
    null or empty text is one empty line; rows of one id are one document, a null id being the smallest.
    """
    drops = repeated_lines(docs, batches, least_docs).select(
        F.col("doc_id").alias(i := fresh("id")), F.col("text_key").alias(k := fresh("key")), F.col("drop").alias(d := fresh("drop"))
    )
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[i]) & (text_key(docs["text"]) == drops[k]), "left")
    lines = joined.withColumn(n := fresh("lines"), F.split(full_text(docs["text"]), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(n) - 1), F.col(d))
    text = F.when(F.col(d).isNull(), full_text(docs["text"])).otherwise(
        F.array_join(F.transform(stay, lambda at: F.col(n)[at]), "\n")
    )
    return lines.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(n).cast("bigint").alias("n_lines"),
        F.greatest(F.coalesce(F.size(d), F.lit(0)), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
