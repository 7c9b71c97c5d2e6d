"""Incremental secret scan over a ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger remembers which (blob, rule version) pairs were
scanned and what was found; a scan touches only unseen pairs, each blob once, and findings are joined back to every path.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm.common import fresh, full_text


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (one capture group) count if the group has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    version: int = 1


# Fixed patterns the results depend on, in the order in which kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
    ),
    Rule("access", r"(AKIA[A-Z0-9]+)", 20),
    Rule("hex", r"([0-9a-f]{24,})", 24),
)
# Added by this operator.
MORE_RULES = (Rule("pem", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)", 1),)
RULES = BASE_RULES + MORE_RULES


def blob_id(content: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(full_text(content), 256)


def spans(content: str, rule: Rule) -> Column:
    """Matches of a rule as an array of (start, end) in code points, end exclusive, leftmost and without overlap.

    The text between matches and the matches themselves alternate, so their lengths add up to positions.
    """
    c, whole = F.col(content), f"({rule.pattern})"
    parts = F.zip_with(
        F.split(c, rule.pattern, -1),
        F.arrays_zip(
            F.regexp_extract_all(c, F.lit(whole), F.lit(1)).alias("match"),
            F.regexp_extract_all(c, F.lit(whole), F.lit(2)).alias("value"),
        ),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["match"]).alias("match"), F.length(m["value"]).alias("value")),
    )
    pair = "array<struct<start:int,end:int>>"
    added = F.aggregate(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(pair).alias("found")),
        lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["match"]).alias("at"),
            F.when(
                p["value"] >= rule.least,
                F.concat(
                    a["found"],
                    F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["match"]).alias("end"))),
                ),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(c.rlike(rule.pattern), added).otherwise(F.array().cast(pair))


class BlobLedger:
    """Findings per scanned (blob, kind, version), kept as Parquet below ``folder``, one part per scan.

    The folder is all there is: a ledger opened on it again, in another session too, goes on where the last one ended.
    """

    SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def begun(self) -> bool:
        """Whether anything was ever written here."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def entries(self) -> DataFrame:
        """Everything scanned so far; a blob scanned without a finding has empty spans."""
        if not self.begun():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).select("blob", "kind", "version", "spans")

    def scan(self, contents: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the unseen pairs of ``contents`` (column ``content``) and rules, and write them down.

        Equal contents are one blob, combined before the shuffle. An unseen blob is read once for all rules it lacks. A null
        content is the empty blob, a very long one a blob like any other; an empty table adds nothing; other columns are not read.
        """
        blobs = contents.select(blob_id(F.col("content")).alias("blob"), full_text("content").alias("content"))
        once = blobs.dropDuplicates(["blob"])
        wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
        if self.begun():
            seen = self.entries().groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
            once = once.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
        else:
            once = once.withColumn("todo", wanted)
        results = F.array(
            *[
                F.struct(
                    F.lit(r.kind).alias("kind"),
                    F.lit(r.version).alias("version"),
                    F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), spans("content", r)).alias("spans"),
                )
                for r in rules
            ]
        )
        rows = once.select("blob", F.explode_outer(results).alias("r")).filter("r.spans is not null").select("blob", "r.*")
        rows.write.mode("error").parquet(f"{self.folder}/scan={uuid.uuid4().hex}")

    def findings(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``versions`` (``content`` and any other columns) with ``found``: kind, start, end of every finding.

        Findings are in order of start, then of kind as the rules list them. Every path of a blob gets its findings, repeated
        rows each; the join is an ordinary one, whose hot blobs are split at run time. A null content is the empty
        text. An empty table gives no rows. Other columns stay, whatever their names; a column ``found`` is replaced.
        """
        order = F.array(*[F.lit(r.kind) for r in rules])
        kept = [f"{r.kind}:{r.version}" for r in rules]
        own = self.entries().filter(F.concat_ws(":", "kind", "version").isin(kept)).filter(F.size("spans") > 0)
        flat = own.select(
            "blob",
            F.transform(
                "spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, F.col("kind")).alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end"))
            ).alias("spans"),
        )
        key, here, all_ = fresh("blob"), fresh("here"), fresh("found")
        by_blob = flat.groupBy(F.col("blob").alias(key)).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias(all_))
        named = versions.withColumn(here, blob_id(F.col("content")))
        empty = F.array().cast(by_blob.schema[all_].dataType)
        found = named.join(by_blob, named[here] == by_blob[key], "left")
        kept_columns = [named[c] for c in versions.columns if c != "found"]
        return found.select(*kept_columns, F.coalesce(F.col(all_), empty).alias("found"))
