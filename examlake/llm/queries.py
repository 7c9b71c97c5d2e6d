"""Registered queries of the document operators: each over the whole given tables, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import (
    decontaminate,
    fill_in_middle,
    line_dedup,
    mixing,
    packing,
    quality_rules,
    secret_ledger,
    simhash_golay,
    source_divergence,
    substring_dedup,
    suffix_array,
    token_shards,
    toxicity,
)
from examlake.llm.common import table
from examlake.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


@query
def op2_mix_sources(spark, sf):
    return mixing.mix_report(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_line_dedup(spark, sf):
    docs = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark, sf):
    judged = quality_rules.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


@query
def op8_secret_ledger(spark, sf):
    versions = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    folder = shared_folder(spark, "blob-ledger")
    # Half of the documents come first; the ledger is opened again for all of them.
    secret_ledger.BlobLedger(spark, folder).scan(versions.filter(F.xxhash64("doc_id") % 2 == 0))
    ledger = secret_ledger.BlobLedger(spark, folder)
    ledger.scan(versions)
    found = ledger.findings(versions)
    base = F.filter("found", lambda f: f["kind"].isin([r.kind for r in secret_ledger.BASE_RULES]))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(r.kind) for r in secret_ledger.BASE_RULES],
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"),
    )


@query
def op7_substring_dedup(spark, sf):
    docs = substring_dedup.dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_suffix_array(spark, sf):
    return suffix_array.dedup_bytes(table(spark, sf, "documents")).drop("kept")


@query
def op10_simhash_golay(spark, sf):
    found = simhash_golay.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_toxicity(spark, sf):
    rows = toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", "lang_threshold", "rejected")


@query
def op5_token_shards(spark, sf):
    return token_shards.materialize(table(spark, sf, "documents"))


@query
def op11_fill_in_middle(spark, sf):
    return fill_in_middle.digests(table(spark, sf, "documents"))


@query
def op12_packing(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_source_divergence(spark, sf):
    return source_divergence.audit(table(spark, sf, "documents"))
