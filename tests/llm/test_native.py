"""Decontamination, mixing, quality rules, secrets and line dedup against plain versions."""

import random
from collections import defaultdict

import brute
import pytest
from conftest import ordered
from pyspark.sql import functions as F

from examlake.llm import decontaminate, line_dedup, mixing, quality_rules, secret_ledger
from examlake.session import shared_folder


@pytest.fixture(scope="module")
def items(rows):
    words = (rows[110 - 100 + 47 - 0][1] or "").split() if len(rows) > 57 else []
    long = next(r[1] for r in rows if r[0] == 110).split()
    return [
        (1, " ".join(long[100:140])), (2, " ".join(long[120:150]).upper()), (3, "one two"), (4, None), (5, " ,. "),
        (6, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), *[(20 + i, " ".join(words[i : i + 14])) for i in range(3) if words],
    ]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contamination_equals_brute_force(spark, docs, pairs, items, limit, monkeypatch):
    """Also with no window broadcast."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated"
    ).collect()
    assert ordered(got) == ordered(brute.op1(pairs, items))


def test_contaminated_documents_and_spans_go(spark, docs, pairs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = [r[5] for r in brute.op1(pairs, items)]
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == bad.count(False) and any(bad)
    clean = decontaminate.remove_spans(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    again = decontaminate.contamination(clean.filter("doc_id = 110"), bench).first()
    assert again["n_words"] == 6000 - brute.op1([(110, dict(pairs)[110])], items)[0][2]


def test_no_text_moves_beyond_the_broadcast_limit(spark, docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    words = docs.select("doc_id", F.lit(1).alias("text_key"), decontaminate.token_words(F.col("text")).alias("words"))
    grams = decontaminate.benchmark_grams(spark.createDataFrame(items, "item_id long, text string"))
    plan = decontaminate.joined_hits(words, grams, [13, 2])._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(hash" in line]
    assert moved and "words" not in "".join(moved)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_no_benchmark_and_no_documents(spark, docs, empty, items, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def water_fill(sizes: dict, weights: dict, share=1.5, epochs=2.0) -> dict:
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        rate = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * rate > epochs * sizes[s]}
        if not over:
            return out | {s: weights[s] * rate for s in open_}
        out |= {s: epochs * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix_targets_and_takings(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.BLANK_WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    found = mixing.mix_report(docs).collect()
    assert len(found) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert ordered(found) == ordered(mixing.mix_report(docs.repartition(7)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


def test_mix_of_many_rows_is_near_and_empty_is_empty(spark, empty):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), "hot" if i % 3 else f"s{i % 30}") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix_report(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 15 for r in found)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_line_dedup_equals_brute_force(docs, pairs, empty):
    for batches in (1, 4, 7):
        found = line_dedup.dedup_lines(docs, batches).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert ordered(found) == ordered(brute.op4(pairs))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_are_levelled(spark, docs):
    runs = line_dedup.LineRuns(spark, fanout=2)
    hashes = line_dedup.line_hashes(docs).select("doc_id", "h1", "h2")
    for i in range(5):
        runs.add(hashes.filter(F.pmod("doc_id", F.lit(5)) == i))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    whole = hashes.filter("doc_id is not null").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))
    assert ordered(runs.totals().collect()) == ordered(whole.collect())
    held = runs._known().select("h1", "h2")
    assert held.count() == held.distinct().count() == whole.count()


def test_statistics_equal_brute_force(docs, pairs, empty):
    found = quality_rules.statistics(docs).withColumn("base_failed", quality_rules.base_failed())
    got = found.select("doc_id", *quality_rules.COUNTS, "base_failed").collect()
    assert ordered(got) == ordered(brute.op6(pairs))
    assert quality_rules.statistics(empty).count() == 0


def test_decision_list_finds_planted_rules(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        n = rng.randint(20, 800)
        symbols = n if i % 10 == 0 else rng.randint(0, 2)
        dup = rng.randint(8, 20) if i % 10 == 1 else rng.randint(0, 2)
        rows.append((i, n, n * 5, symbols, dup, 0, int(i % 10 < 2)))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bad int")
    rules = quality_rules.learn(stats)
    judged = quality_rules.judge(stats, rules)
    assert judged.filter("kept = (bad = 1)").count() < 30
    assert {c.feature for r in rules.rules for c in r.conditions} <= {"symbols_per_word", "dup_lines", "n_words"}
    assert quality_rules.learn(stats.filter("bad = 0")).rules == () and quality_rules.learn(stats.limit(0)).rules == ()


def test_secrets_equal_brute_force(spark, docs, pairs):
    versions = docs.select("doc_id", F.col("text").alias("content"))
    ledger = secret_ledger.BlobLedger(spark, shared_folder(spark, "ledger"))
    ledger.scan(versions)
    base = [r.kind for r in secret_ledger.BASE_RULES]
    got = []
    for r in ledger.findings(versions).collect():
        spans = [f for f in r["found"] if f["kind"] in base]
        digest = brute.sha(",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in spans))
        got.append((r["doc_id"], *[sum(f["kind"] == k for f in spans) for k in base], digest))
        assert (r["doc_id"] == 117) == any(f["kind"] == "pem" for f in r["found"])
    assert ordered(got) == ordered(brute.op8(pairs))


def test_ledger_scans_only_what_is_unseen(spark, docs):
    versions = docs.select("doc_id", F.col("text").alias("content"))
    ledger = secret_ledger.BlobLedger(spark, shared_folder(spark, "ledger"))
    rules = secret_ledger.BASE_RULES
    ledger.scan(versions.filter("doc_id < 110"), rules)
    first = ledger.entries().count()
    ledger.scan(versions, rules)
    blobs = versions.select(secret_ledger.blob_id(F.col("content"))).distinct().count()
    assert ledger.entries().count() == blobs * len(rules) > first
    ledger.scan(versions, rules)
    assert ledger.entries().count() == blobs * len(rules)
    newer = (secret_ledger.Rule("hex", r"([0-9a-f]{8,})", 8, version=2), *rules[:2])
    ledger.scan(versions, newer)
    assert ledger.entries().count() == blobs * (len(rules) + 1)
    assert ledger.findings(versions, newer).filter("doc_id = 116").first()["found"]


def test_ledger_opened_again_goes_on(spark, docs):
    versions = docs.select("doc_id", F.col("text").alias("content"))
    folder = shared_folder(spark, "ledger")
    secret_ledger.BlobLedger(spark, folder).scan(versions.filter("doc_id <= 115"))
    first = secret_ledger.BlobLedger(spark, folder).entries().collect()
    secret_ledger.BlobLedger(spark, folder).scan(versions.filter("doc_id > 115"))
    again = secret_ledger.BlobLedger(spark, folder)
    assert first and {(r["blob"], r["kind"]) for r in first} < {(r["blob"], r["kind"]) for r in again.entries().collect()}
    found = again.findings(versions).filter("size(found) > 0").select("doc_id").collect()
    assert {115, 116, 117} <= {r["doc_id"] for r in found}
    again.scan(versions)
    before = again.entries().count()
    secret_ledger.BlobLedger(spark, folder).scan(versions)
    assert again.entries().count() == before == again.entries().select("blob", "kind", "version").distinct().count()


def test_ledger_keeps_columns_and_takes_an_empty_table(spark, docs, empty):
    versions = docs.select("doc_id", F.col("text").alias("content"), F.lit("own").alias("blob"), F.lit(1).alias("found"), "hash")
    ledger = secret_ledger.BlobLedger(spark, shared_folder(spark, "ledger"))
    none = empty.select("doc_id", F.col("text").alias("content"), F.lit("own").alias("blob"), F.lit(1).alias("found"))
    ledger.scan(none)
    assert ledger.findings(none).count() == 0 and ledger.entries().count() == 0
    ledger.scan(versions)
    got = ledger.findings(versions)
    assert got.columns == ["doc_id", "content", "blob", "hash", "found"] and got.count() == versions.count()
    assert got.filter("blob <> 'own'").count() == 0 and got.filter("size(found) > 0").count() >= 3


def test_thresholds_are_the_exact_quantiles(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 900), rng.randint(0, 5000), rng.choice([0, 0, rng.randint(0, 40)]), rng.randint(0, 9), 0, int(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bad int")
    cuts = quality_rules.thresholds(df)
    exact = df.groupBy("bad").agg(*[F.percentile(v, F.array(*map(F.lit, quality_rules.STEPS))).alias(k) for k, v in quality_rules.features().items()]).collect()
    for k in quality_rules.features():
        assert cuts[k] == pytest.approx(sorted({0.0, *(round(x, 6) for r in exact for x in r[k])}), abs=2e-6)
    assert quality_rules.thresholds(df.limit(0)) == {}


def test_quality_report_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 3 and 1) for i in range(40)] + [(None, 0), (5, None)], "doc_id long, quality int")
    none = labels.limit(0)
    alone = quality_rules.quality_report(docs, none)
    assert alone.filter("kept = base_failed").count() == 0 and alone.count() == docs.count()
    assert quality_rules.quality_report(empty, labels).count() == 0
    assert quality_rules.quality_report(docs, labels).filter("kept and base_failed").count() == 0
