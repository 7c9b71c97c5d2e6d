"""Substring, byte and near dedup, toxicity, token shards and the pipeline against plain versions."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from conftest import ordered
from pyspark.sql import functions as F

import corpus_pipeline
from examlake.llm import anchors, simhash_golay, substring_dedup, suffix_array, token_shards, toxicity
from examlake.llm.common import stored


def test_substring_dedup_equals_brute_force(docs, pairs, empty):
    got = substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert ordered(got) == ordered(brute.op7(pairs)) and any(r[2] for r in got)
    assert substring_dedup.dedup_substrings(docs).columns == [*docs.columns, "n_words", "n_removed"]
    assert substring_dedup.dedup_substrings(empty.select("doc_id", "text")).count() == 0


def test_substring_dedup_keeps_columns_of_any_name(docs, pairs):
    df = docs.select("doc_id", F.lit("mine").alias("row"), "text", F.lit(7).alias("spans"), F.lit(1).alias("n_words"))
    out = substring_dedup.dedup_substrings(df)
    assert out.columns == ["doc_id", "row", "text", "spans", "n_words", "n_removed"]
    assert out.filter("row <> 'mine' or spans <> 7").count() == 0
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert ordered(got) == ordered(brute.op7(pairs))


def test_hashes_do_not_depend_on_the_chunks(monkeypatch):
    rng = np.random.default_rng(12)
    values = rng.integers(0, 256, 5_000).astype(np.uint8)
    begin = rng.integers(0, 4_000, 700)
    length = rng.integers(1, 600, 700)
    whole = anchors.context_hashes(values, begin, length)
    monkeypatch.setattr(anchors, "CHUNK", 97)
    parts = anchors.context_hashes(values, begin, length)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    again = anchors.context_hashes(np.concatenate([values[:50], values]), begin + 50, length)
    assert (again[0] == whole[0]).all()
    assert not len(anchors.context_hashes(values, begin[:0], length[:0])[0])


def test_byte_dedup_equals_brute_force(docs, pairs, empty):
    got = suffix_array.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(got) == ordered(brute.op9(pairs)) and any(r[2] for r in got)
    assert suffix_array.dedup_bytes(empty).count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """Many near copies of one text and many texts with one common passage."""
    rng = random.Random(11)
    word = lambda: rng.choice(["wal", "der", "ost", "nim", "pra", "quo"]) + rng.choice(["a", "en", "ig", "um"])
    base, passage = [word() for _ in range(90)], " ".join(word() for _ in range(45))
    rows = []
    for i in range(300):
        near = list(base)
        near[rng.randrange(90)] = f"x{i}"
        rows.append((2 * i, " ".join(near)))
        rows.append((2 * i + 1, f"{word()} {i} {word()} {passage} {word()} {i}"))
    return rows


@pytest.mark.parametrize("heavy", [20_000, 40])
def test_large_groups_equal_brute_force(spark, copies, heavy, monkeypatch):
    """Also with groups cut down to single windows."""
    monkeypatch.setattr(anchors, "HEAVY", heavy)
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(6)
    words = substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert ordered(words) == ordered(brute.op7(copies))
    data = suffix_array.dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(data) == ordered(brute.op9(copies))


def test_an_anchor_is_heavy_in_all_its_rows(spark, monkeypatch):
    """One document repeats a phrase in one partition; two documents with that phrase stand in another."""
    monkeypatch.setattr(anchors, "HEAVY", 40)
    rows = [(1, "wal " * 100), (2, "wal " * 13), (3, "wal " * 13)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert ordered(got) == ordered(brute.op7(rows))


@pytest.mark.parametrize("module", [substring_dedup, suffix_array])
def test_repeats_of_a_batch_make_an_anchor_heavy(spark, copies, module, monkeypatch):
    """Each batch has the passage too few times to pass the limit alone."""
    monkeypatch.setattr(anchors, "HEAVY", 400)
    df = spark.createDataFrame(copies * 2, "doc_id long, text string").repartition(6)
    symbols = F.col("text").cast("binary") if module is suffix_array else substring_dedup.word_hashes(F.col("text"))
    found = anchors.repeated_anchors(anchors.keyed_rows(df).select("row", F.col("doc_id").alias("doc"), symbols.alias("symbols")), module.SHAPE)
    marks = found.select(F.explode("anchors").alias("a")).groupBy("a.heavy").count().collect()
    assert dict(marks).get(True, 0) > 400 and dict(marks).get(False, 0) > 0


@pytest.mark.parametrize("judge", [substring_dedup.judge, suffix_array.judge])
def test_a_window_of_any_number_passes_in_pieces(judge, monkeypatch):
    """One group over many batches is judged as it comes, and loses nothing at the seams."""
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_array, "PIECE", 1000)
    taken = []

    def batches():
        for i in range(50):
            taken.append(i)
            rows = [np.full(20, x, np.int64) for x in (5, 6, 7)]
            ids = np.arange(20 * i, 20 * i + 20)
            ints = [np.full(20, x, np.int32) for x in (3, 1, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, [*rows, ids, ids, *ints, np.zeros(20, bool)]), pa.nulls(20, pa.binary())], anchors.CONTEXT_NAMES)

    found, seen = set(), []
    for out in judge(batches()):
        seen.append(len(taken))
        found.update(out.column(0).to_pylist())
    assert found == set(range(1 if judge is substring_dedup.judge else 0, 1000))
    assert seen[0] < 5


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    for n, letters in ((1, 2), (50, 2), (400, 3), (900, 1)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw, order = data.tobytes(), suffix_array.suffix_order(data, 1000)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        shared = suffix_array.common_prefixes(data, order, 60)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(same, 60)


def test_shards_of_one_group_find_each_other():
    rng = random.Random(4)
    base = "".join(rng.choice("abcd") for _ in range(500))
    texts = [(base[i : i + 260] + "".join(rng.choice("xyz") for _ in range(5))).encode() for i in range(0, 200, 3)]
    group, weight = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
    whole = {*zip(*(x.tolist() for x in suffix_array.repeated_windows(texts, group, weight)))}
    parts = {*zip(*(x.tolist() for x in suffix_array.repeated_windows(texts, group, weight, shard=1500)))}
    assert whole == parts and whole


def test_golay_decodes_three_errors_and_near_words_share_a_key():
    golay, rng = simhash_golay.Golay(), np.random.default_rng(8)
    words = rng.integers(0, 1 << 23, 2000)
    distance = np.bitwise_count(words ^ ((golay.index(words) << 11) | golay.remainder[golay.index(words)]))
    assert distance.max() <= 3
    for bits in (21, 22, 23):
        x = rng.integers(0, 1 << bits, 3000)
        y = x ^ (1 << rng.integers(0, bits, 3000)) ^ (1 << rng.integers(0, bits, 3000))
        a, b = golay.nearby(x, bits), golay.nearby(y, bits)
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_near_duplicates_equal_brute_force(docs, pairs, empty):
    found = simhash_golay.near_duplicates(docs)
    assert found.columns == ["doc_id", "text_key", "print", "root", "component_id"]
    got = found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0"), "component_id").collect()
    assert ordered(got) == ordered(brute.op10(pairs))
    assert simhash_golay.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(docs, pairs):
    # Two texts share the id 113, which would name two groups.
    kept = simhash_golay.keep_one(docs.filter("doc_id is null or doc_id != 113"))
    assert kept.columns == docs.columns
    found = brute.op10([p for p in pairs if p[0] != 113])
    assert kept.count() == len({(f[2], f[1] if f[2] is None else 0) for f in found})


def test_keep_one_of_an_empty_table_and_clashing_names(spark, docs, empty, pairs):
    assert simhash_golay.keep_one(empty).count() == 0
    clash = docs.filter("doc_id < 113").selectExpr("doc_id", "text", "1 as root", "2 as first", "3 as n", "4 as print", "5 as text_key")
    kept = simhash_golay.keep_one(clash)
    found = brute.op10([p for p in pairs if p[0] is not None and p[0] < 113])
    assert kept.columns == clash.columns and kept.count() == len({f[2] for f in found})
    assert kept.filter("root <> 1 or first <> 2 or n <> 3 or print <> 4 or text_key <> 5").count() == 0


def test_every_group_over_the_limit_is_passed_on():
    rng = np.random.default_rng(2)
    keys = np.repeat(np.arange(6), [10, 300, 5, 250, 1, 90]).astype(np.int64)
    prints = rng.integers(-(1 << 62), 1 << 62, len(keys))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints)], ["key", "print"])
    out = pa.Table.from_batches(list(simhash_golay.link_rows(3, 100)(iter([batch]))))
    passed = out.filter(pa.compute.is_valid(out["key"])).to_pandas()
    assert passed.groupby("key").size().to_dict() == {1: 300, 3: 250}


@pytest.mark.parametrize("defer", [50_000, 60])
def test_links_of_a_dense_group(spark, defer, monkeypatch):
    """A ball of fingerprints, chains of three-bit steps and strangers; also with groups cut into pairs of parts."""
    monkeypatch.setattr(simhash_golay, "DEFER", defer)
    monkeypatch.setattr(simhash_golay, "BLOCK", 32)
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(300)}
    center = rng.getrandbits(64)
    values |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    step = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 3):
            step ^= 1 << b
        values.add(step)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "print long").repartition(4)
    got = {r["node"]: r["root"] for r in simhash_golay.components(simhash_golay.links(df)).collect()}
    parent = {v: v for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {v: root(v) for v in signed if root(v) != v}
    assert {k: v for k, v in got.items() if k != v} == want


def test_scores_equal_convolution_and_pooling_by_loops(monkeypatch):
    """Texts shorter than a filter, without words, and cut into parts while they are scored."""
    rng = np.random.default_rng(4)
    n, width = 1 << toxicity.BITS, toxicity.DIM
    model = toxicity.Model(
        rng.normal(0, 1, (n, width)).astype(np.float32), rng.normal(0, 1, (n, width)).astype(np.float32),
        [rng.normal(0, 1, (w, width, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        rng.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS) + 1).astype(np.float32), (0.7, -0.2),
    )
    texts = [rng.integers(0, 1 << 3 * toxicity.BITS, k) for k in (0, 1, 2, 3, 7, 40, 0, 90)]
    none = np.zeros(width, np.float32)

    def plain(codes):
        x = [model.words[c & (n - 1)] + model.words[c >> toxicity.BITS & (n - 1)] + model.starts[c >> 2 * toxicity.BITS] for c in codes.tolist()]
        pooled = []
        for f, bias in zip(model.filters, model.bias):
            best = np.maximum(bias, 0)  # the window of blanks after a text counts, also of a text without words
            for i in range(len(x)):  # a window may run past the end of the text
                value = bias + sum((x[i + o] if i + o < len(x) else none) @ f[o] for o in range(len(f)))
                best = np.maximum(best, value)
            pooled.append(best)
        z = 0.7 * (np.concatenate(pooled) @ model.out[:-1] + model.out[-1]) - 0.2
        return 1 / (1 + np.exp(-z))

    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for step in (toxicity.STEP_TOKENS, 11):
        monkeypatch.setattr(toxicity, "STEP_TOKENS", step)
        got = model.score(np.concatenate(texts), offsets)
        assert got == pytest.approx([plain(t) for t in texts], abs=1e-4), step


def test_rare_words_stay_neutral_and_every_row_calibrates():
    import pandas as pd

    rng = np.random.default_rng(7)
    code = lambda words: np.array([int(w) * 2654435761 % (1 << 3 * toxicity.BITS) for w in words])
    rows = [(i, int(i % 8 == 0), "en", code([*rng.integers(100, 160, 20), *([7, 8, 9][i % 3 :] if i % 8 == 0 else []), 10_000 + i])) for i in range(240)]
    model = toxicity.train(pd.DataFrame(rows, columns=["doc_id", "toxic", "lang", "codes"]))
    rare = toxicity.split_codes(code([10_003]))[0]
    assert not model.words[rare].any() and model.words[toxicity.split_codes(code([9]))[0]].any()
    new = [code([*rng.integers(100, 160, 20), 90_000 + i, *([9] if i % 2 else [])]) for i in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in new])]).astype(np.int64)
    predicted = model.score(np.concatenate(new), offsets) >= toxicity.THRESHOLD
    assert predicted[1::2].mean() > 0.9 and predicted[::2].mean() < 0.1


def test_toxicity_learns_and_keeps_its_bounds(spark, docs, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        words = ["".join(rng.choice(["ba", "lo", "ti", "re"]) for _ in range(3)) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["grumpf", "Blarg,", "snortle"])
        rows.append((i, " ".join(words), rng.choice(["en", "fr"])))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (99999, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.judged(table, known).collect()}
    held = [i for i in range(1200) if found[i]["held_out"]]
    right = sum(found[i]["predicted"] == (i % 6 == 0) for i in held)
    assert len(held) > 200 and right >= 0.95 * len(held)
    kept = toxicity.drop_toxic(table, known)
    assert kept.columns == table.columns and kept.count() == sum(not r["rejected"] for r in found.values())
    odd = toxicity.judged(docs, known).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.judged(docs, known.limit(0)).count() == docs.count()
    assert toxicity.judged(empty, known).count() == 0 and toxicity.drop_toxic(empty, known).count() == 0


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(1)
    model = toxicity.train(__import__("pandas").DataFrame({"toxic": [0], "lang": ["en"], "codes": [[1]]}))
    codes = rng.integers(0, 1 << 51, 5000)
    offsets = np.array([0, 0, 3, 3000, 3001, 5000])
    whole = model.pooled(codes, offsets)
    monkeypatch.setattr(toxicity, "STEP_TOKENS", 100)
    assert np.allclose(whole, model.pooled(codes, offsets), atol=1e-5)
    for i in range(5):
        own = model.pooled(codes[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        assert np.allclose(whole[i], own[0], atol=1e-5)


def numpy_peak(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_fingerprints_and_links_need_little_memory_besides_their_batch(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([0, 0, 5, 400_000, 0, 1, 90_000, 70_000, 0])
    values = rng.integers(-(1 << 62), 1 << 62, int(sizes.sum()))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(9)), pa.array(np.arange(9)), lists], ["doc_id", "text_key", "hashes"])
    out = []
    assert numpy_peak(lambda: out.extend(simhash_golay.majority(iter([batch, batch.slice(2, 5)])))) < 16
    want = []
    for own in np.split(values, np.cumsum(sizes)[:-1]):
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        want.append(int(np.packbits(2 * bits > len(own), bitorder="little").view(np.int64)[0]))
    assert [b.column(2).to_pylist() for b in out] == [want, want[2:7]]
    prints = np.sort(rng.integers(0, 1 << 62, 2_500))
    assert numpy_peak(lambda: simhash_golay.near_links(prints, np.array([0]), np.array([2_500]), 3)) < 16


def test_texts_do_not_go_to_python_to_be_dropped(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    kept = toxicity.drop_toxic(docs, labels)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_batches_are_small_while_texts_are_stored(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(0, 2_500, 1, 1).mapInArrow(sizes, "n bigint")
    assert sorted(r["n"] for r in stored(rows, "sizes", rows=1_000).collect()) == [500, 1_000, 1_000]
    assert [r["n"] for r in stored(rows, "sizes").collect()] == [2_500] and spark.conf.get(name) == before


def test_slots_are_a_permutation():
    for total in (1, 2, 3, 17, 1000, 4097):
        found = token_shards.slots(np.arange(total), total)
        assert sorted(found.tolist()) == list(range(total))
    assert token_shards.slots(np.arange(1000), 1000, key=1).tolist() != token_shards.slots(np.arange(1000), 1000).tolist()


def test_token_shards_round_trip(spark, docs, pairs, empty, tmp_path):
    encoder = token_shards.Encoder(open(token_shards.TOKENIZER, "rb").read())
    for _, text in pairs:
        ids = np.frombuffer(encoder(text or ""), "<u2").tolist()
        assert ids == [*encoder.encoding.encode_ordinary(text or ""), token_shards.END_MARK]
    manifest = token_shards.materialize(docs, str(tmp_path / "shards"), length=64, per_shard=50).collect()
    total = sum(r["n_tokens"] for r in manifest)
    assert [r["slot"] for r in manifest] == list(range(len(manifest)))
    read = token_shards.read_slots(str(tmp_path / "shards"), 0, len(manifest), 64, 50)
    assert (token_shards.read_slots(str(tmp_path / "shards"), 45, 30, 64, 50) == read[45:75]).all()
    for r, row in zip(manifest, read):
        assert brute.sha(row.tobytes()) == r["tokens_sha256"]
    order = token_shards.slots(np.arange(len(manifest)), len(manifest))
    stream = read[order].ravel()[:total].tolist()
    ends = [i for i, t in enumerate(stream) if t == token_shards.END_MARK]
    texts = [encoder.encoding.decode(stream[a + 1 : b]) for a, b in zip([-1, *ends], ends)]
    assert sorted(texts) == sorted(t or "" for _, t in pairs)
    assert token_shards.materialize(empty, str(tmp_path / "none")).count() == 0


def test_texts_are_encoded_whole_by_one_encoder_of_a_worker(monkeypatch):
    vocabulary = open(token_shards.TOKENIZER, "rb").read()
    encoder = token_shards.encoder(vocabulary)
    assert token_shards.encoder(bytes(bytearray(vocabulary))) is encoder
    odd = ["a\n \nb", "a  b", " \n\n\n x", "one\ntwo  three\r\n", "don't 's \u3000 9\u00a0z", ""]
    for text in odd:
        ids = np.frombuffer(encoder(text), "<u2").tolist()
        assert ids == [*encoder.encoding.encode_ordinary(text), token_shards.END_MARK]
        assert encoder.encoding.decode(ids[:-1]) == text
    calls = []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return [len(calls)]

    monkeypatch.setattr(encoder, "encoding", Counted())
    assert np.frombuffer(encoder("a text of words"), "<u2").tolist() == [1, token_shards.END_MARK]
    assert calls == ["a text of words"]


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_shards"]
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.schema(out.schema).parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        given, left = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in (before, docs))
        if name == "simhash_near_dedup":
            want = {c for _, _, c in brute.op10(given)}
            assert {d for d, _ in left} == want and len(left) == len(want)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(d for d, _ in left) == sorted(r[0] for r in brute.op1(given, items) if not r[5])
    assert counts[0] >= counts[1] >= counts[2]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_small_groups_share_small_shards(monkeypatch):
    """Suffix arrays stay in a core's cache; a group of more bytes than PART still is one shard, as it was."""
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 101, 1000, np.uint8)) for _ in range(60)]
    texts[1] = texts[0][:500] + texts[1][500:]
    texts[41] = texts[59][:300] + texts[41][300:]
    group, sizes, built = np.array([i // 5 for i in range(40)] + [50] * 20), [], suffix_array.Shard.__init__

    def recorded(self, texts, *more):
        sizes.append(sum(len(t) + 1 for t in texts))
        built(self, texts, *more)

    monkeypatch.setattr(suffix_array.Shard, "__init__", recorded)
    monkeypatch.setattr(suffix_array, "PART", 12_000)
    got = sorted(zip(*(x.tolist() for x in suffix_array.repeated_windows(texts, group, np.ones(60)))))
    assert got == [(t, at) for t, most in ((0, 301), (1, 301), (41, 101), (59, 101)) for at in range(most)]
    assert sizes == [10 * 1001] * 4 + [20 * 1001]


def test_bytes_are_hashed_by_a_table_in_steps(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 300_000, np.uint8)
    offsets = np.arange(0, 300_001, 3000)
    mixed, plain = [], anchors.mix
    monkeypatch.setattr(anchors, "mix", lambda x: mixed.append(len(x)) or plain(x))
    got = anchors.all_anchors(data, offsets, suffix_array.SHAPE)
    assert max(mixed) <= anchors.STEP and sum(mixed) < 5.1 * len(data)
    monkeypatch.setattr(anchors, "STEP", 1 << 20)
    assert all((a == b).all() for a, b in zip(got, anchors.all_anchors(data, offsets, suffix_array.SHAPE)))
    # The table gives what hashing each symbol gives.
    assert (anchors.gram_hashes(data[:500], 24) == anchors.gram_hashes(data[:500].astype(np.uint64), 24)).all()
    begin, length = np.array([0, 70_000, 299_000]), np.array([300, 250, 1000])
    wide = anchors.context_hashes(data.astype(np.uint64), begin, length)
    assert all((a == b).all() for a, b in zip(anchors.context_hashes(data, begin, length), wide))
