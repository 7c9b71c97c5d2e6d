"""Fill-in-the-middle, packing and the divergence of sources against plain versions."""

import itertools
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import ordered
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from examlake.llm import fill_in_middle, packing, source_divergence

MARKED = [
    (200, "a\n<P>b\nc"), (201, "ends with <M>"), (202, "<\nP>\n<S"), (203, "\n"), (204, "\n\n\n"), (205, "no line end"), (206, "é\nßü\n日本\n" * 30),
    (207, "x" * 700 + "\n" + "y" * 900), (-3, "one\ntwo\nthree\n"),
]


# ------------------------------------------------------------------ fill in the middle
@pytest.fixture(scope="module")
def lines(spark, docs, pairs):
    more = spark.createDataFrame(MARKED, "doc_id bigint, text string").withColumn("form", F.lit("clash"))
    return docs.unionByName(more, allowMissingColumns=True), [*pairs, *MARKED]


@pytest.mark.parametrize("piece, share, first", [(1 << 16, 100, 50), (16, 60, 30)])
def test_rearranged_texts_equal_brute_force(lines, piece, share, first):
    df, rows = lines
    mix = fill_in_middle.Mix(piece=piece, share=share, suffix_first=first)
    expected = brute.op11(rows, share=share, suffix_first=first)
    assert ordered(fill_in_middle.digests(df, mix).collect()) == ordered(expected)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_rearranged_texts_are_restored(lines):
    df, rows = lines
    mix = fill_in_middle.Mix(piece=20)
    out = fill_in_middle.rearranged(df, mix)
    assert ordered(out.select("doc_id", F.sha2("text", 256)).collect()) == ordered((r[0], r[5]) for r in brute.op11(rows))
    assert ordered(fill_in_middle.restored(out, mix).collect()) == ordered((i, t or "") for i, t in rows)


def test_restoring_moves_nothing_again(docs):
    """Both sorts share one partitioning, so that there is one shuffle."""
    pieces, parts = fill_in_middle.arranged(docs)
    again = fill_in_middle.sorted_pieces(pieces.mapPartitions(lambda x: x, preservesPartitioning=True), parts)
    assert again.partitioner == pieces.partitioner
    assert again.toDebugString().count(b"ShuffledRDD") == 1


def test_a_document_of_many_pieces(spark):
    text = "".join(f"line {i} of a long text\n" for i in range(60_000))
    got = fill_in_middle.digests(spark.createDataFrame([(5, text)], "doc_id long, text string"), fill_in_middle.Mix(piece=1000))
    assert ordered(got.collect()) == brute.op11([(5, text)])


def test_no_texts_and_bad_marks(empty):
    assert fill_in_middle.digests(empty).count() == 0
    assert fill_in_middle.rearranged(empty).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.Mix(prefix="<S>")


# ------------------------------------------------------------------ packing
def test_closest_sum_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        stock = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        ways = [dict(zip(stock, k)) for k in itertools.product(*[range(c + 1) for c in stock.values()])]
        best = max(s for w in ways if (s := sum(n * k for n, k in w.items())) <= room)
        found, mix = packing.closest(sorted(stock.items(), reverse=True), room)
        assert found == best == sum(n * k for n, k in mix.items())
        assert all(0 < k <= stock[n] for n, k in mix.items())


@pytest.mark.parametrize("size", [64, 2048])
def test_a_plan_places_every_tail_once(size):
    rng = random.Random(size)
    for counts in (
        {},
        {1: 1},
        {size * 3 // 4: 100_001},
        {size // 2: 7, size // 3: 1000, 5: 3},
        Counter(rng.randint(1, size - 1) for _ in range(3_000)),
        {n: rng.choice([1, 2, 50, 4000]) for n in range(1, size, 3)},
    ):
        found = packing.plan(dict(counts), size)
        total = sum(n * c for n, c in counts.items())
        length = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
        rank = np.concatenate([np.arange(c) for c in counts.values()] or [np.zeros(0)]).astype(np.int64)
        taken, filled = np.zeros(len(length), np.int64), Counter()
        spans = []
        for row, start, n, sequence, offset in packing.places(found, length, rank):
            np.add.at(taken, row, n)
            spans += zip(sequence.tolist(), offset.tolist(), n.tolist(), row.tolist(), start.tolist())
        assert (taken == length).all()
        for sequence, offset, n, *_ in sorted(spans):
            assert offset == filled[sequence]
            filled[sequence] += n
        assert sum(filled.values()) == total
        assert all(n == size or n & (n - 1) == 0 and n < size for n in filled.values())
        assert sum(n < size for n in filled.values()) < size.bit_length()
        assert len(found.rows) <= 24 * len(counts) * 8


def test_most_windows_are_mixed_whole():
    rng = random.Random(1)
    counts = Counter(int(rng.lognormvariate(6, 1)) % 2047 + 1 for _ in range(20_000))
    found = packing.plan(dict(counts))
    assert found.sequences > 0.99 * sum(n * c for n, c in counts.items()) / 2048


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


@pytest.mark.parametrize("size", [32, 2048])
def test_packed_ids_equal_the_tokenizer(spark, docs, pairs, tokenizer, size):
    odd = [(300, "<|endoftext|> a <|endoftext|>b"), (301, "  two  blanks \n x\t y\n\n z "), (302, " "), (303, "it's  we'll 12 345"), (304, "\r\n a \r\nb")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack(df, sequence=size).toPandas()
    expected = Counter()
    for doc, text in [*pairs, *odd]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_MARK], "<u4").tobytes()
        expected[doc, ids] += 1
    found = Counter()
    for (doc, _), parts in pieces.assign(doc_id=pieces.doc_id.fillna(-9)).groupby(["doc_id", "doc_tokens"]):
        by_start = Counter((r.start, r.length, r.ids) for r in parts.itertuples())
        while by_start:  # repeated rows: their pieces are alike
            at, ids = 0, b""
            while at < parts.doc_tokens.iloc[0]:
                piece = next(p for p in by_start if p[0] == at)
                by_start -= Counter([piece])
                at, ids = at + piece[1], ids + piece[2]
            found[None if doc == -9 else doc, ids] += 1
    assert found == expected
    by_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (by_sequence.cumsum() - pieces.sort_values(["sequence_id", "offset"]).length == pieces.sort_values(["sequence_id", "offset"]).offset).all()
    sums = by_sequence.sum()
    assert ((sums == size) | ((sums & (sums - 1)) == 0)).all() and sums.max() <= size


def test_sequences_hold_their_pieces(spark, docs, empty):
    pieces = packing.pack(docs, sequence=64).persist()
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        s = whole[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"]) and (r["doc_id"], r["offset"]) in [tuple(d) for d in s["documents"]]
        assert len(s["ids"]) == 4 * s["length"]
    crc = pieces.select("ids", F.crc32("ids").alias("crc")).first()
    assert crc["crc"] == zlib.crc32(bytes(crc["ids"]))
    assert packing.pack(empty).count() == 0
    pieces.unpersist()


# ------------------------------------------------------------------ divergence of sources
def _corpus() -> list[tuple]:
    rng = random.Random(9)
    words = ["wal", "Der", "ost", "nim", "pra", "quo", "sé", "ÉT", "日本", "ba", "x", "lor", "zz"]
    out = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "s3", None, "", "é"])
        own = words if source != "s1" else words[:4] * 3 + words
        out.append((i, " 1,".join(rng.choice(own) for _ in range(rng.randint(0, 30))), lang, source, len(own)))
    out += [(1000, None, "fr", "s0", 1), (1001, "", "fr", "s1", 1), (1002, "just once", "fr", "s2", 1), (1003, "123 !", "en", "only here", 1)]
    out += [out[3], out[3], (1004, "wal " * 5000, "en", "s2", 0)]
    return out


@pytest.mark.parametrize("block, each, least", [(128, 4096, 30), (2, 3, 30), (3, 5, 1)])
def test_divergence_equals_brute_force(spark, block, each, least):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, place int").repartition(3)
    got = source_divergence.audit(df, least_docs=least, top=7, block=block, terms_each=each)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = brute.op13([r[1:4] for r in rows], least, 7)
    assert ordered(got.collect()) == ordered(expected)
    assert {r[2] for r in expected} == {"pair", "term"}


def test_divergence_of_the_odd_documents(docs, rows, empty):
    expected = brute.op13([r[1:4] for r in rows], 3)
    assert ordered(source_divergence.audit(docs, least_docs=3).collect()) == ordered(expected)
    assert source_divergence.audit(empty).count() == 0


def test_counts_given_on_early_add_up(docs):
    one, two = (source_divergence.group_shares(docs, 2, held)[1].drop("place").collect() for held in (200_000, 5))
    assert ordered(one) == ordered(two)


def test_shares_beyond_64_bits(spark):
    df = spark.sql("select 9000000000000L as n, 70000000000000L as total, 1000L as kept")
    assert df.select(source_divergence.share("n", "total", "kept")).first()[0] == 1 + 10**9 * (9 * 10**12 + 5) // (7 * 10**13 + 5000)
