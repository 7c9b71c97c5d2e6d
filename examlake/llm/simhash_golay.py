"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. The perfect Golay code (23, 12) puts each 23-bit word within three bits of exactly one
codeword; decoding a segment and its one-bit neighbours gives up to six codeword indices, and two segments that
differ in two bits or fewer share one. Of three errors, two of the segments hold two at most, so linked fingerprints share
a pair of indices. Fingerprints meet by such pairs and are verified bit by bit.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.anchors import list_parts
from examlake.llm.common import TEXT_ROWS, ascii_lower, blank_words, fresh, full_text, small, stored, text_key

SHINGLE, MOST_BITS = 3, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BLOCK = 512  # fingerprints compared with as many others at once
DEFER = 50_000  # larger groups are cut into pairs of parts, compared by tasks of their own
HASHES = 1 << 15  # shingle hashes whose bits are counted at once, some 10 MB


def shingle_hashes(text: Column, n: int = SHINGLE) -> tuple[Column, Column]:
    """(words, hashes): two columns to be added one after the other; the second reads the first as ``words``."""
    starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
    many = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.lit(n)), " ")))
    few = F.when(F.size("words") > 0, F.array(F.xxhash64(F.array_join("words", " ")))).otherwise(F.array().cast("array<bigint>"))
    return blank_words(ascii_lower(text)), F.when(F.size("words") >= n, many).otherwise(few)


def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of ``doc_id, text_key, hashes``: a bit is set if more than half of the hashes have it."""
    for batch in batches:
        values, offsets = list_parts(batch.column(2))
        total = np.diff(offsets)
        ones = np.zeros((len(total), 64), np.int64)
        for begin in range(int(offsets[0]), int(offsets[-1]), HASHES):
            end = min(begin + HASHES, int(offsets[-1]))
            # Texts with hashes in this piece, and where each begins in it.
            low, high = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
            own = low + np.flatnonzero(total[low:high])
            first = np.maximum(offsets[own], begin) - begin
            bits = np.unpackbits(values[begin:end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[own] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        set_ = (2 * ones > total[:, None]).astype(np.uint8)
        prints = np.packbits(set_, axis=1, bitorder="little").view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "text_key", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print`` per row; a text without words, or null, has fingerprint zero."""
    words, hashes = shingle_hashes(full_text())
    rows = docs.select("doc_id", text_key().alias("text_key"), words.alias("words"))
    return rows.select("doc_id", "text_key", hashes.alias("hashes")).mapInArrow(majority, "doc_id bigint, text_key bigint, print bigint")


class Golay:
    """Decoder of the (23, 12) code."""

    def __init__(self):
        self.remainder = np.zeros(1 << 12, np.int64)
        for i in range(1 << 12):
            x = i << 11
            for bit in range(22, 10, -1):
                if x >> bit & 1:
                    x ^= GENERATOR << (bit - 11)
            self.remainder[i] = x
        # Each of the 2048 remainders belongs to one error of three bits or fewer.
        self.error = np.zeros(1 << 11, np.int64)
        for k in (1, 2, 3):
            for bits in combinations(range(23), k):
                e = sum(1 << b for b in bits)
                self.error[self.remainder[e >> 11] ^ (e & 2047)] = e

    def index(self, word: np.ndarray) -> np.ndarray:
        """Number of the nearest codeword: its twelve message bits."""
        return (word ^ self.error[self.remainder[word >> 11] ^ (word & 2047)]) >> 11

    def nearby(self, word: np.ndarray, bits: int) -> np.ndarray:
        """Numbers of the codewords nearest to each word and its one-bit neighbours, as rows padded with -1."""
        around = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.index(word[:, None] ^ around), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return -np.sort(-found, axis=1)[:, :6]


def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, print`` for every pair of codeword numbers of every two segments."""
    golay = Golay()
    for batch in batches:
        everything = batch.column(0).to_numpy()
        for begin in range(0, len(everything), 10_000):
            prints = everything[begin : begin + 10_000]
            u = prints.view(np.uint64)
            near = [golay.nearby(((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64), b) for s, b in SEGMENTS]
            for number, (i, j) in enumerate(combinations(range(3), 2)):
                a, b = near[i][:, :, None], near[j][:, None, :]
                row, x, y = np.nonzero((a >= 0) & (b >= 0))
                key = (number << 24) | (near[i][row, x] << 12) | near[j][row, y]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row])], ["key", "print"])


def _label_pairs(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Carry the smallest label along links ``a``-``b`` until nothing changes."""
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label[:] = label[label]
        if (before == label).all():
            return


def near_links(prints: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """For sorted groups of fingerprints, the place of one each is linked with, directly or through others of its group."""
    label = np.arange(len(prints))
    u = prints.view(np.uint64)
    small = size <= 64
    own = np.repeat(np.where(small, begin + size, 0), size)  # end of the group, 0 for a large one
    a_all, b_all = [], []
    i = np.flatnonzero(own > np.arange(len(prints)) + 1)
    lag = 1
    while len(i):
        i = i[i + lag < own[i]]
        near = np.bitwise_count(u[i] ^ u[i + lag]) <= most
        a_all.append(i[near]), b_all.append(i[near] + lag)
        lag += 1
    if a_all:
        _label_pairs(np.concatenate(a_all), np.concatenate(b_all), label)
    for b, n in zip(begin[~small], size[~small]):
        changed = True
        while changed:  # sweeps over pairs of blocks; only labels are kept, no pairs
            changed = False
            for x in range(b, b + n, BLOCK):
                for y in range(x, b + n, BLOCK):
                    xs, ys = slice(x, min(x + BLOCK, b + n)), slice(y, min(y + BLOCK, b + n))
                    near = np.bitwise_count(u[xs, None] ^ u[None, ys]) <= most
                    for one, other, link in ((xs, ys, near), (ys, xs, near.T)):
                        low = np.where(link, label[other][None, :], len(prints)).min(axis=1)
                        if (low < label[one]).any():
                            label[one] = np.minimum(label[one], low)
                            changed = True
    return label


def link_rows(most: int, defer: int | None):
    """Links of ``key, print`` sorted by key: ``print, other``, a few for each group; every group over ``defer`` is passed on whole."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(begin, len(keys)))
            many = size > (defer or len(keys))
            for b, n in zip(begin[many], size[many]):
                yield out(keys[b], prints[b : b + n], prints[b : b + n])
            prints, size = prints[np.repeat(~many, size)], size[~many]
            if not len(prints):
                return
            begin = np.cumsum(size) - size
            label = near_links(prints, begin, size, most)
            # The same fingerprint in several groups joins their links.
            linked = np.flatnonzero(label != np.arange(len(label)))
            pairs = np.unique(np.stack([prints[linked], prints[label[linked]]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield out(None, np.maximum(pairs[:, 0], pairs[:, 1]), np.minimum(pairs[:, 0], pairs[:, 1]))

        def out(key, a, b) -> pa.RecordBatch:
            keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key))
            return pa.RecordBatch.from_arrays([keys, pa.array(a), pa.array(b)], ["key", "print", "other"])

        keys, prints, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            k, p = (batch.column(i).to_numpy() for i in (0, 1))
            if passing is not None:  # more of a group that is passed on
                n = int(np.searchsorted(k, passing, side="right"))
                if n:
                    yield out(passing, p[:n], p[:n])
                k, p = k[n:], p[n:]
                if not len(k):
                    continue
                passing = None
            keys, prints = np.concatenate([keys, k]), np.concatenate([prints, p])
            if len(keys) < 200_000:
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from settle(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
            if defer and len(keys) > defer:
                passing = keys[0]
                yield out(passing, prints, prints)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield from settle(keys, prints)

    return compare


LINK_SCHEMA = "key bigint, print bigint, other bigint"


def links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (``print`` > ``other``) between distinct fingerprints: enough of them to connect all within ``most`` bits, none further apart."""
    keyed = prints.select("print").mapInArrow(pair_keys, "key bigint, print bigint")
    sorted_ = keyed.repartition(F.col("key")).sortWithinPartitions("key", "print")
    found = stored(sorted_.mapInArrow(link_rows(most, DEFER), LINK_SCHEMA), "simhash-links")
    pairs = found.filter("key is null").select("print", "other")
    rest = found.filter("key is not null").select("key", "print")
    parts = rest.groupBy("key").agg(F.ceil(F.count("*") / DEFER).cast("int").alias("parts"))
    if parts.limit(1).count():
        # Each part meets each other part in a task of its own.
        part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
        dealt = rest.join(parts, "key").withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cell = F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))
        cells = dealt.select(cell.alias("key"), "print").repartition(F.col("key")).sortWithinPartitions("key", "print")
        pairs = pairs.unionByName(cells.mapInArrow(link_rows(most, None), LINK_SCHEMA).select("print", "other"))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``edges`` (``print, other``), the root being the smallest node of its component.

    Large and small stars in turn: each round points every node to smaller neighbours. No neighbour list is gathered; a node's
    least neighbour is an aggregate and comes back by a join. Each round is written down, cutting the lineage.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("print", "other") % (1 << 31))).first())

    e = stored(edges, "components")
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("other").alias("print"), F.col("print").alias("other")))
        least = both.groupBy("print").agg(F.min("other").alias("least")).select("print", F.least("print", "least").alias("least"))
        large = both.filter("other > print").join(least, "print").select(F.col("other").alias("print"), F.col("least").alias("other")).distinct()
        low = large.groupBy("print").agg(F.min("other").alias("least"))
        small = large.join(low, "print").select(F.col("other").alias("print"), F.col("least").alias("other")).filter("print != other")
        e = stored(small.unionByName(low.select("print", F.col("least").alias("other"))).distinct(), "components")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("print").alias("node"), F.col("other").alias("root"))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Per row: ``doc_id, text_key, print, root, component_id``.

    A null or empty text has fingerprint zero and is linked like any other; a very long text has one fingerprint like any other, its
    hashes counted in pieces; repeated rows are reported each; an empty table gives no rows; of other columns none is read. Texts are linked if their fingerprints differ in ``most`` bits or fewer; the component's id is the smallest doc_id in it (null only
    if all are). Texts of one fingerprint are one node, so copies cost a row each and no pairs.
    """
    prints = stored(fingerprints(docs), "simhash-prints", rows=TEXT_ROWS)
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct, most))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "least_id")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.select("print", "root").join(ids, "root")
    return prints.join(known, "print").select("doc_id", "text_key", "print", "root", "component_id")


def keep_one(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, then the smallest text key; all columns stay.

    Rows repeated in full are one document. Only keys are moved: the texts pass a join with the keys of what goes.
    """
    found = stored(near_duplicates(docs, most), "simhash-found")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("best"))
    first = (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("best.text_key") == F.col("text_key"))
    rows = found.join(best, "root").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max(first).alias("first"))
    i, k, t = fresh("id"), fresh("key"), fresh("own")
    odd = stored(rows.filter("n > 1 or not first").select(F.col("doc_id").alias(i), F.col("text_key").alias(k), "first"), "simhash-odd")
    named = docs.withColumn(t, text_key(docs["text"]))

    def same(right: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(right[i]) & (F.col(t) == right[k])

    gone = small(odd)
    kept = named.join(gone, same(gone), "left_anti").select(*docs.columns)
    again = odd.filter("first")
    if again.limit(1).count():
        once = F.row_number().over(Window.partitionBy(docs["doc_id"], F.col(t)).orderBy(F.lit(0)))
        repeated = named.join(small(again), same(again), "left_semi").withColumn(r := fresh("nth"), once).filter(F.col(r) == 1)
        kept = kept.unionByName(repeated.select(*docs.columns))
    return kept
