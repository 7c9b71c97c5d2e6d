"""Token sequences of one length, packed almost without padding.

A document's ids are cut into windows of ``SEQUENCE`` ids; a full window is a sequence by itself, what is left over is its tail. All that
packing has to know of the tails is how many there are of each length, at most ``SEQUENCE - 1`` numbers whatever the corpus.
Windows are filled from that multiset by minimum bin slack: the longest length left goes in, a subset-sum over
bitsets finds the counts of the other lengths that come closest to the capacity, and the same mix is taken as often as the counts allow.
A mix leaves a length with fewer than half of what there was or with none, so a plan has at most some 12 mixes for a length.
A length that no mix completes any more cannot be completed later either, as the stock only shrinks: what is left of it is run
on end to end and cut at the window borders, the last window at powers of two, which need no padding.

Tails are then numbered within their length (counts by task, added up), and their number gives sequence and offset by arithmetic.

Defined cases: a null or empty text has the end mark alone. Rows repeated in full are packed each. Very long texts are so many windows;
only their tails are shuffled. An empty table gives no pieces. Of other columns, whatever their names, none is read or returned.
"""

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import full_text, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END_MARK = 1
SEQUENCE = 2048
ROWS = 500  # texts in memory with their ids
RANK_BITS = 48


# ------------------------------------------------------------------ the plan
def closest(stock: list[tuple[int, int]], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` that lengths of ``stock`` (length and count, longest first) make, and the count of each in it.

    Bit ``s`` of a bitset says whether the lengths so far make ``s``; the bitsets before each length are kept to find the counts.
    """
    within, reach, before = (2 << room) - 1, 1, []
    for length, count in stock:
        if reach >> room & 1:
            break
        if length > room or not count:
            continue
        before.append((length, reach))
        left, step = min(count, room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << length * step) & within
            left, step = left - step, step * 2
    best = at = reach.bit_length() - 1
    mix = {}
    for length, reached in reversed(before):
        count = 0
        while not reached >> at & 1:
            at, count = at - length, count + 1
        if count:
            mix[length] = count
    return best, mix


class Plan(NamedTuple):
    """Rows of mixes sorted by length and first rank, and where the lengths left over run on."""

    rows: np.ndarray  # code of (length, first rank), how many in a window, first sequence, offset in it
    run_on: dict[int, tuple[int, int]]  # length: first rank, first token
    borders: np.ndarray  # of the sequences that are run on, in tokens
    sequences: int


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> Plan:
    """``counts``: tails by their length, each shorter than ``sequence``."""
    left, used, rows, window = dict(counts), Counter(), [], 0
    lengths = sorted(left, reverse=True)
    for place, longest in enumerate(lengths):
        while left[longest]:
            room = sequence - longest
            stock = [(longest, left[longest] - 1), *((n, left[n]) for n in lengths[place + 1 :])]
            best, mix = closest(stock, room)
            if best < room:
                break
            mix[longest] = mix.get(longest, 0) + 1
            times, offset = min(left[n] // k for n, k in mix.items()), 0
            for n, k in mix.items():
                rows.append((n << RANK_BITS | used[n], k, window, offset))
                used[n] += k * times
                left[n] -= k * times
                offset += k * n
            window += times
    run_on, at = {}, 0
    for n in lengths:
        if left[n]:
            run_on[n] = (used[n], at)
            at += n * left[n]
    rest = at % sequence
    powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    borders = np.cumsum([0, *[sequence] * (at // sequence), *powers], dtype=np.int64)
    table = np.array(sorted(rows) or np.empty((0, 4)), np.int64).reshape(-1, 4)
    return Plan(table, run_on, borders, window)


def places(found: Plan, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For tails by length and rank: ``row, start in the tail, length, sequence, offset`` of their pieces, in two parts."""
    first = np.array([found.run_on.get(n, (1 << RANK_BITS, 0))[0] for n in length.tolist()], np.int64)
    mixed = np.flatnonzero(rank < first)
    if len(mixed):
        n, r = length[mixed], rank[mixed]
        row = found.rows[np.searchsorted(found.rows[:, 0], n << RANK_BITS | r, "right") - 1]
        ordinal = (n << RANK_BITS | r) - row[:, 0]
        yield mixed, np.zeros_like(n), n, row[:, 2] + ordinal // row[:, 1], row[:, 3] + ordinal % row[:, 1] * n
    rest = np.flatnonzero(rank >= first)
    if len(rest):
        n = length[rest]
        start = np.array([found.run_on[x][1] for x in n.tolist()], np.int64) + (rank[rest] - first[rest]) * n
        low = np.searchsorted(found.borders, start, "right") - 1
        count = np.searchsorted(found.borders, start + n, "left") - low
        owner = np.repeat(np.arange(len(n)), count)
        which = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.maximum(found.borders[which], start[owner])
        end = np.minimum(found.borders[which + 1], (start + n)[owner])
        yield rest[owner], begin - start[owner], end - begin, found.sequences + which, begin - found.borders[which]


# ------------------------------------------------------------------ ids
# Fixed value: how byte-level vocabularies cut text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, from a vocabulary file of ``tokenizers``.

    A byte-level vocabulary whose merged pieces are numbered in the order of its merges is encoded by tiktoken's merging, which gives
    the same ids in a fifth of the time: inside the limits of a piece all earlier merges have run as they would on the piece alone,
    so the next pair is the one the file lists. Marks of the vocabulary in a text are their own ids. Any other
    vocabulary goes through ``tokenizers``.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        known = json.loads(vocabulary)
        self.marks = {t["content"]: t["id"] for t in known["added_tokens"]}
        self.mark = re.compile("|".join(re.escape(m) for m in sorted(self.marks, key=len, reverse=True)) or r"(?!)")
        self.tokenizer, self.merging = Tokenizer.from_str(vocabulary), None
        if self._plain(known):
            import tiktoken

            byte = byte_of()
            ranks = {bytes(byte[c] for c in piece): i for piece, i in known["model"]["vocab"].items() if piece not in self.marks}
            self.merging = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _plain(known: dict) -> bool:
        model, cut = known["model"], known["pre_tokenizer"] or {}
        if model["type"] != "BPE" or known["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            return False
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        if any(t[k] for t in known["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return False
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        return all(a < b for a, b in zip(merged, merged[1:])) and len(model["vocab"]) <= len(merged) + 256 + len(known["added_tokens"])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.merging is None:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        return [array("I", self._merge(t)).tobytes() for t in texts]

    def _merge(self, text: str) -> list[int]:
        encode = self.merging.encode_ordinary
        ids, at = [], 0
        for m in self.mark.finditer(text):
            ids += encode(text[at : m.start()])
            ids.append(self.marks[m[0]])
            at = m.end()
        return ids + encode(text[at:]) if at else encode(text)


CUT = "doc_id bigint, doc_tokens bigint, start bigint, length int, part int, nth bigint, ids binary"


def cut_windows(vocabulary, sequence: int, end_mark: int):
    """``doc_id, text`` to windows and tails, numbered within their task and length."""
    end = end_mark.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode, seen, part = Encoder(vocabulary.value), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                some = batch.slice(begin, ROWS)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    tokens = len(ids) // 4
                    for start in range(0, tokens, sequence):
                        length = min(sequence, tokens - start)
                        rows.append((doc, tokens, start, length, part, seen[length], ids[4 * start : 4 * (start + length)]))
                        seen[length] += 1
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "doc_tokens", "start", "length", "part", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def put_tails(found, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tails (``doc_id, doc_tokens, start, length, rank, ids``) to pieces with their places."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for batch in (b.slice(i, 4 * ROWS) for b in batches for i in range(0, b.num_rows, 4 * ROWS)):
        length = batch.column(3).to_numpy().astype(np.int64)
        for row, inside, n, sequence, offset in places(found.value, length, batch.column(4).to_numpy()):
            some = batch.take(pa.array(row))
            ids = some.column(5)
            if (n != length[row]).any():
                cut = zip(ids.to_pylist(), inside.tolist(), n.tolist(), strict=True)
                ids = pa.array([x[4 * a : 4 * (a + k)] for x, a, k in cut], pa.binary())
            start = pa.array(some.column(2).to_numpy() + inside)
            columns = [some.column(0), start, pa.array(n), ids, some.column(1), pa.array(2 * sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, end_mark: int = END_MARK) -> DataFrame:
    """All ids of ``docs`` (``doc_id, text``) as pieces of sequences of at most ``sequence`` ids, ``ids`` in little-endian 32-bit numbers.

    A sequence of fewer ids has a power of two of them, so none needs padding. Sequences that are one window of one document have odd
    numbers, the packed ones even numbers. ``tokenizer`` is read by the driver and sent to the executors.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint"), full_text().alias("text"))
    pieces = stored(rows.mapInArrow(cut_windows(vocabulary, sequence, end_mark), CUT), "packing-windows", "zstd")
    window = pieces.filter(F.col("length") == sequence).select(
        "doc_id", "start", F.col("length").cast("bigint"), "ids", "doc_tokens",
        (F.shiftleft(F.col("part").cast("bigint"), 34) + F.col("nth") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    tails = pieces.filter(F.col("length") < sequence)
    counts = stored(tails.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    stock = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a number for each length
    found = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in stock}, sequence))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = tails.join(before, ["part", "length"]).select("doc_id", "doc_tokens", "start", "length", (F.col("before") + F.col("nth")).alias("rank"), "ids")
    return window.unionByName(ranked.mapInArrow(lambda batches: put_tails(found, batches), PIECES))


def sequences(pieces: DataFrame) -> DataFrame:
    """Pieces to whole sequences: ``sequence_id, length, ids`` and ``documents``, the id and first offset of each part."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    documents = F.transform("parts", lambda p: F.struct(p["doc_id"], p["offset"]))
    return rows.select("sequence_id", "length", ids.alias("ids"), documents.alias("documents"))
