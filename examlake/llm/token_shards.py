"""Token ids in training order, in fixed-stride shards.

All texts, each with an end mark, are one stream of tokens cut into sequences of equal length. A keyed Feistel permutation,
walked until it lands inside, gives every sequence a global slot. Ranges of slots are shards: files of records of
one size, so a reader finds slot ``k`` by arithmetic and resumes anywhere.
"""

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import TEXT_ROWS, full_text, small, stored
from examlake.session import shared_folder

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_MARK = 50256  # the free id of the vocabulary
# Fixed value: how the public vocabulary cuts text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE, PER_SHARD, KEY = 2048, 4096, 0x5EED
ROUNDS = 4
TASKS = 10_000  # tasks that write shards, at most


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def slots(sequence: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slot of each sequence number below ``total``: a permutation of 0 .. total - 1.

    A balanced Feistel network permutes the least even number of bits that holds ``total``; numbers that land outside
    go through it again until they are inside.
    """
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = sequence.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


class Encoder:
    """Ids of a text as little-endian 16-bit numbers, with the end mark.

    A text is encoded in one call: a memory of words costs more than it saves where many words occur once.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = END_MARK.to_bytes(2, "little")

    def __call__(self, text: str) -> bytes:
        ids = array("H", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes() + self.end


@lru_cache(maxsize=1)
def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary, read once by a worker however many tasks it runs."""
    return Encoder(vocabulary)


TOKEN_SCHEMA = "task int, start bigint, doc_id bigint, n int, tokens binary"


def tokenize(vocabulary: bytes):
    """``doc_id, text`` to ids, with the tokens that went before in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, task = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                tokens = [encode(t) for t in part.column(1).to_pylist()]
                n = np.array([len(t) // 2 for t in tokens], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), task, np.int32)), pa.array(starts), part.column(0), pa.array(n.astype(np.int32)), pa.array(tokens, pa.binary())],
                    ["task", "start", "doc_id", "n", "tokens"],
                )

    return run


def pieces(length: int, total: int, per_shard: int, tasks: int, key: int):
    """Parts of texts by the sequence they fall in: ``part, slot, at, doc_id, tokens``, the tokens compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=9).compress
        for batch in batches:
            start, ids = batch.column(0).to_numpy(), batch.column(1)
            n, tokens = batch.column(2).to_numpy().astype(np.int64), batch.column(3)
            count = (start + n - 1) // length - start // length + 1
            owner = np.repeat(np.arange(len(n)), count)
            sequence = start[owner] // length + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(sequence * length, start[owner])
            high = np.minimum((sequence + 1) * length, (start + n)[owner])
            slot = slots(sequence, total, key)
            for begin in range(0, len(owner), 2_000):
                s = slice(begin, begin + 2_000)
                parts = []
                last, data = -1, b""
                for o, a, b in zip(owner[s].tolist(), (low - start[owner])[s].tolist(), (high - start[owner])[s].tolist()):
                    if o != last:
                        last, data = o, memoryview(tokens[o].as_py())
                    parts.append(pack(data[2 * a : 2 * b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((slot[s] // per_shard % tasks).astype(np.int32)), pa.array(slot[s]), pa.array((low % length)[s].astype(np.int32)),
                        ids.take(pa.array(owner[s])), pa.array(parts, pa.binary()),
                    ],
                    ["part", "slot", "at", "doc_id", "tokens"],
                )

    return run


MANIFEST = "slot bigint, shard bigint, record int, n_tokens int, doc_ids array<bigint>, tokens_sha256 string"


def write_shards(folder: str, length: int, per_shard: int):
    """Shard files from pieces sorted by slot and place; returns the manifest rows of their sequences.

    A shard is written under a name of the attempt and then moved, so a task that is run again replaces it as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        attempt = TaskContext.get().taskAttemptId()
        rows: list[tuple] = []
        sink, shard, slot, record, docs = None, None, None, bytearray(), []

        def close() -> None:
            if sink is not None:
                sink.close()
                files.move(f"{root}/.{shard:08d}.{attempt}", f"{root}/{shard:08d}.bin")

        def finish() -> None:
            n = len(record) // 2
            record.extend(END_MARK.to_bytes(2, "little") * (length - n))
            sink.write(bytes(record))
            rows.append((slot, shard, slot % per_shard, n, docs, hashlib.sha256(record).hexdigest()))

        def made() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]
            columns = list(zip(*rows)) or [[]] * 6
            names = ["slot", "shard", "record", "n_tokens", "doc_ids", "tokens_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for to, doc, tokens in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if to != slot:
                    if slot is not None:
                        finish()
                    slot, record, docs = to, bytearray(), []
                    if to // per_shard != shard:
                        close()
                        shard = to // per_shard
                        sink = files.open_output_stream(f"{root}/.{shard:08d}.{attempt}")
                record.extend(unpack(tokens))
                docs.append(doc)
            if len(rows) >= 1000:
                yield made()
                rows = []
        if slot is not None:
            finish()
            close()
        yield made()

    return run


def materialize(
    docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = KEY
) -> DataFrame:
    """Write the shards of ``docs`` below ``folder`` and return their manifest.

    Per sequence: ``slot, shard, record`` (its place in the shard), ``n_tokens`` (less than ``length`` in the last sequence only, which end marks
    fill), ``doc_ids`` in it and ``tokens_sha256``. Slot ``k`` is at byte ``record * 2 * length`` of its shard. A null or empty text is its end mark
    alone; repeated rows are texts of their own; columns other than ``doc_id`` and ``text`` are not read; an empty table gives no sequence.
    The stream is in the order of the tokenized table, which is written first, so that every later step sees the same.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-shards")
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text"))
    tokens = stored(texts.mapInArrow(tokenize(vocabulary), TOKEN_SCHEMA), "tokens", "zstd", rows=TEXT_ROWS)
    # One row per task of the step before.
    sums = tokens.groupBy("task").agg(F.sum("n").alias("sum"))
    before = F.sum("sum").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = stored(sums.select("task", (before - F.col("sum")).alias("offset"), before.alias("through")), "token-offsets")
    total = offsets.agg(F.max("through")).first()[0] or 0
    count = -(-total // length)
    shards = max(1, -(-count // per_shard))
    tasks = min(shards, TASKS)
    rows = tokens.join(small(offsets), "task").select((F.col("start") + F.col("offset")).alias("start"), "doc_id", "n", "tokens")
    cut = rows.mapInArrow(pieces(length, max(count, 1), per_shard, tasks, key), "part int, slot bigint, at int, doc_id bigint, tokens binary")
    dealt = cut.repartitionById(tasks, F.col("part")).sortWithinPartitions("slot", "at")
    _make_folder(folder)
    return stored(dealt.mapInArrow(write_shards(folder, length, per_shard), MANIFEST), "token-manifest", rows=TEXT_ROWS).orderBy("slot")


def _make_folder(folder: str) -> None:
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)


def read_slots(folder: str, first: int, count: int, length: int = SEQUENCE, per_shard: int = PER_SHARD) -> np.ndarray:
    """Sequences from slot ``first`` on, as rows of ids; reads only their bytes."""
    files, root = fs.FileSystem.from_uri(folder)
    out, slot, stride = [], first, 2 * length
    while slot < first + count:
        n = min(first + count - slot, per_shard - slot % per_shard)
        with files.open_input_file(f"{root}/{slot // per_shard:08d}.bin") as f:
            f.seek(slot % per_shard * stride)
            out.append(np.frombuffer(f.read(n * stride), "<u2").reshape(-1, length))
        slot += n
    return np.concatenate(out)
