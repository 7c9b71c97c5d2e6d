"""Anchors: where to look for repeated windows without moving every window.

Each window of ``width`` symbols names one place in it, the least hash of its ``gram`` symbols (the first of equal ones).
Equal windows name the same place in them, so they meet at equal anchors. Neighbouring windows mostly share
an anchor: only about one place in ``width / 2`` is one. Anchors that occur once are dropped; around the others, a
``context`` holds the symbols of all windows that name this anchor.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import full_text

U = np.uint64
MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
CHUNK = 1 << 20  # symbols of heavy windows settled at once; above it a text is a chunk of its own
STEP = 1 << 16  # symbols hashed at once, so that the arrays stay in a core's cache
POSITION_BITS = U(32)

ANCHOR_SCHEMA = "anchor bigint, salt int, row bigint, packed bigint"  # packed: size, then at in 32 bits
# More occurrences of an anchor than this, and its windows are compared one by one, by the hash of the whole window.
HEAVY = 20_000
NO_DOC = -(1 << 63)  # stands for a null id


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int
    across_docs: bool  # a repeat counts only between different documents


def mix(x: np.ndarray) -> np.ndarray:
    out = x >> U(32)
    out ^= x
    out *= MIX1
    shifted = out >> U(29)
    out ^= shifted
    out *= MIX2
    np.right_shift(out, U(32), out=shifted)
    out ^= shifted
    return out


def mixed(symbols: np.ndarray, seed: int) -> np.ndarray:
    """``mix`` of each symbol plus ``seed``; bytes are looked up."""
    if symbols.dtype == np.uint8:
        return mix(np.arange(256, dtype=U) + U(seed))[symbols]
    return mix(symbols.astype(U) + U(seed))


def gram_hashes(symbols: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the ``k`` symbols from each place on (``len - k + 1`` of them), by doubling."""
    out, done, block, size, m = None, 0, mixed(symbols, seed), 1, len(symbols)
    while True:
        if k & size:
            part = block[done : done + m - k + 1]
            out = part if out is None else mix(out * MIX1 + part)
            done += size
        if done == k:
            return out
        block = mix(block[:-size] * MIX2 + block[size:])
        size *= 2


def find_anchors(symbols: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: hash, text number, first window (within its text) and number of windows."""
    n, w = len(symbols), shape.width - shape.gram + 1
    none = np.zeros(0, np.int64)
    if n < shape.width:
        return none, none, none, none
    hashes = gram_hashes(symbols, shape.gram)
    packed = (hashes & ~U((1 << 32) - 1)) | np.arange(len(hashes), dtype=U)
    pad = -len(packed) % w
    blocks = np.concatenate([packed, np.full(pad, ~U(0), U)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - shape.width + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    lengths = np.diff(np.append(starts, n))
    text = np.repeat(np.arange(len(starts)), lengths)
    valid = np.flatnonzero(text[:count] == text[shape.width - 1 :])
    if not len(valid):
        return none, none, none, none
    place = (least[valid] & U((1 << 32) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    runs = np.diff(np.append(first, len(valid)))
    owner = text[valid[first]]
    return hashes[place[first]].view(np.int64), owner, valid[first] - starts[owner], runs


def chunks(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of texts of about ``most`` symbols together."""
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def all_anchors(values: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Anchors of a batch of texts, in the order of the texts."""
    found = [(np.zeros(0, np.int64),) * 4]
    for part in chunks(np.diff(offsets), STEP):
        low, high = offsets[part.start], offsets[part.stop]
        a, t, s, n = find_anchors(values[low:high], offsets[part.start : part.stop] - low, shape)
        found.append((a, t + part.start, s, n))
    return tuple(np.concatenate(x) for x in zip(*found))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> or of a binary column, without copying them to Python objects."""
    if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(U), column.offsets.to_numpy().astype(np.int64)


def anchor_rows(shape: Shape) -> Callable:
    """Anchors of a batch of ``row, doc, symbols``.

    An anchor met again in its batch is surely repeated: its later occurrences are salted, so that a common one
    does not gather in one task; the first stands for them, and its ``size`` counts them. Theirs is 0; 1 is not sure.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            values, offsets = list_parts(batch.column(2))
            a, t, s, _ = all_anchors(values, offsets, shape)
            doc = docs[t]
            order = np.lexsort((doc, a))
            a, t, s, doc = a[order], t[order], s[order], doc[order]
            if len(a):
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                size = np.diff(np.append(first, len(a)))
                many = doc[first] != doc[first + size - 1] if shape.across_docs else size > 1
                sure = np.repeat(many, size)
                salt = np.where(sure, np.arange(len(a)) - np.repeat(first, size), 0)
                stands = np.where(salt > 0, 0, np.where(sure, np.repeat(size, size), 1))
                # Back in the order of the texts: rows of one text next to each other take less room in a shuffle.
                back = np.argsort(order)
                a, t, s, salt, stands = (x[back] for x in (a, t, s, salt, stands))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(salt.astype(np.int32)), pa.array(rows[t]), pa.array((stands << 32) | s)],
                    ["anchor", "salt", "row", "packed"],
                )

    return scan


def repeated_anchors(symbols: DataFrame, shape: Shape) -> DataFrame:
    """Per ``row`` of ``symbols`` (row, doc, symbols): ``anchors``, the (at, heavy) that occur elsewhere too.

    With ``across_docs``, different rows stand for different documents here; rows of one id are told apart later.
    """
    rows = symbols.mapInArrow(anchor_rows(shape), ANCHOR_SCHEMA).repartition(F.col("anchor"), F.col("salt"))
    group = Window.partitionBy("anchor", "salt")
    again = F.min("row").over(group) != F.max("row").over(group) if shape.across_docs else F.count("*").over(group) > 1
    size, at = F.shiftright("packed", 32), F.col("packed").bitwiseAND((1 << 32) - 1).cast("int").alias("at")
    # All occurrences of an anchor are counted where its salt is 0. Both sides name every column, so they read one shuffle.
    counts = rows.groupBy("anchor", "salt").agg(F.sum(size).alias("total"), F.max("row").alias("most_row"))
    heavy = counts.filter(F.col("total") > HEAVY).select(F.col("anchor").alias("heavy_anchor"), F.col("most_row").isNotNull().alias("heavy"))
    seen = rows.withColumn("again", again).filter(F.col("again") | (size != 1))
    # At most one anchor for each HEAVY occurrences. A plain equality would filter nulls below one side's shuffle, and part the two.
    flagged = seen.join(F.broadcast(heavy), seen["anchor"].eqNullSafe(heavy["heavy_anchor"]), "left")
    return flagged.groupBy("row").agg(F.collect_set(F.struct(at, F.coalesce("heavy", F.lit(False)).alias("heavy"))).alias("anchors"))


KEPT_BYTES = 5  # of a word's hash in a context
CONTEXT_SCHEMA = "g bigint, row bigint, doc bigint, at int, n int, weight int, done boolean, context binary"
HASH_BYTES = 8  # a context of one window is sent as its second hash, its first is the group; others are longer
SENT_NAMES = ["g", "row", "doc", "at", "n", "weight", "done", "context"]
CONTEXT_NAMES = ["g", "c1", "c2", "row", "doc", "at", "n", "weight", "done", "context"]


def context_rows(shape: Shape) -> Callable:
    """Contexts of a batch of ``row, doc, symbols, anchors``, keyed by group and by the hash of what they hold.

    Equal contexts of a batch are settled here but for one: with ``across_docs`` those of a later document than the
    first are repeated, otherwise all of them are. They leave as ``done``, with a key of their own. The single windows
    of heavy anchors are worked on about CHUNK at once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            values, offsets = list_parts(batch.column(2))
            anchors = batch.column(3)
            flat = anchors.values
            owner = np.repeat(np.arange(len(anchors)), np.diff(anchors.offsets.to_numpy()))
            low = int(anchors.offsets[0].as_py()) if len(anchors) else 0
            at, heavy = (flat.field(i).to_numpy(zero_copy_only=False)[low : low + len(owner)] for i in range(2))
            at = at.astype(np.int64)
            # Found again rather than shuffled: a text's anchors follow from its symbols.
            a, text, first, n = all_anchors(values, offsets, shape)
            of = np.searchsorted((text << 32) + first, (owner << 32) + at)
            a, n = a[of], n[of]
            order = np.lexsort((at, owner))
            light, single = order[~heavy[order]], order[heavy[order]]
            if len(light):
                yield from settled_rows(shape, values, offsets, rows, docs, owner[light], a[light], at[light], n[light])
            for part in chunks(n[single], CHUNK):
                many = n[single[part]]
                reps = np.repeat(single[part], many)
                step = np.arange(len(reps)) - np.repeat(np.cumsum(many) - many, many)
                yield from settled_rows(shape, values, offsets, rows, docs, owner[reps], None, at[reps] + step, np.ones(len(reps), np.int64))

    return cut


def settled_rows(
    shape: Shape, values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, docs: np.ndarray, owner: np.ndarray, a: np.ndarray | None, at: np.ndarray, n: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of the texts, equal ones settled; without anchors ``a`` each is one window, grouped by its hash."""
    begin, length = offsets[owner] + at, n + shape.width - 1
    c1, c2 = context_hashes(values, begin, length)
    doc, row = docs[owner], rows[owner]
    g = c1 if a is None else a
    order = np.lexsort((doc, c2, c1, g))
    new = np.concatenate([[True], np.any([x[order[1:]] != x[order[:-1]] for x in (g, c1, c2)], axis=0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(g)))
    done, weight = np.empty(len(g), bool), np.empty(len(g), np.int64)
    done[order] = doc[order] != np.repeat(doc[order[first]], size) if shape.across_docs else ~new
    weight[order] = np.where(new, np.repeat(size, size), 1)
    if a is None:  # neighbours of one text that are settled, or equal, leave as one run
        run = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (done[1:] == done[:-1])
        run &= done[1:] | ((c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1]))
        heads = np.flatnonzero(np.concatenate([[True], ~run]))
        n, weight = np.add.reduceat(n, heads), np.maximum.reduceat(weight, heads)
        g, c2, row, doc, at, done, begin, length = (x[heads] for x in (g, c2, row, doc, at, done, begin, length))
    # What is settled needs no hash and any group; neighbours of one text stay together, in blocks, and take less room.
    block = mix(row.view(U) + (np.arange(len(g)) // 64).astype(U)).view(np.int64)
    g = np.where(done, block, g)
    narrow = values if values.itemsize == 1 else values.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
    for lo in range(0, len(g), 20_000):
        hi = min(lo + 20_000, len(g))
        ended = done[lo:hi].tolist()
        if a is None:
            hashes = c2[lo:hi].tobytes()
            texts = [None if d else hashes[i : i + HASH_BYTES] for i, d in zip(range(0, len(hashes), HASH_BYTES), ended)]
        else:
            texts = [None if d else narrow[b : b + m].tobytes() for b, m, d in zip(begin[lo:hi].tolist(), length[lo:hi].tolist(), ended)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(g[lo:hi]), pa.array(row[lo:hi]), pa.array(doc[lo:hi]),
                pa.array(at[lo:hi].astype(np.int32)), pa.array(n[lo:hi].astype(np.int32)), pa.array(weight[lo:hi].astype(np.int32)), pa.array(done[lo:hi]), pa.array(texts, pa.binary()),
            ],
            SENT_NAMES,
        )


def context_hashes(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of ranges of ``values``; those that begin within STEP symbols are worked on together."""
    out = np.empty((2, len(begin)), np.int64)
    order = np.argsort(begin, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(begin[order] // STEP)) + 1):
        if len(part):
            out[:, part] = range_hashes(values, begin[part], length[part])
    return out[0], out[1]


@lru_cache(4)
def powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse."""
    return tuple(np.cumprod(np.full(n, x, U)) for x in (base, pow(base, -1, 1 << 64)))


def range_hashes(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each range, from running sums of hashed symbols times powers of an odd number; where a range stands doesn't matter."""
    out = []
    for seed, base in ((1, MIX1), (7, MIX2)):
        low, high = int(begin.min()), int((begin + length).max())
        powers, back = powers_of(int(base), 1 << (high - low).bit_length())
        sums = np.concatenate([[U(0)], np.cumsum(mixed(values[low:high], seed) * powers[: high - low])])
        raw = (sums[begin + length - low] - sums[begin - low]) * back[begin - low]
        out.append(mix(raw + length.astype(U)).view(np.int64))
    return out


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[dict[str, np.ndarray], list]]:
    """Rows sorted by group, given on in pieces of about ``most`` bytes that hold whole groups.

    A group of one window sent as its hash may be of any size: it goes on in the next piece, after its first row once more,
    which has the least document and makes the count more than one. A group's equal contexts follow one another.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    head, key = None, None  # first row of the last context so far
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(i).to_numpy() for i in range(3)]
        g = ids[0]
        if key != (key := tuple(x[-1] for x in ids)):
            head = batch.slice(batch.num_rows - int(np.count_nonzero(np.all([x == x[-1] for x in ids], axis=0))), 1)
        size += batch.nbytes
        if size < most:
            held.append(batch)
            continue
        if not batch.column(8)[-1].as_py() and not batch.column(9)[-1].is_valid:
            yield _columns([*held, batch])
            held, size = [head], head.nbytes
            continue
        last = int(np.searchsorted(g, g[-1]))  # the last group may go on
        if last == 0:
            held.append(batch)
            continue
        held.append(batch.slice(0, last))
        yield _columns(held)
        held, size = [batch.slice(last)], batch.nbytes * (batch.num_rows - last) // batch.num_rows
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], pa.Array]:
    t = pa.Table.from_batches(held).combine_chunks()
    columns = {c: t.column(c).to_numpy() for c in CONTEXT_NAMES[:-1]}
    return columns, t.column("context").combine_chunks() if t.num_rows else pa.array([], pa.binary())


def repeated_spans(keyed: DataFrame, symbols: Callable, shape: Shape, judge: Callable) -> DataFrame:
    """``row`` with ``spans``: (at, n) runs of windows that ``judge`` finds repeated in their groups.

    ``keyed`` has ``row, doc_id, text``; ``symbols`` makes the sequence to search of a text. The texts of documents with a repeated
    anchor are shuffled once; a caller that joins the same frame by ``row`` afterwards reads that shuffle again.
    """
    doc = F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc")
    made = symbols(F.col("text")).alias("symbols")
    anchors = repeated_anchors(keyed.select("row", doc, made), shape)
    joined = keyed.join(anchors, "row").select("row", doc, made, "anchors")
    contexts = joined.mapInArrow(context_rows(shape), CONTEXT_SCHEMA)
    # The hash that tells contexts apart is made after the shuffle, which carries what it is made of.
    hashed = contexts.repartition(F.col("g")).withColumns(
        {
            "c1": F.xxhash64("context"),
            "c2": F.xxhash64(F.lit(7), "context"),
            "context": F.when(F.octet_length("context") > HASH_BYTES, F.col("context")),
        }
    )
    parted = hashed.select(*CONTEXT_NAMES).sortWithinPartitions("g", "c1", "c2", "doc")
    marks = parted.mapInArrow(judge, "row bigint, at int, n int")
    return marks.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, the key of its id and text, and its null text empty."""
    return docs.withColumn("text", full_text()).withColumn("row", F.xxhash64("doc_id", "text"))

