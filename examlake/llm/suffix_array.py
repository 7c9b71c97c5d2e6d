"""Suffix-array dedup by bytes.

Contexts of repeated anchors are gathered in shards. Each shard gets a suffix array by Larsson-Sadakane refinement and
common prefixes by Kasai's rule; suffixes with 200 bytes in common are repeats. A group of contexts too
large for one shard takes several, whose windows are looked up in each other's suffix arrays by binary search.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.anchors import Shape, U, groups, keyed_rows, list_parts, repeated_spans

WIDTH = 200
SHAPE = Shape(width=WIDTH, gram=24, across_docs=False)
PIECE = 8 << 20  # bytes of rows taken together
SHARD = 1 << 20  # bytes of a shard
PART = 1 << 17  # bytes of the groups that share a shard; a larger group has shards of its own
FIRST_BYTES = U(1) << (U(8) * np.arange(1, 8, dtype=U))  # a number of eight bytes below the i-th begins with 7 - i zero bytes
END = 0xFF  # stands between texts; no UTF-8 text holds it


def next_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; past the end they count as zero."""
    key = np.concatenate([data, np.zeros(7, np.uint8)]).astype(U)
    for size in (1, 2, 4):
        key = (key[:-size] << U(8 * size)) | key[size:]
    return key


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` bytes at least.

    Sorted by eight bytes first; then suffixes that are still equal are sorted by the rank of what follows, which doubles the
    bytes known at each step. Sorted ones are left alone.
    """
    n = len(data)
    key = next_bytes(data)
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank, known = np.empty(n + 1, np.int64), 8
    rank[n] = -1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(slots) and known < depth:
        at = order[slots]
        both = (rank[at] << 32) | (rank[np.minimum(at + known, n)] + 1)
        by = np.argsort(both)
        order[slots] = at = at[by]
        both = both[by]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(slots)))
        rank[at] = np.repeat(slots[start], size)
        slots = slots[np.repeat(size > 1, size)]
        known *= 2
    return order


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, counted up to ``most``."""
    n, out = len(data), np.zeros(len(a), np.int64)
    key = next_bytes(data)
    left, x, y = np.arange(len(a)), a, b
    while True:
        inside = (np.maximum(x, y) < n) & (out[left] < most)
        left, x, y = left[inside], x[inside], y[inside]
        if not len(left):
            return out
        # Eight bytes at a time; the first that differs ends it, as does the end of the data.
        differ = key[x] ^ key[y]
        ends = np.flatnonzero(differ)
        run = np.full(len(left), 8)
        run[ends] = (differ[ends, None] < FIRST_BYTES).sum(axis=1)
        run = np.minimum(run, n - np.maximum(x, y))
        out[left] += run
        going = run == 8
        left, x, y = left[going], x[going] + 8, y[going] + 8


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before, exact below ``most``.

    Kasai: if the suffix at ``i`` follows the one at ``j``, and ``i + 1`` follows ``j + 1``, the latter pair shares one byte
    less. Only the heads of such chains are compared byte by byte.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = before[1:] != before[:-1] + 1
    head[0] = True
    head |= before < 0
    chain = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    longest = int(np.max(np.diff(np.append(np.flatnonzero(head), n)))) if n else 0
    shared = np.zeros(n, np.int64)
    todo = np.flatnonzero(head & (before >= 0))
    while len(todo):
        shared[todo] = _common(data, todo, before[todo], most + longest)
        value = shared[chain] - (np.arange(n) - chain)
        value[before < 0] = 0
        # Where a chain has run out, it starts anew.
        bad = value < 0
        if not bad.any():
            shared = value
            break
        fresh = np.flatnonzero(bad & ~np.concatenate([[False], bad[:-1]]))
        head[fresh] = True
        chain = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        todo = fresh
    return np.minimum(shared, most)[order]


class Shard:
    """The suffix array of some contexts laid end to end."""

    def __init__(self, texts: list[bytes], width: int = WIDTH):
        self.width, self.texts = width, texts
        self.data = np.frombuffer(bytes([END]).join(texts) + bytes([END]), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        windows = lengths - (width - 1)
        begins = np.cumsum(lengths + 1) - lengths - 1
        self.owner = np.repeat(np.arange(len(texts)), windows)
        self.step = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.window_at = begins[self.owner] + self.step
        self.order = suffix_order(self.data, width)
        self.shared = common_prefixes(self.data, self.order, width)

    def classes(self) -> np.ndarray:
        """For each window, the number of its class of equal windows."""
        number = np.empty(len(self.data), np.int64)
        number[self.order] = np.cumsum(self.shared < self.width) - 1
        return number[self.window_at]

    def holds(self, other: "Shard", texts: np.ndarray) -> np.ndarray:
        """Which windows of the marked ``texts`` of ``other`` start a suffix here: a binary search for each, all at once."""
        out = np.zeros(len(other.window_at), bool)
        wanted_at = np.flatnonzero(texts[other.owner])
        for begin in range(0, len(wanted_at), 20_000):
            part = wanted_at[begin : begin + 20_000]
            at = other.window_at[part]
            wanted = _windows(other.data, at, self.width)
            low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
            while (low < high).any():
                middle = (low + high) // 2
                less = _less(_windows(self.data, self.order[np.minimum(middle, len(self.order) - 1)], self.width), wanted) & (low < high)
                low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
            found = low < len(self.order)
            there = _windows(self.data, self.order[np.minimum(low, len(self.order) - 1)], self.width)
            out[part] = found & (there == wanted).all(axis=1)
        return out


def _windows(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Bytes from each place on, as rows; past the end they count as zero."""
    places = at[:, None] + np.arange(width)
    return np.where(places < len(data), data[np.minimum(places, len(data) - 1)], 0)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    first = np.argmax(a != b, axis=1)
    rows = np.arange(len(a))
    return a[rows, first] < b[rows, first]


def repeated_windows(texts: list[bytes], group: np.ndarray, weight: np.ndarray, width: int = WIDTH, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(text, first byte) of the windows found more than once among ``texts`` of a group; a text counts ``weight`` times.

    Texts come sorted by group. A shard holds whole groups of ``PART`` bytes together, or one larger group; only a group of more than
    ``shard`` bytes takes several, which look each other's windows up.
    """
    total = np.cumsum([len(t) + 1 for t in texts])
    text_out, at_out = [], []
    begin, kept = 0, []  # shards before this one that hold nothing but its first group
    while begin < len(texts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + min(PART, shard), side="right")))
        if end < len(texts) and group[begin] == group[end]:
            own = int(np.searchsorted(group, group[begin], side="right"))
            end = max(begin + 1, min(own, int(np.searchsorted(total, before + shard, side="right"))))
        elif end < len(texts):
            end = int(np.searchsorted(group, group[end]))
        piece = Shard(texts[begin:end], width)
        number = piece.classes()
        repeated = np.bincount(number, weights=weight[begin:end][piece.owner])[number] > 1
        kept = [(b, s) for b, s in kept if group[b] == group[begin]]
        for b, earlier in kept:
            repeated |= earlier.holds(piece, group[begin:end] == group[begin])
            again = piece.holds(earlier, np.ones(len(earlier.texts), bool))
            text_out.append(b + earlier.owner[again]), at_out.append(earlier.step[again])
        text_out.append(begin + piece.owner[repeated]), at_out.append(piece.step[repeated])
        if group[end - 1] == group[begin]:
            kept.append((begin, piece))
        begin = end
    return np.concatenate(text_out), np.concatenate(at_out)


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that start anywhere else too, as runs of windows per row."""
    for c, contexts in groups(batches, PIECE):
        done = c["done"]
        rows, at, n = [c["row"][done]], [c["at"][done]], [c["n"][done]]
        open_ = np.flatnonzero(~done)
        if len(open_):
            g, c1, c2 = (c[k][open_] for k in ("g", "c1", "c2"))
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(open_)))
            weight = np.add.reduceat(c["weight"][open_].astype(np.int64), first)
            same = np.repeat(weight > 1, size)  # the whole context stands elsewhere
            rows.append(c["row"][open_[same]]), at.append(c["at"][open_[same]]), n.append(c["n"][open_[same]])
            head = g[first]
            group = np.cumsum(np.concatenate([[True], head[1:] != head[:-1]])) - 1
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            if len(several):
                texts = contexts.take(pa.array(open_[first[several]])).to_pylist()
                text, step = repeated_windows(texts, group[several], weight[several])
                alone = weight[several][text] == 1  # the others are out as a whole
                row = open_[first[several][text[alone]]]
                rows.append(c["row"][row]), at.append(c["at"][row] + step[alone]), n.append(np.ones(len(row), np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(rows)), pa.array(merge_type(at)), pa.array(merge_type(n))], ["row", "at", "n"]
        )


def merge_type(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int32)


KEPT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (``doc_id, text, spans``) without the bytes that repeated windows cover."""
    for batch in batches:
        values, offsets = list_parts(batch.column(1))
        spans = batch.column(2)
        ends = spans.offsets.to_numpy().astype(np.int64)
        at, n = (spans.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        made: list[tuple] = []
        for i in range(batch.num_rows):
            text = values[offsets[i] : offsets[i + 1]]
            low, high = ends[i], ends[i + 1]
            if low == high or not spans[i].is_valid:
                kept, removed, runs = text.tobytes(), 0, 0
            else:
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, at[low:high], 1)
                np.add.at(change, np.minimum(at[low:high] + n[low:high] + (WIDTH - 1), len(text)), -1)
                gone = np.cumsum(change[:-1]) > 0
                kept, removed = text[~gone].tobytes(), int(gone.sum())
                runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
            made.append((len(text), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*made)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) and ``kept_sha256``.

    Every byte covered by a string of 200 bytes that also starts anywhere else goes, wherever it stands. A null
    text is empty; repeated rows are texts of their own and lose what they share; a very long text is hashed in chunks; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    keyed = keyed_rows(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed, lambda text: text.cast("binary"), SHAPE, judge)
    joined = keyed.join(spans, "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return joined.mapInArrow(cut, KEPT_SCHEMA)
