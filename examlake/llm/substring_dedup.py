"""Substring dedup by words, over prefix-partitioned suffix trees.

Suffixes that may share their first 13 words are sent to groups by a prefix: the four words of their anchor, or all 13 words
where that prefix is too frequent for one group to fit in memory. Each task builds the upper part of its groups' suffix
trees, level by level, dropping branches with one leaf. Nodes 13 words deep are the repeats.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.llm.anchors import KEPT_BYTES, Shape, U, groups, keyed_rows, repeated_spans
from examlake.llm.common import blank_words, fresh

WIDTH = 13
SHAPE = Shape(width=WIDTH, gram=4, across_docs=True)
PIECE = 8 << 20


def deep_nodes(words: np.ndarray, starts: np.ndarray, roots: np.ndarray, depth: int) -> np.ndarray:
    """Nodes ``depth`` words below the roots: a number for each suffix, or -1 where it shares none.

    The tree grows from the roots: each level splits the leaves of a node by their next word; a node
    with one leaf grows no further.
    """
    node, alive = roots.copy(), np.arange(len(starts))
    for level in range(depth):
        if not len(alive):
            break
        order = np.lexsort((words[starts[alive] + level], node[alive]))
        alive = alive[order]
        parent, word = node[alive], words[starts[alive] + level]
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(alive)))
        child = np.cumsum(new) - 1
        branch = np.repeat(size > 1, size)
        node[alive] = child
        node[alive[~branch]] = -1
        alive = alive[branch]
    return node


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose words also start in a smaller document, as runs of windows per row."""
    for c, contexts in groups(batches, PIECE):
        done = c["done"]
        rows, at, n = [c["row"][done]], [c["at"][done]], [c["n"][done]]
        open_ = np.flatnonzero(~done)
        if len(open_):
            g, c1, c2, doc = (c[k][open_] for k in ("g", "c1", "c2", "doc"))
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(open_)))
            least = np.repeat(doc[first], size)
            later = doc != least  # the same context in a smaller document
            rows.append(c["row"][open_[later]]), at.append(c["at"][open_[later]]), n.append(c["n"][open_[later]])
            # Groups of several contexts: one tree each, with a context's first document for all of it.
            head = g[first]
            begins = np.concatenate([[True], head[1:] != head[:-1]])
            group = np.cumsum(begins) - 1
            several = np.bincount(group)[group] > 1
            picked = first[several]
            if len(picked):
                texts = contexts.take(pa.array(open_[picked]))
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) // KEPT_BYTES
                packed = np.frombuffer(texts.buffers()[2], np.uint8)
                packed = packed[: len(packed) // KEPT_BYTES * KEPT_BYTES].reshape(-1, KEPT_BYTES)
                words = np.zeros((len(packed), 8), np.uint8)
                words[:, :KEPT_BYTES] = packed
                words = words.view(U).ravel()
                windows = np.diff(offsets) - (WIDTH - 1)
                owner = np.repeat(np.arange(len(picked)), windows)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                node = deep_nodes(words, offsets[owner] + step, group[several][owner].astype(np.int64), WIDTH)
                shared = np.flatnonzero(node >= 0)
                if len(shared):
                    by = np.lexsort((doc[picked][owner[shared]], node[shared]))
                    shared = shared[by]
                    lead = np.concatenate([[True], node[shared][1:] != node[shared][:-1]])
                    smallest = doc[picked][owner[shared]][np.flatnonzero(lead)][np.cumsum(lead) - 1]
                    hit = shared[doc[picked][owner[shared]] != smallest]
                    # All rows of the context that are of its first document.
                    member = np.flatnonzero(~later)
                    of = (np.cumsum(new) - 1)[member]
                    place = np.full(len(first), -1)
                    place[np.flatnonzero(several)] = np.arange(len(picked))
                    member, of = member[place[of] >= 0], place[of][place[of] >= 0]
                    marks = np.sort(hit)
                    low = np.searchsorted(owner[marks], of)
                    many = np.searchsorted(owner[marks], of, side="right") - low
                    which = marks[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    rows.append(np.repeat(c["row"][open_[member]], many))
                    at.append(np.repeat(c["at"][open_[member]], many) + step[which])
                    n.append(np.ones(len(which), np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(rows)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int32))],
            ["row", "at", "n"],
        )


def word_hashes(text: Column) -> Column:
    return F.transform(blank_words(text), lambda w: F.xxhash64(w))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` made of the words that stay, one blank apart, and ``n_words``, ``n_removed`` added.

    A word goes if a window of 13 words over it also starts in a document with a smaller id; a null id is the smallest.
    Rows of one id are one document. A null or empty text has no words; texts that lose nothing are respaced too. A very long
    text is worked on in chunks of windows. An empty table gives no rows. Other columns stay, whatever their names; columns
    ``n_words`` and ``n_removed`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    own = {c: fresh(c) for c in others if c in ("row", "spans")}
    keyed = keyed_rows(docs.select(*others).withColumnsRenamed(own))
    spans = repeated_spans(keyed, word_hashes, SHAPE, judge)
    words, gone = fresh("words"), fresh("gone")
    joined = keyed.join(spans, "row", "left").withColumn(words, blank_words(F.col("text")))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] + (WIDTH - 2)))))
    counted = joined.withColumn(gone, covered)
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    stay = F.transform(F.array_except(every, F.col(gone)), lambda i: F.col(words)[i])
    text = F.array_join(F.when(F.col(gone).isNull(), F.col(words)).otherwise(stay), " ")
    return counted.select(
        *[text.alias("text") if c == "text" else F.col(own.get(c, c)).alias(c) for c in others],
        F.size(words).cast("bigint").alias("n_words"),
        F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("bigint").alias("n_removed"),
    )
