"""Texts rearranged for fill-in-the-middle training, and put back.

Each text is cut at two line ends into prefix, middle and suffix. A task turns a document into pieces of whole lines, each keyed by
document and place in the output; ``repartitionAndSortWithinPartitions`` brings a document's pieces together in output
order, so they stream into a digest one by one. The texts are measured first, and there are so many partitions that each
has about ``PARTITION`` bytes. For restoration the pieces that came out are keyed by their place in the
text and sorted again; the partitioning is the same, so that nothing moves a second time. No task holds a document's
pieces at once: Spark's sorter spills them.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, or one the share leaves out stays plain (its counts of
prefix and middle are null); a null id is hashed as ``null``. Rows repeated in full each give a row of their own. A text
without line ends is one unit; a unit longer than a piece is cut into several. An empty table gives no rows. Of other columns,
whatever their names, none is read or returned.
"""

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import full_text

PLAIN, PSM, SPM = "plain", "psm", "spm"
PARTITION = 32 << 20


@dataclass(frozen=True)
class Mix:
    """How many texts of a hundred are rearranged, how many of those with the suffix first, by which seed and marks.

    The marks must differ, begin with ``<``, end with ``>`` and hold neither inside, so that no text can complete one.
    """

    seed: int = 7
    share: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    piece: int = 1 << 16  # characters

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        if len(set(marks)) < 3 or any(m[:1] != "<" or m[-1:] != ">" or {*m[1:-1]} & {*"<>"} for m in marks):
            raise ValueError(f"marks must be three different <...>: {marks}")


def units(text: str) -> int:
    """Lines with their ends; what follows the last end is a line too."""
    return text.count("\n") + (text != "" and text[-1] != "\n")


def end_of(text: str, unit: int) -> int:
    """Where the first ``unit`` lines end."""
    at = 0
    for _ in range(unit):
        at = text.find("\n", at) + 1 or len(text)
    return at


def cut(doc_id: int | None, text: str, mix: Mix) -> tuple[int, str, int, int]:
    """Number of units, form, end of the prefix, end of the middle."""
    name = f"{mix.seed}:{'null' if doc_id is None else doc_id}"
    digits = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    n = units(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in (mix.prefix, mix.suffix, mix.middle)) or h3 % 100 >= mix.share:
        return n, PLAIN, 0, 0
    a = end_of(text, low)
    return n, SPM if h4 % 100 < mix.suffix_first else PSM, a, a + end_of(text[a:], high - low)


def chunks(text: str, start: int, stop: int, most: int) -> Iterator[str]:
    """``text[start:stop]`` in runs of whole lines of at most ``most`` characters, longer lines cut."""
    while start < stop:
        end = min(start + most, stop)
        if end < stop:
            end = text.rfind("\n", start, end) + 1 or end
        yield text[start:end]
        start = end


def output(text: str, form: str, a: int, b: int, mix: Mix) -> Iterator[str]:
    """The pieces of the rearranged text in order; marks are pieces of their own."""
    if form == PLAIN:
        yield from chunks(text, 0, len(text), mix.piece)
        return
    prefix, middle, suffix = (mix.prefix, 0, a), (mix.middle, a, b), (mix.suffix, b, len(text))
    for mark, start, stop in (suffix, prefix, middle) if form == SPM else (prefix, suffix, middle):
        yield mark
        yield from chunks(text, start, stop, mix.piece)


def keyed(mix: Mix, rows: Iterable) -> Iterator[tuple]:
    """``(document, place), piece`` of each row; at place 0 what is known of the document.

    The key of a document follows from its content, its partition and, among equal rows there, its number: a task that runs again gives
    the same keys whatever order its rows come in.
    """
    task, copies = TaskContext.get().partitionId(), Counter()
    for doc_id, text in rows:
        own = hashlib.blake2b(f"{doc_id}:{text}".encode(), digest_size=16).digest()
        key = hashlib.blake2b(own + f"{task}:{copies[own]}".encode(), digest_size=16).digest()
        copies[own] += 1
        n, form, a, b = cut(doc_id, text, mix)
        known = (None, None) if form == PLAIN else (a, b - a)
        yield (key, 0), (doc_id, n, form, *known)
        for place, piece in enumerate(output(text, form, a, b, mix), 1):
            yield (key, place), piece


def by_document(key: tuple) -> int:
    return int.from_bytes(key[0][:6], "big")


def sorted_pieces(rdd: RDD, parts: int) -> RDD:
    """Documents together, pieces in order. What is partitioned so already is only sorted."""
    return rdd.repartitionAndSortWithinPartitions(parts, by_document)


def arranged(docs: DataFrame, mix: Mix = Mix()) -> tuple[RDD, int]:
    """All pieces in output order, and the number of partitions: as many as the session's shuffles have, more for many bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    rows = docs.select("doc_id", full_text().alias("text")).rdd
    return sorted_pieces(rows.mapPartitions(partial(keyed, mix)), parts), parts


def taken_apart(mix: Mix, pieces: Iterable) -> Iterator[tuple]:
    """Pieces in output order to the same pieces by their place in the text, by the form and the marks alone.

    At place ``(-1, 0)`` of a document stands what is known of it, with the digest of its output.
    """
    part_of = {mix.prefix: 0, mix.middle: 1, mix.suffix: 2}
    key, known, digest, part = None, None, None, 0
    for (doc, place), piece in pieces:
        if place == 0:
            if key is not None:
                yield (key, (-1, 0)), (*known, digest.hexdigest())
            key, known, digest, part = doc, piece, hashlib.sha256(), 0
            continue
        digest.update(piece.encode())
        if known[2] != PLAIN and piece in part_of:
            part = part_of[piece]
        else:
            yield (doc, (part, place)), piece
    if key is not None:
        yield (key, (-1, 0)), (*known, digest.hexdigest())


def put_together(pieces: Iterable) -> Iterator[tuple]:
    """What is known of each document, with the digests of its output and of the text restored from it."""
    known, digest = None, None
    for (_, (part, _)), piece in pieces:
        if part < 0:
            if known is not None:
                yield (*known, digest.hexdigest())
            known, digest = piece, hashlib.sha256()
        else:
            digest.update(piece.encode())
    if known is not None:
        yield (*known, digest.hexdigest())


KNOWN = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"


def digests(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of ``docs``: units, form, lengths, and SHA-256 of the rearranged text and of the text restored from it."""
    pieces, parts = arranged(docs, mix)
    apart = pieces.mapPartitions(partial(taken_apart, mix), preservesPartitioning=True)
    rows = sorted_pieces(apart, parts).mapPartitions(put_together)
    return docs.sparkSession.createDataFrame(rows, f"{KNOWN}, output_sha256 string, restored_sha256 string", verifySchema=False)


def whole(pieces: Iterable) -> Iterator[tuple]:
    """What is known of each document with its pieces joined: one document in memory at a time, as in a row of the input."""
    known, parts = None, []
    for (_, place), piece in pieces:
        if place in (0, (-1, 0)):
            if known is not None:
                yield (*known, "".join(parts))
            known, parts = piece, []
        else:
            parts.append(piece)
    if known is not None:
        yield (*known, "".join(parts))


def rearranged(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of ``docs``: units, form, lengths, and the rearranged text as ``text``."""
    pieces, _ = arranged(docs, mix)
    return docs.sparkSession.createDataFrame(pieces.mapPartitions(whole), f"{KNOWN}, text string", verifySchema=False)


def restored(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rearranged texts (``doc_id, form, text``, as ``rearranged`` gives them) back to ``doc_id, text``."""

    def back(rows: Iterable) -> Iterator[tuple]:
        order = {PSM: (mix.prefix, mix.suffix, mix.middle), SPM: (mix.suffix, mix.prefix, mix.middle)}
        for doc_id, form, text in rows:
            if form != PLAIN:
                first, second, third = (text.index(m) for m in order[form])
                a, b, c = text[first + len(order[form][0]) : second], text[second + len(order[form][1]) : third], text[third + len(mix.middle) :]
                text = a + c + b if form == PSM else b + c + a
            yield doc_id, text

    rows = docs.select("doc_id", F.col("form"), full_text().alias("text")).rdd.mapPartitions(back)
    return docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string", verifySchema=False)
