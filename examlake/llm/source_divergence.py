"""How the words of each source differ from those of its language.

One ``bytes.translate`` lowers A-Z and blanks all that is no letter, ``bytes.split`` gives the terms, and a Counter for each document
its frequencies and, by its keys, the documents of a term. A task adds them up for each language and source before they
are shuffled, so a frequent term or a large source sends one row from each batch.

With p(g, t) = 1 + floor(10^9 (count + 5) / (N + 5 V)) a group's shares are compared with those of its language (terms used more) and
with those of each other source (sum of all differences). The latter runs over blocks of sources: a task
takes two blocks and a slice of the terms as a matrix, and gives one sum for each pair, never a row for a pair and a term.

Defined cases: null text, language or source is empty text, which is a language or source like any other. Texts without a term still
make their group occur; without kept terms all pairs have the value 0. Rows repeated in full count each. Equal values rank by the
bytes of the item. A very long text is one Counter. An empty table gives no rows. Of other columns, whatever their names, none is read.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import full_text, stored

LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
BLOCK = 128  # sources side by side
SLICE = 4_096  # terms of a task's matrix
HELD = 200_000  # terms a task holds before it gives them on

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def count_terms(held: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, text`` to ``lang, source, term, n, docs``; the empty term counts the documents of a group."""
    groups: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            words, found = list(docs), len(docs)
            columns = [
                pa.array([lang] * found, pa.string()),
                pa.array([source] * found, pa.string()),
                pa.array(words, pa.binary()).cast(pa.string()),
                pa.array([n[w] for w in words], pa.int64()),
                pa.array(list(docs.values()), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = groups[lang, source]
            before = len(docs)
            own = Counter(terms(text))
            n.update(own)
            docs.update(own.keys())
            docs[b""] += 1
            size += len(docs) - before
            if size > held:
                yield from given()
                size = 0
    yield from given()


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE (n + ADDED) / (total + ADDED kept)) in whole numbers of 38 digits; null where nothing is kept."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = wide(wide(n + ADDED, 20) * F.lit(SCALE).cast("decimal(10,0)"), 38)
    low = wide(total + kept * ADDED, 20)
    return F.when(kept > 0, 1 + F.call_function("div", top, low))


def group_shares(docs: DataFrame, least_docs: int = LEAST_DOCS, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(``lang, source, place, sources, total, kept, rest`` of each group, ``lang, source, term, n, p, q`` of each kept term it has).

    ``place`` numbers a language's sources, ``rest`` is the share of a kept term that a group lacks, ``q`` the language's share.
    """
    rows = docs.select(full_text("lang").alias("lang"), full_text("source").alias("source"), full_text().cast("binary").alias("text"))
    found = rows.mapInArrow(partial(count_terms, held), COUNTS)
    counts = stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = stored(kept.drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    used = stored(words.drop("docs").join(kept, ["lang", "term"]), "used-terms")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nothing = F.lit(0).cast("bigint")
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumns(
        {
            "place": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1,
            "sources": F.count("*").over(Window.partitionBy("lang")),
            "rest": F.coalesce(share(nothing, "total", "kept"), nothing),
        }
    )
    groups = stored(groups, "term-groups")
    p, q = share("n", "total", "kept"), share("all", "lang_total", "kept")
    shares = used.join(groups, ["lang", "source"]).select("lang", "source", "place", "sources", "kept", "term", "n", p.alias("p"), q.alias("q"))
    return groups, shares


def blocks_of(rows: DataFrame, slices: Column, block: int) -> DataFrame:
    """Rows once for each other block of their language's sources: ``low`` and ``high`` are the two blocks, ``slice`` that of the term."""
    own = F.floor(F.col("place") / block).cast("int")
    last = F.floor((F.col("sources") - 1) / block).cast("int")
    other = rows.withColumns({"_slice": slices, "_own": own}).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return other.withColumns({"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other"), "slice": F.col("_slice")})


def differences(shares: pd.DataFrame, groups: pd.DataFrame, block: int) -> pd.DataFrame:
    """One language, two blocks of sources, one slice of terms: the sum of all differences of each pair of sources.

    ``shares``: ``place, term, p``; ``groups``: ``place, rest`` of all sources in the two blocks.
    """
    groups = groups.sort_values("place")
    places, rest = groups["place"].to_numpy(np.int64), groups["rest"].to_numpy(np.int64)
    total = np.zeros((len(places), len(places)), np.int64)
    column = np.searchsorted(places, shares["place"].to_numpy(np.int64))
    code, found = pd.factorize(shares["term"])
    p, order = shares["p"].to_numpy(np.int64), np.argsort(code, kind="stable")
    for first in range(0, len(found), 256):
        some = order[np.searchsorted(code, first, sorter=order) : np.searchsorted(code, first + 256, sorter=order)]
        matrix = np.tile(rest, (min(256, len(found) - first), 1))
        matrix[code[some] - first, column[some]] = p[some]
        for i in range(len(places)):
            total[i] += np.abs(matrix - matrix[:, i : i + 1]).sum(axis=0)
    low, high = int(groups["low"].iloc[0]), int(groups["high"].iloc[0])
    own = places // block
    a, b = np.nonzero((own[:, None] == low) & (own[None, :] == high) & (places[:, None] != places[None, :]))
    pairs = {"lang": groups["lang"].iloc[0], "a": places[a], "b": places[b], "value": total[a, b]}
    out = pd.DataFrame(pairs)
    if low == high:
        return out
    return pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[out.columns]], ignore_index=True)


def pair_sums(groups: DataFrame, shares: DataFrame, block: int = BLOCK, terms_each: int = SLICE) -> DataFrame:
    """``lang, source, item, value``: each two sources of a language, both ways.

    A term that neither of two blocks has adds what the two groups' shares for absent terms differ, so only terms of a block are
    shuffled to it, and the others are added by their number.
    """
    slices = F.greatest(F.ceil(F.col("kept") / terms_each), F.lit(1)).cast("int")
    keys = ["lang", "low", "high", "slice"]
    left = blocks_of(shares, F.pmod(F.xxhash64("term"), slices).cast("int"), block).select(*keys, "place", "term", "p")
    renewed = groups.select([F.col(c).alias(c) for c in groups.columns])  # shares descend from groups as well
    right = blocks_of(renewed, F.explode(F.sequence(F.lit(0), slices - 1)), block).select(*keys, "place", "rest")
    schema = "lang string, a bigint, b bigint, value bigint, terms bigint"

    def summed(shares: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        return differences(shares, groups, block).assign(terms=shares["term"].nunique())

    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(summed, schema)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", F.col("place").cast("bigint").alias("a"), "source", "kept", F.col("rest").alias("_rest_a"))
    two = groups.select("lang", F.col("place").cast("bigint").alias("b"), F.col("source").alias("item"), F.col("rest").alias("_rest_b"))
    joined = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    absent = (F.col("kept") - F.col("terms")) * F.abs(F.col("_rest_a") - F.col("_rest_b"))
    return joined.select("lang", "source", "item", (F.col("value") + absent).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, terms_each: int = SLICE) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group all other sources (``pair``) and the ``top`` terms it uses most beyond its language (``term``)."""
    groups, shares = group_shares(docs, least_docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(groups, shares, block, terms_each).withColumn("rank", F.row_number().over(ranked))
    more = shares.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    words = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    both = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for d, part in ((pairs, "pair"), (words, "term"))]
    return both[0].unionByName(both[1])
