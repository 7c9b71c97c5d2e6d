"""Benchmark decontamination: training token windows against a broadcast hash set of benchmark n-grams.

Both sides become ASCII-lower-cased runs of letters, digits and non-ASCII characters. Each window of a document
is hashed in the scan and looked up in the benchmark's windows; a hit is verified word by word. Beyond BROADCAST_BYTES of benchmark windows
an ordinary join of hashes takes the place of the lookup: a row of it is a document's key, a place and 128 bits of hash, whose equality
is the verification, so no text moves. The items of a window stand in a table of their own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import ascii_lower, fresh, full_text, small, stored, text_key

WORDS = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20  # of benchmark windows, measured


def token_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _hash(gram: Column) -> Column:
    return F.xxhash64(gram)


def _check(gram: Column) -> Column:
    """A second hash, independent of the first."""
    return F.xxhash64(F.lit(7), gram)


def _windows(words: str, n: int, made, kind: str) -> Column:
    """``made`` of each window of ``n`` words, by its start."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    none = F.array().cast(f"array<{kind}>")
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: made(F.slice(words, i, F.lit(n))))).otherwise(none)


def benchmark_grams(items: DataFrame, n: int = WORDS) -> DataFrame:
    """Windows of the items: ``item_id`` as text, ``gram`` (its words), ``hash, check, n``.

    An item of fewer than ``n`` words, but not none, is one window. Items with a null id or text hold
    none; equal items share their windows.
    """
    words = items.filter("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), token_words(full_text()).alias("words")
    ).filter(F.size("words") > 0)
    short = F.array("words")
    grams = words.select("item_id", F.explode(F.when(F.size("words") >= n, _windows("words", n, lambda g: g, "array<string>")).otherwise(short)).alias("gram"))
    return grams.select("item_id", "gram", _hash(F.col("gram")).alias("hash"), _check(F.col("gram")).alias("check"), F.size("gram").alias("n"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_words, n_hit, n_items, item_ids, spans, contaminated``.

    ``spans`` are the hit windows as (start, n) in words, from 1. A document is contaminated with a hit and at
    least ``percent`` of its words in hit windows. A null or empty text has no words and no hit; a very long text is one array of
    hashes; rows that repeat are reported as often as they come; an empty table gives no rows; columns other than
    ``doc_id`` and ``text`` are not read.
    """
    grams = stored(benchmark_grams(items, n), "benchmark-grams")
    windows = stored(grams.select("hash", "check", "n", "gram").distinct(), "benchmark-windows")
    # At most n rows: an item shorter than n is looked up at its own length.
    lengths = sorted({n, *(r["n"] for r in windows.select("n").distinct().collect())}, reverse=True)
    words = docs.select("doc_id", text_key().alias("text_key"), token_words(full_text()).alias("words"))
    size = windows.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * F.col("n") + 48)).first()[0] or 0
    rows = looked_up(words, windows, lengths) if size <= BROADCAST_BYTES else joined_hits(words, windows, lengths)
    window = F.when(F.col("at") > 0, F.struct("hash", "check"))
    found = rows.groupBy("doc_id", "text_key").agg(
        F.sum((F.col("at") == 0).cast("int")).alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.struct("start", "n")))).alias("spans"),
        F.collect_set(window).alias("windows"),
    )
    found = stored(found, "contamination")
    hits = found.filter(F.size("windows") > 0).select("doc_id", "text_key", F.inline("windows"))
    links = grams.select("hash", "check", "item_id").distinct()
    named = hits.join(links, ["hash", "check"]).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    named = named.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "ids")
    found = found.drop("windows").join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    found = found.withColumn("item_ids", F.coalesce("ids", F.array().cast("array<string>"))).drop("_doc", "_key", "ids")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("total"),
        ),
        lambda a: a["total"],
    )
    counted = found.withColumn("n_hit", covered).withColumn("n_items", F.size("item_ids").cast("bigint"))
    judged = counted.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return judged.select(
        "doc_id", "text_key", "n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def place_of(lengths: list[int]) -> tuple[Column, Column]:
    """Start and length of the window at place ``at`` (from 1): the windows of each length follow one another."""
    starts, sizes, skipped = [], [], F.lit(0)
    for k in lengths:
        count = F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        here = (F.col("at") > skipped) & (F.col("at") <= skipped + count)
        starts.append(F.when(here, F.col("at") - skipped))
        sizes.append(F.when(here, F.lit(k)))
        skipped = skipped + count
    return F.coalesce(*starts), F.coalesce(*sizes)


HIT = ["doc_id", "text_key", "at", "n_words", "start", "n", "hash", "check"]


def looked_up(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row with ``at`` 0 for each text and one for each hit, by a broadcast of the windows and a comparison of words."""
    none = F.array(F.lit(None).cast("bigint"))
    hashed = words.select("*", F.concat(none, *[_windows("words", k, _hash, "bigint") for k in lengths]).alias("all"))
    # The array is never empty. An outer generator keeps the optimizer from testing that in the scan, where it
    # would split the text anew for every window.
    places = hashed.select("doc_id", "text_key", "words", F.size("words").alias("n_words"), F.posexplode_outer("all").alias("at", "hash"))
    start, length = place_of(lengths)
    gram = F.broadcast(windows)
    # Written so that the comparison of words is no join key: it is made for equal hashes only.
    verified = places["hash"].isNull() | (F.slice("words", F.greatest(start, F.lit(1)), length) == gram["gram"])
    joined = places.join(gram, (places["hash"] == gram["hash"]) & verified, "left")
    rows = joined.filter((F.col("at") == 0) | gram["hash"].isNotNull())
    return rows.select("doc_id", "text_key", "at", "n_words", start.alias("start"), gram["n"].alias("n"), gram["hash"].alias("hash"), "check")


def joined_hits(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same rows by a join of both hashes, for any number of windows."""
    both = "struct<hash:bigint,check:bigint>"
    pairs = [_windows("words", k, lambda g: F.struct(_hash(g).alias("hash"), _check(g).alias("check")), both) for k in lengths]
    texts = words.select("doc_id", "text_key", F.size("words").alias("n_words"), F.concat(F.array().cast(f"array<{both}>"), *pairs).alias("all"))
    places = texts.select("doc_id", "text_key", "n_words", F.posexplode("all").alias("at", "pair"))
    places = places.select("doc_id", "text_key", (F.col("at") + 1).alias("at"), "n_words", "pair.hash", "pair.check")
    start, _ = place_of(lengths)
    hits = places.join(windows.select("hash", "check", "n").distinct(), ["hash", "check"]).withColumn("start", start)
    absent = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("hash", "bigint"), ("check", "bigint"))]
    plain = words.select("doc_id", "text_key", F.lit(0).alias("at"), F.size("words").alias("n_words"), *absent)
    return plain.unionByName(hits.select(*HIT))


def remove_documents(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = 5) -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay."""
    found = contamination(docs, items, n, percent).filter("contaminated").select("doc_id", "text_key").distinct()
    bad = small(stored(found, "contaminated")).select(F.col("doc_id").alias(i := fresh("id")), F.col("text_key").alias(k := fresh("key")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[i]) & (text_key(docs["text"]) == bad[k]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """``docs`` with every hit word taken out of ``text``; what stands between words stays. A null text stays null."""
    found = contamination(docs, items, n).filter("n_hit > 0").dropDuplicates(["doc_id", "text_key"])
    spans = found.select(F.col("doc_id").alias(i := fresh("id")), F.col("text_key").alias(k := fresh("key")), F.col("spans").alias(s := fresh("spans")))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans[i]) & (text_key(docs["text"]) == spans[k]), "left")
    hit = F.array_distinct(F.flatten(F.transform(s, lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))
    gaps, words, hits = fresh("gaps"), fresh("words"), fresh("hits")
    parts = joined.withColumns(
        {
            gaps: F.split(docs["text"], ANY_CASE_WORD, -1),
            words: F.regexp_extract_all(docs["text"], F.lit(f"({ANY_CASE_WORD})"), F.lit(1)),
            hits: hit,
        }
    )
    kept = F.array_join(
        F.zip_with(
            gaps,
            F.transform(words, lambda w, i: F.when(F.array_contains(hits, i + 1), F.lit("")).otherwise(w)),
            lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))),
        ),
        "",
    )
    return parts.select(*[F.when(F.col(s).isNotNull(), kept).otherwise(docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])
