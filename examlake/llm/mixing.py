"""Mixing sources to target weights by capped water-filling.

Targets share a budget by weight. A source whose share passes its cap is clamped there and what it
can't take is shared by the others, until no share passes its cap. A source is then taken in whole repetitions,
and the rest of its target as its first documents in a seeded order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import blank_words, fresh, full_text, id_order, running_totals, small, stored

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2.0


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents without their text: ``doc_id, source, size`` in words and ``place``, the seeded order of ids."""
    return docs.select(
        "doc_id", "source", F.size(blank_words(full_text())).cast("bigint").alias("size"), id_order(seed).alias("place")
    )


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources with their sizes, by code point and null last, given ``weights`` in turn.

    The only step that sees all sources in one task; there is one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.withColumn("weight", turn[(F.row_number().over(order) - 1) % len(weights)])


def targets(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``source, source_size, weight`` with ``target``: ``share`` of all sizes, each at most ``epochs`` times its size.

    Each round is one aggregate over the sources, giving the rate of words per unit of weight; sources
    above their cap at this rate are clamped. Rates only rise, so none is ever released. Weights are positive.
    """
    sources = stored(sources, "mix-sources")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * F.lit(float(epochs))
    rate, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(rate) > cap
        n, taken, weight = sources.agg(
            F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == clamped or not weight:
            break
        rate, clamped = (budget - taken) / weight, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate)))


def plan(rows: DataFrame, weigh=cyclic_weights, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Per source: ``target``, ``whole`` repetitions, and the last document (``last_place, last_id``) taken once more.

    ``rows`` are ``sized`` documents. Documents are added in their seeded order while more than half of
    one still fits, so the words taken miss the target by half a document at most. Rows with one id are taken together.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(weigh(sizes), share, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = stored(
        aims.withColumn("whole", F.floor(rate)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    ids = rows.groupBy("source", "place", "doc_id").agg(F.sum("size").alias("size"))
    before = running_totals(ids, ["source"], ["place", "doc_id"], "size")
    rest = small(aims.select(F.col("source").alias("of"), "rest"))
    fits = (F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    last = before.join(rest, before["source"].eqNullSafe(rest["of"])).filter(fits).groupBy("of").agg(
        F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("last")
    )
    joined = aims.join(last, aims["source"].eqNullSafe(last["of"]), "left").drop("of")
    return stored(joined, "mix-plan")


def copies(place: Column, doc_id: Column, whole: Column, last: Column) -> Column:
    """How often a document is taken."""
    here = F.struct(place.alias("place"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"))
    return (whole + F.coalesce(here <= last, F.lit(False)).cast("bigint")).cast("int")


def mix_report(docs: DataFrame, seed: int = SEED, **rules) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    A null text has size 0; a null source is one source; an empty table gives no rows; other columns are not read.
    """
    rows = stored(sized(docs, seed), "mix-sizes")
    aims = small(plan(rows, **rules).withColumnRenamed("source", "of"))
    joined = rows.join(aims, rows["source"].eqNullSafe(aims["of"]), "left")
    times = copies(F.col("place"), F.col("doc_id"), F.col("whole"), F.col("last"))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", times.alias("copies"), (times * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, seed: int = SEED, **rules) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay."""
    rows = stored(sized(docs, seed), "mix-sizes")
    names = {c: fresh(c) for c in ("source", "whole", "last")}
    aims = small(plan(rows, **rules).select(*[F.col(c).alias(n) for c, n in names.items()]))
    joined = docs.join(aims, docs["source"].eqNullSafe(aims[names["source"]]), "left")
    times = copies(id_order(seed, docs["doc_id"]), docs["doc_id"], aims[names["whole"]], aims[names["last"]])
    kept = joined.withColumn(n := fresh("copies"), times).filter(F.col(n) > 0)
    return kept.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
