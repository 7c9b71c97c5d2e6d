"""Exact quantiles, and the other statistics of a group, without gathering its values in one task."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    quantiles: dict[str, float],
    low: float,
    high: float,
    buckets: int = 1000,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group; one column per named quantile.

    Rows with a null group or value are left out.
    """
    known = [F.col(c).isNotNull() for c in [*groups, value]]
    found = exact_summary(df.filter(reduce(and_, known)), groups, value, quantiles, low, high, buckets)
    return found.select(*groups, *quantiles)


def exact_summary(
    df: DataFrame,
    groups: list[str],
    value: str,
    quantiles: dict[str, float],
    low: float,
    high: float,
    buckets: int = 1000,
    few_groups: bool = False,
) -> DataFrame:
    """``count, mean, std, min, max`` and the named quantiles of ``value`` per group, in two reads of the rows.

    The first read makes a state of each bucket of [low, high], combined before the shuffle: number, sum, squares around
    the bucket's mean, least and greatest value. Merged over the buckets of a group they give its statistics, and the
    running numbers tell which buckets hold a wanted rank. The second read keeps only rows of those
    buckets and counts them per value; slices of the buckets narrow the ranks down again before any values are
    sorted. ``percentile`` would keep all distinct values of a group in one task's memory instead.

    Values beyond the range fall in the outer buckets, so the result is exact for any input. A null group is a group. A group
    without values has the count 0 and nulls. The statistics travel with the list of wanted buckets, at most two rows
    per group and quantile, so the states are used once. That list is broadcast, and the values not shuffled, if there are
    ``few_groups``: a number that does not grow with the rows, such as years by a fixed list.
    """
    width = (high - low) / buckets
    values = df.select(*groups, F.col(value).alias("_v")).withColumn("_b", _bucket(F.col("_v"), F.lit(low), width, buckets))
    states = values.groupBy(*groups, "_b").agg(
        F.count("_v").alias("_n"),
        F.sum("_v").alias("_sum"),
        (F.var_pop("_v") * F.count("_v")).alias("_squares"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    states = _merged(states, groups, (low + high) / 2)
    wanted = _holding_ranks(states, groups, "_b", F.lit(0), quantiles, ["_all"])
    wanted = F.broadcast(wanted) if few_groups else wanted

    slice_start = F.lit(low) + F.col("_b") * width
    counts = (
        _same_keys(values, wanted, [*groups, "_b"])
        .groupBy(*groups, "_b", "_total", "_base", "_all", "_v")
        .agg(F.count("_v").alias("_n"))
        .withColumn("_s", _bucket(F.col("_v"), slice_start, width / buckets, buckets))
    )
    per_slice = counts.groupBy(*groups, "_b", "_total", "_base", "_s").agg(F.sum("_n").alias("_n"))
    wanted = _holding_ranks(per_slice, [*groups, "_b"], "_s", F.col("_base"), quantiles)

    found = _same_keys(counts.drop("_base", "_total"), wanted, [*groups, "_b", "_s"])
    found = _running(found, [*groups, "_b", "_s"], "_v", F.col("_base"))
    picks = [F.max("_all").alias("_all")]
    for name, q in quantiles.items():
        below, above = F.floor(_rank(q)), F.ceil(_rank(q))
        picks.append(F.max(F.when(_covers(below), F.col("_v"))).alias(f"_{name}_lo"))
        picks.append(F.max(F.when(_covers(above), F.col("_v"))).alias(f"_{name}_hi"))
        picks.append(F.max(_rank(q) - below).alias(f"_{name}_at"))

    def interpolated(name: str) -> Column:
        start, end = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (start + (end - start) * F.col(f"_{name}_at")).alias(name)

    return found.groupBy(*groups).agg(*picks).select(*groups, "_all.*", *[interpolated(n) for n in quantiles])


def _merged(states: DataFrame, groups: list[str], middle: float) -> DataFrame:
    """Bucket states with ``_total`` and the statistics of their whole group in ``_all``.

    Squares are taken around a constant inside the range first, which keeps their difference to the mean's exact enough.
    """
    whole = Window.partitionBy(*groups)
    mean = F.col("_sum") / F.col("_n")
    about = F.when(F.col("_n") > 0, F.col("_squares") + F.col("_n") * (mean - middle) * (mean - middle))
    summed = states.select(
        *groups,
        "_b",
        "_n",
        F.sum("_n").over(whole).alias("_total"),
        F.sum("_sum").over(whole).alias("_sums"),
        F.sum(about).over(whole).alias("_about"),
        F.min("_min").over(whole).alias("min"),
        F.max("_max").over(whole).alias("max"),
    )
    total, mean = F.col("_total"), F.when(F.col("_total") > 0, F.col("_sums") / F.col("_total"))
    squares = F.greatest(F.col("_about") - total * (mean - middle) * (mean - middle), F.lit(0.0))
    std = F.when(total > 1, F.sqrt(squares / (total - 1)))
    statistics = F.struct(total.alias("count"), mean.alias("mean"), std.alias("std"), "min", "max")
    return summed.select(*groups, "_b", "_n", "_total", statistics.alias("_all"))


def _same_keys(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which each may be null."""
    named = found.withColumnsRenamed({k: f"_found_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_found_{k}")) for k in keys]
    return rows.join(named, same).drop(*[f"_found_{k}" for k in keys])


def _bucket(value: Column, low: Column, width: float, buckets: int) -> Column:
    inside = F.least(F.floor((value - low) / width), F.lit(buckets - 1))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), inside).cast("int"))


def _running(df: DataFrame, groups: list[str], order: str, base: Column) -> DataFrame:
    """Rows standing before each entry: ``base`` plus the counts of the entries ordered before."""
    window = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", base + F.coalesce(F.sum("_n").over(window), F.lit(0)))


def _holding_ranks(
    df: DataFrame, groups: list[str], order: str, base: Column, quantiles: dict[str, float], carried: list[str] = []  # noqa: B006
) -> DataFrame:
    """The entries that hold a wanted rank, with the number of rows before them; those of a group without values as they are."""
    checks = [F.col("_total") == 0]
    for q in quantiles.values():
        checks += [_covers(F.floor(_rank(q))), _covers(F.ceil(_rank(q)))]
    kept = _running(df, groups, order, base).filter(reduce(or_, checks))
    return kept.select(*groups, order, "_total", F.col("_before").alias("_base"), *carried)


def _rank(q: float) -> Column:
    return F.lit(q) * (F.col("_total") - 1)


def _covers(rank: Column) -> Column:
    return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
