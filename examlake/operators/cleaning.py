"""Row quarantine, keep-first de-duplication, domain repair and the cleaning report."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlake.fixed_values import AGE_MAX, AGE_MIN, SCORE_MAX, SCORE_MIN, SCORES
from examlake.sources.raw_files import POSITION


@dataclass(frozen=True)
class RangeRule:
    """Present values must lie in [low, high]; an open bound is None."""

    column: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        # Null and NaN never break a rule; Spark orders NaN above infinity.
        value = F.col(self.column)
        checks = []
        if self.low is not None:
            checks.append(value < self.low)
        if self.high is not None:
            checks.append((value > self.high) & (value <= float("inf")))
        return F.coalesce(reduce(or_, checks, F.lit(False)), F.lit(False))


@dataclass(frozen=True)
class DomainRule:
    """Allowed values of a column, for one year or (year None) for all."""

    column: str
    allowed: tuple
    unknown: str = "UNKNOWN"
    year: int | None = None


DEFAULT_RANGES = (
    RangeRule("NU_IDADE", AGE_MIN, AGE_MAX),
    *[RangeRule(score, SCORE_MIN, SCORE_MAX) for score in SCORES],
)


@dataclass(frozen=True)
class CleaningPlan:
    """What to check.

    ``scope`` names the columns within which identifiers must be unique (the year: each year's
    file is cleaned on its own) and ``order`` decides which copy of a row came first.
    """

    ranges: tuple[RangeRule, ...] = DEFAULT_RANGES
    domains: tuple[DomainRule, ...] = ()
    keys: tuple[str, ...] = ("ID_INSCRICAO",)
    scope: tuple[str, ...] = ("ANO",)
    order: tuple[str, ...] = field(default=(POSITION,))


class Cleaned(NamedTuple):
    valid: DataFrame
    invalid: DataFrame
    duplicates: DataFrame
    report: DataFrame


def cleaning_plan(domains: dict[str, Sequence] | None = None, **overrides) -> CleaningPlan:
    """Default plan plus allowed values per column."""
    rules = tuple(DomainRule(c, tuple(v)) for c, v in (domains or {}).items())
    keys = ("ID_INSCRICAO", "NU_INSCRICAO", "ANO")
    return CleaningPlan(**{"domains": rules, "keys": keys, **overrides})


def domains_from_metadata(metadata: DataFrame, years: list[int] | None = None) -> tuple[DomainRule, ...]:
    """Domain rules declared in the metadata table (one row per variable and year)."""
    rows = metadata.filter(F.col("dominio_valores").isNotNull())
    if years is not None:
        rows = rows.filter(F.col("ano").isin(years))
    found = rows.select("nome_padrao", "dominio_valores", "ano").collect()
    return tuple(DomainRule(name, tuple(values), year=year) for name, values, year in found)


def domains_by_year(metadata: DataFrame) -> DataFrame:
    """One row per year of the metadata: ``_year, _domains``, a map from column to its declared lists of allowed values.

    Nothing is collected: the table is joined to the rows by year. Of several declarations of a column in a year all hold.
    """
    declared = metadata.filter("nome_padrao <> '' AND dominio_valores IS NOT NULL")
    lists = declared.groupBy(F.col("ano").cast("int").alias("_year"), "nome_padrao").agg(F.collect_list("dominio_valores").alias("lists"))
    entries = F.map_from_entries(F.collect_list(F.struct("nome_padrao", "lists")))
    return lists.groupBy("_year").agg(entries.alias("_domains"))


def outside_declared(df: DataFrame, column: str) -> Column:
    """Present value that the declared domain of its row's year does not allow; numbers compare as numbers."""
    value, lists = F.col(column), F.try_element_at("_domains", F.lit(column))
    if is_numeric(df, column):
        number = value.cast("double")
        allowed = lambda values: F.exists(values, lambda x: x.try_cast("double") == number)
    else:
        allowed = lambda values: F.array_contains(values, value.cast("string"))
    return F.coalesce(value.isNotNull() & ~F.forall(lists, lambda x: F.coalesce(allowed(x), F.lit(False))), F.lit(False))


# ------------------------------------------------------------------ quarantine
def out_of_range(df: DataFrame, rules: Sequence[RangeRule]) -> Column:
    checks = [r.broken() for r in rules if r.column in df.columns]
    return reduce(or_, checks, F.lit(False))


def quarantine(df: DataFrame, rules: Sequence[RangeRule] = DEFAULT_RANGES) -> tuple[DataFrame, DataFrame]:
    """(rows passing every rule, rows breaking one). Two filters over the same scan."""
    bad = out_of_range(df, rules)
    return df.filter(~bad), df.filter(bad)


# ------------------------------------------------------------------ keep-first
def present_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key; null keys count as equal.

    Filtering on row number 1 lets Spark drop later copies inside each map task, before the
    shuffle, so a key holding a large share of the rows sends one row per task.
    """
    keys = present_keys(df, keys)
    if not keys:
        return df
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


SLOTS = 1 << 25  # one bit each: the table of repeated keys is 4 MB at most
SLOT_BITS = 1 << 15  # bits of one bitmap


def split_repeated(df: DataFrame, keys: Sequence[str], hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key stands in no other row, rows whose key may be repeated); null keys count as equal.

    Keys are counted by a hash of 64 bits, and the hashes found more than once set bits in a table of fixed size, small
    enough to be broadcast whatever the input. Rows of one key share a bit, so the second part holds every repeated key whole;
    only that part needs a shuffle to be compared. ``df`` is read three times, or twice if the ``hashes`` (``_hash``, by
    ``xxhash64`` of the keys) of the repeated keys are known.
    """
    slot = F.pmod(F.col("_hash"), F.lit(SLOTS))
    if hashes is None:
        hashes = df.select(F.xxhash64(*keys).alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_copies")).filter("_copies > 1")
    found = hashes.select(slot.alias("_slot"))
    place = F.col("_slot") % SLOT_BITS
    bits = found.groupBy(F.floor(F.col("_slot") / SLOT_BITS).alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    rows = df.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(SLOTS)))
    rows = rows.join(F.broadcast(bits), F.floor(F.col("_slot") / SLOT_BITS) == F.col("_part"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return rows.filter(~maybe).select(*df.columns), rows.filter(maybe).select(*df.columns)


def later_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row but the first per key.

    Repeated keys and their first position come from one map-side-combined aggregation; the rows
    then join that list, which holds one row per repeated key. A hot key therefore never gathers
    its rows in one task: AQE broadcasts a small list and splits skewed partitions otherwise.
    """
    keys = present_keys(df, keys)
    if not keys:
        return df.filter(F.lit(False))
    names = [f"_key{i}" for i in range(len(keys))]
    position = F.struct(*order)
    repeated = (
        df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        .agg(F.count("*").alias("_copies"), F.min(position).alias("_first"))
        .filter("_copies > 1")
        .drop("_copies")
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    joined = df.join(repeated, same, "inner").filter(position > F.col("_first"))
    return joined.select(*df.columns)


def split_duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(first row per key, later copies) over whichever of the keys exist."""
    return keep_first(df, keys, order), later_copies(df, keys, order)


# ------------------------------------------------------------------ domains
def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def outside_domain(df: DataFrame, rules: Sequence[DomainRule]) -> Column:
    """Present value not allowed by the rules of one column."""
    checks = []
    for rule in rules:
        value = F.col(rule.column)
        if is_numeric(df, rule.column):
            # Text among the allowed values matches no number.
            value, allowed = value.cast("double"), [F.lit(str(v)).try_cast("double") for v in rule.allowed]
        else:
            allowed = [str(v) for v in rule.allowed]
        check = value.isNotNull() & ~F.coalesce(value.isin(allowed), F.lit(False))
        if rule.year is not None and "ANO" in df.columns:
            check = check & (F.col("ANO") == rule.year)
        checks.append(F.coalesce(check, F.lit(False)))
    return reduce(or_, checks)


def domain_checks(df: DataFrame, rules: Sequence[DomainRule]) -> dict[str, Column]:
    by_column: dict[str, list[DomainRule]] = {}
    for rule in rules:
        if rule.column in df.columns:
            by_column.setdefault(rule.column, []).append(rule)
    return {column: outside_domain(df, found) for column, found in by_column.items()}


def repair_domains(df: DataFrame, rules: Sequence[DomainRule]) -> DataFrame:
    """Present values outside the domain become null (numbers) or "UNKNOWN" (text)."""
    checks = domain_checks(df, rules)
    unknown = {rule.column: rule.unknown for rule in rules}

    def repaired(column: str) -> Column:
        if column not in checks:
            return F.col(column)
        kind = df.schema[column].dataType
        fill = F.lit(None).cast(kind) if is_numeric(df, column) else F.lit(unknown[column])
        return F.when(checks[column], fill).otherwise(F.col(column)).alias(column)

    return df.select(*[repaired(c) for c in df.columns])


# ------------------------------------------------------------------ pipeline
def clean(df: DataFrame, plan: CleaningPlan = CleaningPlan(), stored: bool = False) -> Cleaned:
    """Quarantine, then keep-first, then domain repair, plus the report of what changed.

    Rows that are ``stored`` are cheap to read again, so only those whose key may be repeated are shuffled whole.
    """
    scope = present_keys(df, plan.scope)
    keys = present_keys(df, plan.keys)
    keys = [*scope, *[k for k in keys if k not in scope]] if keys else []
    passing, invalid = quarantine(df, plan.ranges)
    if stored and keys:
        single, maybe = split_repeated(passing, keys)
        first = single.unionByName(keep_first(maybe, keys, plan.order))
    else:
        first = keep_first(passing, keys, plan.order)
    return Cleaned(
        valid=repair_domains(first, plan.domains),
        invalid=invalid,
        duplicates=later_copies(passing, keys, plan.order),
        report=cleaning_report(df, plan, first),
    )


def cleaning_report(df: DataFrame, plan: CleaningPlan, first: DataFrame) -> DataFrame:
    """Affected rows per rule (and per scope value), rules without any left out.

    Counts come from two aggregations that combine before the shuffle. Duplicates are the passing
    rows less the kept ones, so the copies themselves are not needed here.
    """
    scope = present_keys(df, plan.scope)
    bad = out_of_range(df, plan.ranges)
    before = df.groupBy(*scope).agg(
        F.count_if(bad).alias("invalid_rows"), F.count_if(~bad).alias("duplicates")
    )
    checks = domain_checks(first, plan.domains)
    after = first.groupBy(*scope).agg(
        (-F.count("*")).alias("duplicates"),
        *[F.count_if(check).alias(f"domain:{column}") for column, check in checks.items()],
    )
    long = before.unpivot(scope, None, "rule", "affected_rows").unionByName(
        after.unpivot(scope, None, "rule", "affected_rows")
    )
    return (
        long.groupBy(*scope, "rule")
        .agg(F.sum("affected_rows").alias("affected_rows"))
        .filter(F.col("affected_rows") > 0)
    )


# ------------------------------------------------------------------ one marked pass
VERDICT, REPAIRED = "_VERDICT", "_REPAIRED"
VALID, INVALID, DUPLICATE = "valid", "invalid", "duplicate"


def unique_keys(df: DataFrame, plan: CleaningPlan) -> list[str]:
    """Scope and identifier columns that exist; none if there is no identifier."""
    scope, keys = present_keys(df, plan.scope), present_keys(df, plan.keys)
    return [*scope, *[k for k in keys if k not in scope]] if keys else []


def flag(df: DataFrame, plan: CleaningPlan = CleaningPlan()) -> DataFrame:
    """Rows with a first verdict that needs no other row: ``invalid`` or, so far, ``valid``."""
    return df.withColumn(VERDICT, F.when(out_of_range(df, plan.ranges), INVALID).otherwise(VALID))


def first_positions(flagged: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Per key among the valid rows: its first position and its number of rows, combined before the shuffle."""
    keys = unique_keys(flagged, plan)
    valid = flagged.filter(F.col(VERDICT) == VALID)
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    return valid.groupBy(*named).agg(F.min(F.struct(*plan.order)).alias("_first"), F.count("*").alias("_copies"))


RUNNING = "_RUNNING"


def mark(
    flagged: DataFrame, plan: CleaningPlan, running: DataFrame | None = None, domains: DataFrame | None = None
) -> DataFrame:
    """Flagged rows with their last verdict and the repairs made (``_REPAIRED``, names of columns).

    A valid row is a duplicate if its key is taken already or if another row of its key comes first; missing identifiers are
    one key. A key is taken if its ``running`` count (``_key0``, ... of ``first_positions`` and ``_RUNNING``: valid rows of
    all batches so far, this one's included) exceeds its valid rows here; keys without such a count have one row. Only keys
    that are taken or repeated are joined to the rows, one row for each, so a hot key is split between tasks; without
    ``running``, rows whose key is not repeated are not shuffled. ``plan.order`` must tell rows apart: equal first rows all stay.
    Values outside their domain are replaced in valid rows only: domains of the plan, or those of the row's year
    from ``domains`` (``domains_by_year``).
    """
    keys = unique_keys(flagged, plan)
    rows = flagged
    if keys:
        names = [f"_key{i}" for i in range(len(keys))]
        single, compared = split_repeated(flagged, keys) if running is None else (None, flagged)
        firsts = first_positions(compared, plan)
        if running is None:
            known = firsts.filter("_copies > 1").withColumn("_taken", F.lit(False))
        else:
            total = running.select(*[F.col(n).alias(f"_run{n}") for n in names], RUNNING)
            same = [F.col(n).eqNullSafe(F.col(f"_run{n}")) for n in names]
            known = firsts.join(total, same).withColumn("_taken", F.col(RUNNING) > F.col("_copies"))
        known = known.select(*names, "_first", "_taken")
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
        rows = compared.join(known, same, "left")
        later = F.coalesce(F.col("_taken"), F.lit(False)) | F.coalesce(F.struct(*plan.order) > F.col("_first"), F.lit(False))
        rows = rows.withColumn(VERDICT, F.when((F.col(VERDICT) == VALID) & later, DUPLICATE).otherwise(F.col(VERDICT)))
        if single is not None:
            rows = single.unionByName(rows.select(*flagged.columns))
    outside = domain_checks(flagged, plan.domains)
    if domains is not None:
        rows = rows.join(domains, F.col("ANO") == F.col("_year"), "left")
        plain = [f.name for f in flagged.schema if f.name != VERDICT and isinstance(f.dataType, T.AtomicType)]
        outside = {c: outside_declared(flagged, c) for c in plain}
    checks = {c: (F.col(VERDICT) == VALID) & check for c, check in outside.items()}
    unknown = {c: "UNKNOWN" for c in checks} | {rule.column: rule.unknown for rule in plan.domains}

    def repaired(column: str) -> Column:
        if column not in checks:
            return F.col(column)
        kind = flagged.schema[column].dataType
        text = isinstance(kind, T.StringType)
        fill = F.lit(unknown[column]) if text else F.lit(None).cast(kind)
        return F.when(checks[column], fill).otherwise(F.col(column)).alias(column)

    names = F.array(*[F.when(check, F.lit(c)) for c, check in checks.items()]) if checks else F.array().cast("array<string>")
    out = [repaired(c) for c in flagged.columns]
    return rows.select(*out, F.filter(names, lambda x: x.isNotNull()).alias(REPAIRED))


def marked_report(marked: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Affected rows per rule and scope value, read off the marks."""
    scope = present_keys(marked, plan.scope)
    verdict = F.when(F.col(VERDICT) == INVALID, F.lit("invalid_rows")).when(F.col(VERDICT) == DUPLICATE, F.lit("duplicates"))
    repairs = F.transform(REPAIRED, lambda c: F.concat(F.lit("domain:"), c))
    rules = F.filter(F.concat(F.array(verdict), repairs), lambda x: x.isNotNull())
    return marked.select(*scope, F.explode(rules).alias("rule")).groupBy(*scope, "rule").agg(F.count("*").alias("affected_rows"))


def by_verdict(marked: DataFrame, plan: CleaningPlan) -> Cleaned:
    """The four tables as views of marked rows."""

    def having(verdict: str) -> DataFrame:
        return marked.filter(F.col(VERDICT) == verdict).drop(VERDICT, REPAIRED)

    return Cleaned(having(VALID), having(INVALID), having(DUPLICATE), marked_report(marked, plan))


def write_marked(
    df: DataFrame, path: str, plan: CleaningPlan = CleaningPlan(), compact: bool = False, domains: DataFrame | None = None
) -> Cleaned:
    """``clean`` by one write: rows once on disk, in folders by verdict and scope, and the four tables as views of them.

    ``compact`` evens out the files by one more shuffle, for rows of many tasks and years.
    """
    marked = mark(flag(df, plan), plan, domains=domains)
    marked = marked.drop(POSITION) if POSITION in marked.columns else marked
    folders = [VERDICT, *present_keys(marked, plan.scope)]
    out = marked.hint("rebalance", *[F.col(c) for c in folders]) if compact else marked
    out.write.partitionBy(*folders).parquet(path)
    rows = df.sparkSession.read.schema(marked.schema).parquet(path)
    return by_verdict(rows.select(*marked.columns), plan)


# ------------------------------------------------------------------ stand-alone rule checks
def first_broken_rule(df: DataFrame, rules: Sequence[RangeRule]) -> Column:
    """Reason of the first rule a row breaks, in rule order, or null."""
    reasons = [
        F.when(r.broken(), F.lit(f"range_{r.column}")) for r in rules if r.column in df.columns
    ]
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def enforce_ranges(
    df: DataFrame, rules: Sequence[RangeRule] = DEFAULT_RANGES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passing rows, broken rows with ``_reason``, report). A row counts for one rule only."""
    marked = df.withColumn("_reason", first_broken_rule(df, rules))
    broken = marked.filter(F.col("_reason").isNotNull())
    issues = [
        F.when(
            F.col("_reason") == f"range_{r.column}",
            F.lit(f"Valores fora do range ({r.low}, {r.high})"),
        )
        for r in rules
    ]
    report = (
        broken.groupBy("_reason")
        .agg(F.count("*").alias("affected_rows"))
        .select(
            F.lit("numeric_range").alias("rule_type"),
            F.substr(F.col("_reason"), F.lit(len("range_") + 1)).alias("column"),
            F.coalesce(*issues).alias("issue"),
            "affected_rows",
        )
    )
    return marked.filter(F.col("_reason").isNull()).drop("_reason"), broken, report


def enforce_domains(df: DataFrame, rules: Sequence[DomainRule]) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, report). Unlike ``repair_domains`` this also fills missing values."""
    rules = [r for r in rules if r.column in df.columns]
    outside = {r.column: ~F.coalesce(F.col(r.column).isin(list(r.allowed)), F.lit(False)) for r in rules}
    unknown = {r.column: r.unknown for r in rules}
    repaired = df.select(
        *[
            F.when(outside[c], F.lit(unknown[c])).otherwise(F.col(c).cast("string")).alias(c)
            if c in outside
            else F.col(c)
            for c in df.columns
        ]
    )
    counts = df.agg(*[F.count_if(check).alias(c) for c, check in outside.items()])
    issues = {
        r.column: f"Valores fora do domínio {sorted(r.allowed)[:10]}" for r in rules
    }
    report = (
        counts.unpivot([], None, "column", "affected_rows")
        .filter(F.col("affected_rows") > 0)
        .select(
            F.lit("domain").alias("rule_type"),
            "column",
            F.coalesce(*[F.when(F.col("column") == c, F.lit(i)) for c, i in issues.items()]).alias(
                "issue"
            ),
            "affected_rows",
        )
    )
    return repaired, report
