"""Quality rules as a learned decision list.

Text statistics are counted per document; sequential covering then learns, from labelled statistics, an
ordered list of threshold conjunctions that describe bad documents. The list is a Spark conditional expression.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import BLANKS, blank_words, full_text, stored, text_key
from examlake.operators.quantiles import exact_summary

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features() -> dict[str, Column]:
    """What rules may test: names and their expressions over the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
    }


def _neighbours(array: Column | str, test) -> Column:
    """``test(element, next element)`` along an array; the last element has a null for the next."""
    a = F.col(array) if isinstance(array, str) else array
    return F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), test)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key`` and the counts, as longs, of every text; one row per input row, without a shuffle.

    Null and empty texts count zero throughout. A line with a word that equals an earlier one is a duplicate line. A word
    is repeated if it stands in a window of five words found twice or more in its text.
    """
    text = full_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    base = docs.select(
        "doc_id",
        text_key().alias("text_key"),
        blank_words(text).alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.when(
        F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = base.select(
        "doc_id",
        "text_key",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window get the sorted pairs.
    paired = hashed.withColumn(
        "pairs",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    equal = _neighbours("pairs", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    placed = paired.withColumn(
        "at", F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    ).drop("pairs")
    steps = _neighbours("at", lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return placed.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("bigint"))).drop("at").select(
        "doc_id", "text_key", *COUNTS
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        test = F.lit(True)
        for c in self.conditions:
            test = test & c.column()
        return test

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, none keeps."""

    rules: tuple[Rule, ...] = field(default=())

    def verdict(self) -> Column:
        """The number of the rule that rejects, from 1; null if none does."""
        chain = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            chain = F.when(rule.column(), F.lit(i)).otherwise(chain)
        return chain


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[float, float]]]:
    """Bad and good rows by feature and interval between cuts: one aggregation, a few dozen numbers."""
    bins = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                sum((F.when(value > c, 1).otherwise(0) for c in cuts[name]), F.lit(0)).alias("bin"),
            )
            for name, value in features().items()
        ]
    )
    grouped = rows.select("bad", F.explode(bins).alias("b")).groupBy("b.feature", "b.bin").agg(
        F.sum("bad").alias("bad"), F.count("*").alias("n")
    )
    table = {name: [(0.0, 0.0)] * (len(c) + 1) for name, c in cuts.items()}
    for r in grouped.collect():
        table[r["feature"]][r["bin"]] = (float(r["bad"]), float(r["n"] - r["bad"]))
    return table


def _best(table, cuts, least_bad: float) -> tuple[Condition, float, float] | None:
    """The condition that leaves the most bad rows per row, with what it covers; ties go to more bad rows, then to names."""
    found = []
    for name, cells in table.items():
        all_bad, all_good = (sum(c[k] for c in cells) for k in (0, 1))
        bad = good = 0.0
        for cut, (b, g) in zip(cuts[name], cells):
            bad, good = bad + b, good + g
            for above, p, n in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                if p >= least_bad:
                    found.append((round((p + 1) / (p + n + 2), 4), p, name, above, cut, n))
    if not found:
        return None
    _, p, name, above, cut, n = max(found, key=lambda f: f[:4])
    return Condition(name, above, cut), p, n


STEPS = [i / 20 for i in range(1, 20)] + [0.975, 0.99]


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Values a rule may test, by feature: zero and quantiles of the bad and of the good rows; none if there are no rows.

    The quantiles are exact and located by counting, on values scaled to [0, 1] by each feature's range, so that no task
    holds the values of a group.
    """
    values = features()
    ends = rows.agg(*[x for k, v in values.items() for x in (F.min(v).alias(f"{k}_low"), F.max(v).alias(f"{k}_high"))]).first()
    low = {k: ends[f"{k}_low"] for k in values}
    if None in low.values():
        return {}
    width = {k: (ends[f"{k}_high"] - low[k]) or 1.0 for k in values}
    pairs = [x for k, v in values.items() for x in (F.lit(k), (v - low[k]) / width[k])]
    long = rows.select("bad", F.stack(F.lit(len(values)), *pairs).alias("feature", "value"))
    found = exact_summary(long, ["bad", "feature"], "value", {f"q{i}": q for i, q in enumerate(STEPS)}, 0.0, 1.0).collect()
    cuts = {k: {0.0} for k in values}
    for r in found:
        k = r["feature"]
        cuts[k] |= {round(low[k] + width[k] * r[f"q{i}"], 6) for i in range(len(STEPS))}
    return {k: sorted(c) for k, c in cuts.items()}


def learn(labelled: DataFrame, precision: float = 0.97, most_rules: int = 8, most_conditions: int = 3) -> DecisionList:
    """Decision list from ``statistics`` with a column ``bad`` (0 or 1); rows with a null ``bad`` don't count.

    Each round grows a rule on two thirds of the rows the list does not cover yet, adding the best condition while
    precision rises, and prunes it from its end on the rest. A rule that is not precise on the latter ends
    the list. Every round works by aggregation over the stored rows; only counts come to the driver.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0
    rows = stored(labelled.filter("bad is not null").select(*COUNTS, F.col("bad").cast("int").alias("bad"), part.alias("prune")), "quality-labelled")
    cuts = thresholds(rows)
    rules: list[Rule] = []
    left = rows
    while cuts and len(rules) < most_rules:
        grow, best, part_rows = [], 0.0, left.filter(~F.col("prune"))
        least = 3.0
        while len(grow) < most_conditions:
            found = _best(_counts(part_rows, cuts), cuts, least)
            if found is None:
                break
            condition, bad, good = found
            if (bad + 1) / (bad + good + 2) <= best:
                break
            best = (bad + 1) / (bad + good + 2)
            grow.append(condition)
            part_rows = part_rows.filter(condition.column())
            if not good:
                break
        if not grow:
            break
        tests = [Rule(tuple(grow[: i + 1])) for i in range(len(grow))]
        held = left.filter("prune").agg(
            *[F.coalesce(F.sum(F.when(t.column(), v)), F.lit(0)).alias(f"{k}{i}") for i, t in enumerate(tests) for k, v in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]
        ).first()
        worth = [(held[f"bad{i}"] - held[f"good{i}"]) / max(1, held[f"bad{i}"] + held[f"good{i}"]) for i in range(len(tests))]
        pick = max(range(len(tests)), key=lambda i: (round(worth[i], 3), -i))
        if held[f"bad{pick}"] < precision * max(1, held[f"bad{pick}"] + held[f"good{pick}"]):
            break
        rules.append(tests[pick])
        left = left.filter(~tests[pick].column())
    return DecisionList(tuple(rules))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (that rejects, or null) and ``kept``."""
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdicts of all documents by rules learned from ``labels`` (``doc_id, quality``; 0 is bad).

    Unlabelled rows are only judged; without labels there are no rules and the base alone decides. Null texts count zero and fail
    the base; repeated rows are judged each; an empty table gives no rows; of other columns none is read.
    """
    stats = stored(statistics(docs), "quality-statistics")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.join(known, "doc_id").filter(~base_failed()).withColumn("bad", (F.col("quality") == 0).cast("int"))
    return judge(stats, learn(labelled))
