"""Quality rules: decision lists learnt by sequential covering, run as one ordered Spark conditional expression.

Every text's statistics are DataFrame expressions. The labelled ones are counted in Spark in cells of a threshold grid,
so that the learner sees all labels through a table whose size the grid bounds. It grows a rule (a conjunction of
threshold conditions on low quality documents) by information gain on two thirds of the labels, prunes it on the rest,
removes what it covers and repeats while rules stay precise. Documents that no rule drops are kept.

Defined results: a null or wordless text has all statistics 0 and fails the base test. Without labels no rule is learnt.
Repeated rows are judged alike. Input columns named like a statistic are not used and not returned by statistics().
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, table

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Statistics that rules use, with the thresholds they choose from.
RATES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5)
GRID: dict[str, tuple[float, ...]] = {
    "n_words": (20.0, 50.0, 100.0, 1000.0, 10000.0),
    "word_length": (2.5, 3.5, 4.0, 4.25, 4.5, 5.0, 6.0, 7.0, 9.0),
    "symbol_rate": (*RATES, 1.0, 2.0),
    "dup_line_rate": RATES,
    "repeat_rate": RATES,
    "upper_rate": (*RATES, 0.8),
    "distinct_rate": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6),
}
#: A rule must be this precise on the labels it was not grown on and cover so many low quality labels there.
PRECISION, LEAST_COVER, MAX_CONDITIONS, MAX_RULES = 0.9, 3, 4, 12

Condition = tuple[str, str, float]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_distinct (words) and n_upper (A-Z) of each whole text."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        "doc_id",
        F.array_remove(F.split(text, SPACE), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    base = [F.col(c) for c in ("doc_id", "word_chars", "n_symbols", "n_upper")]
    n_lines = F.size("lines").cast("long").alias("n_lines")
    lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
    hashed = words.select(*base, lines, n_lines, F.size("w").cast("long").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    starts = F.sequence(F.lit(0), F.size("h") - WINDOW)
    windows = F.when(F.size("h") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    base += [F.col("n_dup_lines"), F.col("n_lines"), F.col("n_words")]
    n_distinct = F.size(F.array_distinct("h")).cast("long").alias("n_distinct")
    found = hashed.select(*base, n_distinct, windows.alias("win"))
    base.append(F.col("n_distinct"))
    # windows in order of their hash, only where some hash comes twice
    ordered = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    found = found.select(*base, ordered.alias("o"))
    twice = F.filter("o", lambda s, i: F.coalesce(s["x"] == F.get("o", i + 1)["x"], F.lit(False)) | F.coalesce(s["x"] == F.get("o", i - 1)["x"], F.lit(False)))
    found = found.select(*base, F.sort_array(F.transform(twice, lambda s: s["i"])).alias("at"))
    reach = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return found.select(*base, repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features(stats: DataFrame) -> DataFrame:
    """stats with the columns of GRID."""
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return stats.withColumns({
        "word_length": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "word_chars"), "distinct_rate": per("n_distinct", "n_words"),
    })


def cells(labelled: DataFrame) -> list[tuple[dict[str, int], bool, int, int]]:
    """(bin of each statistic, whether to grow on it, low, high quality labels) for the occupied cells of the grid."""
    bins = [sum((F.when(F.col(c) > t, 1).otherwise(0) for t in cuts), F.lit(0)).alias(c) for c, cuts in GRID.items()]
    low = F.sum(F.when(F.col("quality") == 0, 1).otherwise(0))
    grow = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow")
    rows = labelled.select(*bins, grow, "quality").groupBy(*GRID, "grow").agg(low.alias("low"), F.count("*").alias("n")).orderBy(*GRID, "grow").collect()
    return [({c: r[c] for c in GRID}, r["grow"], r["low"], r["n"] - r["low"]) for r in rows]


def holds(at: dict[str, int], rule: Sequence[Condition]) -> bool:
    """Whether a cell lies within the rule: bin k of a statistic holds the values above its first k thresholds."""
    return all((at[c] > GRID[c].index(t)) if op == ">" else (at[c] <= GRID[c].index(t)) for c, op, t in rule)


def covered(found, rule: Sequence[Condition]) -> tuple[int, int]:
    inside = [(low, high) for at, _, low, high in found if holds(at, rule)]
    return sum(x for x, _ in inside), sum(x for _, x in inside)


def grow(found) -> list[Condition]:
    """Adds the condition with the most information gain until no high quality label is covered or none gains."""
    rule: list[Condition] = []
    low, high = covered(found, rule)
    while high and low and len(rule) < MAX_CONDITIONS:
        before = math.log2(low / (low + high))
        gained = []
        for c, cuts in GRID.items():
            for t in cuts:
                for op in (">", "<="):
                    a, b = covered(found, [(c, op, t)])
                    if a and (b < high or a < low):
                        gained.append((a * (math.log2(a / (a + b)) - before), -b, (c, op, t)))
        best = max(gained, default=(0, 0, None))
        if best[0] <= 0:
            break
        rule.append(best[2])
        found = [x for x in found if holds(x[0], [best[2]])]
        low, high = covered(found, [])
    return rule


def worth(found, rule: Sequence[Condition]) -> float:
    low, high = covered(found, rule)
    return (low - high) / (low + high) if low + high else -1.0


def learn(found) -> list[list[Condition]]:
    """The ordered rules for low quality."""
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        rule = grow([x for x in found if x[1]])
        held = [x for x in found if not x[1]]
        # the shortest of the best beginnings of the rule
        ends = [(worth(held, rule[:k]), -k) for k in range(1, len(rule) + 1)]
        if not ends:
            break
        rule = rule[: -max(ends)[1]]
        low, high = covered(held, rule)
        if low < LEAST_COVER or low < PRECISION * (low + high):
            break
        rules.append(rule)
        found = [x for x in found if not holds(x[0], rule)]
    return rules


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """False for the first rule that holds, else true, as one conditional expression."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c, op, t in rule:
            test = test & ((F.col(c) > t) if op == ">" else (F.col(c) <= t))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of docs with base_failed and kept, by rules learnt from labels(doc_id, quality)."""
    stats = features(materialize(statistics(docs), "statistics")).withColumn("base_failed", base_failed())
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    rules = learn(cells(stats.where(~F.col("base_failed")).join(labels, "doc_id")))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
