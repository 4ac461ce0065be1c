"""Learned decision lists over text statistics.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds, grown
by information gain on one part of the labelled rows and pruned on the other; rows that
a rule covers leave, and the next rule is learned on the rest. The driver sees only
histograms of (statistic, bin), never rows. The list becomes one ordered Spark
conditional expression.

Defined results: a NULL text counts as empty; without labels, or with labels of one
kind, the list is empty and only the base test decides; a document labelled both ways
counts as unlabelled; a repeated row gets the same verdict each time; an empty table gives
an empty result. Words are separated by ASCII white space. Windows of three words
are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterbook.llm.common import SPACE, fresh, store, word_list

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
BINS = 32
MAX_CONDITIONS = 4
MAX_RULES = 12
MIN_PRECISION = 0.9
MIN_COVER = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Ratios that the rules may test.
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "upper_per_char": "n_upper / word_chars",
    "digits_per_char": "n_digits / word_chars",
    "stops_per_word": "n_stops / n_words",
    "chars_per_word": "word_chars / n_words",
    "dup_lines_per_line": "n_dup_lines / n_lines",
    "repeats_per_word": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
}


def _without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its counts, in columns of unused names; and those names."""
    names = {n: fresh(docs, n) for n in [*COUNTS, "n_upper", "n_digits", "n_stops", "n_lines", "n_distinct"]}
    step = {n: fresh(docs, f"__{n}") for n in ("text", "words", "lines", "grams", "sorted", "places")}
    words, lines, grams, ranked, places = (F.col(f"`{step[n]}`") for n in ("words", "lines", "grams", "sorted", "places"))
    whole = F.col(f"`{step['text']}`")
    df = docs.withColumn(step["text"], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumns(
        {
            step["words"]: word_list(whole),
            step["lines"]: F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        }
    )
    # One hash per window of three words; a window is named by its first word.
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn(
        step["grams"],
        F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(1)))),
    )
    # Only texts with a repeated window pay for sorting (hash, place).
    df = df.withColumn(
        step["sorted"],
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    )
    def same(e, k):
        return F.get(ranked, k)["g"].eqNullSafe(e["g"])

    repeated = F.filter(ranked, lambda e, k: same(e, k - 1) | same(e, k + 1))
    df = df.withColumn(step["places"], F.array_sort(F.transform(repeated, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.withColumns(
        {
            names["n_words"]: F.size(words).cast("long"),
            names["word_chars"]: F.length(F.array_join(words, "")).cast("long"),
            names["n_symbols"]: _without(whole, SYMBOLS),
            names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            names["n_repeat_words"]: F.coalesce(covered, F.lit(0).cast("long")),
            names["n_upper"]: _without(whole, r"\p{Lu}"),
            names["n_digits"]: _without(whole, "[0-9]"),
            names["n_stops"]: _without(whole, "[.!?]"),
            names["n_lines"]: F.size(lines).cast("long"),
            names["n_distinct"]: F.size(F.array_distinct(words)).cast("long"),
        }
    )
    return df.drop(*step.values()), names


def _ratio(formula: str, names: dict[str, str]) -> Column:
    above, below = (F.col(f"`{names[n]}`").cast("double") for n in formula.split(" / "))
    return above / F.greatest(below, F.lit(1.0))


def base_failed(names: dict[str, str]) -> Column:
    n_words, n_repeat = F.col(f"`{names['n_words']}`"), F.col(f"`{names['n_repeat_words']}`")
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, names: dict[str, str]) -> Column:
        value = _ratio(RATIOS[self.statistic], names)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that a rule covers is rejected, others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_number(self, names: dict[str, str]) -> Column:
        """Number (from 1) of the first rule that covers a row, NULL for none."""
        out = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            test = F.lit(True)
            for condition in rule:
                test = test & condition.holds(names)
            out = F.when(test, F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) or "keep all"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _test(conditions: list[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for name, above, cut in conditions:
        out = out & ((F.col(name) > cut) if above else (F.col(name) <= cut))
    return out


def fit_decision_list(
    statistics: DataFrame,
    names: dict[str, str],
    labels: DataFrame,
    doc_id: str = "doc_id",
    label: str = "quality",
    min_precision: float = MIN_PRECISION,
) -> DecisionList:
    """Learn when a row is of label 0; ``statistics`` holds ``doc_id`` and the counts."""
    marks = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label"))
        .where("label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .drop("most")
    )
    values = statistics.select(F.col(doc_id).alias("id"), *[_ratio(f, names).alias(n) for n, f in RATIOS.items()])
    known = store(values.join(marks, "id"), "labelled")
    shares = [i / BINS for i in range(1, BINS)]
    cuts = known.agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in RATIOS]).first()
    if cuts is None or cuts[0] is None:
        return DecisionList(())
    cuts = {n: sorted(set(cuts[n])) for n in RATIOS}
    # The bin of a value is the number of cuts below it, so "bin > k" is "value > cuts[k]".
    binned = known.select(
        (F.pmod(F.xxhash64(F.lit("prune"), "id"), F.lit(3)) == 0).alias("prune"),
        (F.col("label") == 0).cast("long").alias("bad"),
        *[
            sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n)
            for n in RATIOS
        ],
    )
    left = store(
        binned.groupBy("prune", *RATIOS).agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")), "binned"
    )

    def grow() -> list[tuple[str, bool, int]]:
        chosen: list[tuple[str, bool, int]] = []
        while len(chosen) < MAX_CONDITIONS:
            rows = (
                left.where(~F.col("prune") & uncovered & _test(chosen))
                .select("p", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in RATIOS])).alias("x"))
                .groupBy("x.f", "x.b")
                .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
                .collect()  # statistics times bins
            )
            bins: dict[str, dict[int, tuple[int, int]]] = {}
            for r in rows:
                bins.setdefault(r.f, {})[r.b] = (r.p, r.n)
            first = next(iter(bins.values()), {})
            p0, n0 = sum(p for p, _ in first.values()), sum(n for _, n in first.values())
            if not p0 or not n0:
                break
            best, choice = 1e-9, None
            for name in sorted(bins):
                below_p = below_n = 0
                for cut in range(len(cuts[name])):
                    p, n = bins[name].get(cut, (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                        if (g := _gain(p, n, p0, n0)) > best:
                            best, choice = g, (name, above, cut)
            if choice is None:
                break
            chosen.append(choice)
        return chosen

    uncovered, rules = F.lit(True), []
    while len(rules) < MAX_RULES:
        grown = grow()
        if not grown:
            break
        # Counts of every prefix of the conjunction, on both parts, in one job.
        sums = []
        for k in range(1, len(grown) + 1):
            test = _test(grown[:k]) & uncovered
            for part in (True, False):
                for c in ("p", "n"):
                    sums.append(F.coalesce(F.sum(F.when(test & (F.col("prune") == part), F.col(c))), F.lit(0)))
        counts = left.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        worth = []
        for k in range(1, len(grown) + 1):
            p, n, gp, gn = counts[4 * k - 4 : 4 * k]
            worth.append(((p - n) / (p + n) if p + n else (gp - gn) / max(gp + gn, 1), k, p + gp, n + gn))
        _, k, p, n = max(worth, key=lambda w: (w[0], -w[1]))
        if p < MIN_COVER or p < min_precision * (p + n):
            # The longest form is the most precise one on the growing part.
            _, k, p, n = worth[-1]
            if p < MIN_COVER or p < min_precision * (p + n):
                break
        rules.append(grown[:k])
        uncovered = uncovered & ~_test(grown[:k])
    return DecisionList(tuple(tuple(Condition(n, a, float(cuts[n][c])) for n, a, c in rule) for rule in rules))


def quality_verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its counts, ``base_failed``, the number of the rule that rejects it, ``kept``."""
    counted, names = with_statistics(docs.select(doc_id, text), text)
    statistics = store(counted.drop(text), "statistics")
    rules = fit_decision_list(statistics, names, labels, doc_id)
    return statistics.select(
        doc_id, *COUNTS, base_failed(names).alias("base_failed"), rules.rule_number(names).alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the base test and the learned list keep, with their own columns."""
    labelled, names = with_statistics(docs.select(doc_id, text).join(labels.select(doc_id).distinct(), doc_id, "left_semi"), text)
    rules = fit_decision_list(store(labelled.drop(text), "statistics"), names, labels, doc_id)
    counted, names = with_statistics(docs, text)
    good = fresh(counted, "__good")
    verdict = ~base_failed(names) & rules.rule_number(names).isNull()
    # The verdict passes a generator: pushed below the statistics, the filter would repeat them per test.
    return counted.select(*docs.columns, F.explode(F.array(verdict)).alias(good)).where(F.col(good)).select(*docs.columns)
