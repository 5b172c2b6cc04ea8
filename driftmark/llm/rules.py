"""Quality rules: a learned decision list over text statistics.

Statistics of a text are column expressions. Rules are found by sequential covering: a conjunction
of thresholds grows on two thirds of the labelled rows, condition by condition, by the gain that
FOIL uses; its tail is cut off again where the last third says so; what it covers is taken out, and
the next one grows. The list of rules becomes one ordered conditional expression.

Candidate thresholds are quantiles of either label, over values rounded to two digits, so that their
table is small whatever the corpus. Labelled rows are then counted by the bins between thresholds;
every step of the search is one aggregate over these counts, and only sums per feature and bin
reach the driver. All labelled rows take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.sources.scratch import materialize

WHITE, NOT_WHITE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SYMBOLS, CAPITALS, MARKS = "[#*$%&|<>]", "[A-Z]", "[!?]"
WINDOW = 3
#: Base rule: too short, or more than half of the words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Thresholds per feature and label, conditions per rule, rules per list.
CUTS, MOST_CONDITIONS, MOST_RULES = 16, 4, 12
#: Rows of the low label a rule has to cover, and their share among all it covers.
LEAST_COVERED, LEAST_PRECISION = 3, 0.9

STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_capitals",
    "n_marks",
    "n_lines",
    "n_distinct_words",
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("long")


def words_of(text: Column) -> Column:
    """Words of a text, between the white space of ASCII."""
    return F.array_remove(F.split(text, f"{WHITE}+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows that occur twice or more, all occurrences counted.

    The windows are sorted with their places; those equal to a neighbour are repeated, and each
    adds the words up to the next repeated one."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))
    windows = F.transform(
        starts,
        lambda w, i: F.struct(
            F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, window))).alias("w"),
            i.alias("at"),
        ),
    )

    def repeated(rows: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            before, after = (F.get(rows, i + step)["w"] for step in (-1, 1))
            return before.eqNullSafe(x["w"]) | after.eqNullSafe(x["w"])

        return F.sort_array(F.transform(F.filter(rows, same), lambda x: x["at"]))

    def covered(places: Column) -> Column:
        added = F.transform(
            places,
            lambda at, i: F.least(
                F.lit(window), F.coalesce(F.get(places, i + 1) - at, F.lit(window))
            ),
        )
        return F.aggregate(added, F.lit(0).cast("long"), lambda a, b: a + b)

    return _let(F.sort_array(windows), lambda rows: _let(repeated(rows), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the numbers in ``STATISTICS``) of every whole text.

    docs: doc_id and text; other columns are ignored. A null text has no words and no lines. Null
    and repeated ids are rows like any other.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WHITE))
    of_words = _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.size(F.array_distinct(w)).alias("distinct"),
            repeated_words(w).alias("repeated"),
        ),
    )
    of_lines = _let(
        lines,
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")),
    )
    counted = docs.select(
        "doc_id",
        of_words.alias("words"),
        of_lines.alias("lines"),
        (F.length(text).cast("long") - _count(text, WHITE)).alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, CAPITALS).alias("n_capitals"),
        _count(text, MARKS).alias("n_marks"),
    )
    return counted.select(
        "doc_id",
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
        F.col("words.repeated").alias("n_repeat_words"),
        "n_capitals",
        "n_marks",
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("words.distinct").cast("long").alias("n_distinct_words"),
    )


def features() -> dict[str, Column]:
    """What rules speak of, from the columns of ``statistics``; 0 without words or lines."""

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "characters per word": share("word_chars", "n_words"),
        "symbols per word": share("n_symbols", "n_words"),
        "marks per word": share("n_marks", "n_words"),
        "capitals per character": share("n_capitals", "word_chars"),
        "repeated lines per line": share("n_dup_lines", "n_lines"),
        "words in repeated windows per word": share("n_repeat_words", "n_words"),
        "distinct words per word": share("n_distinct_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, limit = features()[self.feature], F.lit(self.threshold)
        return value > limit if self.above else value <= limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _two_digits(value: Column) -> Column:
    """Rounded to two significant digits, by the power of ten below it; 0 below a millionth."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 1)
    return F.when(F.abs(value) < 1e-6, F.lit(0.0)).otherwise(F.round(value / power) * power)


def _quantiles(counts: list[tuple[float, int]], parts: int) -> set[float]:
    """Values at the inner boundaries of ``parts`` equal parts of counted, sorted values."""
    total, passed, out = sum(n for _, n in counts), 0, set()
    for value, n in counts:
        # The first boundary at or above what was passed lies within this value.
        if passed * parts // total != (passed + n) * parts // total:
            out.add(value)
        passed += n
    return out


def thresholds(labelled: DataFrame, names: list[str], parts: int) -> dict[str, list[float]]:
    """Candidate thresholds of every feature: quantiles of the rows of either label.

    Rounded, a feature has a few hundred values at most, so the counts fit the driver.
    """
    lists = F.array(
        *(F.struct(F.lit(n).alias("feature"), _two_digits(F.col(f"`{n}`")).alias("value")) for n in names)
    )
    counted = (
        labelled.select(F.inline(lists), "good", "bad")
        .groupBy("feature", "value")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .collect()
    )
    out = {}
    for name in names:
        rows = sorted((r.value, r.good, r.bad) for r in counted if r.feature == name)
        cuts = set()
        for column in (1, 2):
            seen = [(r[0], r[column]) for r in rows if r[column]]
            cuts |= _quantiles(seen, parts) if seen else set()
        out[name] = sorted(cuts)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


class Covering:
    """Counts of labelled rows by the bins of their features, and the questions asked of them."""

    def __init__(self, labelled: DataFrame, names: list[str], cuts: dict[str, list[float]]):
        self.names, self.cuts = names, cuts
        bins = [
            sum((F.when(F.col(f"`{n}`") > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(f"b{i}")
            for i, n in enumerate(names)
        ]
        keys = [f"b{i}" for i in range(len(names))]
        self.cells = materialize(
            labelled.select(*bins, "growing", "good", "bad")
            .groupBy(*keys, "growing")
            .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")),
            "rule-cells",
        )

    def holds(self, rule: Rule) -> Column:
        met = F.lit(True)
        for c in rule:
            at = self.cuts[c.feature].index(c.threshold)
            place = F.col(f"b{self.names.index(c.feature)}")
            met = met & (place > at if c.above else place <= at)
        return met

    def best_condition(self, left: Column, rule: Rule) -> tuple[Condition | None, int]:
        """The condition of highest gain to add to a rule, and the good rows covered with it."""
        lists = F.array(
            *(
                F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin"))
                for i in range(len(self.names))
            )
        )
        rows = (
            self.cells.where(F.col("growing") & left & self.holds(rule))
            .select(F.inline(lists), "good", "bad")
            .groupBy("feature", "bin")
            .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
            .collect()
        )
        counts = {(r.feature, r.bin): (r.good, r.bad) for r in rows}
        best, chosen = 0.0, (None, 0)
        for i, name in enumerate(self.names):
            size = len(self.cuts[name]) + 1
            of_bin = [counts.get((i, b), (0, 0)) for b in range(size)]
            n0, p0 = (sum(x) for x in zip(*of_bin, strict=True))
            below_n = below_p = 0
            for (n, p), cut in zip(of_bin, self.cuts[name], strict=False):
                below_n, below_p = below_n + n, below_p + p
                for above in (True, False):
                    cn, cp = (n0 - below_n, p0 - below_p) if above else (below_n, below_p)
                    gain = _gain(cp, cn, p0, n0)
                    if gain > best + 1e-9:
                        best, chosen = gain, (Condition(name, above, cut), cn)
        return chosen

    def counts(self, left: Column, rule: Rule, growing: bool) -> list[tuple[int, int]]:
        """(bad, good) rows covered by every beginning of the rule, the empty one first."""
        ends = range(len(rule) + 1)
        sums = [
            F.coalesce(F.sum(F.when(self.holds(rule[:k]), F.col(c))), F.lit(0)).alias(f"{c}{k}")
            for k in ends
            for c in ("bad", "good")
        ]
        rows = self.cells.where(left & (F.col("growing") == growing))
        row = rows.agg(*sums).first()
        return [(row[f"bad{k}"], row[f"good{k}"]) for k in ends]


def labelled_rows(stats: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(features, good, bad, growing): statistics of rows with a usable label of 0 or 1.

    Labels are counted per id first, so repeated ones weigh by their number and join once.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & usable)
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(
            F.sum((F.col("quality") == 1).cast("long")).alias("good"),
            F.sum((F.col("quality") == 0).cast("long")).alias("bad"),
        )
    )
    third = F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(3))
    return stats.join(known, F.col("doc_id") == F.col("label_id")).select(
        *(c.alias(n) for n, c in features().items()), "good", "bad", (third > 0).alias("growing")
    )


def fit(stats: DataFrame, labels: DataFrame, usable: Column | None = None) -> list[Rule]:
    """The rules, in order, that say which rows are of label 0.

    stats: see ``statistics``, best stored; labels: doc_id and quality (0 or 1, others are left
    out); ``usable`` says which labels may be learnt from. Without rows of both labels, or without
    a rule that is precise enough on the third held back for pruning, the list is empty.
    """
    names = list(features())
    labelled = materialize(
        labelled_rows(stats, labels, F.lit(True) if usable is None else usable), "rule-rows"
    )
    space = Covering(labelled, names, thresholds(labelled, names, CUTS))
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < MOST_RULES:
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            condition, good = space.best_condition(left, rule)
            if condition is None:
                break
            rule += (condition,)
            if not good:
                break
        if not rule:
            break
        pruning = space.counts(left, rule, growing=False)
        # Without rows held back the rule stays as it grew.
        if any(p + n for p, n in pruning):
            worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pruning]
            rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth[k], -k))]
        bad, good = pruning[len(rule)]
        if not bad + good:
            bad, good = space.counts(left, rule, growing=True)[len(rule)]
        if bad < LEAST_COVERED or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(rule)
        left = left & ~space.holds(rule)
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """1-based number of the first rule that holds, as one conditional expression; null if none."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        met = F.lit(True)
        for condition in rule:
            met = met & condition.column()
        out = F.when(met, F.lit(number)).otherwise(out)
    return out


def decide(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with base_failed, rule (see ``rule_number``) and kept: neither failed nor ruled
    out."""
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return stats.withColumns({"base_failed": failed, "rule": rule_number(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
