"""Quality rules: learned decision lists (operator 1).

Sequential covering: for either verdict a rule, a conjunction of thresholds on text statistics, is grown condition by
condition on part of the labelled documents, pruned on the rest, and kept if it is precise enough there. The more precise of
the two joins the list, the documents that it covers are set aside, and the next rules are grown on what is left. The list
is emitted as one ordered conditional expression of Spark: the first rule that holds decides, so a rule that keeps documents
shields them from later ones that reject. Documents that no rule covers are kept.

Statistics, and the verdict, are column expressions. Rules are learned from counts of labelled documents by statistic
intervals, over at most ``max_labelled`` different texts of labelled documents (those with the smallest hashes of id and
text). Only their statistics are shuffled, never texts.

NULL, empty and blank texts have no words and fail the base checks; texts of any length are measured whole. A document whose
labels contradict one another is not learned from; without usable labels the list is empty and the base checks alone decide.
Rows without a ``doc_id`` are judged like all others, repeated rows alike. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import columns, stored, words

WINDOW = 8
#: Characters that count as symbols (fixed value).
SYMBOLS = "[#*$%&|<>]"
#: Learned statistics: shares, so that a threshold means the same in short and long texts.
STATISTICS = {
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
    "capitals": "n_capitals / word_chars",
    "digits": "n_digits / word_chars",
    "word_length": "word_chars / n_words",
}


def measured(documents: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` with the counts that the rules look at, for the column ``text``."""
    content = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(*kept, content.alias("content")).withColumn("words", words(F.col("content")))

    def without(pattern: str) -> Column:
        return F.length("content") - F.length(F.regexp_replace("content", pattern, ""))

    # Elements by index: a slice inside a lambda would copy the whole array each time.
    windows = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])))
    lines = F.filter(F.split("content", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)
    counted = base.select(
        *kept, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        without(SYMBOLS).cast("long").alias("n_symbols"), without("[!?;:=_~^]").alias("n_marks"),
        without(r"\p{Lu}").alias("n_capitals"), without("[0-9]").alias("n_digits"),
        lines.alias("lines"), F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"))
    # Windows sorted by hash: one that equals a neighbour occurs more than once.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeated, F.sort_array(F.arrays_zip(
        F.col("windows").alias("h"), F.sequence(F.lit(1), F.size("windows")).alias("at"))))
    shifted = counted.withColumn("placed", placed).withColumns({
        "before": F.concat(F.array(F.lit(None).cast("struct<h:bigint,at:int>")), "placed"),
        "after": F.slice("placed", F.lit(2), F.size("windows"))})
    starts = F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(
        F.filter(F.arrays_zip("placed", "before", "after"),
                 lambda x: (x["placed"]["h"] == x["before"]["h"]) | (x["placed"]["h"] == x["after"]["h"])),
        lambda x: x["placed"]["at"])))
    # Each repeated window covers eight words, or as many as there are before the next one.
    found = shifted.withColumn("starts", starts).withColumn("next", F.slice("starts", F.lit(2), F.size("windows")))
    covered = F.aggregate(F.arrays_zip("starts", "next"), F.lit(0).cast("long"), lambda total, x: total + F.coalesce(
        F.least(F.lit(WINDOW), x["next"] - x["starts"]), F.lit(WINDOW)))
    counts = F.struct(
        "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_distinct", "n_marks", "n_capitals",
        "n_digits", F.size("lines").alias("n_lines"))
    # As generated columns, so that a filter on them is not moved down and the steps above repeated inside it.
    return found.select(*kept, F.inline(F.array(counts)))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def statistic(name: str) -> Column:
    over, under = STATISTICS[name].split(" / ")
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = statistic(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold


class Rule(tuple):
    """Conditions that must all hold, and whether documents for which they do are rejected or kept."""

    rejects = True

    def __new__(cls, conditions: Iterable[Condition], rejects: bool = True) -> Rule:
        rule = super().__new__(cls, conditions)
        rule.rejects = rejects
        return rule


def rejects(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: true where the first rule that holds rejects a document."""
    verdict = None
    for rule in map(Rule, rules, [getattr(r, "rejects", True) for r in rules]):
        condition = rule[0].column()
        for further in rule[1:]:
            condition &= further.column()
        verdict = (F if verdict is None else verdict).when(condition, F.lit(rule.rejects))
    return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))


def labelled_counts(documents: DataFrame, labels: DataFrame, max_labelled: int, steps: int) -> tuple[dict, list]:
    """Thresholds of each statistic, and (interval of each statistic, for pruning, bad, number) of labelled documents.

    Only documents that pass the base checks count. Of all labels, the ``max_labelled`` with the smallest hashes of their
    id are looked up; of the documents found, the ``max_labelled`` with the smallest hashes of id and text count, copies once.
    """
    marked = columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null") \
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high") \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = columns(documents, "doc_id", "text").join(F.broadcast(marked.select("doc_id", "low")), "doc_id") \
        .withColumn("order", F.xxhash64("doc_id", "text"))
    values = stored(measured(known, "doc_id", "low", "order").where(~base_failed()).select(
        "order", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune"), (F.col("low") == 0).alias("bad"),
        *[statistic(s).alias(s) for s in STATISTICS]).distinct().orderBy("order").limit(max_labelled).drop("order"), "labelled")
    shares = [k / steps for k in range(1, steps)]
    found = values.agg(*[F.percentile_approx(s, shares, 10_000).alias(s) for s in STATISTICS]).first()
    thresholds = {}
    for s in STATISTICS:
        points = sorted(set(found[s] or []))
        thresholds[s] = sorted({*points, *[(a + b) / 2 for a, b in zip(points, points[1:])]})

    def interval(name: str) -> Column:
        steps_up = F.array(*[F.lit(t) for t in thresholds[name]]) if thresholds[name] else F.array().cast("array<double>")
        return F.size(F.filter(steps_up, lambda t: F.col(name) > t)).alias(name)

    counts = values.select("prune", "bad", *[interval(s) for s in STATISTICS]).groupBy(*STATISTICS, "prune", "bad").count()
    return thresholds, [(tuple(r[:len(STATISTICS)]), r["prune"], r["bad"], r["count"]) for r in counts.collect()]


def tally(rows: list, holds: Callable[[tuple], bool] = lambda _: True) -> tuple[int, int]:
    """Bad and good documents among ``rows`` for which the condition holds."""
    bad = sum(n for at, _, is_bad, n in rows if is_bad and holds(at))
    return bad, sum(n for at, _, is_bad, n in rows if not is_bad and holds(at))


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information that a condition gains on the bad documents when p of p0 bad and n of n0 good ones meet it."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def grown(thresholds: dict, rows: list, max_conditions: int) -> tuple:
    """The conjunction (statistic, above, threshold) that gains most on the bad rows, condition by condition."""
    rule: tuple = ()
    while len(rule) < max_conditions:
        p0, n0 = tally(rows)
        if not p0 or not n0:
            break
        best = (1e-9, 0, 0, None)  # gain, earlier statistic, stricter threshold, condition
        for s, name in enumerate(STATISTICS):
            by = Counter()
            for at, _, bad, n in rows:
                by[at[s], bad] += n
            p = n = 0
            for k in range(len(thresholds[name]) - 1, -1, -1):  # from the strictest threshold
                p += by[k + 1, True]
                n += by[k + 1, False]
                for above, (pa, na) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                    best = max(best, (gain(pa, na, p0, n0), -s, k if above else -k, (s, above, k)))
        if best[3] is None:
            break
        rule += (best[3],)
        rows = [r for r in rows if holds((best[3],), r[0])]
    return rule


def holds(rule: tuple, at: tuple) -> bool:
    return all((at[s] > k) == above for s, above, k in rule)


def pruned(rule: tuple, rows: list, min_precision: float, min_support: int) -> tuple[float, int, tuple] | None:
    """How the best beginning of a rule does on the pruning rows: margin, minus its length, and itself."""
    worth = []
    for length in range(1, len(rule) + 1):
        p, n = tally(rows, lambda at, cut=rule[:length]: holds(cut, at))
        if p >= min_support and p >= min_precision * (p + n):
            worth.append(((p - n) / (p + n), -length, rule[:length]))
    return max(worth, default=None)


def covering(thresholds: dict, rows: list, min_precision: float, min_support: int, max_rules: int,
             max_conditions: int) -> list[Rule]:
    """Sequential covering for both verdicts: rules in the order in which they were found, the last of them one that rejects."""
    names, good = list(STATISTICS), [r for r in rows if not r[2]]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        found = []
        for rejecting in (True, False):
            # What is left may be bad throughout; what sets it apart is then seen against all good documents.
            against = good if rejecting and not tally(rows)[1] else []
            turned = [(at, prune, bad == rejecting, n) for at, prune, bad, n in rows]
            rule = grown(thresholds, [r for r in [*turned, *against] if not r[1]], max_conditions)
            best = pruned(rule, [r for r in turned if r[1]], min_precision, min_support)
            if best:
                found.append((best[0], rejecting, best[2]))
        if not found:
            break
        _, rejecting, rule = max(found, key=lambda f: f[:2])
        rules.append(Rule((Condition(names[s], above, thresholds[names[s]][k]) for s, above, k in rule), rejecting))
        rows = [r for r in rows if not holds(rule, r[0])]
    while rules and not rules[-1].rejects:
        rules.pop()
    return rules


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = 10_000, steps: int = 32,
          min_precision: float = 0.9, min_support: int = 3, max_rules: int = 8, max_conditions: int = 4) -> list[Rule]:
    """The decision list for ``documents`` whose ``labels`` (doc_id, quality) say 0 for bad and 1 for good."""
    thresholds, rows = labelled_counts(documents, labels, max_labelled, steps)
    return covering(thresholds, rows, min_precision, min_support, max_rules, max_conditions)


def judged(documents: DataFrame, rules: list[Rule], *kept: str) -> DataFrame:
    """The columns ``kept`` of ``documents`` with the base counts, base_failed and the list's verdict ``kept``."""
    counts = measured(columns(documents, *dict.fromkeys([*kept, "text"])), *kept)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejects(rules))


def quality(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, base counts, base_failed and kept of each document, by rules learned from ``labels``."""
    rules = learn(documents, labels, **settings)
    return judged(documents, rules, "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
