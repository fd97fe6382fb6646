"""Secrets (operator 5): known formats, and strings that are too random to be words.

The base kinds always stay: assignments to names such as ``password``, access keys, and long runs of hexadecimal digits.
Beyond them, long runs of key characters are candidates. A window slides over each and carries the counts of its characters;
its entropy is kept up by adjusting the counts of the character that enters and of the one that leaves. The highest entropy of a window decides, by the
candidate's class of characters, unless an allow-list knows the string. Base spans, and parts between separators that hold
a word of the allow-list, are cut out of a run first; what is left on either side is a candidate if it is long enough. All
of it is column expressions.

NULL and empty texts have no spans, an empty table gives an empty result. Texts and runs of any length are scanned whole, in
linear time and without recursion. Rows without a ``doc_id`` and repeated rows are treated like all others; further
columns are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm import spans
from spendlens.llm.common import columns

KINDS = ["assign", "access", "hex", "entropy"]
BASE = 3

# Base patterns (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least entropy in bits per character of some window, by class; the first class that fits a candidate counts.
CLASSES = [("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), ("^[A-Za-z0-9+/_=-]+$", 3.9)]
#: Strings that look random and are none, or are made to be shown.
ALLOWED = [
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9_=+/-]+$", "^[A-Za-z/_=+-]*[0-9]{0,4}$",
    "(?i)example|sample|placeholder|changeme|dummy|your_?key",
]
#: The last of them are words, and count for the part of a run between separators that holds one.
SHOWN = ALLOWED[-1]
SHOWN_PART = f"(?i)(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:{SHOWN.removeprefix('(?i)')})[A-Za-z0-9]*+"
SEPARATORS = "/_=+-"


def top_entropy(value: Column) -> Column:
    """The highest entropy of a window of ``WINDOW`` characters.

    The window carries how often it holds each character of the string. With S the sum of n log2 n over these counts, its
    entropy is log2 W - S / W; S changes only by the counts of the character that enters and of the one that leaves.
    """
    weight = F.array(*[F.lit(n * log2(n) if n else 0.0) for n in range(WINDOW + 1)])

    def slide(codes: Column, letters: Column) -> Column:
        zero = F.struct(F.transform(letters, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("top"))

        def change(n: Column, by: int) -> Column:
            return F.get(weight, n + by) - F.get(weight, n)

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.coalesce(F.get(codes, i - WINDOW), F.lit(-1))
            counts = F.transform(acc["counts"], lambda n, k: F.when(enters == leaves, n).when(k == enters, n + 1).when(
                k == leaves, n - 1).otherwise(n))
            moved = F.when(enters == leaves, acc["s"]).otherwise(
                acc["s"] + change(F.get(acc["counts"], enters), 1)
                + F.when(leaves >= 0, change(F.get(acc["counts"], leaves), -1)).otherwise(0.0))
            return spans.let(moved, lambda s: F.struct(counts.alias("counts"), s.alias("s"), F.when(
                i >= WINDOW - 1, F.greatest(acc["top"], log2(WINDOW) - s / WINDOW)).otherwise(acc["top"]).alias("top")))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["top"])

    def coded(letters: Column) -> Column:
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        return spans.let(F.transform(chars, lambda c: (F.array_position(letters, c) - 1).cast("int")), lambda codes: slide(codes, letters))

    return spans.let(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), coded)


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    assign = F.filter(spans.matches(text, ASSIGN, 0, text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")),
                      lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8)
    access = F.filter(spans.matches(text, ACCESS, 1, text.contains("AKIA")), lambda s: F.length(s["value"]) >= 16)
    return F.sort_array(F.concat(assign, access, spans.matches(text, HEX, 2)))


def blanked(value: Column, cuts: Column) -> Column:
    """``value`` with blanks in the places of the sorted ``cuts``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(F.concat(acc["out"], F.substring(value, acc["at"] + 1, begin - acc["at"]),
                                 F.repeat(F.lit(" "), (end - begin).cast("int"))).alias("out"), end.alias("at"))

    return F.aggregate(cuts, start, step, lambda acc: F.concat(
        acc["out"], F.substring(value, acc["at"] + 1, F.length(value).cast("long"))))


def candidates(text: Column, base: Column) -> Column:
    """Long runs of key characters without the base spans and shown parts in them, and without separators at the cuts."""
    def uncut(s: Column) -> Column:
        size = F.length(s["value"]).cast("long")

        def inside(b: Column) -> Column:
            return F.struct(F.greatest(b["start"] - s["start"], F.lit(0)).alias("start"), b["kind"],
                            F.least(b["end"] - s["start"], size).alias("end"), b["value"])

        def piece(p: Column) -> Column:
            left = F.when(p["start"] > 0, F.ltrim(p["value"], F.lit(SEPARATORS))).otherwise(p["value"])
            both = F.when(p["end"] < size, F.rtrim(left, F.lit(SEPARATORS))).otherwise(left)
            start = s["start"] + p["start"] + F.length(p["value"]) - F.length(left)
            return F.struct(start.alias("start"), p["kind"], (start + F.length(both)).alias("end"), both.alias("value"))

        covering = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        shown = spans.matches(s["value"], SHOWN_PART, 3, s["value"].rlike(SHOWN))
        cuts = F.sort_array(F.concat(F.transform(covering, inside).cast(spans.SPAN), shown))
        return spans.let(cuts, lambda c: F.when(F.size(c) == 0, F.array(s)).otherwise(
            F.transform(spans.matches(blanked(s["value"], c), CANDIDATE, 3), piece).cast(spans.SPAN)))

    pieces = F.flatten(F.transform(spans.matches(text, CANDIDATE, 3), uncut))
    return F.filter(pieces, lambda s: F.length(s["value"]) >= WINDOW)


def random_strings(text: Column, base: Column) -> Column:
    """Candidates that are not allowed and have a window of enough entropy."""
    def suspicious(s: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED[:-1]:
            allowed = allowed | s["value"].rlike(pattern)
        least = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES):
            least = F.when(s["value"].rlike(pattern), bits).otherwise(least)
        return F.when(allowed, F.lit(False)).otherwise(top_entropy(s["value"]) >= least)

    return F.filter(candidates(text, base), suspicious)


def secrets(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans of each document."""
    source = columns(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    based = source.withColumn("base", base_spans(F.col("content")))
    every = based.withColumn("all", F.sort_array(F.concat("base", random_strings(F.col("content"), F.col("base")))))
    counts = [spans.count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return every.select("doc_id", *counts, F.sha2(spans.written(F.col("base"), KINDS), 256).alias("base_sha256"),
                        spans.written(F.col("all"), KINDS).alias("spans"), spans.count(F.col("all"), 3).alias("n_entropy"))
