"""Places of pattern matches in texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _sums(values: Column, first: Column) -> Column:
    """For each element ``first`` plus the sum of all elements before it."""
    return F.slice(F.aggregate(values, F.array(first), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v))),
                   F.lit(1), F.size(values))


def sums_before(values: Column) -> Column:
    """For each element the sum of all before it; in chunks, so that long arrays are not copied for each element."""
    zero = F.lit(0).cast("long")

    def of(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        return let(chunks, lambda parts: F.flatten(F.zip_with(
            parts, _sums(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, b: a + b)), zero), _sums)))

    return let(values, of)


def matches(text: Column, pattern: str, kind: int, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` with code-point places; only looked for where ``guard`` holds."""
    def placed(x: Column) -> Column:
        between, found = x["between"], x["found"]
        lengths = F.zip_with(between, found, lambda b, f: (F.length(b) + F.coalesce(F.length(f), F.lit(0))).cast("long"))
        starts = F.zip_with(sums_before(lengths), between, lambda s, b: s + F.length(b))
        return F.zip_with(F.slice(starts, F.lit(1), F.size(found)), found, lambda s, v: F.struct(
            s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(v)).alias("end"), v.alias("value")))

    pair = F.struct(F.split(text, pattern, -1).alias("between"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    wanted = text.rlike(pattern) if guard is None else guard
    return F.when(wanted, let(pair, placed)).otherwise(F.array()).cast(SPAN)


def written(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, kinds: list[str]) -> Column:
    """``text`` with each span of the sorted ``spans`` replaced by its kind; of overlapping ones the first names it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in kinds])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text).cast("long"))))).otherwise(text)
