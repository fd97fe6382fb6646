"""Language identification by hierarchical discrimination (operator 3).

The language family is predicted first, by one linear support vector machine for each family against all others; then
linear machines for each pair of its languages vote. Features are the shares of hashed runs of one to three letters of the
lower-cased text. A prediction looks at the whole text and at nothing else.

The machines are fitted on a bounded sample: of every language the ``max_training_rows`` / (number of languages) labelled
documents with the smallest hashes of id, language and text, at least one, copies once. The sample, of at most 8 KB a row,
goes to all tasks, and one job fits all machines, each in one task.

NULL texts and texts without a letter are ``und`` with score 0; texts of any length are read whole. Without any labelled
document everything is ``und``. With one language every text with a letter has it. Rows without a ``doc_id`` are not held
out; repeated rows are predicted alike. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import columns, map_batches

UNDETERMINED = "und"
#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}
BUCKETS = 2048


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Shares of the hashed runs of one to three letters (a blank marks word ends); None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = letters()[np.minimum(codes, 0xFFFF)]
    if len(far := np.flatnonzero(codes > 0xFFFF)):
        letter[far] = [chr(c).isalpha() for c in codes[far]]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ c[1:]) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ c[2:]) * np.uint32(0xC2B2AE35)
    at = np.concatenate([one, two, three]) >> np.uint32(32 - buckets.bit_length() + 1)
    return np.bincount(at, minlength=buckets) / len(at)


def sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


@dataclass
class Machines:
    """Linear machines over classes: one for each pair, or one for each class against all others."""

    classes: list[str]
    paired: bool
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vote(self, x: np.ndarray) -> tuple[str, float]:
        """The class that wins, and how sure it does, 0.5 to 1.

        Among pairs, the class with the most won comparisons, then the largest margins; else the one with the largest margin.
        """
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights @ x + self.offsets
        if not self.paired:
            order = np.argsort(-margins, kind="stable")
            return self.classes[order[0]], sure(margins[order[0]] - margins[order[1]])
        a, b = np.array(list(combinations(range(len(self.classes)), 2))).T
        n = len(self.classes)
        won = np.bincount(a, margins > 0, n) + np.bincount(b, margins < 0, n)
        total = np.bincount(a, margins, n) - np.bincount(b, margins, n)
        best = int(np.lexsort((np.arange(n), -total, -won))[0])
        own = np.concatenate([margins[a == best], -margins[b == best]])
        return self.classes[best], max(0.5, float(np.mean([sure(2 * m) for m in own])))


@dataclass
class LanguageModel:
    families: Machines | None
    languages: dict[str, Machines]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or self.families is None:
            return UNDETERMINED, 0.0
        family, certain = self.families.vote(x)
        language, within = self.languages[family].vote(x)
        return language, certain * within


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: the crc32 of the written id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(documents: DataFrame, max_rows: int) -> DataFrame:
    """lang and features of at most ``max_rows`` labelled documents that are not held out (or one for each language).

    A first job counts the different documents of each language; those beyond about twice the wanted number by their hash
    do not leave their task. The smallest hash of a language is always wanted.
    """
    labelled = columns(documents, "doc_id", "text", "lang").where("text is not null and lang is not null") \
        .where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", "lang", "text"))
    part = F.shiftrightunsigned("h", 1) / 2.0 ** 63
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min(part).alias("least")).collect()
    each = max(1, max_rows // max(1, len(counts)))
    limits = [F.lit(x) for r in counts for x in (r["lang"], max((2 * each + 20) / r["n"], r["least"]))]
    limit = F.create_map(*limits)[F.col("lang")] if limits else F.lit(0.0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("part", "h"))
    near = labelled.withColumn("part", part).where(F.col("part") <= limit).dropDuplicates(["lang", "h"])
    sample = near.withColumn("place", place).where(F.col("place") <= each).select("lang", "text")

    def make(batch: pa.RecordBatch) -> list:
        found = [(lang, x) for lang, t in zip(*(c.to_pylist() for c in batch.columns)) if (x := features(t)) is not None]
        return [[lang for lang, _ in found], [x.astype(np.float32) for _, x in found]]

    return map_batches(sample, make, "lang string, x array<float>")


def machine(x: np.ndarray, positive: np.ndarray, rounds: int, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine with squared hinge loss, by dual coordinate descent.

    Features are scaled to unit deviation for fitting. Rows are visited in an order that depends on their number alone.
    """
    scale = x.std(axis=0)
    scale = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    z = np.hstack([x * scale, np.ones((len(x), 1))])
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, len(x) / (2 * max(positive.sum(), 1)), len(x) / (2 * max((~positive).sum(), 1)))
    slack = strength * len(x) / (2 * share)  # both classes weigh the same
    norm = np.einsum("ij,ij->i", z, z) + slack
    alpha, w = np.zeros(len(x)), np.zeros(z.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (z[i] @ w) - 1 + slack[i] * alpha[i]) / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * z[i]
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


def learn(documents: DataFrame, families: Mapping[str, str] = FAMILIES, max_training_rows: int = 3000,
          iterations: int = 20) -> LanguageModel:
    """Fits the machines on ``documents`` (doc_id, text, lang)."""
    spark = documents.sparkSession
    sample = training_sample(documents, max_training_rows).toArrow()  # bounded, see there
    if not sample.num_rows:
        return LanguageModel(None, {})
    langs = np.array(sample["lang"].to_pylist(), object)
    x = sample["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(langs), -1)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], x[i].tobytes()))
    langs, x = langs[order], x[order]
    family = {lang: families.get(lang, lang) for lang in langs}
    names = sorted(set(family.values()))
    within = {f: sorted(k for k in family if family[k] == f) for f in names}
    tasks = [(f, None) for f in names if len(names) > 1] + [pair for f in names for pair in combinations(within[f], 2)]
    shared = spark.sparkContext.broadcast((langs, x, family))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, x, family = shared.value
        of = np.array([family[k] for k in langs], object)
        for batch in batches:
            for nr, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                chosen = np.ones(len(x), bool) if b is None else (langs == a) | (langs == b)
                w, offset = machine(x[chosen].astype(np.float64), (of if b is None else langs)[chosen] == a, iterations)
                yield pa.RecordBatch.from_arrays([pa.array([nr], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([offset])],
                                                 ["nr", "w", "bias"])

    wanted = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(tasks)], "nr long, a string, b string")
    slots = max(1, min(len(tasks), spark.sparkContext.defaultParallelism))
    found = {r["nr"]: r for r in wanted.repartition(slots, "nr").mapInArrow(fit, "nr long, w binary, bias double").collect()}
    weights = np.array([np.frombuffer(found[i]["w"], np.float32) for i in range(len(tasks))]).reshape(-1, BUCKETS)
    offsets = np.array([found[i]["bias"] for i in range(len(tasks))])

    def machines(classes: list[str], paired: bool, first: int, n: int) -> Machines:
        return Machines(classes, paired, weights[first:first + n], offsets[first:first + n])

    at = len(names) if len(names) > 1 else 0
    model = LanguageModel(machines(names, False, 0, at), {})
    for f in names:
        n = len(within[f]) * (len(within[f]) - 1) // 2
        model.languages[f] = machines(within[f], True, at, n)
        at += n
    return model


def predict(documents: DataFrame, model: LanguageModel, *kept: str) -> DataFrame:
    """The columns ``kept`` of each document with lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def one(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    found = columns(documents, *dict.fromkeys([*kept, "text"])).withColumn("found", one("text"))
    return found.select(*kept, F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def identify(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, learned from the documents that are not held out."""
    model = learn(documents, **settings)
    found = predict(documents, model, "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
