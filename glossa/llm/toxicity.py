"""Toxicity by a weighted lexicon (operator 4).

A text is folded (compatibility forms, lower case, look-alike letters of other
scripts inside Latin words, digits and signs that stand for letters inside
words) and reduced to its words, joined by single spaces. One Aho-Corasick
automaton finds the lexicon's entries: whole words and word beginnings, each
with a weight. A match inside an exception phrase (a whole word or a word pair
known to be harmless) does not count; of several matches that start at the same
word the heaviest counts. Their sum, also divided by the square root of the
number of words, goes through a logistic curve.

Learning (``fit``) takes a bounded sample of the labelled rows (``sample_docs``,
by a hash of the key). Spark counts, for every candidate entry, in how many
toxic and clean texts it occurs; an entry's weight is its log odds ratio less
``Z`` standard errors, and it is kept from ``MIN_WEIGHT`` on. A second count
gives the exceptions: words and word pairs that contain an entry but occur in
clean texts only. The curve is fitted on the sample's match sums.

Edge cases: null and empty texts score as a text without matches. Without
labelled rows, or with one class only, every score is that class's share (0
without rows). Repeated rows and extra columns are kept; empty table: empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import prepare, stage
from glossa.llm.language_id import sample

SAMPLE_DOCS = 20_000
PREFIXES = range(3, 9)   # lengths of word beginnings
MIN_DOCS = 4             # toxic texts an entry must occur in
MIN_WEIGHT = 1.5
Z = 1.64
MAX_ENTRIES = 20_000
MIN_CLEAN = 3            # clean texts an exception must occur in

WORD = regex.compile(r"\p{L}+")
# Letters of other scripts that look like Latin ones, and digits
# and signs used in place of letters.
LOOKALIKES = dict(zip(map(ord, "авеікмнорстухѕјԁԛԝгαβεικνορτυχ"), "abeikmhopctyxsjdqwrabeiknoptux"))
SIGNS = dict(zip("013457@$!|", "oieastasil"))
_FOREIGN = regex.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_SIGN = regex.compile(r"(?<=\p{L})[013457@$!|]+(?=\p{L})|(?<![\p{L}\p{N}])[013457@$](?=\p{L})")


def fold(text: str) -> str:
    """The text's words, folded, as `` w1 w2 ... ``."""
    t = unicodedata.normalize("NFKC", text).lower()
    if _FOREIGN.search(t):
        # words that mix scripts become Latin; words wholly in another script stay
        t = regex.sub(r"\p{L}+", lambda m: m[0].translate(LOOKALIKES) if regex.search("[a-z]", m[0]) else m[0], t)
    if _SIGN.search(t):
        t = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)
    return f" {' '.join(WORD.findall(t))} "


def entries(word: str) -> list[str]:
    """Candidate lexicon entries of one word: the word and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in PREFIXES if len(word) > k)]


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(),
                 curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)):
        self.weights, self.exceptions, self.curve = dict(weights), set(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term in self.weights.keys() | self.exceptions:
                a.add_word(term, (len(term), self.weights.get(term, 0.0), term in self.exceptions))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """(sum of weights, sum over the square root of the word count)."""
        folded = fold(text or "")
        if not self.weights:
            return 0.0, 0.0
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight, harmless) in self.automaton().iter(folded):
            start = end - size + 1
            if harmless:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in safe:
            for k in [k for k in best if a <= k < b] if best else ():
                del best[k]
        total = sum(best.values())
        return total, total / math.sqrt(max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * math.log1p(a) + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _count(texts: DataFrame, items) -> DataFrame:
    """Per item: toxic and clean texts it occurs in. Counted per batch first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b["text"], b["label"]):
                (toxic if label else clean).update(items(text))
            keys = list(toxic.keys() | clean.keys())
            # an empty batch must keep the column's type
            yield pd.DataFrame({"item": pd.Series(keys, dtype=object), "toxic": [toxic[k] for k in keys],
                                "clean": [clean[k] for k in keys]})

    parts = texts.mapInPandas(run, "item string, toxic long, clean long")
    return parts.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """Learn lexicon, exceptions and curve from the documents that ``labels`` (key,
    label 0 / 1) marks. The sample is drawn from the labels, so the side that is
    broadcast has about ``sample_docs`` rows at most, and only their texts are kept."""
    prepare(docs.sparkSession)
    chosen = sample(labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("label")),
                    key, sample_docs)
    picked = stage(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
                   .select("text", "label"), "toxic-sample")
    n1, n = picked.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not n1 or n1 == n:
        return Lexicon({}, curve=(40.0 if n1 else -40.0, 0.0, 0.0))
    n0 = n - n1

    def candidates(t):
        return {e for w in set(fold(t).split()) for e in entries(w)}

    lo = F.log((F.col("toxic") + 0.5) / (n1 - F.col("toxic") + 0.5)
               / ((F.col("clean") + 0.5) / (n0 - F.col("clean") + 0.5)))
    se = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = (_count(picked, candidates).where(F.col("toxic") >= MIN_DOCS)
             .select("item", (lo - F.lit(Z) * se).alias("weight")).where(F.col("weight") >= MIN_WEIGHT)
             .orderBy(F.desc("weight"), "item").limit(MAX_ENTRIES).collect())
    lex = Lexicon({r["item"]: float(r["weight"]) for r in found})
    shared = picked.sparkSession.sparkContext.broadcast(lex)

    def harmless(t):
        words = fold(t).split()
        weights = shared.value.weights
        hit = [any(e in weights for e in entries(w)) for w in words]
        pairs = {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}
        return pairs | {f" {w} " for w, h in zip(words, hit) if h}

    safe = (_count(picked, harmless).where((F.col("toxic") == 0) & (F.col("clean") >= MIN_CLEAN))
            .orderBy(F.desc("clean"), "item").limit(MAX_ENTRIES).collect()) if found else []
    lex = Lexicon(lex.weights, {r["item"] for r in safe})
    ready = picked.sparkSession.sparkContext.broadcast(lex)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [ready.value.features(t) for t in b["text"]]
            yield pd.DataFrame(x, columns=["a", "b"]).assign(y=b["label"].to_numpy())

    got = picked.mapInPandas(features, "a double, b double, y int").toPandas()  # at most sample_docs rows
    return Lexicon(lex.weights, lex.exceptions, _logistic(got))


def _logistic(got: pd.DataFrame) -> tuple[float, float, float]:
    """Ridge logistic regression on (1, log(1 + sum), normalised sum), by Newton steps."""
    got = got.sort_values(["a", "b", "y"])
    x = np.column_stack([np.ones(len(got)), np.log1p(got["a"]), got["b"]])
    y = got["y"].to_numpy(float)
    beta, ridge = np.zeros(3), np.diag([1e-6, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in beta)


def with_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (score >= threshold); input
    columns of these names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value
        for s in batches:
            yield pd.Series([one.score(t) for t in s], dtype="float64")

    out = docs.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
