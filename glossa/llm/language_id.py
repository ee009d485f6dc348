"""Language identification by word-first backoff (operator 10).

A word that the model knows is scored by its per-language log frequency. A word
it does not know falls back to its character n-grams of length 4, then 3, 2, 1:
the longest length at which any n-gram of the word is known gives the score (the
mean over the known ones). A text's language is the one with the largest sum;
its score is that language's share after a softmax of the mean evidence per
word times ``SHARPNESS``.

The tables are learned from a bounded sample of the labelled rows
(``sample_docs``, chosen by a hash of the row's key, so reruns agree and every
language keeps its share); counting is a Spark aggregation. The model keeps the
``max_words`` most frequent words per language (others fall back to their n-grams) and the
n-grams seen at least ``min_gram`` times, as numbers: hash, language, occurrences.

Edge cases: null text or text without a letter gives ``und`` with score 0. With
no labelled row at all every text is ``und``. Ties go to the language that
sorts first. Repeated rows and extra columns are kept; empty table: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import prepare, stage

SAMPLE_DOCS = 10_000
MAX_WORDS = 60_000
MIN_GRAM = 3
LENGTHS = (4, 3, 2, 1)
SHARPNESS = 8.0
MAX_MEMO = 300_000
LEARN, TEXTS = 4096, 256      # words looked up at a time; texts whose words are counted at a time
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")


SEED = 42                # of Spark's xxhash64


def item_hash(item: str) -> int:
    """What Spark's ``xxhash64`` gives for the text, unsigned."""
    return xxhash.xxh64_intdigest(item.encode("utf-8"), SEED)


class LanguageModel:
    """Log frequencies per language of words (length 0) and of n-grams, by the items' 64-bit
    hashes: per length one sorted array of hashes and one matrix. No text is kept."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``counts``: length -> (hashes, languages by number, occurrences), one row per item and language."""
        self.langs = langs
        self.tables = {k: self._logs(*counts[k]) if k in counts else (np.zeros(0, np.uint64), np.zeros((0, len(langs))))
                       for k in (0, *LENGTHS)}

    def _logs(self, hashes: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        items, row = np.unique(hashes, return_inverse=True)
        m = np.zeros((len(items), len(self.langs)))
        m[row, lang] = n
        return items, np.log((m + 0.1) / (m.sum(0) + 0.1 * len(items)))

    def found(self, length: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``items`` are known, and the log frequencies of those."""
        hashes, logs = self.tables[length]
        if not len(hashes):
            return np.zeros(len(items), bool), logs
        h = np.fromiter(map(item_hash, items), np.uint64, len(items))
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = hashes[at] == h
        return known, logs[at[known]]

    def words(self, words: list[str]) -> np.ndarray:
        """The log frequencies of words (words x languages): their own, or the mean of their longest
        n-grams that are known, or 0."""
        out = np.zeros((len(words), len(self.langs)))
        known, logs = self.found(0, words)
        out[known] = logs
        left = np.flatnonzero(~known)
        for n in LENGTHS:
            padded = [f" {words[i]} " for i in left.tolist()]
            size = np.array([max(0, len(p) - n + 1) for p in padded], np.int64)
            known, logs = self.found(n, [p[i:i + n] for p in padded for i in range(len(p) - n + 1)])
            owner = np.repeat(np.arange(len(left)), size)[known]
            hits = np.bincount(owner, minlength=len(left))
            some = hits > 0
            for c in range(len(self.langs)):
                out[left[some], c] = np.bincount(owner, logs[:, c], len(left))[some] / hits[some]
            left = left[~some]
        return out

    def word(self, w: str) -> np.ndarray:
        return self.words([w])[0]


class Predictor:
    """Scores texts; remembers the vector of every distinct word it met (bounded)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.model.langs))))

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), LEARN):
            part = words[at:at + LEARN]
            first = len(self.index)
            self.index.update(zip(part, range(first, first + len(part))))
            while len(self.index) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first:first + len(part)] = self.model.words(part)

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.predict([text])[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the new words of all are looked up together."""
        out = []
        for at in range(0, len(texts), TEXTS):
            counts = [Counter(WORD.findall(t.lower())) if t else {} for t in texts[at:at + TEXTS]]
            if len(self.index) > MAX_MEMO:
                self.reset()
            if self.model.langs:
                self._learn(list(dict.fromkeys(w for c in counts for w in c if w not in self.index)))
            out += [self._one(c) for c in counts]
        return out

    def _one(self, counts: dict[str, int]) -> tuple[str, float]:
        if not counts or not self.model.langs:
            return UNKNOWN, 0.0
        idx = np.fromiter(map(self.index.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        total = n @ self.rows[idx]
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / n.sum() * SHARPNESS)
        return self.model.langs[best], float(1.0 / share.sum())


def sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of the key (all, if fewer)."""
    n = rows.count()
    if n <= bound:
        return rows
    keep = int(bound / n * (1 << 20))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < keep)


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, min_gram: int = MIN_GRAM) -> LanguageModel:
    """Learn from ``rows`` (null text or language is skipped)."""
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    picked = sample(labelled, key, sample_docs)
    words = (picked.select(F.col(lang).alias("lang"),
                           F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
             .groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")))
    words = stage(words, "language-words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    number = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = (words.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max_words)
           .select(F.lit(0).alias("k"), F.xxhash64("w").alias("h"), number.alias("l"), "n"))
    padded = words.select("lang", "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("p"))
    grams = padded.select("lang", "n", F.explode(F.flatten(F.array(*[
        F.expr(f"transform(sequence(1, greatest(1, length(p) - {k - 1})), i -> substring(p, i, {k}))")
        for k in LENGTHS]))).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    grams = grams.where(F.col("n") >= min_gram).select(F.length("g").alias("k"), F.xxhash64("g").alias("h"), number.alias("l"), "n")
    # numbers only: at most max_words rows per language, and the n-grams of a bounded sample
    got = top.union(grams.where(F.col("k").isin(*LENGTHS))).toArrow()
    k, h, lang, n = (got.column(c).to_numpy() for c in ("k", "h", "l", "n"))
    del got
    counts = {int(c): (h[k == c].astype(np.int64).view(np.uint64), lang[k == c], n[k == c]) for c in np.unique(k)}
    return LanguageModel(langs, counts)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (input columns of these names are replaced)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = Predictor(shared.value)
        for s in batches:
            yield pd.DataFrame(one.predict(s.tolist()), columns=["lang_pred", "score"])

    out = "_language_id"
    return (docs.withColumn(out, predict(F.col(text)))
                .withColumn("lang_pred", F.col(out)["lang_pred"])
                .withColumn("score", F.col(out)["score"]).drop(out))
