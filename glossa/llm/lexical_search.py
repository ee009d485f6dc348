"""Ranked lexical search with hashed max-sketches (operator 12).

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A
document's impact for a term grows with the term's occurrences tf there and
falls with the document's length; the query side multiplies it by the term's weight.

* Index (``build``, independent of any query). Per document: its number of terms and a
  sketch, an array of ``CELLS`` cells of which the occupied ones are stored (3 bytes each). A
  term's cell keeps the largest tf of all terms that fall into it (255 stands for 255 and
  more). For one document the impact is monotone in tf, so a cell is the maximum of
  the impacts. Beside it a table of the document frequencies of all terms, counted per task
  and summed by Spark, and the totals. Texts are not copied: a document is found
  again by its key and a 128-bit digest of its text.
* Bounds. Queries come in blocks of ``BLOCK_TERMS`` different terms at most (a query is not
  split). For a batch of sketches all cells of a block are looked up at once and multiplied by
  the matrix of the terms' weights per cell and query: upper bounds of all scores.
* Rescoring. Wave 1 scores the ``FIRST`` documents with the highest bounds per query
  exactly, from their whole texts; the k-th best of them is the threshold. Wave 2 scores
  every document whose bound still reaches the threshold (at a tie, those whose key comes
  before), so what is left out cannot enter the k best. Nothing is capped: where bounds are
  loose, more documents are scored.
* Copies. A text's score is computed once: documents of a query with the same text are reduced to
  the k with the smallest keys, as no other can be among the k best.

Arithmetic is 64-bit integer throughout (weights: doubles, floored).

Edge cases: null or empty texts and texts without a term match nothing; such items
have no result. Rows that repeat an item (key and text) are one item; rows with the same item key and
different texts are ranked apart. Documents that repeat rank once per row. Among equal scores rows
without a key come last. Empty table on either side: empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import maybe_in, no_cycle_scans, prepare, stage

TOP = 20
CELLS = 1 << 16
FIRST = 100
BLOCK_TERMS = 8192
BATCH_CHARS = 4_000_000
MAX_WORDS = 400_000      # terms numbered per worker before the counts go out
LAST_ID = (1 << 63) - 1
FULL = 1_000_000         # limit of a term's impact as tf grows

# bytes that separate terms become blanks, A-Z become a-z
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def cell(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % CELLS


def impact(tf, m):
    """The document's part of a term's score."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factor(n, docs: int, total: int):
    return 75 + (25 * n * docs) // max(1, total)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class _Numbers(dict):
    """term -> running number, with the terms' cells."""

    def __init__(self):
        super().__init__()
        self.cells: list[int] = []

    def __missing__(self, term: bytes) -> int:
        i = self[term] = len(self.cells)
        self.cells.append(cell(term))
        return i


def _slices(b: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    size = np.cumsum(b[column].str.len().fillna(0).to_numpy(np.int64))
    at, base = 0, 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(size, base + BATCH_CHARS)))
        yield b.iloc[at:to]
        base, at = size[to - 1], to


def _text_key(text: str) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(12), text).alias("k2")]


@dataclass
class Index:
    """Sketches (doc, k1, k2, n, cells, most), document frequencies (term, df) and totals."""

    sketches: DataFrame
    frequencies: DataFrame
    docs: int
    total: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of ``docs``; its tables are written to the shared folder."""
    prepare(docs.sparkSession)

    def flush(numbers: _Numbers, df: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"term": list(numbers), "df": df[:len(numbers)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, df = _Numbers(), np.zeros(MAX_WORDS, np.int64)
        for b in batches:
            for part in _slices(b, "text"):
                words = [terms(t) for t in part["text"]]
                n = np.fromiter(map(len, words), np.int64, len(words))
                with no_cycle_scans():
                    flat = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, int(n.sum()))
                known = len(numbers.cells)
                if known > len(df):
                    df = np.concatenate([df, np.zeros(known, np.int64)])
                doc = np.repeat(np.arange(len(words)), n)
                pair, tf = np.unique(doc * max(1, known) + flat, return_counts=True)
                doc, term = pair // max(1, known), pair % max(1, known)
                df[:known] += np.bincount(term, minlength=known)
                at = doc * CELLS + np.array(numbers.cells, np.int64)[term]
                order = np.argsort(at, kind="stable")
                at, tf = at[order], tf[order]
                start = np.flatnonzero(np.diff(at, prepend=-1))
                most = np.minimum(np.maximum.reduceat(tf, start), 255).astype(np.uint8) if len(at) else tf.astype(np.uint8)
                at = at[start]
                cells, ends = (at % CELLS).astype(np.uint16), np.searchsorted(at, np.arange(len(words) + 1) * CELLS)
                yield pd.DataFrame({
                    "row": part["row"], "n": n, "cells": [cells[a:z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())],
                    "most": [most[a:z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]})
                if known > MAX_WORDS:
                    yield flush(numbers, df)
                    numbers, df = _Numbers(), np.zeros(MAX_WORDS, np.int64)
        if numbers:
            yield flush(numbers, df)

    rows = docs.select(F.struct(F.col(key).cast("long").alias("doc"), *_text_key(text)).alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = stage(_past_python(rows, run), "lexical-index")
    sketches = made.where("n > 0").select("doc", "k1", "k2", "n", "cells", "most")
    frequencies = made.where("df is not null").groupBy("term").agg(F.sum("df").alias("df"))
    docs_with, total = sketches.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(sketches, frequencies, docs_with, total)


def _past_python(rows: DataFrame, run) -> DataFrame:
    """``run`` over (row, text); keys travel as text, which no null turns into a float."""
    flat = rows.select(F.concat_ws(",", F.coalesce(F.col("row.doc").cast("string"), F.lit("")), F.col("row.k1").cast("string"),
                                   F.col("row.k2").cast("string")).alias("row"), "text")

    def nullable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            out = out.reindex(columns=["row", "n", "cells", "most", "term", "df"])
            for c in ("n", "df"):
                out[c] = out[c].astype("Int64")
            for c in ("row", "cells", "most", "term"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    made = flat.mapInPandas(nullable, "row string, n long, cells binary, most binary, term binary, df long")
    part = F.split("row", ",")
    return made.select(F.when(part[0] != "", part[0]).cast("long").alias("doc"), part[1].cast("long").alias("k1"),
                       part[2].cast("long").alias("k2"), "n", "cells", "most", "term", "df")


@dataclass
class Block:
    """Queries of one pass: their distinct terms with weights times occurrences per query,
    and the same summed by cell. Its size is bounded by BLOCK_TERMS."""

    queries: list[int]
    terms: list[bytes]
    weights: np.ndarray          # terms x queries
    place: np.ndarray            # cell -> row of by_cell, or -1
    by_cell: np.ndarray          # occupied cells x queries

    def bounds(self, cells: list[bytes], most: list[bytes], m: np.ndarray) -> np.ndarray:
        """Upper bounds, documents x queries (exact in doubles: far below 2^53)."""
        size = np.fromiter(map(len, most), np.int64, len(most))
        doc = np.repeat(np.arange(len(most)), size)
        row = self.place[np.frombuffer(b"".join(cells), np.uint16)]
        hit = np.flatnonzero(row >= 0)
        doc, row = doc[hit], row[hit]
        tf = np.frombuffer(b"".join(most), np.uint8)[hit].astype(np.int64)
        part = np.where(tf == 255, FULL, impact(tf, m[doc])).astype(np.float64)
        out = np.zeros((len(most), len(self.queries)), np.int64)
        ends = np.searchsorted(doc, np.arange(len(most) + 1))
        step = max(1, BATCH_CHARS // max(1, len(self.queries)))
        at = 0
        while at < len(most):        # whole documents, about ``step`` hits at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
            a, z = ends[at], ends[to]
            if z > a:
                start = np.flatnonzero(np.diff(doc[a:z], prepend=-1))
                out[doc[a:z][start]] = np.add.reduceat(part[a:z, None] * self.by_cell[row[a:z]], start, axis=0).astype(np.int64)
            at = to
        return out


def _blocks(index: Index, items: DataFrame) -> Iterator[Block]:
    """``items``: q, text. Blocks are read one after the other."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, t in zip(b["q"], b["text"]):
                counts = Counter(terms(t))
                yield pd.DataFrame({"q": q, "term": list(counts), "times": list(counts.values())})

    wanted = stage(items.mapInPandas(cut, "q long, term binary, times long"), "lexical-terms")
    df = (index.frequencies.join(wanted.select("term").distinct(), "term", "left_semi"))
    rows = wanted.join(df, "term").orderBy("q")

    def block(part: list) -> Block:
        queries = sorted({r.q for r in part})
        known = {}
        for r in part:
            known.setdefault(bytes(r.term), len(known))
        w = np.zeros((len(known), len(queries)))
        at = {q: i for i, q in enumerate(queries)}
        for r in part:
            w[known[bytes(r.term)], at[r.q]] = weight(index.docs, r.df) * r.times
        used, at_cell = np.unique([cell(t) for t in known], return_inverse=True)
        place, by_cell = np.full(CELLS, -1, np.int64), np.zeros((len(used), len(queries)))
        place[used] = np.arange(len(used))
        np.add.at(by_cell, at_cell, w)
        return Block(queries, list(known), w, place, by_cell)

    part, seen = [], set()
    for r in rows.toLocalIterator():
        if part and r.q != part[-1].q and len(seen) >= BLOCK_TERMS:
            yield block(part)
            part, seen = [], set()
        part.append(r)
        seen.add(bytes(r.term))
    if part:
        yield block(part)


def _candidates(index: Index, block, k: int, limits: dict[int, tuple[int, int]] | None) -> DataFrame:
    """q, bound, doc, k1, k2, n of documents that may be among the k best: per batch the
    ``FIRST`` highest bounds, or, with ``limits`` (q -> threshold, key of the k-th), all
    that reach the threshold. Rows of one text: those with the k smallest keys."""
    docs, total = index.docs, index.total

    def pick(mine: np.ndarray, doc: np.ndarray, q: int) -> np.ndarray:
        if limits is None:
            at = np.flatnonzero(mine > 0)
            return at[np.lexsort((doc[at], -mine[at]))[:FIRST]] if len(at) > FIRST else at
        least, last = limits.get(q, (0, LAST_ID))
        return np.flatnonzero((mine > max(0, least)) | ((mine == least) & (mine > 0) & (doc <= last)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = block.value
        for b in batches:
            doc, n = b["doc"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
            m = length_factor(n, docs, total)
            bounds = one.bounds(b["cells"].tolist(), b["most"].tolist(), m)
            at = [pick(bounds[:, c], doc, q) for c, q in enumerate(one.queries)]
            every = np.concatenate(at)
            column = np.repeat(np.arange(len(at)), [len(x) for x in at])
            yield pd.DataFrame({"q": np.array(one.queries)[column], "bound": bounds[every, column], "doc": doc[every],
                                "k1": b["k1"].to_numpy()[every], "k2": b["k2"].to_numpy()[every]})

    rows = index.sketches.select(F.coalesce("doc", F.lit(LAST_ID)).alias("doc"), "k1", "k2", "n", "cells", "most")
    found = rows.mapInPandas(run, "q long, bound long, doc long, k1 long, k2 long")
    if limits is None:
        best = Window.partitionBy("q").orderBy(F.desc("bound"), "doc", "k1", "k2")
        return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= FIRST).drop("_r")
    same = Window.partitionBy("q", "k1", "k2").orderBy("doc")
    return found.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")


def _best(index: Index, texts: DataFrame, block, found: DataFrame, k: int, name: str) -> DataFrame:
    """q, rank, doc, score: the k best of ``found`` by exact scores."""
    docs, total = index.docs, index.total
    found = stage(found, f"lexical-{name}")
    # one document per text stands for it (with at most as many queries as the block has);
    # a bit map of fixed size keeps all other texts out of the shuffle
    wanted = found.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.collect_set("q").alias("qs"))
    picked = (maybe_in(texts, wanted, "doc", "k1", "k2").join(wanted, ["doc", "k1", "k2"]).groupBy("k1", "k2")
              .agg(F.first("text").alias("text"), F.first("qs").alias("qs")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = block.value
        column = {q: i for i, q in enumerate(one.queries)}
        for b in batches:
            out = []
            for k1, k2, text, qs in zip(b["k1"], b["k2"], b["text"], b["qs"]):
                words = terms(text)
                counts = Counter(words)
                m = length_factor(len(words), docs, total)
                got = np.array([impact(tf, m) if (tf := counts.get(t, 0)) else 0 for t in one.terms], np.float64)
                for q, s in zip(qs, (got @ one.weights[:, [column[q] for q in qs]]).astype(np.int64).tolist()):
                    if s > 0:
                        out.append((q, k1, k2, s))
            yield pd.DataFrame(out, columns=["q", "k1", "k2", "score"])

    scores = picked.mapInPandas(run, "q long, k1 long, k2 long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "doc", "k1", "k2", "bound")
    ranked = found.join(scores, ["q", "k1", "k2"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return stage(ranked.select("q", "rank", "doc", "score"), f"lexical-{name}-best")


def search(docs: DataFrame, items: DataFrame, index: Index | None = None, k: int = TOP, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item``, rank, ``key``, score: the k best documents of each item. ``index`` may come
    from an earlier ``build`` of the same documents."""
    spark = docs.sparkSession
    prepare(spark)
    index = index or build(docs, key, text)
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text).alias("text"), *_text_key(text))
    asked = stage(items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text"))
                  .distinct().withColumn("q", F.monotonically_increasing_id()), "lexical-items")
    out = None
    for one in _blocks(index, asked.select("q", "text")):
        block = spark.sparkContext.broadcast(one)
        first = _best(index, texts, block, _candidates(index, block, k, None), k, "first")
        limits = {r.q: (r.score, r.doc) for r in first.where(F.col("rank") == k).collect()}
        best = _best(index, texts, block, _candidates(index, block, k, limits), k, "all")
        out = best if out is None else out.union(best)
        block.unpersist()
    if out is None:
        out = spark.createDataFrame([], "q long, rank int, doc long, score long")
    return out.join(asked.select("q", "item"), "q").select(
        F.col("item").alias(item), "rank", F.when(F.col("doc") != LAST_ID, F.col("doc")).alias(key), "score")
