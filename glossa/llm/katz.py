"""Language-model scoring by a Katz backoff bigram model (operator 3).

Model. Tokens are words plus one end per text. Counts come from the training
texts. Good-Turing discounts d_r (Katz, r <= ``K``) are computed from the global
counts of counts of each order; where these do not give discounts between 0 and
1 (a smaller K is tried first), (r - 1/2) / r is used. With c(h) the count of a
context (the previous word, or the begin of the text):

    p(w)     = d c(w) / (N + 1)                 for known words; the rest of the
                                                mass is the unknown word's
    p(w | h) = d c(h, w) / (c(h) + 1)           for seen pairs
    p(w | h) = a(h) p(w)                        otherwise, with
    a(h)     = (1 - sum of the seen p(w | h)) / (1 - sum of their p(w))

so every distribution over the known words and the unknown word sums to exactly
one (the added 1 keeps some mass for contexts without small counts), and a
token is evaluated recursively: pair, else backoff weight times word.

Work flow. All tables are partitioned by hash and hold packed arrays, one row per
(bucket, batch) instead of one per token:

1. Batches of texts become token tables: local word ids, word hashes, training counts.
2. Word counts: words go to buckets by hash; a bucket adds up the counts, numbers
   its words and answers every batch for its own; counts of counts are added over buckets.
3. Each batch, now knowing its words' numbers and counts, sends its distinct pairs with their
   training counts and the documents they occur in to buckets by context. Hot
   contexts (more than 1/``SALT`` of a bucket) are split by the second word.
4. A bucket adds up pair counts over batches. All that does not depend on the
   discounts becomes sums per document; contexts of unseen pairs keep their
   discount-free statistics. Statistics of the split contexts (at most SALT times the
   number of buckets, by the definition of hot) are added up on the driver.
5. With the counts of counts known, a document's partial scores are finished and added.

Edge cases: null text is empty (one end token). Repeated rows are texts of their
own and count in training as often as they occur. Without training rows the
unknown word has probability one. Rows without an id count as training rows.
Empty table: empty result; extra columns are ignored. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import no_cycle_scans, partitions, prepare, stage

K = 5
SALT = 8
BATCH_CHARS = 12_000_000
DOCS_PER_BUCKET = 6000
END = 1                    # hash of the end token
UNKNOWN, BEGIN = 0, 1      # word numbers; known words follow
NO_ID = -(1 << 63)
_U = np.uint64


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d_0 .. d_K (d_0 unused) from N_1 .. N_{K+1}; all larger counts keep 1."""
    n = np.concatenate([[0.0], np.asarray(counts_of_counts, float)])
    for k in range(K, 1, -1):
        if (n[1:k + 2] > 0).all():
            r = np.arange(1, k + 1)
            cut = (k + 1) * n[k + 1] / n[1]
            if cut < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate([[1.0], d, np.ones(K - k)])
    r = np.arange(1, K + 1)
    return np.concatenate([[1.0], (r - 0.5) / r])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d_c * c."""
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; the bytes of a number are stored in planes, so the mostly
    empty high bytes and the skewed low ones compress by themselves."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T) for a in arrays]
    raw = b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes(),
                    *(x.tobytes() for x in planes)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size, dtype in zip(sizes, dtypes, strict=True):
        width = np.dtype(dtype).itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(width, size // width)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += size
    return out


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self) + 1          # 0 is the end token
        return i


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) % _U(n)).astype(np.int64)


def token_tables(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per batch: batch, documents (id, training flag, tokens), local word
    ids of all tokens, word hashes and their training counts, and the words' order by
    bucket. ``docs``: doc_id, text, train."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            size = np.cumsum(b["text"].str.len().to_numpy(np.int64))
            at, base = 0, 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(size, base + BATCH_CHARS)))
                part, base, at = b.iloc[at:to], size[to - 1], to
                index, ids = _Index(), []
                end = np.zeros(1, np.int32)
                with no_cycle_scans():
                    for t in part["text"]:
                        words = t.encode("utf-8", "replace").lower().split()
                        ids += [np.fromiter(map(index.__getitem__, words), np.int32, len(words)), end]
                n = np.array([len(x) + 1 for x in ids[::2]], np.int32)
                ids = np.concatenate(ids)
                train = part["train"].to_numpy(np.uint8)
                hashes = np.array([END, *map(xxhash.xxh3_64_intdigest, index)], np.uint64)
                # frequent words first: small numbers compress
                order = np.argsort(-np.bincount(ids, minlength=len(hashes)), kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                ids, hashes = place[ids], hashes[order]
                counts = np.bincount(ids[np.repeat(train, n) > 0], minlength=len(hashes)).astype(np.uint32)
                yield pd.DataFrame({"batch": [task + k], "docs": [_pack(
                    part["doc_id"].fillna(NO_ID).to_numpy(np.int64), train, n)],
                    "ids": [_pack(ids)], "words": [_pack(hashes, counts)],
                    "place": [_pack(np.argsort(_bucket(hashes, buckets), kind="stable").astype(np.uint32))]})
                k += 1

    return docs.mapInPandas(run, "batch long, docs binary, ids binary, words binary, place binary")


def word_counts(tokens: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, counts): numbers and training counts of a batch's words of one
    bucket, in the batch's order; batch -1 has the bucket's N, V and counts of counts.
    A word's number is its rank by count in its bucket, interleaved over the buckets."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for batch, blob in zip(b["batch"], b["words"]):
                hashes, counts = _unpack(blob, np.uint64, np.uint32)
                to = _bucket(hashes, buckets)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                rows = [(k, batch, _pack(hashes[order[cut[k]:cut[k + 1]]], counts[order[cut[k]:cut[k + 1]]]))
                        for k in np.unique(to).tolist()]
                yield pd.DataFrame(rows, columns=["bucket", "batch", "blob"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(x, np.uint64, np.uint32) for x in g["blob"]]
        _, back = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        total = np.bincount(back, np.concatenate([x[1] for x in got])).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = np.where(total > 0, BEGIN + 1 + rank * buckets + int(g["bucket"].iat[0]), UNKNOWN)
        stop = np.cumsum([len(x[0]) for x in got])
        blobs = [_pack(number[back[e - len(x[0]):e]], total[back[e - len(x[0]):e]]) for x, e in zip(got, stop.tolist())]
        few = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
        blobs.append(_pack(np.concatenate([[total.sum(), (total > 0).sum()], few[1:K + 2]]).astype(np.int64)))
        return pd.DataFrame({"batch": [*g["batch"], -1], "bucket": int(g["bucket"].iat[0]), "counts": blobs})

    return tokens.select("batch", "words").mapInPandas(ask, "bucket int, batch long, blob binary").groupBy(
        "bucket").applyInPandas(answer, "batch long, bucket int, counts binary")


def _statistics(rows) -> np.ndarray:
    return np.sum([_unpack(r[0], np.int64)[0] for r in rows], axis=0) if rows else np.zeros(K + 3, np.int64)


def _word_probability(stats: np.ndarray):
    """(discounted p of a known word by its count, p of the unknown word)."""
    n_all, d = int(stats[0]), discounts(stats[2:K + 3])
    r = np.arange(1, K + 1)
    known = (discounted(r, d) - r) @ stats[2:K + 2] + n_all
    unknown = 1.0 - float(known) / (n_all + 1)
    return (lambda c: np.where(c > 0, discounted(c, d) / (n_all + 1), unknown)), unknown


def _hot(stats: np.ndarray, buckets: int) -> int:
    return max(64, int(stats[0]) // (buckets * SALT))


def _pairs(tokens: DataFrame, counts: DataFrame, buckets: int, stats: np.ndarray) -> DataFrame:
    """Pairs of every batch by bucket of their context (kind 1), and the batch's own
    document rows (bucket of the batch, kind 0)."""
    n_all, v, n_train = (int(stats[k]) for k in (0, 1, K + 3))
    p_word, _ = _word_probability(stats)
    hot = _hot(stats, buckets)

    def run(t: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        if t.empty:
            return pd.DataFrame([], columns=["bucket", "kind", "batch", "blob"])
        batch = int(t["batch"].iat[0])
        doc_ids, train, n = _unpack(t["docs"].iat[0], np.int64, np.uint8, np.int32)
        (ids,) = _unpack(t["ids"].iat[0], np.int32)
        # the answers come by bucket of the word; ``place`` is where each belongs
        (place,) = _unpack(t["place"].iat[0], np.uint32)
        got = [_unpack(x, np.int64, np.int64) for x in u.sort_values("bucket")["counts"]]
        number, c = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        number[place] = np.concatenate([x[0] for x in got])
        c[place] = np.concatenate([x[1] for x in got])
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        start = np.cumsum(n) - n
        base = np.bincount(doc, np.log10((c + 1.0) / (n_all + v + 1.0))[ids], len(n))
        known = np.bincount(doc, (c > 0)[ids], len(n)).astype(np.int64)

        m = len(c)
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[start] = m                                   # the begin of a text
        context, context_count = np.append(number, BEGIN), np.append(c, n_train)
        # after an unknown context the word decides alone
        alone = context_count[before] == 0
        part = np.bincount(doc[alone], np.log10(p_word(c))[ids[alone]], len(n))
        rows = [(batch % buckets, 0, batch, _pack(doc_ids, train, n, known, base, part))]
        # the other tokens by pair; unknown words are one word
        local = np.where(c > 0, np.arange(m), m)
        keep = np.flatnonzero(~alone)
        key = before[keep] * (m + 1) + local[ids[keep]]
        by = np.argsort(key, kind="stable")
        key, token_doc = key[by], doc[keep[by]]
        if len(key):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(at, len(key)))
            learn = np.add.reduceat(train[token_doc].astype(np.int64), at)
            h, w = key[at] // (m + 1), key[at] % (m + 1)
            word, word_count = np.append(number, UNKNOWN)[w], np.append(c, 0)[w]
            salt = np.where(context_count[h] > hot, word, 0).astype(np.uint64)
            with np.errstate(over="ignore"):
                to = _bucket((context[h].astype(np.uint64) + salt * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93), buckets)
            order = np.lexsort((word, context[h], to))
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in np.unique(to).tolist():
                x = order[cut[k]:cut[k + 1]]
                hk, first, per = np.unique(context[h[x]], return_index=True, return_counts=True)
                wk, some, wi = np.unique(word[x], return_index=True, return_inverse=True)
                many = size[x]
                picked = np.repeat(at[x], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rows.append((k, 1, batch, _pack(
                    np.array([len(n)], np.int64), np.diff(hk, prepend=0), context_count[h[x][first]], per.astype(np.uint32),
                    np.diff(wk, prepend=0), word_count[x[some]], wi.astype(np.uint32), learn[x].astype(np.uint32),
                    many.astype(np.uint32), token_doc[picked].astype(np.uint32))))
        return pd.DataFrame(rows, columns=["bucket", "kind", "batch", "blob"])

    return tokens.groupBy("batch").cogroup(counts.groupBy("batch")).applyInPandas(
        run, "bucket int, kind int, batch long, blob binary")


# documents of the batch; contexts: number (differences), count, pairs of each; words:
# number (differences), count; pairs: word, training count, tokens; tokens: document
PAIR_TYPES = (np.int64, np.int64, np.int64, np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32)


def _count_pairs(pairs: DataFrame, buckets: int, stats: np.ndarray) -> DataFrame:
    """Per bucket: kind 0 rows as they are; kind 2: context statistics and, per batch,
    partial sums, in one row, so the next step needs no shuffle to bring them together;
    kind 3: statistics of split contexts; kind 4: counts of counts."""
    hot = _hot(stats, buckets)
    p_word, _ = _word_probability(stats)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        bucket = int(g["bucket"].iat[0])
        own = g["kind"] == 0
        rows = [(bucket, 0, b, x, None, None) for b, x in zip(g["batch"][own], g["blob"][own])]
        names = ["bucket", "kind", "batch", "blob", "batches", "parts"]
        g = g[~own]
        if g.empty:
            return pd.DataFrame(rows, columns=names)
        got = [_unpack(x, *PAIR_TYPES) for x in g["blob"]]
        contexts, first, hb = np.unique(np.concatenate([np.cumsum(x[1]) for x in got]), return_index=True,
                                        return_inverse=True)
        count = np.concatenate([x[2] for x in got])[first]
        words, first, wb = np.unique(np.concatenate([np.cumsum(x[4]) for x in got]), return_index=True,
                                     return_inverse=True)
        p1 = p_word(np.concatenate([x[5] for x in got])[first])
        key, ho, wo = [], 0, 0
        for x in got:
            key.append(np.repeat(hb[ho:ho + len(x[1])], x[3]) * len(words) + wb[wo + x[6]])
            ho, wo = ho + len(x[1]), wo + len(x[4])
        pair, back = np.unique(np.concatenate(key), return_inverse=True)
        c = np.bincount(back, np.concatenate([x[7] for x in got])).astype(np.int64)
        h, w = pair // len(words), pair % len(words)
        seen = c > 0
        # what a context's backoff weight needs, without the discounts
        table = np.zeros((len(contexts), K + 2))
        table[:, 0] = np.bincount(h[seen], p1[w[seen]], len(contexts))
        for r in range(1, K + 1):
            table[:, r] = np.bincount(h[c == r], minlength=len(contexts))
        table[:, K + 1] = np.bincount(h[c > K], c[c > K], len(contexts))
        part = np.where(seen, np.log10(np.maximum(c, 1)) - np.log10(count[h] + 1.0), np.log10(p1[w]))
        asked = np.zeros(len(contexts), bool)
        parts = []
        at = 0
        for batch, x in zip(g["batch"], got):
            n_docs = int(x[0][0])
            token_pair = np.repeat(back[at:at + len(x[6])], x[8])
            at += len(x[6])
            doc, ct = x[9], c[token_pair]
            sums = np.bincount(doc, part[token_pair], n_docs)
            small = np.stack([np.bincount(doc[ct == r], minlength=n_docs) for r in range(1, K + 1)]).astype(np.uint32)
            no = ct == 0
            hn = h[token_pair[no]]
            asked[hn] = True
            used = np.flatnonzero((sums != 0) | (small.sum(0) > 0))
            parts.append(_pack(np.array([n_docs], np.int64), used.astype(np.uint32), sums[used],
                               small[:, used].ravel(), doc[no].astype(np.uint32), hn.astype(np.uint32)))
        split = count > hot
        rows.append((bucket, 2, -1, _pack(np.flatnonzero(asked).astype(np.uint32), contexts[asked], count[asked],
                                          table[asked].ravel()), g["batch"].tolist(), parts))
        rows.append((bucket, 3, -1, _pack(contexts[split], count[split], table[split].ravel()), None, None))
        few = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1:K + 2]
        rows.append((bucket, 4, -1, _pack(few.astype(np.int64)), None, None))
        return pd.DataFrame(rows, columns=names)

    return pairs.groupBy("bucket").applyInPandas(
        run, "bucket int, kind int, batch long, blob binary, batches array<long>, parts array<binary>")


def _finish(counted: DataFrame, d: np.ndarray, split: dict[int, np.ndarray]):
    """The two last steps as functions: partial scores of a bucket's documents per
    batch (kind 1, beside the batch's document rows, kind 0), and their sum."""
    shared = counted.sparkSession.sparkContext.broadcast(split)
    log_d = np.log10(d[1:])
    gain = np.arange(1, K + 1) * d[1:]

    def weights(count, table):
        used = (table[:, 1:K + 1] @ gain + table[:, K + 1]) / (count + 1.0)
        return np.log10((1.0 - used) / (1.0 - table[:, 0]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for bucket, kind, batch, blob, batches, parts in f.itertuples(index=False):
                if kind == 0:
                    yield pd.DataFrame([(batch, 0, bucket, blob)], columns=["batch", "kind", "bucket", "blob"])
                    continue
                where, contexts, count, table = _unpack(blob, np.uint32, np.int64, np.int64, np.float64)
                table = table.reshape(-1, K + 2).copy()
                for i, x in enumerate(contexts.tolist()):
                    if x in shared.value:
                        table[i] = shared.value[x]
                alpha = np.zeros(int(where.max(initial=0)) + 1)
                alpha[where] = weights(count, table)
                rows = []
                for one, part in zip(batches, parts):
                    n_docs, used, sums, small, doc, h = _unpack(part, np.int64, np.uint32, np.float64, np.uint32,
                                                                np.uint32, np.uint32)
                    total = np.zeros(int(n_docs[0]))
                    total[used] = sums + log_d @ small.reshape(K, -1)
                    if len(doc):
                        total += np.bincount(doc, alpha[h], len(total))
                    rows.append((one, 1, bucket, _pack(total)))
                yield pd.DataFrame(rows, columns=["batch", "kind", "bucket", "blob"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        doc_ids, train, n, known, base, alone = _unpack(g["blob"][g["kind"] == 0].iat[0], np.int64, np.uint8, np.int32,
                                                        np.int64, np.float64, np.float64)
        # the same order of addition whatever order the rows arrive in
        parts = g[g["kind"] == 1].sort_values("bucket")["blob"]
        score = np.sum([alone, *(_unpack(x, np.float64)[0] for x in parts)], axis=0)
        return pd.DataFrame({"doc_id": doc_ids, "held_out": train == 0, "n_tokens": n.astype(np.int64),
                             "n_known": known, "base_score": base, "score": score})

    return run, add


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train: str = "train") -> DataFrame:
    """One row per document: ``key``, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one word model), score (log10 probability by the model). ``train``
    marks the rows to learn from."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(F.col(train), F.lit(True)).cast("int").alias("train"))
    buckets = max(partitions(spark), -(-slim.count() // DOCS_PER_BUCKET))
    n_train = slim.where("train = 1").count()
    tokens = stage(token_tables(slim, buckets), "katz-tokens")
    counts = stage(word_counts(tokens, buckets), "katz-words")
    stats = np.append(_statistics(counts.where("batch = -1").select("counts").collect()), n_train)
    # the hashes stay behind: from here on words are numbers
    pairs = _pairs(tokens.select("batch", "docs", "ids", "place"), counts.where("batch >= 0"), buckets, stats)
    counted = stage(_count_pairs(pairs, buckets, stats), "katz-pairs")
    few = np.sum([_unpack(r[0], np.int64)[0] for r in counted.where("kind = 4").select("blob").collect()]
                 or [np.zeros(K + 1, np.int64)], axis=0)
    split: dict[int, np.ndarray] = {}
    for r in counted.where("kind = 3").orderBy("bucket").select("blob").toLocalIterator():
        contexts, _, table = _unpack(r[0], np.int64, np.int64, np.float64)
        for x, t in zip(contexts.tolist(), table.reshape(-1, K + 2)):
            split[x] = split.get(x, 0) + t
    run, add = _finish(counted, discounts(few), split)
    partial = counted.where("kind in (0, 2)").select("bucket", "kind", "batch", "blob", "batches", "parts").mapInPandas(
        run, "batch long, kind int, bucket int, blob binary")
    out = partial.groupBy("batch").applyInPandas(
        add, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias(key), "held_out", "n_tokens", "n_known",
                      F.lit(int(stats[0])).cast("long").alias("train_tokens"), "base_score", "score")
