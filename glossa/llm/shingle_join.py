"""Similarity join of word shingles with PartEnum signatures (operator 5).

Documents whose sets of five-word shingles have a Jaccard similarity of at least
0.75 are linked; components of the links are the near-duplicate groups.

Signatures. Sets are put into size bands; a set also signs for the next band if a
partner there is possible. Similar sets A and B differ in at most d = (|A| + |B|) / 7
shingles. Within a band the shingle domain is dealt by hash into n first-level
partitions, n a little above half of the largest d of the band, and each of them into
``PARTS`` second-level ones. In at least one of any d / 2 + 1 first-level partitions A
and B differ in one shingle at most, so they agree on all second-level parts but one:
for every first-level partition all subsets of ``PARTS`` - 1 parts are enumerated, and
the hash of a subset's content is a signature. One equal signature suffices.

* Only subsets with content sign. A partition with two non-empty parts or more keeps
  content in the shared subset whichever part differs; call it strong. A set signs its
  first partitions up to the one that makes d / 2 + 1 strong ones. Of two sets, the one
  that stops first has a strong partition with one difference at most, and the other
  signs that far too. A set with too few strong partitions signs all.
* Only rare shingles are dealt at first: on a part of the domain sets differ in no more
  shingles than on all of it, so the argument holds there. Shingles in more than one
  document in ``HOT_SHARE`` (counted over all documents, kept as a bit map of fixed
  size) are not rare, so a passage that many documents share makes no signature.
* Sets that have too few strong partitions of rare shingles (mostly passages, or very
  short) sign again over all their shingles, and if even those are too few, subsets
  without content too: two such sets then share a signature by the argument over all n.
  So no pair is lost, whatever is rare.

Candidates and verification. Documents with the same set are one class (hash of
the set) before anything is paired. A pair is first held against a lower bound of
its distance, then compared by exact intersection. The bound comes from parity
sketches: the shingles' cells in a bit array, one flip each; every shingle that only one
set has flips at most one bit of their difference, so the differing bits never exceed
the distance. Sets under one signature are first paired with the smallest of them
(a star, linear in the signatures). Where the members of a signature are then still
in more than one component, pairs across components are taken too, in tiles of
bounded size (signatures with the same members are one; the largest component's sets
have tiles of their own, which meet only the others'): for ``NEAREST_ROUNDS`` rounds
each set's nearest member of another component by the sketches, which joins most
components, then, where components are still apart, all. A set that the sketches keep apart
from all others under a signature is done there: components only grow. So every pair of similar
sets is either linked or already in one component. Only documents in a surviving pair have
their sets built again; a bit map of fixed size keeps the others' texts out of the shuffle.

Signatures travel as packed, compressed arrays per (batch, bucket): a row per
signature would be an order of magnitude more rows.

Edge cases: null text and text without words have no shingles and link with
nothing (n_shingles 0, own component). Fewer than five words: the whole sequence is
one shingle. Repeated rows belong to the same class. Rows without a doc_id are kept
with a null component unless they link. Empty table: empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import connected_components, partitions, prepare, stage

SHINGLE = 5
BAND = 2.0               # ratio of a size band's bounds
PARTS = 3                # second-level parts of a partition; subsets leave one out
SPARE = 0.1              # share of first-level partitions beyond half the distance
HOT_SHARE = 1000         # a shingle is common from one document in so many
HOT_LEAST = 50
SKETCH, LARGE_SKETCH = 2048, 16384     # bits; the large one for sets from LARGE_SET on
LARGE_SET = 1500
BITS = 1 << 22          # slots of the bit map of wanted documents (512 KB)
HOT_BITS = 1 << 26      # slots of the bit map of common shingles (8 MB)
TILE = 2048
SPREAD = 2000           # sets dealt to the buckets at a time
PAIRS = 1 << 16         # pairs compared at a time
NEAREST_ROUNDS = 2
BATCH_CHARS = 5_000_000
DOCS_PER_BUCKET = 4000
SLICE = 1 << 19         # bytes hashed at a time
NO_ID = -(1 << 63)

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
# a random number for every byte, the same for A-Z and a-z, 0 for white space
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
LETTER[65:91] = LETTER[97:123]
LETTER[~IN_WORD] = 0


class Shingler:
    """Sets of shingle hashes of texts (sorted, distinct)."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.factors = np.zeros(0, np.uint64)

    def _factors(self, n: int) -> np.ndarray:
        """An odd random factor for every place of a letter in its word."""
        if n > len(self.factors):
            self.factors = mixed(np.arange(1, 2 * n + 64, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)
        return self.factors

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first bytes, hashes) of the words of ``raw``, which starts and ends in white space:
        sums of letter numbers times the factors of their places, some ``SLICE`` bytes at a time."""
        b = np.frombuffer(raw, np.uint8)
        inside = IN_WORD[b]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        out = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + SLICE)))
            first, stop = start[at], end[to - 1]
            rel = start[at:to] - first
            gap = np.diff(rel, append=stop - first)
            value = LETTER[b[first:stop]]
            value *= self._factors(int(gap.max()))[np.arange(stop - first) - np.repeat(rel, gap)]
            out[at:to] = np.add.reduceat(value, rel)
            at = to
        return start, mixed(out + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all shingle hashes in text order with repeats, number per text)."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        k = self.size
        bounds = np.cumsum([1, *[len(r) + 1 for r in raw]])
        start, w = self.words(b"\n" + b"\n".join(raw) + b"\n")
        cut = np.searchsorted(start, bounds)
        n = np.diff(cut)
        counts = np.where(n >= k, n - k + 1, n > 0).astype(np.int64)
        place = np.cumsum(counts) - counts
        out, whole = np.zeros(int(counts.sum()), np.uint64), np.ones(int(counts.sum()), bool)

        def window(first: np.ndarray, size: int) -> np.ndarray:
            h = np.full(len(first), size, np.uint64)
            for j in range(size):
                h = h * _U(0x9E3779B97F4A7C15) + w[first + j]
            return h

        for m in range(1, k):       # a text of fewer words is one shingle
            short = np.flatnonzero(n == m)
            out[place[short]] = window(cut[short], m)
            whole[place[short]] = False
        left = np.repeat(cut[1:], n) - np.arange(len(w))        # words to the text's end
        out[whole] = window(np.flatnonzero(left >= k), k)
        return mixed(out), counts

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        flat, counts = self.flat(texts)
        out = []
        for b, c in zip(np.cumsum(counts).tolist(), counts.tolist()):
            s = np.sort(flat[b - c:b])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if c > 1 else s)
        return out


def set_sums(flat: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """Sum of the salted hashes of every set; ``flat`` holds the sets one after the other, none empty."""
    return np.add.reduceat(mixed(flat ^ _U(salt)), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.uint64)


def set_classes(sets: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit key of every set (0: empty)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros(len(sets), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        key = mixed(set_sums(np.concatenate(sets), sizes[some], 0x5851F42D4C957F2D) + sizes[some].astype(np.uint64))
        out[some] = key.view(np.int64)
    return out


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each cell, packed."""
    bits = LARGE_SKETCH if len(s) >= LARGE_SET else SKETCH
    return np.packbits(np.bincount((s % _U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketches(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(small sketches of all, rows with a large one, large sketches of those), as words
    of 64 bits. A large sketch folds into a small one: cells are residues."""
    large = np.flatnonzero(np.fromiter(map(len, blobs), np.int64, len(blobs)) > SKETCH // 8)
    wide = np.frombuffer(b"".join(blobs[i] for i in large), np.uint64).reshape(len(large), LARGE_SKETCH // 64)
    small = np.zeros((len(blobs), SKETCH // 64), np.uint64)
    rest = np.setdiff1d(np.arange(len(blobs)), large)
    small[rest] = np.frombuffer(b"".join(blobs[i] for i in rest), np.uint64).reshape(len(rest), SKETCH // 64)
    small[large] = np.bitwise_xor.reduce(wide.reshape(len(large), LARGE_SKETCH // SKETCH, SKETCH // 64), axis=1)
    place = np.full(len(blobs), -1)
    place[large] = np.arange(len(large))
    return small, place, wide


def differing(a, i, b, j) -> np.ndarray:
    """Lower bounds of the distance of the sets a[i] and b[j]; a, b from ``sketches``."""
    low = np.bitwise_count(a[0][i] ^ b[0][j]).sum(-1, dtype=np.int64)
    both = np.flatnonzero((a[1][i] >= 0) & (b[1][j] >= 0))
    if len(both):
        i, j = np.broadcast_arrays(i, j)
        low[both] = np.bitwise_count(a[2][a[1][i[both]]] ^ b[2][b[1][j[both]]]).sum(-1, dtype=np.int64)
    return low


@lru_cache(1 << 16)
def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, partitions, largest distance to a partner there) that a set of ``n`` signs for."""
    j, low, high = 0, 1, 0
    while True:
        high = max(low + 1, int(np.ceil(BAND ** (j + 1))))
        if n < high:
            break
        j, low = j + 1, high
    reach = 4 * n // 3
    out = [(j, _parts(high), (n + min(reach, high - 1)) // 7)]
    if reach >= high:
        nxt = max(high + 1, int(np.ceil(BAND ** (j + 2))))
        out.append((j + 1, _parts(nxt), (n + reach) // 7))
    return out


def _parts(upper: int) -> int:
    least = 2 * (upper - 1) // 7 // 2 + 1
    return least + int(SPARE * least + 0.5)


def _subsets(flat: np.ndarray, start: np.ndarray, size: np.ndarray, band: np.ndarray, n: np.ndarray, d: np.ndarray,
             salt: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures of the subsets, the entry of each, whether an entry's strong partitions were
    too few). An entry is a set (``size`` shingles of ``flat`` from ``start`` on) in a band; with
    ``last`` an entry with too few also signs subsets without content."""
    entry = np.repeat(np.arange(len(n)), size)
    s = flat[np.arange(len(entry)) + np.repeat(start - (np.cumsum(size) - size), size)]
    tag = 2 * band + salt
    cell = (mixed(s + ((tag + 1).astype(np.uint64) * _U(0xD1342543DE82EF95))[entry]) >> _U(20)).astype(np.int64)
    first = np.cumsum(n) - n
    cell = cell % (n * PARTS)[entry] + (first * PARTS)[entry]
    cells = int(n.sum()) * PARTS
    content = np.zeros(cells, np.uint64)
    np.add.at(content, cell, mixed(s ^ _U(0xA0761D6478BD642F)))
    count = np.bincount(cell, minlength=cells).reshape(-1, PARTS)
    content = content.reshape(-1, PARTS)
    strong = ((count > 0).sum(1) >= 2).astype(np.int64)
    few = np.add.reduceat(strong, first) <= d // 2
    of = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(strong) - strong
    row = np.flatnonzero(before - before[first][of] <= (d // 2)[of])
    content, count, of = content[row], count[row], of[row]
    rest = content.sum(1, keepdims=True) - content
    left = (count.sum(1, keepdims=True) - count).astype(np.uint64)
    place = (((row - first[of]) * PARTS + (tag << 40)[of])[:, None] + np.arange(PARTS)).astype(np.uint64)
    sig = mixed(rest + left * _U(0xE7037ED1A0B428DB) + place * _U(0x8EBC6AF09C88C6E3))
    ok = left > 0
    if last:
        ok |= few[of][:, None]
    return sig[ok], np.repeat(of, ok.sum(1)), few


def all_signatures(sets: list[np.ndarray], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set of each, ascending) of non-empty sets; ``rare`` marks
    the rare shingles of all sets, one after the other."""
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    of, band, n, d = np.array([(i, *e) for i, size in enumerate(sizes.tolist()) for e in bands(size)], np.int64).T
    # without a distance only equal sets are similar: the whole is the signature
    sums = set_sums(flat, sizes, 0xA0761D6478BD642F)
    same = d == 0
    out, owner = [mixed(sums[of[same]] + band[same].astype(np.uint64))], [of[same]]
    of, band, n, d = of[~same], band[~same], n[~same], d[~same]
    if len(of):
        stop = np.cumsum(sizes)
        seen = np.concatenate([[0], np.cumsum(rare)])
        start, end = seen[stop - sizes][of], seen[stop][of]
        sig, at, few = _subsets(flat[rare], start, end - start, band, n, d, 0, False)
        out.append(sig)
        owner.append(of[at])
        if few.any():
            of, band, n, d = of[few], band[few], n[few], d[few]
            sig, at, _ = _subsets(flat, (stop - sizes)[of], sizes[of], band, n, d, 1, True)
            out.append(sig)
            owner.append(of[at])
    sig, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return sig[order], owner[order]


def signatures(s: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Distinct signatures of one set; ``rare`` marks its rare shingles."""
    return np.unique(all_signatures([s], rare)[0])


def _parted(b: pd.DataFrame, chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    size = np.cumsum(b["text"].str.len().to_numpy(np.int64))
    at, base = 0, 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(size, base + chars)))
        yield b.iloc[at:to]
        base, at = size[to - 1], to


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in more than one document in ``HOT_SHARE``, counted per batch over all
    documents: a bit for every slot (hash modulo ``HOT_BITS``), packed. A rare shingle
    in a common one's slot counts as common for all documents alike, so the order of
    signatures stays global."""
    n = docs.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Shingler()
        for b in batches:
            for part in _parted(b):
                # one count per distinct text, so copies do not make a passage common
                texts = list(dict.fromkeys(part["text"].tolist()))
                sets = one.sets(texts)
                keys, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
                ok = counts >= max(2, len(texts) // (2 * HOT_SHARE))
                yield pd.DataFrame({"h": keys[ok].view(np.int64), "n": counts[ok].astype(np.int64)})

    slots = (docs.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= max(HOT_LEAST, n // HOT_SHARE))
             .select((F.col("h").bitwiseAND(F.lit(HOT_BITS - 1)) + 1).alias("s")))
    maps = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros(HOT_BITS // 8, np.uint8)
    for r in maps.toLocalIterator():        # HOT_BITS / 32768 rows of 4 KB at most
        at = (r["b"] - 1) * len(r["bits"])
        out[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_common(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Marks the shingles whose slot in ``common_shingles`` is set."""
    slot = (s & _U(HOT_BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _pack(sig: np.ndarray, owner: np.ndarray, classes: np.ndarray, ids: np.ndarray, sizes: np.ndarray,
          own: np.ndarray, cells: list[bytes]) -> bytes:
    """Signatures (low 32 bits; the bucket tells the rest) by class with the number of each
    class (``owner`` ascends), and document rows with their sketches."""
    used, count = np.unique(owner, return_counts=True)
    head = np.array([len(sig), len(used), len(ids)], np.int64)
    raw = b"".join([head.tobytes(), (sig & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    classes[used].tobytes(), count.astype(np.int64).tobytes(), ids.tobytes(), sizes.tobytes(), own.tobytes(),
                    np.fromiter(map(len, cells), np.int64, len(cells)).tobytes(), *cells])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, k = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    out = []
    for dtype, count in ((np.uint32, n), (np.int64, m), (np.int64, m), (np.int64, k), (np.int64, k), (np.int64, k), (np.int64, k)):
        out.append(np.frombuffer(raw, dtype, count, at))
        at += out[-1].nbytes
    low, classes, count, ids, sizes, own, length = out
    stop = at + np.cumsum(length)
    cells = [raw[b - n:b] for b, n in zip(stop.tolist(), length.tolist())]
    return low, np.repeat(classes, count), ids, sizes, own, cells


def _sign(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """kind 0: (doc_id, n_shingles, class, sketch); kind 1: (signature, smallest
    class under it, class) for every signature that more than one class carries."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Shingler()
        common = shared.value
        for b in batches:
            for part in _parted(b):
                ids = part["doc_id"].fillna(NO_ID).to_numpy(np.int64)
                sets = one.sets(part["text"].tolist())
                sizes = np.array([len(s) for s in sets], np.int64)
                own = set_classes(sets)
                some = np.flatnonzero(sizes)
                once = np.sort(some[np.unique(own[some], return_index=True)[1]])    # one set of each class
                cells = [b""] * len(sets)
                for i in once.tolist():
                    cells[i] = sketch(sets[i])
                picked = [sets[i] for i in once.tolist()]
                sig, owner = all_signatures(picked, ~is_common(np.concatenate([np.zeros(0, np.uint64), *picked]), common))
                classes = own[once]
                to = ((sig >> _U(40)) % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                doc_to = ids % buckets
                rows = []
                for k in np.union1d(to, doc_to).tolist():
                    at = order[cut[k]:cut[k + 1]]
                    d = np.flatnonzero(doc_to == k)
                    rows.append((k, _pack(sig[at], owner[at], classes, ids[d], sizes[d], own[d],
                                          [cells[i] for i in d.tolist()])))
                yield pd.DataFrame(rows, columns=["bucket", "blob"])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(x) for x in g["blob"]]
        sig, cls, ids, sizes, own = (np.concatenate([x[k] for x in got]) for k in range(5))
        cells = [c for x in got for c in x[5]]
        ordered = np.sort(sig)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            at = np.minimum(np.searchsorted(again, sig), len(again) - 1)
            sig, cls = sig[again[at] == sig], cls[again[at] == sig]
        else:
            sig, cls = sig[:0], cls[:0]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[fresh], cls[fresh]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(sig)))
        first = np.repeat(cls[start], size)
        many = np.repeat(size > 1, size)
        bucket = int(g["bucket"].iat[0])
        key = sig[many].astype(np.int64) | bucket << 32
        return pd.DataFrame({"kind": np.concatenate([np.zeros(len(ids), np.int32), np.ones(int(many.sum()), np.int32)]),
                             "a": np.concatenate([ids, key]), "b": np.concatenate([sizes, first[many]]),
                             "c": np.concatenate([own, cls[many]]),
                             "cells": pd.Series(cells + [None] * int(many.sum()), dtype=object)})

    return docs.mapInPandas(emit, "bucket int, blob binary").groupBy("bucket").applyInPandas(
        gather, "kind int, a long, b long, c long, cells binary")


def _wanted_only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be in ``wanted``: a bit per hash slot, BITS in
    all, so the broadcast side has a fixed size; a wrong bit only costs a row more."""
    def slots(df):
        return df.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1)
    bits = slots(wanted).groupBy(F.bitmap_bucket_number("_s").alias("_b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    at = F.bitmap_bit_position("_s")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return (slots(docs).withColumn("_b", F.bitmap_bucket_number("_s")).join(F.broadcast(bits), "_b")
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_s", "_b", "_bits"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, hashes of the classes in ``wanted`` (cls, doc_id). A class may come on
    several rows when a doc_id does."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Shingler()
        for b in batches:
            for part in _parted(b):
                sets = one.sets(part["text"].tolist())
                rows = [(c, len(s), s.view(np.int64)) for c, s, own in
                        zip(part["cls"].tolist(), sets, set_classes(sets).tolist()) if len(s) and own == c]
                yield pd.DataFrame(rows, columns=["cls", "n", "hashes"])

    return (_wanted_only(docs, wanted).join(wanted, "doc_id").select("cls", "text")
            .mapInPandas(run, "cls long, n long, hashes array<long>"))


def _possible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity. ``info``: cls, n, cells."""
    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        at = np.arange(len(x))
        return pd.Series(differing(sketches(x.tolist()), at, sketches(y.tolist()), at) <= n.to_numpy() // 7)

    def side(name):
        return info.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col("cells").alias(f"c{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    return both.where(near("ca", "cb", F.col("na") + F.col("nb"))).select("a", "b")


def _verify(pairs: DataFrame, docs: DataFrame, info: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) with a similarity of at least 0.75."""
    pairs = stage(pairs, f"{name}-pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = stage(_sets(docs, ids.join(info.select("cls", "doc_id"), "cls")), f"{name}-sets")
    # whole sets are never broadcast, whatever the session's threshold is
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha")).hint("merge")
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb")).hint("merge")
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return stage(both.where(100 * F.col("i") >= 75 * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), name)


def _tile_pairs(sig: np.ndarray, second: np.ndarray, one_tile: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs under one signature, in slices of about ``PAIRS``: all of one tile, or the first
    tile's rows with the ``second`` one's. Rows are in order of (sig, second)."""
    rows = np.arange(len(sig))
    end = np.searchsorted(sig, sig, "right")
    if one_tile:
        start = rows + 1
    else:
        seconds = np.concatenate([[0], np.cumsum(second)])
        start = end - (seconds[end] - seconds[np.searchsorted(sig, sig)])
    count = end - start if one_tile else np.where(second, 0, end - start)
    total = np.cumsum(count)
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        i = np.repeat(rows[at:to], count[at:to])
        if len(i):
            yield i, start[i] + np.arange(len(i)) - (total[i] - count[i] - base)
        at = to


def _spread(pdf: pd.DataFrame, buckets: int) -> Iterator[tuple]:
    """(bucket, lo, hi, blob): the sets of ``pdf`` (cls, comp, n, cells and spots: signature, place,
    signature, place ...) for every pair of tiles they are compared in; in a blob a set stands once."""
    cls, comp, n = (pdf[c].to_numpy(np.int64) for c in ("cls", "comp", "n"))
    cells = pdf["cells"].tolist()
    spots = np.concatenate(pdf["spots"].to_numpy()).reshape(-1, 2)
    row = np.repeat(np.arange(len(pdf)), pdf["spots"].map(len).to_numpy() // 2)
    tile, core, rest = spots[:, 1] >> 42, spots[:, 1] >> 21 & 0x1FFFFF, spots[:, 1] & 0x1FFFFF
    copies = np.where(tile < core, rest, core + rest)
    at = np.repeat(np.arange(len(row)), copies)
    other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies) + np.where(tile < core, core, 0)[at]
    sig, row, tile = spots[at, 0], row[at], tile[at]
    lo, hi = np.minimum(tile, other), np.maximum(tile, other)
    to = (mixed(sig.view(np.uint64)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((row, hi, lo, to))
    sig, row, tile, lo, hi, to = (x[order] for x in (sig, row, tile, lo, hi, to))
    new = np.flatnonzero((np.diff(to) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
    for i, j in zip([0, *new.tolist()], [*new.tolist(), len(to)]):
        used, count = np.unique(row[i:j], return_counts=True)
        mine = [cells[k] for k in used.tolist()]
        second = (tile[i:j] == hi[i]) & (lo[i] != hi[i])
        yield int(to[i]), int(lo[i]), int(hi[i]), zstandard.ZstdCompressor(level=1).compress(b"".join([
            np.array([j - i, len(used)], np.int64).tobytes(), sig[i:j].tobytes(), cls[used].tobytes(), comp[used].tobytes(),
            n[used].tobytes(), count.astype(np.int64).tobytes(), np.fromiter(map(len, mine), np.int64, len(mine)).tobytes(),
            second.tobytes(), *mine]))


def _spread_out(blob: bytes) -> tuple:
    """sig, second and set number per signature, then cls, comp, n and cells per set."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, m = np.frombuffer(raw, np.int64, 2).tolist()
    words = np.frombuffer(raw, np.int64, k + 5 * m, 16)
    cls, comp, n, count, length = words[k:].reshape(5, m)
    at = 16 + words.nbytes
    stop = at + k + np.cumsum(length)
    return (words[:k], np.frombuffer(raw, bool, k, at), np.repeat(np.arange(m), count), cls, comp, n,
            [raw[e - w:e] for e, w in zip(stop.tolist(), length.tolist())])


def _across(placed: DataFrame, info: DataFrame, buckets: int, nearest: bool) -> DataFrame:
    """Pairs (sig, a, b) of ``placed`` (sig, cls, comp) under one signature that lie in different
    components and whose sketches allow the similarity; with ``nearest``, per set and
    tile the one with the nearest sketch."""
    placed = placed.repartition("sig")
    open_sigs = (placed.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("cls")).alias("who"))
                 .groupBy("sig").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("_n"), F.bit_xor("who").alias("who"),
                                     F.max(F.struct("k", "comp")).alias("_most"))
                 .where("comps > 1").groupBy("_n", "who").agg(F.min(F.struct("sig", "_most")).alias("s"))
                 .select("s.sig", "_n", F.col("s._most.k").alias("_k"), F.col("s._most.comp").alias("_core")))
    # sets of the largest component have tiles of their own, which are not held against each other
    tile, many = F.lit(float(TILE)), F.col("_n") > TILE
    core = F.when(many, F.ceil(F.col("_k") / tile)).otherwise(0).cast("long")
    rest = F.when(many, F.ceil((F.col("_n") - F.col("_k")) / tile)).otherwise(1).cast("long")
    own = F.when(many & (F.col("comp") == F.col("_core")), F.pmod(F.xxhash64("cls"), core)).otherwise(
        core + F.pmod(F.xxhash64("cls"), rest))
    spot = F.shiftleft(own, 42) + F.shiftleft(core, 21) + rest
    # a set meets its sketch once, with all its signatures (a bounded number)
    sets = (placed.join(open_sigs, "sig").select("cls", "comp", "sig", spot.alias("spot")).repartition("cls")
            .groupBy("cls", "comp").agg(F.flatten(F.collect_list(F.array("sig", "spot"))).alias("spots"))
            .join(info.select("cls", "n", "cells"), "cls"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), SPREAD):
                rows = list(_spread(b.iloc[i:i + SPREAD], buckets))
                yield pd.DataFrame(rows, columns=["bucket", "lo", "hi", "blob"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        got = [_spread_out(x) for x in g["blob"]]
        lo, hi = g["lo"].iat[0], g["hi"].iat[0]
        sig, second = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        first = np.cumsum([0] + [len(x[3]) for x in got])
        row = np.concatenate([x[2] + k for x, k in zip(got, first.tolist())])
        order = np.lexsort((second, sig))
        sig, second, place = sig[order], second[order], row[order]
        cls, comp, n = (np.concatenate([x[k] for x in got])[place] for k in (3, 4, 5))
        h = sketches([c for x in got for c in x[6]])
        best, by = np.full(len(sig), np.iinfo(np.int64).max), np.full(len(sig), -1)
        out = [np.zeros((0, 3), np.int64)]

        def add(i, j):
            if len(i):
                out.append(np.unique(np.column_stack([sig[i], np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])]), axis=0))

        for i, j in _tile_pairs(sig, second, lo == hi):
            ok = (comp[i] != comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            # a pair of sets may stand under many signatures
            pair, back = np.unique(np.minimum(place[i], place[j]) * first[-1] + np.maximum(place[i], place[j]), return_inverse=True)
            low = differing(h, pair // first[-1], h, pair % first[-1])[back]
            ok = low <= (n[i] + n[j]) // 7
            i, j, low = i[ok], j[ok], low[ok]
            if not nearest:
                add(i, j)
                continue
            row, other, low = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([low, low])
            top = np.lexsort((cls[other], low, row))
            top = top[np.concatenate([[True], row[top][1:] != row[top][:-1]])] if len(top) else top
            row, other, low = row[top], other[top], low[top]
            nearer = (low < best[row]) | ((low == best[row]) & (cls[other] < cls[by[row]]))
            best[row[nearer]], by[row[nearer]] = low[nearer], other[nearer]
        if nearest:
            add(np.flatnonzero(by >= 0), by[by >= 0])
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["sig", "a", "b"])

    dealt = sets.mapInPandas(deal, "bucket long, lo long, hi long, blob binary")
    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(run, "sig long, a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (the smallest key
    reachable by links, itself included)."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = max(partitions(spark), -(-slim.count() // DOCS_PER_BUCKET))
    signed = stage(_sign(slim, common_shingles(slim), buckets), "shingle-signatures")
    rows = signed.where("kind = 0").select(F.when(F.col("a") != NO_ID, F.col("a")).alias("doc_id"),
                                           F.col("b").alias("n_shingles"), F.when(F.col("b") > 0, F.col("c")).alias("cls"), "cells")
    members = signed.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("rep"), F.col("c").alias("cls"))
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("cells").alias("cells"))
    info = stage(classes.where("doc_id is not null").join(members.select("cls").distinct(), "cls"), "shingle-info")

    star = members.where("rep <> cls").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct()
    links = _verify(_possible(star, info), slim, info, "shingle-links")
    comp = connected_components(links, "shingle-cc")
    live = members.where("rep <> cls").select("sig", "cls")         # the smallest was paired with all
    tried = links.select("a", "b").where("false")
    rounds = [True] * NEAREST_ROUNDS + [False]
    while rounds:
        nearest = rounds.pop(0)
        name = f"shingle-{'near' if nearest else 'all'}"
        placed = (live.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                  .select("sig", "cls", F.coalesce("component", "cls").alias("comp")))
        found = stage(_across(placed, info, buckets, nearest), f"{name}-found")
        if found.isEmpty():     # no set has a possible partner in another component
            break
        pairs = found.select("a", "b").distinct()
        more = _verify(pairs.join(tried, ["a", "b"], "left_anti"), slim, info, name)
        if not more.isEmpty():
            comp = connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more),
                                        f"{name}-cc")
        elif nearest:           # the nearest would be the same again
            rounds = [False]
        # a set without a possible partner under a signature never has one there again
        live = found.select("sig", F.explode(F.array("a", "b")).alias("cls")).distinct()
        tried = tried.union(pairs)

    known = (classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
             .select("cls", "doc_id", F.coalesce("component", "cls").alias("comp")))
    # written, so that the join by a large component can be split
    lowest = stage(known.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "shingle-lowest")
    named = known.join(lowest, "comp").select("cls", "component_id")
    return (rows.join(named, "cls", "left")
            .select(F.col("doc_id").alias(key), "n_shingles",
                    F.coalesce("component_id", "doc_id").alias("component_id")))
