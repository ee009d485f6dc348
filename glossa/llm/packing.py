"""Best-fit packing by a grouping genetic algorithm (operator 9).

Documents become token ids (the tokenizer's ids, then one end id); a document
longer than a sequence is cut into full pieces and a rest. Pieces shorter than a
sequence are then grouped into as few sequences as possible:

* Shards. Pieces are dealt by a hash to shards of about ``SHARD_ITEMS`` pieces,
  so a group's size is bounded whatever the input is.
* Islands. ``ISLANDS`` populations evolve each shard independently
  (``applyInPandas`` per shard and island). An individual is a set of bins.
  Crossover injects whole well-filled bins of one parent into another, removes
  the bins that hold a duplicate, and puts the displaced pieces back best-fit,
  longest first. Fitness: fewer bins, then the sum of squared fills.
* Migration. Between epochs an island keeps its population, and its best solution also joins
  the next island of the shard. The best island wins.
* Levels. Bins at least ``FROZEN`` full are final; the pieces of the others go
  to fewer shards of the next level, until one shard holds the rest. Where most
  pieces lie in other bins (pieces so long that bins cannot fill), bins at least
  half full are final too, and only the emptier ones climb. So the number of
  half-filled sequences does not grow with the number of shards.

Evolution goes on where the number of bins is already the least possible, as fuller bins
leave fewer pieces for the next level; it ends early only when all bins but one are full. How many
crossovers a shard had, and how many of them gained, stands in every epoch's table. All random choices
are seeded by shard, island and epoch. The table of
pieces and every epoch's result are written, so lost executors repeat one step.

Edge cases: null and empty texts are a single end id. Repeated rows are packed
as often as they occur (pieces have their own ids). An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import no_cycle_scans, prepare, stage

CAPACITY = 2048
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
FROZEN = 0.97
BATCH_CHARS = 4_000_000
MAX_IDS = 6_000_000      # ids remembered per worker and table before it starts anew


class _Numbered(dict):
    """item -> running number; new items are queued."""

    def __init__(self, first: int):
        super().__init__()
        self.first, self.new = first, []

    def __missing__(self, item):
        i = self[item] = len(self) + self.first
        self.new.append(item)
        return i


class _Runs:
    """Runs of ids by number, in growing arrays."""

    def __init__(self, ids=()):
        self.ids = np.array(ids, np.uint32)
        n = int(len(ids) > 0)
        self.start, self.size = np.zeros(n, np.int64), np.full(n, len(ids), np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, flat])

    def gather(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs named by ``order``, one after the other, and where each ends."""
        n = self.size[order]
        stop = np.cumsum(n)
        return self.ids[np.repeat(self.start[order] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], stop


class TextIds:
    """Token ids of whole texts, one tokenizer call per distinct word part of a worker.

    The tokenizer's split rule never crosses ASCII white space and its
    normalisation acts inside words, so a text's ids are its words' ids in order. A
    word of plain Latin characters is further cut by that rule (after lower-casing)
    into runs of letters, single digits and runs of other characters, which repeat
    much more than words with their punctuation do; other words, and words with a
    special token in them, go to the tokenizer whole.
    """

    PLAIN = regex.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u017f]+")
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}++|\p{N}|[^\s\p{L}\p{N}]++")

    def __init__(self, spec_text: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in json.loads(spec_text)["added_tokens"]]
        self.end_id = end_id
        self._forget_words()
        self._forget_parts()

    def _forget_words(self):
        self.words, self.runs = _Numbered(1), _Runs([self.end_id])      # 0 is the end id

    def _forget_parts(self):
        self.parts, self.part_runs = _Numbered(0), _Runs()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, end position of every text); each text ends with the end id."""
        # words are cheap to learn again from their parts, parts are not
        if len(self.runs.ids) > MAX_IDS:
            self._forget_words()
        if len(self.part_runs.ids) > MAX_IDS:
            self._forget_parts()
        # distinct words of the batch first: only these are looked up one by one
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = words.flatten().dictionary_encode()
        with no_cycle_scans():
            distinct = coded.dictionary.to_pylist()
            number = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
            self._learn()
        ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
        order = np.insert(number[coded.indices.to_numpy()], ends, 0)
        flat, stop = self.runs.gather(order)
        return flat, stop[order == 0]

    def _cut(self, word: str) -> tuple | list:
        if not (word.isascii() or self.PLAIN.fullmatch(word)):
            return (word,)
        low = word.lower()
        if low.isalpha():
            return (low,)
        return (word,) if any(s in word for s in self.special) else self.PARTS.findall(low)

    def _ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts. A printable ASCII part is what the tokenizer's own normaliser and splitter would leave of it
        (its byte alphabet has ASCII at its place), so it goes straight to the merges."""
        direct = [p.isascii() and p.isprintable() and not any(s in p for s in self.special) for p in parts]
        rest = iter(self.tokenizer.encode_batch([p for p, d in zip(parts, direct) if not d], add_special_tokens=False))
        merge = self.tokenizer.model.tokenize
        return [[t.id for t in merge(p)] if d else next(rest).ids for p, d in zip(parts, direct)]

    def _learn(self):
        if not self.words.new:
            return
        cut = [self._cut(w) for w in self.words.new]
        self.words.new.clear()
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        order = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        if self.parts.new:
            got = self._ids(self.parts.new)
            self.parts.new.clear()
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.part_runs.add(np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size)
        flat, stop = self.part_runs.gather(order)
        ends = np.concatenate([[0], stop])[np.cumsum(n)]
        self.runs.add(flat, np.diff(ends, prepend=0))


_TEXT_IDS: dict[int, TextIds] = {}


def pieces(docs: DataFrame, spec_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """One row per piece: uid, ``key``, piece, start, length, ids_crc32 (and ids)."""
    spark = docs.sparkSession
    prepare(spark)
    with open(spec_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = hash(spec.value)
        if own not in _TEXT_IDS:
            _TEXT_IDS[own] = TextIds(spec.value)
        task, uid = TaskContext.get().partitionId() << 36, 0
        for b in batches:
            for part in _by_size(b, "text", BATCH_CHARS):
                ids, stops = _TEXT_IDS[own](part["text"].tolist())
                rows, start = [], 0
                for doc, stop in zip(part["key"], stops.tolist()):
                    for k, at in enumerate(range(start, stop, capacity)):
                        one = ids[at:min(at + capacity, stop)]
                        raw = one.astype("<u4").tobytes()
                        row = (task + uid, doc, k, at - start, len(one), zlib.crc32(raw))
                        rows.append((*row, one.astype(np.int64).tolist()) if with_ids else row)
                        uid += 1
                    start = stop
                yield pd.DataFrame(rows, columns=names)

    schema = f"uid long, key {key_type}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInPandas(cut, schema)


def _by_size(b: pd.DataFrame, col: str, chars: int) -> Iterator[pd.DataFrame]:
    """Slices of about ``chars`` characters."""
    size = np.cumsum(b[col].str.len().to_numpy(np.int64))
    at, base = 0, 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(size, base + chars)))
        yield b.iloc[at:to]
        base, at = size[to - 1], to


class Bins:
    """Best-fit placement: open bins by free room, with a bit mask of the rooms in use."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        self.next = 0

    def add(self, items: list[int]) -> None:
        b, self.next = self.next, self.next + 1
        self.bins[b] = items
        self._open(b, self.capacity - sum(self.sizes[i] for i in items))

    def _open(self, b: int, room: int) -> None:
        self.room[b] = room
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def place(self, items: list[int]) -> None:
        for i in items:
            fits = self.mask >> self.sizes[i]
            if not fits:
                self.add([i])
                continue
            room = self.sizes[i] + (fits & -fits).bit_length() - 1
            same = self.by_room[room]
            b = same.pop()
            if not same:
                self.mask &= ~(1 << room)
            self.bins[b].append(i)
            self._open(b, room - self.sizes[i])

    def solution(self) -> list[list[int]]:
        return list(self.bins.values())


def best_fit(sizes: list[int], order: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    b = Bins(sizes, capacity)
    for items in start:
        b.add(list(items))
    b.place(order)
    return b.solution()


def fitness(sol: list[list[int]], sizes: list[int]) -> tuple[int, int]:
    return len(sol), -sum(sum(sizes[i] for i in b) ** 2 for b in sol)


def crossover(base: list[list[int]], donor: list[list[int]], sizes: list[int], capacity: int,
              rng: random.Random) -> list[list[int]]:
    """Inject whole well-filled bins of ``donor`` into ``base``."""
    ranked = sorted(donor, key=lambda b: -sum(sizes[i] for i in b))
    take = ranked[:max(1, len(ranked) // 2)]
    inject = [b for b in take if rng.random() < 0.5] or take[:1]
    taken = {i for b in inject for i in b}
    kept, loose = [], []
    for b in base:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            loose += [i for i in b if i not in taken]
    # the emptiest kept bin is opened too, so its pieces can fill gaps elsewhere
    if kept:
        worst = min(range(len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))
        loose += kept.pop(worst)
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), capacity, [*inject, *kept])


def perfect(score: tuple[int, int], sizes: list[int], capacity: int) -> bool:
    """As few bins as the total needs, and all but one of them full: nothing is left to gain."""
    full, rest = divmod(sum(sizes), capacity)
    return score == (full + (rest > 0), -(full * capacity ** 2 + rest ** 2))


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (),
           population: int = POPULATION, generations: int = GENERATIONS, log: dict | None = None) -> list[list[list[int]]]:
    """The population after ``generations`` crossovers, best first; ``elites`` are solutions that join
    it at the start. It is filled up with best fit by falling size, and by sizes that are disturbed at
    random. ``log`` gets the crossovers, and those whose child entered the population or led it."""
    rng = random.Random(seed)
    n = len(sizes)
    log = log if log is not None else {}
    log |= {"crossovers": 0, "entered": 0, "led": 0}
    pool = [(fitness(e, sizes), e) for e in elites]
    if not pool:
        first = best_fit(sizes, sorted(range(n), key=lambda i: -sizes[i]), capacity)
        pool.append((fitness(first, sizes), first))
    while len(pool) < population:
        spread = rng.uniform(0.02, 0.4)
        sol = best_fit(sizes, sorted(range(n), key=lambda i: -sizes[i] * rng.uniform(1 - spread, 1)), capacity)
        pool.append((fitness(sol, sizes), sol))
    pool.sort(key=lambda p: p[0])
    del pool[max(population, 2):]
    for _ in range(generations):
        if perfect(pool[0][0], sizes, capacity) or len(pool) < 2:
            break
        a, b = rng.sample(range(len(pool)), 2)
        child = crossover(pool[a][1], pool[b][1], sizes, capacity, rng)
        score = fitness(child, sizes)
        log["crossovers"] += 1
        log["entered"] += score < pool[-1][0]
        log["led"] += score < pool[0][0]
        if score < pool[-1][0]:
            pool[-1] = (score, child)
            pool.sort(key=lambda p: p[0])
    return [sol for _, sol in pool]


def _epoch(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every (shard, island). ``rows``: shard, island, origin, uid, length, bin;
    origin -1 has no bins yet, the others are solutions: the island's population and the
    neighbour's elite. Returns the population (rank 0 is the best) with what evolved."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(g["shard"].iat[0]), int(g["island"].iat[0])
        g = g.sort_values(["origin", "uid"])
        solutions = [s for _, s in g.groupby("origin", sort=True)]
        uid, sizes = solutions[0]["uid"].to_numpy(), solutions[0]["length"].astype(int).tolist()
        elites = []
        for s in solutions:
            if s["origin"].iat[0] >= 0:
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(s["bin"].tolist()):
                    bins.setdefault(b, []).append(i)
                elites.append(list(bins.values()))
        log: dict = {}
        out = []
        for rank, sol in enumerate(evolve(sizes, capacity, (shard * 1009 + island) * 31 + epoch, elites, log=log)):
            where, offset, fill = np.empty(len(uid), np.int64), np.empty(len(uid), np.int64), np.empty(len(uid), np.int64)
            for k, b in enumerate(sol):
                at = 0
                for i in b:
                    where[i], offset[i] = k, at
                    at += sizes[i]
                fill[b] = at
            out.append(pd.DataFrame({"shard": shard, "island": island, "rank": rank, "uid": uid, "length": sizes, "bin": where,
                                     "offset": offset, "fill": fill, "bins": len(sol), "emptiness": fitness(sol, sizes)[1], **log}))
        return pd.concat(out, ignore_index=True)

    return rows.groupBy("shard", "island").applyInPandas(
        run, "shard long, island int, rank int, uid long, length long, bin long, offset long, fill long, bins long, "
             "emptiness long, crossovers long, entered long, led long")


def group_pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, sequence_id, offset) for ``items`` (uid, length <= capacity), in as few
    sequences as the algorithm finds."""
    full = items.where(F.col("length") >= capacity).select(
        "uid", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    done, level, shards = [full], 0, None
    while True:
        n = rest.count()
        if not n:
            break
        # at most half as many as before, also where thousands of pieces do not half fill a bin
        shards = min(-(-n // SHARD_ITEMS), -(-shards // 2) if shards else n)
        dealt = rest.select(F.pmod(F.xxhash64(F.lit(level), "uid"), F.lit(shards)).alias("shard"), "uid", "length")
        rows = dealt.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
                            F.lit(-1).alias("origin"), "uid", "length", F.lit(0).cast("long").alias("bin"))
        for epoch in range(EPOCHS):
            last = epoch == EPOCHS - 1
            evolved = _epoch(rows, capacity, epoch)
            best = stage(evolved.where("rank = 0") if last else evolved, f"pack-{level}-{epoch}")
            # an island keeps its population; its best solution also goes to the next island
            own = best.select("shard", "island", F.col("rank").alias("origin"), "uid", "length", "bin")
            elite = best.where("rank = 0").select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"),
                                                  F.lit(POPULATION).alias("origin"), "uid", "length", "bin")
            rows = own.union(elite) if ISLANDS > 1 else own
        winner = best.groupBy("shard").agg(F.min(F.struct("bins", "emptiness", "island")).alias("w"))
        won = best.join(winner, "shard").where(F.col("island") == F.col("w")["island"])
        limit = FROZEN * capacity
        if shards > 1 and won.where(F.col("fill") < limit).count() > n // 2:
            limit = capacity / 2      # pieces so long that bins cannot fill
        final = won if shards == 1 else won.where(F.col("fill") >= limit)
        done.append(final.select("uid", (F.lit(level << 56) + F.shiftleft("shard", 24) + F.col("bin"))
                                 .alias("sequence_id"), "offset"))
        if shards == 1:
            break
        rest = won.where(F.col("fill") < limit).select("uid", "length")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack(docs: DataFrame, spec_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id,
    offset (and the ids themselves)."""
    cut = stage(pieces(docs, spec_path, capacity, key, text, with_ids), "pieces")
    out = cut.join(group_pieces(cut.select("uid", "length"), capacity), "uid")
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *(["ids"] if with_ids else []))
