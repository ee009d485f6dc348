"""Token counts by compiled finite-state transducers (operator 6).

Counts the tokens of byte-level BPE without tokenizing running text. Two
deterministic transducers are compiled from the tokenizer file:

1. *Word splitter.* The byte-level split rule (contractions, letter runs, digit
   runs, other runs, white space) is a machine of ``N_STATES`` states over 13
   character classes whose transitions say whether a new piece starts at this
   character or, for white space, one character earlier. All texts of a batch
   form one character stream (a separator class flushes and resets), cut into
   equal chunks. Every chunk is run from every state at once, which gives its
   state map; maps compose by a parallel prefix scan; then each chunk is run
   once from the state it really starts in, which gives the piece starts.
2. *Piece transducer.* Over the bytes of one piece, lazily determinised: a
   state holds the last token and running count of the prefixes that a later
   token can still reach (never longer than the longest vocabulary entry that
   could still end ahead); a transition reads a byte and is annotated with the
   change of the emitted-token count. It relies on the pair property of merge
   tables: a token sequence is the tokenizer's output exactly when each adjacent
   pair is, so each prefix has one last token.

Piece counts are memoised per distinct piece in a worker (bounded dictionary),
so the piece transducer runs once per distinct piece.

Edge cases: null text is empty (0 bytes, 0 tokens). The strings of the file's
special tokens count as one token each wherever they occur, as the library
does by default. Repeated rows are counted each by itself; extra columns are
kept by ``with_token_counts``; an empty table gives an empty result. Texts may
have any length: a batch is cut by characters, not by rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import prepare

CHUNK = 128               # characters per chunk of the prefix scan
STREAM_CHARS = 2_000_000  # characters handled at once
MAX_MEMO = 400_000         # distinct pieces (and machine states) remembered per worker

# Character classes. Letters of the contractions have classes of their own.
SEP, WS, SP, APOS, LETTER, DIGIT, OTHER = range(7)
C_S, C_T, C_M, C_D, C_L, C_R_V, C_E = range(7, 14)
N_CLASSES = 14
_IS_LETTER = {LETTER, C_S, C_T, C_M, C_D, C_L, C_R_V, C_E}

# Splitter states: what the piece being read is.
(START, IN_LETTER, IN_DIGIT, IN_OTHER, WS_RUN_SP, WS_RUN_WS, APOS_FIRST, APOS_L, APOS_RV,
 CONTR_END, ONE_SP) = range(11)
N_STATES = 11
# Outputs of a transition: a piece starts here; the white space run before it loses its last character.
NEW, SPLIT_LAST = 1, 2


def _step(state: int, c: int) -> tuple[int, int]:
    """One transition: (next state, outputs).

    ONE_SP: a single space so far; it joins a following run of letters, digits
    or other characters. WS_RUN_SP / WS_RUN_WS: a longer white space run ending
    in a space / in another character. APOS_FIRST: an apostrophe that starts a
    piece, which becomes a contraction if the right letters follow; APOS_L and
    APOS_RV wait for the second letter, and when it does not come the letter
    after the apostrophe turns out to start a letter run (SPLIT_LAST).
    """
    if c == SEP:
        return START, NEW
    if state == APOS_FIRST:
        if c in (C_S, C_T, C_M, C_D):
            return CONTR_END, 0
        if c == C_L:
            return APOS_L, 0
        if c == C_R_V:
            return APOS_RV, 0
        if c in (APOS, OTHER):
            return IN_OTHER, 0
    elif state == APOS_L or state == APOS_RV:
        if (state == APOS_L and c == C_L) or (state == APOS_RV and c == C_E):
            return CONTR_END, 0
        # not a contraction: the apostrophe stands alone, the letter before started a run
        if c in _IS_LETTER:
            return IN_LETTER, SPLIT_LAST
        nxt, out = _fresh(c)
        return nxt, out | SPLIT_LAST
    elif state == IN_LETTER and c in _IS_LETTER:
        return IN_LETTER, 0
    elif state == IN_DIGIT and c == DIGIT:
        return IN_DIGIT, 0
    elif state == IN_OTHER and c in (OTHER, APOS):
        return IN_OTHER, 0
    elif state == ONE_SP:
        if c in _IS_LETTER:
            return IN_LETTER, 0
        if c == DIGIT:
            return IN_DIGIT, 0
        if c in (OTHER, APOS):
            return IN_OTHER, 0
        return (WS_RUN_SP if c == SP else WS_RUN_WS), 0
    elif state == WS_RUN_SP:
        # the run's last space goes to what follows (to a piece of letters, digits or others)
        if c in _IS_LETTER:
            return IN_LETTER, SPLIT_LAST
        if c == DIGIT:
            return IN_DIGIT, SPLIT_LAST
        if c in (OTHER, APOS):
            return IN_OTHER, SPLIT_LAST
        return (WS_RUN_SP if c == SP else WS_RUN_WS), 0
    elif state == WS_RUN_WS:
        if c in (SP, WS):
            return (WS_RUN_SP if c == SP else WS_RUN_WS), 0
        # the run's last character is a piece of its own (if the run is longer than it)
        nxt, out = _fresh(c)
        return nxt, out | SPLIT_LAST
    return _fresh(c)


def _fresh(c: int) -> tuple[int, int]:
    if c in _IS_LETTER:
        return IN_LETTER, NEW
    if c == DIGIT:
        return IN_DIGIT, NEW
    if c == OTHER:
        return IN_OTHER, NEW
    if c == APOS:
        return APOS_FIRST, NEW
    return (ONE_SP if c == SP else WS_RUN_WS), NEW


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) tables, indexed by class * N_STATES + state."""
    nxt = np.zeros(N_CLASSES * N_STATES, np.uint8)
    out = np.zeros(N_CLASSES * N_STATES, np.uint8)
    for c in range(N_CLASSES):
        for s in range(N_STATES):
            nxt[c * N_STATES + s], out[c * N_STATES + s] = _step(s, c)
    return nxt, out


def class_table() -> np.ndarray:
    """Class of every code point (times N_STATES, ready for the tables)."""
    t = np.full(0x110000, OTHER, np.uint16)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", WS)):
        hit = np.frombuffer("".join(regex.findall(pattern, chars)).encode("utf-32-le"), np.uint32)
        t[hit] = cls
    for text, cls in ((" ", SP), ("'", APOS), ("s", C_S), ("t", C_T), ("m", C_M), ("d", C_D), ("l", C_L),
                      ("rv", C_R_V), ("e", C_E)):
        for ch in text:
            t[ord(ch)] = cls
    return t * np.uint16(N_STATES)


class Splitter:
    def __init__(self):
        self.nxt, self.out = splitter_tables()
        self.cls = class_table()

    def starts(self, cps: np.ndarray, seps: np.ndarray) -> np.ndarray:
        """Sorted piece starts of a code point stream; ``seps`` marks separators
        (which are pieces of their own)."""
        n = len(cps)
        rows = -(-n // CHUNK)
        c = np.zeros(rows * CHUNK, np.uint16)
        c[:n] = self.cls[cps]
        c[:n][seps] = SEP
        grid = np.ascontiguousarray(c.reshape(rows, CHUNK).T)      # [position, chunk]
        maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, 1)  # [start state, chunk]
        for pos in range(CHUNK):
            maps = self.nxt[grid[pos] + maps]
        state = self._scan(maps)
        out = np.empty((CHUNK, rows), np.uint8)
        for pos in range(CHUNK):
            at = grid[pos] + state
            out[pos] = self.out[at]
            state = self.nxt[at]
        flat = out.T.reshape(-1)[:n]
        new = (flat & NEW) > 0
        back = np.flatnonzero(flat & SPLIT_LAST)
        new[back[back > 0] - 1] = True
        return np.flatnonzero(new)

    @staticmethod
    def _scan(maps: np.ndarray) -> np.ndarray:
        """Exclusive prefix composition of the chunk maps, applied to START."""
        acc = maps.copy()
        rows, step = acc.shape[1], 1
        while step < rows:
            acc[:, step:] = np.take_along_axis(acc[:, step:], acc[:, :-step].copy(), 0)
            step *= 2
        state = np.full(rows, START, np.uint8)
        state[1:] = acc[START, :-1]
        return state


class PieceTransducer:
    """Emitted-token counts of byte-level BPE pieces, by a lazily built machine."""

    def __init__(self, spec: dict):
        byte_of = _byte_symbols()
        spell = lambda tok: bytes(byte_of[ch] for ch in tok)
        # token ids in merge order: single bytes first, then one per merge
        self.ids = {bytes([b]): b for b in range(256)}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for m in spec["model"]["merges"]:
            left, right = map(spell, m if isinstance(m, list) else m.split(" "))
            i = self.ids.setdefault(left + right, len(self.parts))
            if i == len(self.parts):
                self.parts.append((self.ids[left], self.ids[right]))
            self.joined.setdefault((self.ids[left], self.ids[right]), i)
        # proper prefixes of multi-byte tokens: how far back a coming token can reach
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.info: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.root = self._state((b"", (-1,), (0,)))

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.info)
            self.info.append(key)
            self.moves.append({})
        return self.states[key]

    def _pair(self, a: int, b: int) -> bool:
        """Whether two tokens may stand side by side: undo their merges from the
        latest on, and see whether an earlier merge would have joined the parts
        that meet in the middle."""
        key, limit = (a, b), len(self.parts)
        if key in self.pairs:
            return self.pairs[key]
        ok = True
        while True:
            if self.joined.get((a, b), limit) < limit:
                ok = False
                break
            open_a, open_b = a > 255, b > 255
            if not open_a and not open_b:
                break
            if open_a and (a > b or not open_b):
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]
        self.pairs[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the token count. A state is (reachable bytes,
        last token of each prefix inside them, counts relative to the newest)."""
        tail, last, rel = self.info[state]
        tail = tail + bytes([byte])
        for start in range(len(tail)):
            tok = self.ids.get(tail[start:])
            if tok is not None and (last[start] < 0 or self._pair(last[start], tok)):
                break
        delta = rel[start] + 1
        # prefixes that a later token may still start from
        keep = next((k for k in range(len(tail)) if tail[k:] in self.prefixes), len(tail))
        return self._state((tail[keep:], (last + (tok,))[keep:],
                            tuple(r - delta for r in rel[keep:]) + (0,))), delta

    def trim(self, limit: int) -> None:
        """Forget the built states when there are more than ``limit`` (bounded memory)."""
        if len(self.info) > limit:
            self.states, self.info, self.moves = {}, [], []
            self.pairs = {}
            self.root = self._state((b"", (-1,), (0,)))

    def count(self, piece: bytes) -> int:
        state, n = self.root, 0
        for byte in piece:
            move = self.moves[state].get(byte)
            if move is None:
                move = self.moves[state][byte] = self._move(state, byte)
            state = move[0]
            n += move[1]
        return n


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of every byte in byte-level vocabularies (public rule:
    printable bytes stand for themselves, the others follow from code point 256)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class TokenCounter:
    """Token counts of whole texts; ``spec_text`` is the tokenizer file's JSON."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.splitter, self.pieces = Splitter(), PieceTransducer(spec)
        rng = np.random.default_rng(2024)
        self.mix = rng.integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
        self.inv = np.uint64(pow(int(self.mix[1]), -1, 1 << 64))
        self.memo: dict[int, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of every text."""
        total = np.zeros(len(texts), np.int64)
        part: list[str] = []
        owner: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            segs = [t]
            if self.split_special and any(s in t for s in self.special):
                segs = self.split_special.split(t)
                total[i] += len(segs) - 1
            for s in segs:
                if s:
                    part.append(s)
                    owner.append(i)
                    size += len(s)
            if size >= STREAM_CHARS:
                np.add.at(total, owner, self._stream(part))
                part, owner, size = [], [], 0
        if part:
            np.add.at(total, owner, self._stream(part))
        return total

    def _stream(self, texts: list[str]) -> np.ndarray:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\0".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lens + 1)[:-1] - 1          # separator positions
        starts = self.splitter.starts(cps, ends)
        stops = np.append(starts[1:], len(cps))
        # a 64-bit key per piece: position-weighted sums, shifted back to offset 0
        with np.errstate(over="ignore"):
            x = (cps.astype(np.uint64) + np.uint64(1)) * self.mix[0]
            x ^= x >> np.uint64(29)
            x *= self.mix[2]
            x ^= x >> np.uint64(32)
            keys = np.zeros(len(starts), np.uint64)
            length = stops - starts
            acc, weight = np.zeros(len(starts), np.uint64), np.uint64(1)
            live = np.arange(len(starts))
            for k in range(int(length.max(initial=0))):
                live = live[length[live] > k]
                if len(live) < 64:
                    break
                acc[live] += x[starts[live] + k] * weight
                weight *= self.mix[1]
            for i in live if len(live) < 64 else ():
                seg = x[starts[i]:stops[i]]
                acc[i] = (seg * _powers(self.mix[1], len(seg))).sum(dtype=np.uint64)
            keys = acc ^ (length.astype(np.uint64) * self.mix[2])
        uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
        got = np.empty(len(uniq), np.int64)
        memo = self.memo
        if len(memo) > MAX_MEMO:
            memo.clear()
        self.pieces.trim(MAX_MEMO)
        is_sep = np.zeros(len(cps) + 1, bool)
        is_sep[ends] = True
        for j, (k, f) in enumerate(zip(uniq.tolist(), first.tolist())):
            n = memo.get(k)
            if n is None:
                n = memo[k] = self.pieces.count(joined[starts[f]:stops[f]].encode("utf-8", "surrogatepass"))
            got[j] = n
        per = got[back]
        per[is_sep[starts]] = 0                       # a separator (stored as U+0000) emits nothing
        cum = np.concatenate([[0], np.cumsum(per)])
        begin = np.concatenate([[0], ends + 1])
        stop = np.append(ends, len(cps))
        return cum[np.searchsorted(starts, stop)] - cum[np.searchsorted(starts, begin)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        out = np.multiply.accumulate(out)
    return out


_COUNTERS: dict[int, TokenCounter] = {}


def _counter(spec_text: str) -> TokenCounter:
    key = hash(spec_text)
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(spec_text)
    return _COUNTERS[key]


def token_count(spec_path: str, col: Column) -> Column:
    """Number of tokens of a text column (null: 0). The file is read once on the
    driver and broadcast (a few MB, fixed), so executors need no copy of it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    prepare(spark)
    with open(spec_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(spec.value)
        for s in batches:
            yield pd.Series(counter.counts(s.fillna("").tolist()))

    return count(F.coalesce(col, F.lit("")))


def with_token_counts(docs: DataFrame, spec_path: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_bytes, n_tokens, over_limit (n_tokens > limit). Columns of
    these names in the input are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
                .withColumn("n_tokens", token_count(spec_path, F.col(text_col)))
                .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
