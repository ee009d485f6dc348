"""Each stage of the corpus pipeline against a plain version, on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from glossa.llm import language_id, toxicity
from glossa.llm.common import stage

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage as pandas frames."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    extra = spark.createDataFrame([(900001, None, "en", "src0", 0), (900002, "", None, None, 0), (900003, "12 34 !!", "en", "src1", 8),
                                   (900004, "one two three four five six seven", "en", None, 33),
                                   (900005, "ONE  two three four five six seven", "en", "src2", 34)], docs.schema)
    docs, out = stage(docs.union(extra), "test-docs"), []
    for name, step in cp.STAGES:
        done = stage(step(spark, docs, SF), f"test-{name}")
        out.append((docs.toPandas(), done.toPandas()))
        docs = done
    return out


def rows(df):
    return Counter(map(tuple, df[cp.COLUMNS].astype(object).where(df[cp.COLUMNS].notna(), None).itertuples(index=False)))


def test_stages_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    for _, out in steps[:-1]:
        assert list(out.columns) == cp.COLUMNS and len(out)


def test_language(steps):
    before, after = steps[0]
    keep = before[before.text.fillna("").str.contains(language_id.WORD.pattern.replace(r"\p{L}", r"[^\W\d_]"), regex=True)]
    assert rows(after) == rows(keep)


def test_toxicity(spark, steps):
    before, after = steps[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = [i for i in before.doc_id if zlib.crc32(str(i).encode()) % 5]
    lexicon = toxicity.fit(spark.createDataFrame(before[["doc_id", "text"]]), labels.where(labels.doc_id.isin(train)))
    keep = before[[lexicon.score(t) < 0.5 for t in before.text]]
    assert rows(after) == rows(keep) and len(after) < len(before)


def test_near_duplicates(steps):
    before, after = steps[2]
    sets = {}
    for d, t in zip(before.doc_id, before.text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for (a, b), n in Counter((a, b) for g in where.values() for i, a in enumerate(g) for b in g[i + 1:]).items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    keep = before[[find(d) == d for d in before.doc_id]]
    assert rows(after) == rows(keep) and len(after) < len(before)


def test_mixing(steps):
    before, after = steps[3]
    size = {d: len(WORD.findall(t)) for d, t in zip(before.doc_id, before.text)}
    whole, got = rows(before), rows(after)
    assert set(got) <= set(whole) and max(got.values()) <= 2
    by, taken = Counter(), Counter()
    for d, s in zip(before.doc_id, before.source):
        by[s] += size[d]
    for d, s in zip(after.doc_id, after.source):
        taken[s] += size[d]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(by.values()), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if rate * weight[s] > 2 * by[s]}
        target |= {s: 2 * by[s] if s in above else rate * weight[s] for s in (above or open_)}
        left -= sum(2 * by[s] for s in above)
        open_ = open_ - above if above else set()
    for s in names:
        largest = max(size[d] for d, x in zip(before.doc_id, before.source) if x == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1


def test_packing(steps):
    before, after = steps[4]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in zip(before.doc_id, before.text):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.update((d, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))
                    for k in range(0, len(ids), 2048))
    assert Counter(after[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in after.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert after.sequence_id.nunique() <= -(-after.length.sum() // 2048) + 1


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).limit(0)
    for name, step in cp.STAGES:
        docs = stage(step(spark, docs, SF), f"test-empty-{name}")
        assert docs.count() == 0


def test_near_duplicates_judges_every_row_by_its_own_text(spark):
    """A doc_id on several rows: a near copy goes, a text similar to nothing stays."""
    words = [f"w{i}" for i in range(80)]
    first, copy = " ".join(words), " ".join(["a0", *words[1:]])
    own, other = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    docs = [(3, first, "en", "s", 1), (7, copy, "en", "s", 2), (7, own, "en", "s", 3), (7, own, "en", "s", 3), (9, own, "en", None, 4),
            (9, own, None, "s", 4), (None, copy, "en", "s", 5), (None, other, "en", "s", 6), (None, other, "en", "s", 6)]
    given = stage(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "test-rows")
    got = cp.near_duplicates(spark, given, SF).collect()
    assert sorted(r.n_chars for r in got) == [1, 3, 6]
