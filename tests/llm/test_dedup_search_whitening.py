"""Exact dedup, lexical search and whitening against plain versions, on awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from glossa.llm import exact_dedup, lexical_search, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# exact dedup ---------------------------------------------------------------------------------

def deduplicated(rows):
    """(id, keep, size, hash) per row, and the number of rows that stay per text."""
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = by[t or ""]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return out, by


@pytest.mark.parametrize("digest_bytes", [32, 1])      # with one byte most digests stand for several texts
def test_exact_dedup(spark, digest_bytes):
    rows = [(i, f"text {i % 300}") for i in range(900)] + [(1000 + i, "hot " * 50) for i in range(400)]
    rows += [(1, "Text 1"), (2, "text 2 "), (3, None), (4, ""), (3, None), (5, "x" * 200_000), (6, "x" * 200_000),
             (None, "text 7"), (None, "nobody"), (None, "nobody"), (50, "é"), (51, "é"), (899, "text 299"), (899, "text 299")]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n long, digest string")
    got = exact_dedup.deduplicate(docs.repartition(7), digest_bytes=digest_bytes).collect()
    want, by = deduplicated(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    stays = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in stays)
    assert Counter(r.text_sha256 for r in stays) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in by)


def test_exact_dedup_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert not exact_dedup.deduplicate(empty).collect()


def test_exact_dedup_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_dedup.deduplicate(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# lexical search ------------------------------------------------------------------------------

def ranked(docs, items, k=20):
    terms = [TERM.findall(lower(t or "")) for _, t in docs]
    n_docs, words = sum(map(bool, terms)), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = TERM.findall(lower(text or ""))
        scored = []
        for (doc, _), ts, c in zip(docs, terms, counts):
            s = 0
            for w in asked:
                if c[w]:
                    m = 100 - 25 + (25 * len(ts) * n_docs) // words
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (
                        (1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m))
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_lexical_search(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)] + ["Über", "naïve", "e-mail", "日本"]
    def text(n):
        return " ".join(vocabulary[min(len(vocabulary) - 1, int(x))] for x in rng.zipf(1.3, n))
    docs = [(i, text(int(rng.integers(1, 120)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]                     # copies: ties by doc_id
    docs += [(5, docs[5][1]), (5, docs[6][1]), (900, None), (901, ""), (902, "!! ??"), (None, docs[9][1]), (903, "w1 " * 400)]
    docs += [(904, " ".join(f"t{i}" for i in range(70_000)))]               # more terms than cells
    items = [(i, docs[i * 3][1]) for i in range(25)] + [(30, None), (31, ""), (32, "t5 t7 t9 t5"), (33, "nowhereatall"),
                                                       (34, "W1 w1, W2"), (34, "W1 w1, W2"), (35, docs[7][1])]
    frame = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], "doc_id long, text string, rank long, score double")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in lexical_search.search(frame.repartition(5), asked).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(ranked(docs, items), key=key)


def test_lexical_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 3)
    docs = [(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(90)]
    items = [(i, f"a{i} b{i} zz") for i in range(8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical_search.build(frame)
    got = lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), index, k=4)
    assert sorted(map(tuple, got.collect())) == sorted(ranked(docs, items, 4))


def test_lexical_search_on_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert not lexical_search.search(none, items).collect()
    assert not lexical_search.search(docs, items.where("false")).collect()


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(50)]
    cells = rng.integers(0, 12, 50)             # many terms per cell
    for _ in range(50):
        tf = rng.integers(0, 4, 50) * rng.integers(0, 200, 50)
        weights = rng.integers(0, 9000, (50, 3)).astype(float)
        used, at = np.unique(cells, return_inverse=True)
        by_cell, place = np.zeros((len(used), 3)), np.full(lexical_search.CELLS, -1)
        np.add.at(by_cell, at, weights)
        place[used] = np.arange(len(used))
        block = lexical_search.Block([0, 1, 2], words, weights, place, by_cell)
        most = np.zeros(12, int)
        np.maximum.at(most, cells, tf)
        held = np.flatnonzero(most)
        m = np.array([lexical_search.length_factor(int(tf.sum()), 100, 5000)])
        bound = block.bounds([held.astype(np.uint16).tobytes()], [np.minimum(most[held], 255).astype(np.uint8).tobytes()], m)
        exact = lexical_search.impact(tf, m).astype(float) @ weights
        assert (bound[0] >= exact).all()


# whitening -----------------------------------------------------------------------------------

def plain(vectors):
    """n, S, deviations, axes by falling eigenvalue, explained; for vectors of one length."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = (np.array(fit, object) * n - np.array(total, object)).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, total)) for v in x]
    z = (np.array(x, object) * n - np.array(total, object)).astype(float) / n @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
    return n, deviation, z, values[::-1] / values.sum()


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e8])      # beyond 64 bits in the scatter
def test_whitening(spark, scale):
    rng = np.random.default_rng(5)
    v = [(rng.standard_normal(6) * [9, 5, 3, 2, 1, 1] * scale).tolist() for _ in range(300)]
    v += [v[0]] * 150 + [(rng.standard_normal(3) * [4, 2, 1]).tolist() for _ in range(40)]
    odd = [None, [], [1.0, None, 2.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    rows = [(i, x, 1, 2.0) for i, x in enumerate(v)] + [(9000 + i, x, 1, 2.0) for i, x in enumerate(odd)] + [(None, v[1], 1, 2.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened double")
    got = whitening.whiten(frame.repartition(6)).toPandas()
    ids = [r[0] for r in rows if r[0] is not None and r[0] < 9000]
    assert sorted(got.vec_id.dropna().unique()) == ids and got.vec_id.isna().sum() == 4
    assert (got.identity_error <= 1e-9).all()
    for part in ([i for i in ids if len(v[i]) == 6], [i for i in ids if len(v[i]) == 3]):
        n, deviation, z, explained = plain([v[i] for i in part])
        mine = got[got.vec_id.isin(part)]
        assert (mine.n == n).all() and sorted(mine.component.unique()) == list(range(1, min(4, z.shape[1]) + 1))
        dev = mine.drop_duplicates("vec_id").set_index("vec_id").deviation
        for i, d in zip(part, deviation):
            assert dev[i] == d if d < 1 << 63 else np.isnan(dev[i])
        for c, g in mine.groupby("component"):
            w = g.set_index("vec_id").whitened.loc[part].to_numpy()
            assert min(np.abs(w - z[:, c - 1]).max(), np.abs(w + z[:, c - 1]).max()) < 1e-9
            assert np.allclose(g.explained, explained[c - 1], rtol=1e-9)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert not whitening.whiten(one).collect()
    flat = spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1)
    assert not whitening.whiten(one.where("false")).collect()


def test_popcounts_give_the_exact_cross_products():
    rng = np.random.default_rng(1)
    for top, rows in ((1, 70), (1 << 9, 1000), (1 << 44, 129)):
        y = rng.integers(0, top + 1, (rows, 5))
        y[:, 2] = 0
        bits = np.array([int(t).bit_length() for t in y.max(0)])
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(5)] for i in range(5)]
        assert whitening.cross_products(y, bits).tolist() == want


def test_registered_whitening(run, given):
    got, emb = run("op13_whitening"), given("embeddings")
    n, deviation, z, explained = plain(emb.embedding.tolist())
    assert (got.n == n).all() and len(got) == 4 * len(emb)
    for c, g in got.groupby("component"):
        w = g.set_index("vec_id").loc[emb.vec_id]
        assert w.deviation.tolist() == deviation and np.allclose(w.explained, explained[c - 1], rtol=1e-9)
        assert min(np.abs(w.whitened - z[:, c - 1]).max(), np.abs(w.whitened + z[:, c - 1]).max()) < 1e-9
