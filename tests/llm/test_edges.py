"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossa.llm import (html_text, katz, language_id, mixing, packing, shingle_join, token_counts, toxicity,
                        vector_dedup, vector_search)
from glossa.llm.common import connected_components

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, score double, size string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Every awkward case at once; ``score`` and ``size`` clash with result columns."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, base, "en", "a", 9.0, "x"), (2, base, "en", "a", 9.0, "x"), (2, base, "en", "a", 9.0, "x"),
            (3, None, "en", None, None, None), (4, "", None, "b", 1.0, "y"), (5, " \n\t ", "en", "b", 1.0, "y"),
            (6, "three small words", "en", "b", 1.0, "y"), (7, "THREE small  words", "en", None, 1.0, "y"),
            (8, LONG, "en", "c", 1.0, "y"), (9, LONG + " tail", "en", "c", 1.0, "y"),
            (None, "no id at all here we go", "en", "c", 1.0, "y"), (10, "12345 67 !!", "en", "c", 1.0, "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and not mixing.mix(empty).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for g in by.values():
        assert sum(r["size"] for r in g) == g[0].source_size
        assert abs(sum(r.taken for r in g) - g[0].target) <= max(r["size"] for r in g) / 2 + 1


def test_mixing_expectation_over_many_buckets(spark):
    """A hot source in many buckets and levels stays near its target."""
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 37).cast("int")), " ").alias("text"))
    got = mixing.mix(d, bucket=8).toPandas()
    assert len(got) == 5000
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iat[0]) <= 37
        assert (g.copies <= 2).all()


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights a 3, b 1, c 2, null 3; total 2265: a and c stop at 20 and 0, null at 1000, b takes the rest
    assert got == {"a": 20.0, "c": 0.0, None: 1000.0, "b": 1245.0}


def test_shingle_join(docs, empty):
    got = rows(shingle_join.join(docs), "doc_id", "n_shingles", "component_id")
    assert got == rows_sorted([(1, 12, 1), (2, 12, 1), (2, 12, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6),
                               (7, 1, 6), (8, 977, 8), (9, 978, 8), (None, 3, None), (10, 1, 10)])
    assert not shingle_join.join(empty).collect()


def rows_sorted(x):
    return sorted(x, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_shingle_join_chains_and_hot_passages(spark):
    """Near copies, chains and a passage that every document shares, against brute force."""
    rng = np.random.default_rng(5)
    texts = []
    passage = [f"p{i}" for i in range(40)]
    for family in range(12):
        words = [f"f{family}x{i}" for i in range(int(rng.integers(20, 220)))]
        for _ in range(8):
            words = list(words)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(words[:len(words) // 2] + passage * (family % 2) + words[len(words) // 2:]))
    texts += [f"t{i} " + " ".join(passage) for i in range(60)]
    texts += [" ".join(f"s{i}q{j}" for j in range(3)) + " " + " ".join(passage[:8]) for i in range(30)]
    order = rng.permutation(len(texts))
    d = spark.createDataFrame([(int(k), t) for k, t in zip(order, texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.join(d).collect()}
    sets = {int(k): {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for k, w in zip(order, map(str.split, texts))}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert links > 100
    assert got == {k: find(k) for k in sets}


def test_signatures_of_similar_sets_meet():
    """Any two similar sets share a signature, whatever shingles count as rare."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 60)) if rng.random() < 0.7 else int(rng.integers(60, 600))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            hot = rng.random() < 0.5
            rare = lambda s: (s % np.uint64(3) == 0) if hot else np.ones(len(s), bool)
            assert len(np.intersect1d(shingle_join.signatures(a, rare(a)), shingle_join.signatures(b, rare(b))))


def rows_made(plan, of):
    """Rows out of the nodes of an executed plan whose description contains ``of``."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return rows_made(plan.executedPlan(), of)
    if name.endswith("QueryStage"):
        return rows_made(plan.plan(), of)
    metric = plan.metrics().get("numOutputRows")
    own = metric.get().value() if "Join" in name and of in plan.simpleString(200) and metric.isDefined() else 0
    return own + sum(rows_made(plan.children().apply(i), of) for i in range(plan.children().size()))


def test_shingle_join_across_components(spark, monkeypatch):
    """All pairs across components under many shared signatures, in small tiles; a set
    meets its sketch once, however many signatures, buckets and tiles it has."""
    monkeypatch.setattr(shingle_join, "TILE", 16)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.08], rng.integers(0, 1 << 63, int(rng.integers(2, 9))).astype(np.uint64)]))
            for _ in range(200)]
    comp = [0] * 150 + list(range(150, 180)) + [7] * 20          # one large component, single sets, a small one
    info = spark.createDataFrame([(i, len(x), shingle_join.sketch(x)) for i, x in enumerate(sets)], "cls long, n long, cells binary")
    under = {(s, i) for s in range(12) for i in range(200) if (i + s) % 11}
    placed = spark.createDataFrame([(s, i, comp[i]) for s, i in under], "sig long, cls long, comp long")
    found = shingle_join._across(placed, info, 5, False)
    got = {tuple(r) for r in found.collect()}
    h, every = shingle_join.sketches([shingle_join.sketch(x) for x in sets]), np.arange(200)
    size = np.array([len(x) for x in sets])
    low = shingle_join.differing(h, np.repeat(every, 200), h, np.tile(every, 200)).reshape(200, 200)
    near = (low <= (size[:, None] + size) // 7) & (4 * np.minimum(size[:, None], size) >= 3 * np.maximum(size[:, None], size))
    # of signatures with the same members (0 and 11) only the smaller stays
    want = {(s, a, b) for s in range(11) for a in range(200) for b in range(a + 1, 200)
            if comp[a] != comp[b] and near[a, b] and (s, a) in under and (s, b) in under}
    assert 1000 < len(want) < 11 * 200 * 199 // 2 and got == want
    assert rows_made(found._jdf.queryExecution().executedPlan(), "[cls#") <= 200


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 4000), (4000, 4500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}, 4000: 4000, 4500: 4000, 5000: 4000}
    assert not connected_components(spark.createDataFrame([], "a long, b long")).collect()


VECTORS = "vec_id long, embedding array<float>, label int, score double, n_links string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    near = [(i, (base + 0.02 * rng.standard_normal(16)).tolist(), 1, 0.0, "") for i in range(10, 20)]
    odd = [(1, None, 1, 0.0, ""), (2, [0.0] * 16, 1, 0.0, ""), (3, [1.0] * 15 + [None], 1, 0.0, ""),
           (4, [1.0] * 15 + [math.nan], 1, 0.0, ""), (5, [1.0] * 15 + [math.inf], 1, 0.0, ""), (6, [], 1, 0.0, ""),
           (7, base.tolist(), None, 0.0, ""), (8, base.tolist(), 2, 0.0, ""), (20, base[:8].tolist(), 1, 0.0, "")]
    copies = [(30, base.tolist(), 1, 0.0, ""), (30, base.tolist(), 1, 0.0, ""), (31, base.tolist(), 1, 0.0, ""),
              (32, (3 * base).tolist(), 1, 0.0, ""), (0, (-base).tolist(), 1, 0.0, ""), (50, base.tolist(), 3, 0.0, "")]
    return spark.createDataFrame(near + odd + copies, VECTORS)


def test_vector_dedup(vectors, spark):
    got = rows(vector_dedup.near_duplicates(vectors), "vec_id", "n_links", "component_id", "kept")
    alone = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 50)]
    group = [(i, 13, 10, i == 10) for i in [*range(10, 20), 30, 30, 31, 32]]
    assert got == rows_sorted(alone + group)
    assert not vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).collect()


@pytest.mark.parametrize("block", [8, 40])
def test_vector_dedup_over_cuts_and_tiles(spark, block):
    """Clusters, exact copies and a dense cluster larger than a block, against brute force."""
    rng = np.random.default_rng(3)
    x = []
    for _ in range(60):
        c = rng.standard_normal(32)
        x += [(c + s * rng.standard_normal(32)).astype(np.float32) for s in (0.0, 0.05, 0.1, 0.15, 0.2)]
    c = rng.standard_normal(32)
    x += [(c + 0.12 * rng.standard_normal(32)).astype(np.float32) for _ in range(120)]
    x += [x[0]] * 30
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(d, block=block).collect()}
    m = np.stack(x).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.98 + 1e-15
    np.fill_diagonal(linked, False)
    comp = np.arange(len(m))
    for _ in range(len(m)):
        low = np.array([min(comp[i], comp[linked[i]].min(initial=comp[i])) for i in range(len(m))])
        if (low == comp).all():
            break
        comp = low
    assert linked.sum() > 3000
    assert got == {i: (int(linked[i].sum()), int(comp[i])) for i in range(len(m))}


def test_count_needed_keeps_recall():
    need = vector_dedup.count_needed()
    p = math.erf(vector_dedup.WINDOW / math.sqrt(2))
    n = vector_dedup.LINES
    assert sum(math.comb(n, c) * p**c * (1 - p)**(n - c) for c in range(need)) <= vector_dedup.MISS


def test_vector_search(vectors, spark):
    got = rows(vector_search.search(vectors, every=10, k=3), "query_id", "rank", "vec_id")
    ids = {q for q, _, _ in got}
    assert ids == {0, 10, 20, 30, 50} - {20}            # 20 has no candidate of its length
    assert [v for q, _, v in got if q == 30] == [7, 8, 31]   # copies tie at cosine 1, smaller id first
    assert [v for q, _, v in got if q == 50] == [7, 8, 30]
    assert not vector_search.search(spark.createDataFrame([], VECTORS)).collect()


def test_katz(docs, empty):
    got = katz.score(docs.withColumn("train", F.col("doc_id") % 2 == 0)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[9].n_tokens == 30_002
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert not katz.score(empty.withColumn("train", F.lit(True))).collect()
    none = katz.score(docs.withColumn("train", F.lit(False))).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none)


def test_katz_discounts():
    d = katz.discounts([1000, 400, 200, 120, 80, 55])
    assert (0 < d[1:]).all() and (d[1:] < 1).all()
    odd = katz.discounts([0, 0, 5, 0, 0, 0])
    assert np.allclose(odd[1:], [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9])


def test_token_counts(docs, empty):
    got = {r.doc_id: r for r in token_counts.with_token_counts(docs, BYTE_BPE).collect()}
    assert (got[3].n_bytes, got[3].n_tokens) == (0, 0) and got[8].over_limit and not got[6].over_limit
    assert got[6].score == 1.0 and got[6].n_tokens == 3
    assert not token_counts.with_token_counts(empty, BYTE_BPE).collect()


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    own = token_counts.TokenCounter(open(BYTE_BPE, encoding="utf-8").read())
    rng = np.random.default_rng(4)
    bits = ["a", "'", "'s", "'re", "'ll", "'l", "'v", " ", "  ", "\n", "\t", " \n", "1", "23", "é", "ß", "!", "...",
            "they'll", " ", "　", "中", "😀", "\0", "<|endoftext|>", "'S", "ve", "_", "ﬁ", "́", "٣", "Ω"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 999, "\n" * 500 + "x", "'" * 300 + "s", "ab" * 3000]
    assert own.counts(texts).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, empty):
    got = packing.pack(docs, WORD_BPE, with_ids=True).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY
    assert got[got.doc_id == 3].length.tolist() == [1] and len(got[got.doc_id == 2]) == 2
    eight = got[got.doc_id == 8].sort_values("piece")
    assert eight.start.tolist() == [2048 * i for i in range(len(eight))] and eight.ids.iloc[-1][-1] == 0
    assert not packing.pack(empty, WORD_BPE).collect()


def test_packing_text_ids_equal_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_BPE)
    own = packing.TextIds(open(WORD_BPE, encoding="utf-8").read())
    rng = np.random.default_rng(6)
    bits = ["a", "Don't", " ", "  ", "\n", "\x1c", "1", "23", "É", "ß", "!", " ", "中", "😀", "\0", "<|endoftext|>",
            "<|startoftext|>", "'S", "ΟΔΟΣ", "é", "́", "ﬁ", "İ", " ", "\x85"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(3000)] + ["", "a" * 3000]
    ids, stops = own(texts)
    starts = [0, *stops[:-1]]
    for t, a, b, e in zip(texts, starts, stops, lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == [*e.ids, 0], t


def test_evolution_gains_over_best_fit():
    """Whole bins of one parent and best fit for the rest find what best fit alone does not."""
    rng = np.random.default_rng(7)
    gained = fewer = 0
    for seed in range(6):
        sizes = rng.integers(300, 1400, 150).tolist()
        first = packing.best_fit(sizes, sorted(range(150), key=lambda i: -sizes[i]), 2048)
        log = {}
        best = packing.evolve(sizes, 2048, seed, generations=60, log=log)[0]
        assert sorted(i for b in best for i in b) == list(range(150))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in best)
        assert packing.fitness(best, sizes) <= packing.fitness(first, sizes) and log["crossovers"] == 60
        gained += packing.fitness(best, sizes) < packing.fitness(first, sizes) and log["led"] > 0
        fewer += len(best) < len(first)
    assert gained >= 3 and fewer >= 1


def test_evolution_runs_on_the_documents(spark):
    """Crossovers happen in every shard, and some children lead their population."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = packing.pieces(docs, WORD_BPE).where("length < 2048").select(
        F.lit(0).cast("long").alias("shard"), F.explode(F.array(F.lit(0), F.lit(1))).alias("island"), F.lit(-1).alias("origin"),
        "uid", "length", F.lit(0).cast("long").alias("bin"))
    got = packing._epoch(cut, 2048, 0).groupBy("island").agg(F.max("crossovers").alias("x"), F.max("entered").alias("e"),
                                                             F.max("rank").alias("r")).collect()
    assert all(r.x == packing.GENERATIONS and r.e > 0 and r.r == packing.POPULATION - 1 for r in got) and len(got) == 2


def test_a_perfect_packing_ends_the_evolution():
    log = {}
    packing.evolve([1024] * 8, 2048, 0, log=log)
    assert log["crossovers"] == 0


def test_packing_of_unfillable_pieces(spark):
    items = spark.range(9000).select(F.col("id").alias("uid"), F.lit(1100).cast("long").alias("length"))
    got = packing.group_pieces(items)
    assert got.select("sequence_id").distinct().count() == got.count() == 9000


def test_packing_leaves_no_half_filled_sequence_per_shard(spark, monkeypatch):
    """Pieces so long that no bin is 97 % full: the shards' emptiest bins are still combined."""
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    items = spark.range(1000).select(F.col("id").alias("uid"), F.lit(700).cast("long").alias("length"))
    got = packing.group_pieces(items).collect()
    assert sorted(r.uid for r in got) == list(range(1000)) and len({r.sequence_id for r in got}) == 500
    assert len({(r.sequence_id, r.offset) for r in got}) == 1000 and {r.offset for r in got} == {0, 700}


def test_packing_of_pieces_that_do_not_half_fill_a_shards_bin(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    items = spark.range(400).select(F.col("id").alias("uid"), F.lit(1).cast("long").alias("length"))
    got = packing.group_pieces(items, 1000).collect()
    assert sorted(r.offset for r in got) == list(range(400)) and len({r.sequence_id for r in got}) == 1


def test_html_text_sections_wrapped_on_their_own():
    """Without article or main: every section of one depth stays, each with its heading."""
    def section(i, paras):
        return (f"<div class=sec><h2>Head {i}</h2><div class=inner>"
                + "".join(f"<p>Part {i}.{k}, with commas, and some words to count.</p>" for k in range(paras)) + "</div></div>")
    def lines(i, paras):
        return [f"Head {i}", *[f"Part {i}.{k}, with commas, and some words to count." for k in range(paras)]]
    links = "<div><div class=x><a href=a>one link, two</a> <a href=b>three, four</a></div></div>"
    for paras in ([3], [4, 2], [5, 3, 1], [2, 6, 2, 3]):
        body = "".join(section(i, n) for i, n in enumerate(paras))
        page = f"<body><div class=menu><p>menu, text, here</p></div><div>{body}</div>{links}<div class=footer>foot, text</div></body>"
        kept = [i for i, n in enumerate(paras) if 5 * n >= max(paras)]
        assert html_text.extract(page).split("\n") == [x for i in kept for x in lines(i, paras[i])]


def test_html_text_inline_parts():
    for piece, kept in [('<span style="display:none">secret</span>', ""), ('<span class="ad">BUY <span>now</span> it</span>', ""),
                        ('<svg class="i"/>', ""), ('<svg><text>x</text></svg>', ""), ("<b hidden>no</b>", ""),
                        ('<b class="share-price">12 up</b>', "12 up "), ('<a class="ads" href=q>shop</a>', "")]:
        page = f"<article><p>First, one {piece} and more.</p><p>Second, two.</p></article>"
        assert html_text.extract(page).replace("\n", " ") == f"First, one {kept}and more. Second, two.", piece
    # not closed: it ends with its paragraph
    assert html_text.extract("<article><p>One <i hidden>no<p>Two, three</article>") == "One\nTwo, three"


def test_html_text(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>home</a></header>
    <div id=main-menu><ul><li><a>x</a></ul></div><div class="cookie-notice">We use cookies, ok, yes.</div>
    <div class="content"><h1>Title &amp; more</h1><div class="body"><p>First para, with commas, long text, and there.
    <p>Second is <a href=q>linked</a> here, ok.<ul><li>one, two<li>three</ul><p>Third&nbsp;one.<br>after</div></div>
    <div id="comments"><p>I like it, very much, indeed, a lot, so long, yes.</p></div><aside><p>Side, side</p></aside>
    <form><p>name, x</p></form><footer>c</footer><script>var a = "<p>no, no</p>";</script>"""
    assert html_text.extract(page) == ("Title & more\nFirst para, with commas, long text, and there.\n"
                                       "Second is linked here, ok.\none, two\nthree\nThird one. after")
    long = "<article>" + "".join(f"<p>para {i}, {'x' * 50}</p>" for i in range(5000)) + "</article>"
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p>a<p>b</b>&lt;"),
                               (5, "u", long), (6, "u", "<nav>only menu</nav>")], "page_id int, url string, html string")
    got = rows(html_text.with_main_text(d.withColumn("text", F.lit("clash"))), "page_id", "n_chars")
    assert got == rows_sorted([*[(1, len(html_text.extract(page)))] * 2, (2, 0), (3, 0), (4, 4), (6, 0), (5, len(html_text.extract(long)))])
    assert html_text.extract(long).count("\n") == 4999
    assert html_text.extract("<div>" * 5000 + "deep, text") == "deep, text"


def test_language_id(docs, empty, spark):
    model = language_id.fit(spark.createDataFrame(
        [(i, "the cat and the dog of the house" if i % 2 else "der hund und die katze von dem haus",
          "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language_id.with_language(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[10].lang_pred == "und" and got[3].score == 0.0
    assert got[1].lang_pred == "en" and 0.5 <= got[1].score <= 1
    one = language_id.Predictor(model)
    # the model against dictionaries: words, then the longest known n-grams
    text = {"en": "the cat and the dog of the house", "de": "der hund und die katze von dem haus"}
    tables = {}
    for k in (0, 4, 3, 2, 1):
        tables[k] = c = {lang: {} for lang in ("de", "en")}
        for lang, t in text.items():
            for w in t.split():
                for item in [w] if not k else [f" {w} "[i:i + k] for i in range(max(1, len(w) + 3 - k))]:
                    if len(item) == k or not k:
                        c[lang][item] = c[lang].get(item, 0) + 20
    def logs(k, item):
        known = set(tables[k]["de"]) | set(tables[k]["en"])
        return [math.log((tables[k][x].get(item, 0) + 0.1) / (sum(tables[k][x].values()) + 0.1 * len(known)))
                for x in ("de", "en")] if item in known else None
    def plain(w):
        if logs(0, w):
            return logs(0, w)
        for k in (4, 3, 2, 1):
            got = [v for v in (logs(k, f" {w} "[i:i + k]) for i in range(len(w) + 3 - k)) if v]
            if got:
                return np.mean(got, 0)
        return [0.0, 0.0]
    assert model.langs == ["de", "en"]
    for w in ["the", "katze", "katzen", "doghouse", "xyzzy", "und", "a", "zq", "ø"]:
        assert np.allclose(model.word(w), plain(w)), w
    assert one("katzenhaus")[0] == "de" and one("doghouse")[0] == "en"      # unseen words by their n-grams
    assert not language_id.with_language(empty, model).collect()
    nothing = language_id.fit(empty.where("false"))
    assert {r.lang_pred for r in language_id.with_language(docs, nothing).collect()} == {"und"}


def test_toxicity(docs, empty, spark):
    # toxic texts with two hits and with one: a sample of two only would put one hit on the boundary
    bad = ["stupid idiot", "stupid person", "kind idiot"]
    train = spark.createDataFrame([(i, f"you {bad[i // 4 % 3] if i % 4 == 0 else 'kind person'} number {i}", int(i % 4 == 0))
                                   for i in range(200)], "doc_id long, text string, toxic int")
    lex = toxicity.fit(train.drop("toxic"), train.drop("text"))
    assert lex.score("what an idiot") > 0.5 > lex.score("what a person")
    assert lex.score("what an 1d10t") > 0.5 and lex.score("what an іdіоt") > 0.5      # digits, look-alike letters
    safe = toxicity.Lexicon(lex.weights, {" idiot proof "}, lex.curve)
    assert safe.score("this is idiot proof") < 0.5 < safe.score("this idiot is proof")
    got = {r.doc_id: r for r in toxicity.with_toxicity(docs, lex).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[3].predicted == got[4].predicted == 0
    assert not toxicity.with_toxicity(empty, lex).collect()
    # the automaton against a scan for every entry
    for t in ["what an 1d10t", "you stupid idiot", "idiot proof idiot", "stupidity and idiots", "kind", "", "proof " * 40 + "stupid"]:
        folded, best = toxicity.fold(t), {}
        for entry, weight in safe.weights.items():
            for at in range(len(folded)):
                if folded.startswith(entry, at):
                    best[at] = max(best.get(at, 0.0), weight)
        for entry in safe.exceptions:
            for at in range(len(folded)):
                if folded.startswith(entry, at):
                    best = {k: w for k, w in best.items() if not at <= k < at + len(entry) - 1}
        total = sum(best.values())
        assert safe.features(t) == pytest.approx((total, total / math.sqrt(max(1, len(folded.split())))))
    assert toxicity.fit(train.drop("toxic"), train.drop("text").where("toxic = 0")).score("idiot") < 0.01


def test_fold():
    assert toxicity.fold("The&&& 1d10T $tupid, 2024 ab$$$") == " the idiot stupid ab "


def test_common_shingles_are_a_bit_map_of_fixed_size(spark):
    """As long as the map, however many shingles are common; every one of them is marked."""
    import numpy as np

    shared = " ".join(f"s{i}" for i in range(3000))
    few = [f"{shared} own{i}" for i in range(60)]
    own = " ".join(f"o{i}" for i in range(3000))
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*few, own])], "doc_id long, text string")
    one, none = shingle_join.common_shingles(d), shingle_join.common_shingles(d.where("doc_id > 58"))
    assert one.nbytes == none.nbytes == shingle_join.HOT_BITS // 8 and not none.any()
    common, alone = shingle_join.Shingler().sets([shared, own])
    assert shingle_join.is_common(common, one).all() and shingle_join.is_common(alone, one).mean() < 0.01
    assert np.unpackbits(one).sum() <= len(common)
