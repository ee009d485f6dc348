"""Registered queries against plain brute-force versions on sf0.01."""

import html
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op1_mixing(run, given):
    got, docs = run("op1_mixing"), given("documents")
    size = {d: len(WORD.findall(t or "")) for d, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got["size"])) == size
    by = defaultdict(int)
    for d, s in zip(docs.doc_id, docs.source):
        by[s] += size[d]
    # the stated rule, step by step
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(by.values()), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if rate * weight[s] > 2 * by[s]}
        if not above:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in above:
            target[s] = 2 * by[s]
            left -= target[s]
        open_ -= above
    for s, g in got.groupby("source"):
        assert (g.source_size == by[s]).all()
        assert np.allclose(g.target, target[s], rtol=1e-12)
        # at most half of one document away
        assert abs(g.taken.sum() - target[s]) <= g["size"].max() / 2 + 1
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()


def test_op2_vector_dedup(run, given):
    got, emb = run("op2_vector_dedup").set_index("vec_id"), given("embeddings")
    links = []
    for _, g in emb.groupby("label"):
        x = np.stack(g.embedding).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        ids = g.vec_id.to_numpy()
        links += list(zip(ids[i].tolist(), ids[j].tolist()))
    n = Counter(v for pair in links for v in pair)
    comp = components(emb.vec_id.tolist(), links)
    assert len(got) == len(emb)
    for v in emb.vec_id.tolist():
        assert (got.n_links[v], got.component_id[v], got.kept[v]) == (n[v], comp[v], comp[v] == v)


def test_op3_katz_against_a_plain_model(run, given):
    from glossa.llm.katz import discounted, discounts

    got, docs = run("op3_katz").set_index("doc_id"), given("documents")
    tokens = {d: [*WORD.findall(lower(t or "")), "\n"] for d, t in zip(docs.doc_id, docs.text)}
    train = [t for d, t in tokens.items() if crc(d, 7) != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter((h, w) for t in train for h, w in zip(["\r", *t], t))
    big = sum(uni.values())
    ctx = Counter()
    for (h, _), c in bi.items():
        ctx[h] += c
    coc = [[sum(c == r for c in t.values()) for r in range(1, 7)] for t in (uni, bi)]
    d1, d2 = discounts(coc[0]), discounts(coc[1])
    low = {w: float(discounted(np.array([c]), d1)[0]) / (big + 1) for w, c in uni.items()}
    unknown = 1 - sum(low.values())
    high = {p: float(discounted(np.array([c]), d2)[0]) / (ctx[p[0]] + 1) for p, c in bi.items()}
    used, room = Counter(), Counter()
    for (h, w), p in high.items():
        used[h] += p
        room[h] += low[w]
    alpha = {h: (1 - used[h]) / (1 - room[h]) for h in ctx}
    # exactly normalised
    some = next(iter(ctx))
    total = used[some] + alpha[some] * (sum(p for w, p in low.items() if (some, w) not in bi) + unknown)
    assert math.isclose(total, 1, rel_tol=1e-9)
    for d, t in tokens.items():
        base = sum(math.log10((uni[w] + 1) / (big + len(uni) + 1)) for w in t)
        score = sum(math.log10(high[h, w] if (h, w) in high else alpha.get(h, 1.0) * low.get(w, unknown))
                    for h, w in zip(["\r", *t], t))
        row = got.loc[d]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(w in uni for w in t), big)
        assert row.held_out == (crc(d, 7) == 2)
        assert math.isclose(row.base_score, base, rel_tol=1e-9) and math.isclose(row.score, score, rel_tol=1e-6)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_op4_toxicity(run, given):
    got = run("op4_toxicity")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(given("labels"), on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == held.doc_id.map(lambda d: crc(d, 5) == 0)).all()
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert held[held.toxic == 1].predicted.mean() > 0.5


def test_op5_shingle_join(run, given):
    got, docs = run("op5_shingle_join").set_index("doc_id"), given("documents")
    sets = {}
    for d, t in zip(docs.doc_id, docs.text):
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = Counter((a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1:])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(docs.doc_id.tolist(), links)
    assert links
    assert got.n_shingles.to_dict() == {d: len(s) for d, s in sets.items()}
    assert got.component_id.to_dict() == comp


def test_op6_token_counts(run, given):
    got, docs = run("op6_token_counts").set_index("doc_id"), given("documents")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t, e in zip(docs.doc_id, docs.text, tok.encode_batch([t or "" for t in docs.text], add_special_tokens=False)):
        row = got.loc[d]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((t or "").encode()), len(e.ids), len(e.ids) > 512)


def test_op7_vector_search(run, given):
    got, emb = run("op7_vector_search"), given("embeddings")
    x = np.stack(emb.embedding).astype(float)
    ids = emb.vec_id.to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, g in got.groupby("query_id"):
        cos = unit @ unit[ids == q][0]
        others = np.flatnonzero(ids != q)
        best = others[np.lexsort((ids[others], -np.round(cos[others], 12)))][:5]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(g.score, [cos[ids == v][0] for v in g.vec_id], atol=1e-12)
        hits += len(set(g.vec_id) & set(ids[best]))
        total += len(best)
    assert sorted(got.query_id.unique()) == sorted(i for i in ids if i % 50 == 0)
    assert hits >= 0.99 * total


def test_op8_html_text(run, given):
    got, pages = run("op8_html_text").set_index("page_id"), given("pages")
    for p, h in zip(pages.page_id, pages.html):
        inner = re.search("<article>(.*)</article>", h, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        text = "\n".join(b for b in blocks if b)
        assert (got.text[p], got.n_chars[p]) == (text, len(text))


def test_op9_packing(run, given):
    got, docs = run("op9_packing"), given("documents")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, e in zip(docs.doc_id, tok.encode_batch([t or "" for t in docs.text], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[d, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()}
    assert rows == want and len(got) == len(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    bound = -(-got.length.sum() // 2048)
    assert got.sequence_id.nunique() <= bound + 1


def test_op10_language_id(run, given):
    got = run("op10_language_id").merge(given("documents"), on="doc_id")
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda d: crc(d, 5) == 0)).all() and len(held) > 100
    assert (held.lang == held.lang_pred).mean() > 0.99
    assert set(got.lang_pred) <= {*got.lang, "und"}


def test_oracles_match_registered_names():
    from glossa.llm.oracle import ORACLE
    from glossa.llm.queries import QUERIES

    assert set(ORACLE) <= set(QUERIES)
    assert json.dumps(sorted(QUERIES))
