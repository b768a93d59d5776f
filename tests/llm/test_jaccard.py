"""Near-duplicates at a Jaccard similarity of 0.8 against all pairs."""

import random

import corpus_pipeline as cp
from lumenrank.llm import jaccard as ja
from lumenrank.llm import simhash as sh


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for j, a in enumerate(ids):
        for b in ids[:j]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def texts_around_the_limit():
    """Edited copies from well above to well below 0.8, chains of edits, texts that share a long passage, short and empty ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    out = [None, "", " \t", "one", "One", "one two three four", "a b c d e", "A b c d e", "a b c d e f"]
    for n in (20, 60, 150, 700, 1100):
        for _ in range(4):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for edits in (1, 2, 3, n // 40, n // 30, n // 20):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(n)] = word()
                out.append(" ".join(w))
            chain = list(base)
            for _ in range(5):
                chain[rng.randrange(n)] = word()
                out.append(" ".join(chain))
            out += [passage + " " + " ".join(base[: n // 2]), " ".join(base[: n - n // 6])]
    rng.shuffle(out)
    return out + out[:5]


def test_components_are_those_of_all_pairs(spark, docs_of):
    texts = texts_around_the_limit()
    want = plain_components(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in ja.jaccard_components(docs_of(texts)).collect()}
    assert got == want
    assert len(set(want.values())) < len(texts) - 60


def test_order_of_shingles_loses_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ja, "SAMPLE", 20)
    texts = texts_around_the_limit()
    assert {r.doc_id: r.component_id for r in ja.jaccard_components(docs_of(texts)).collect()} == plain_components(dict(enumerate(texts)))


def test_exactly_the_limit():
    pick = lambda *r: ja.np.array(r, ja.np.uint64)
    assert list(ja.linked([pick(1, 2, 3, 4), pick(1, 2, 3, 4, 5)])) == [(0, 1)]
    assert list(ja.linked([pick(1, 2, 3), pick(1, 2, 3, 4)])) == []


def test_stage_drops_edited_copies(spark, docs_of):
    """Copies that keep 0.8 of their shingles and lie more than 3 bits apart."""
    texts = texts_around_the_limit()
    docs = docs_of(texts)
    kept = {r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    assert kept == {i for i, c in plain_components(dict(enumerate(texts))).items() if i == c}
    assert len(kept) < sh.keep_one(docs).count()


def test_keep_one_and_empty(spark, docs_of):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "other words stand here now"), (None, None), (7, "")]
    assert sorted(r.doc_id for r in sh.keep_one(docs_of(rows), components=ja.jaccard_components).collect()) == [3, 7, 9]
    assert ja.jaccard_components(docs_of([])).count() == 0
    assert sh.keep_one(docs_of([(None, "x y z"), (1, "q r s t")]), components=ja.jaccard_components).count() == 2


def test_components_cut_in_parts(spark, docs_of):
    """A component too large for one tile is compared part by part."""
    texts = texts_around_the_limit()
    assert {r.doc_id: r.component_id for r in ja.jaccard_components(docs_of(texts), part_bytes=2000).collect()} == plain_components(dict(enumerate(texts)))


def test_repeated_ids_lose_no_group(spark, docs_of):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (1, "a b c d e f")]
    for components in (ja.jaccard_components, sh.simhash_components):
        assert sorted((r.doc_id, r.text) for r in sh.keep_one(docs_of(rows), components=components).collect()) == [(1, "a b c d e f"), (1, "u v w x y z")]


def test_sketches_bound_the_difference():
    """Never more bits than members that differ, whatever the lengths; unlike sets are far apart, large ones too."""
    rng = ja.np.random.default_rng(1)
    sets = [ja.np.unique(rng.integers(0, 1 << 63, n, dtype=ja.np.uint64)) for n in (0, 1, 900, 1000, 1100, 2100, 5000, 30000)]
    sets += [ja.np.union1d(x[::2], x[:20]) for x in sets]
    k = ja._Sketches([ja._sketch(s) for s in sets])
    for i, a in enumerate(sets):
        for j, d in enumerate(k.apart(i, ja.np.arange(len(sets)))):
            assert d <= len(ja.np.setxor1d(a, sets[j]))
    assert k.apart(6, ja.np.array([7]))[0] * 9 > (len(sets[6]) + len(sets[7]))


def plain_simhash(s):
    h = [ja.xxh64_intdigest(b" ".join(g), 42) for g in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_stage_links_by_simhash_balls(spark, docs_of, monkeypatch):
    """Without the prefix filter the stage still unites every pair within 8 bits of 5-word SimHash, and no pair below 0.8."""
    texts = texts_around_the_limit()
    sets = [plain_set(t) for t in texts]
    sims = [plain_simhash(s) for s in sets]
    want = plain_components(dict(enumerate(texts)))
    monkeypatch.setattr(ja, "_met", lambda batches: iter(()))
    got = {r.doc_id: (r.fp, r.component_id) for r in ja.jaccard_components(docs_of(texts)).collect()}
    near = [(i, j) for i, x in enumerate(sets) for j in range(i) if (y := sets[j]) != x and 5 * len(x & y) >= 4 * len(x | y) and (sims[i] ^ sims[j]).bit_count() <= 8]
    assert len(near) > 60
    assert all(got[i][1] == got[j][1] for i, j in near)
    assert all(want[i] == want[c] for i, (_, c) in got.items())
    kept = {r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, docs_of(texts), "").collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_wide_links_lose_no_pair(spark):
    """All distances from 0 on around few centres, one dense ball and runs of both lengths: components as of all pairs."""
    rng = random.Random(4)
    fps = set()
    for _ in range(4):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (*range(1, 14), 8, 9) * 4}
        fps |= {c ^ (255 << s) for s in (0, 14, 18, 20, 40, 56)}
        fps |= {c ^ (7 << 0 | 7 << 22 | 3 << 43), c ^ (3 << 20 | 7 << 41 | 7 << 61)}
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    links = sh.wide_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    root = {v: v for v in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    comp = {r.node: r.component for r in sh.connected_components(links).collect()}
    mask = 2**64 - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 8 for r in links.collect())
    groups, wanted = {}, {}
    for v, s in zip(fps, signed, strict=True):
        groups.setdefault(comp.get(s, s), set()).add(v)
        wanted.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert 4 < len(wanted) < len(fps)
