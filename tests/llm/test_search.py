import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from wavespan.llm import ann, components, lm_score, neardup
from wavespan.llm.tokens import default_path, encoder


def nearest_by_hand(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        found = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i)
                       for i, w in vectors.items() if i != q and len(w) == len(v))
        out[q] = found[:k]
    return out


def test_block_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=12).round(3).tolist() for i in range(400)}
    vectors |= {i: vectors[7] for i in range(400, 470)}  # one common vector
    vectors |= {i: [float(x) for x in rng.integers(0, 2, 12)] for i in range(470, 600)}  # ties
    vectors |= {600: [1e-3] * 12, 601: [1e6] * 12, 602: [1.0, 2.0, 3.0]}
    vectors = {i: v for i, v in vectors.items() if any(v)}
    rows = list(vectors.items()) + [
        (700, None), (701, [0.0] * 12), (702, [float("nan")] + [1.0] * 11),
        (703, [None] + [1.0] * 11), (704, [float("inf")] + [1.0] * 11), (None, [1.0] * 12),
        (705, [])] + [(3, vectors[3])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows],
                                  "vec_id long, embedding array<double>, block string")
    found = ann.nearest(frame.where("vec_id % 10 = 0"), frame, 5, block_rows=90, query_rows=13)
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = nearest_by_hand(vectors, {i: v for i, v in vectors.items() if i % 10 == 0}, 5)
    want = {q: v for q, v in want.items() if v}
    assert set(got) == set(want)
    for q, pairs in want.items():
        assert [i for _, i in got[q]] == [i for _, i in pairs]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in pairs], rel=1e-12)
    few = ann.nearest(frame.where("vec_id = 0"), frame.where("vec_id in (0, 1, 2)"), 5)
    assert [(r["rank"], r.query_id) for r in few.orderBy("rank").collect()] == [(1, 0), (2, 0)]
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_block_join_of_vectors_beyond_the_range_of_squares(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=4) * s).tolist() for i, s in enumerate(
        [1.0] * 8 + [1e154] * 6 + [1e200] * 6 + [1e-170] * 6 + [1e307] * 4)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found = ann.nearest(frame, frame, 10, block_rows=11, query_rows=7)
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, a in vectors.items():
        want = sorted((math.hypot(*[x / 4 - y / 4 for x, y in zip(a, b)]), i)
                      for i, b in vectors.items() if i != q)[:10]
        assert len(got[q]) == 10
        assert [s / 4 for _, s in got[q]] == pytest.approx([s for s, _ in want], rel=1e-12)


def test_sketches_lose_no_link_between_small_sets():
    # sets of a few shingles fill their bins with copies: seven deviations must allow for that
    rng = np.random.default_rng(11)
    for small, large, percent in ((4, 5, 80), (6, 7, 85), (8, 10, 80), (17, 20, 85), (40, 50, 80), (200, 250, 80)):
        mean, variance = neardup.bits_moments(percent)
        allowed = mean + neardup.SLACK_DEVIATIONS * np.sqrt(max(1.0, neardup.BINS / small) * variance)
        for _ in range(1500):
            a = np.unique(rng.integers(0, 1 << 64, large, dtype=np.uint64))
            b = np.sort(rng.permutation(a)[:small])
            bits = (neardup.signature(a) ^ neardup.signature(b)) & np.uint64(1)
            assert bits.sum() <= allowed


def shingles(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    n = len(words)
    return frozenset([tuple(words)] if 0 < n < width
                     else [tuple(words[i:i + width]) for i in range(n - width + 1)])


def groups_by_hand(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d, _ in sets}


def near_copies(seed, n_bases, n_copies, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(n_copies):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent, tile", [(3, 85, 256), (5, 80, 7)])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, width, percent, tile):
    # few centres meet all links: many copies, each a little off, of a few texts
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = near_copies(1, 4, 60) + [(900 + i, t) for i, t in enumerate(
        ["one", "One", "one two", "", None, " \n", "one two", "a b c d e f g", "A b C d e f g"])]
    rows += [(990, "lone text with no id near it"), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    found = neardup.near_duplicates(docs(*rows), width, percent).collect()
    want = groups_by_hand(rows, width, percent)
    assert len(found) == len(rows)
    for r in found:
        assert r.n_shingles == len(shingles(dict(rows).get(r.doc_id), width)) or r.doc_id is None
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_odd_documents(docs, odd_docs):
    found = neardup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert [r.component_id for r in found if r.doc_id == 5] == [4, 4]
    assert all(r.component_id == r.doc_id for r in found if not r.n_shingles)
    assert neardup.near_duplicates(docs()).count() == 0


def test_shingles_of_slices_equal_those_of_whole_batches(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ça", "É", "Foo", "naïve", "A", "日本", "", "\t"])
                      for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(texts)], names=["a", "b"])
    want = [x.tolist() for x in neardup.shingle_sets(batch.column(1), 3)]
    by_set = {}
    for text, found in zip(texts, want, strict=True):
        assert by_set.setdefault(shingles(text, 3), found) == found
        assert len(found) == len(shingles(text, 3))
    assert len({tuple(x) for x in by_set.values()}) == len(by_set)
    for limit in (40, 500, 10**6):
        monkeypatch.setattr(neardup, "SLICE_BYTES", limit)
        parts = list(neardup.slices(batch))
        assert sum(p.num_rows for p in parts) == 301
        assert [x.tolist() for p in parts
                for x in neardup.shingle_sets(p.column(1), 3)] == want


def test_bands_and_densification():
    for percent in (80, 85, 95):
        rows = neardup.rows_per_band(percent)
        assert (1 - (percent / 100) ** rows) ** (neardup.BINS // rows) <= neardup.MISS
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 500, 5000):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[n // 10:], rng.integers(
            0, 2**64, n // 10, dtype=np.uint64)]))
        same = (neardup.signature(base) == neardup.signature(other)).mean()
        share = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        assert abs(same - share) < 0.2
        assert (neardup.signature(base) == neardup.signature(base.copy())).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)]
    edges += [(200 + rng.randrange(90), 200 + rng.randrange(90)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    found = {r.node: r.root for r in components.components(frame).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components.components(frame.limit(0)).count() == 0


def test_language_model_scores_equal_brute_force(docs, odd_docs):
    rng = random.Random(9)
    target = [" ".join(rng.choice(["tea", "cup", "pot", "hot"]) for _ in range(30))
              for _ in range(6)]
    rows = [(i, " ".join(rng.choice(["tea", "cup", "dog", "runs", "far"]) for _ in range(
        rng.randint(0, 40)))) for i in range(40)] + [(50, target[0]), (51, None), (52, ""), (53, "x")]
    words = encoder(default_path())
    ids = {d: np.frombuffer(words.whole([t or ""])[0], "<u4").tolist() for d, t in rows}
    wanted = [np.frombuffer(w, "<u4").tolist() for w in words.whole(target)]

    def model(texts):
        single, pairs = collections.Counter(), collections.Counter()
        for t in texts:
            single.update(t)
            pairs.update(zip(t, t[1:]))
        total = sum(single.values())

        def loss(t):
            share = {w: (single[w] + 1) / (total + words.size) for w in t}
            first = -math.log(share[t[0]])
            return (first + sum(-math.log((pairs[v, w] + 20 * share[w]) / (single[v] + 20))
                                for v, w in zip(t, t[1:]))) / len(t)
        return loss

    of_target, of_all = model(wanted), model(list(ids.values()))
    frame = docs(*enumerate(target))
    found = lm_score.score(docs(*rows), frame, default_path(), block_tokens=100).collect()
    assert len(found) == len(rows)
    for r in found:
        t = ids[r.doc_id]
        assert r.n_tokens == len(t)
        if t:
            assert r.target_loss == pytest.approx(of_target(t))
            assert r.background_loss == pytest.approx(of_all(t))
            assert r.score == pytest.approx(of_target(t) - of_all(t))
        else:
            assert r.score is None and r.target_loss is None
    best = min((r for r in found if r.n_tokens > 10), key=lambda r: r.score)
    assert best.doc_id == 50
    odd = lm_score.score(odd_docs, frame, default_path()).collect()
    assert len(odd) == odd_docs.count()
    assert len(lm_score.score(odd_docs, docs(), default_path()).collect()) == len(odd)
    assert lm_score.score(docs(), frame, default_path()).count() == 0
