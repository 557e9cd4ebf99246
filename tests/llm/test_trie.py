import hashlib
import random
import zlib

import pytest

from wavespan.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, owner string, depth string"


def by_hand(rows, shared=True):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(
                ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if shared else 0
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, found in members.items():
        under = [x for x in members if x[:len(node)] == node]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(found) if len(built[c]) == len(node))
        out.add((min(found), len(node), min(members[node[:-1]]) if node else None, len(found),
                 sum(len(x) == len(node) + 1 for x in under), len(leaves), saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows, shared=True, local_nodes=trie.LOCAL_NODES):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    turns = trie.numbered(frame)
    parts = trie.with_shared_heads(turns) if shared else trie.as_they_are(turns)
    out = [tuple(r) for r in trie.prefix_trie(*parts, local_nodes=local_nodes).collect()]
    assert len(out) == len(set(out))
    return set(out)


def odd_rows():
    return [(None, 1, "user", "nobody"), (0, None, "user", "first"), (0, 1, None, "äß"),
            (0, 1, "a", None), (0, 1, "a", None), (1, 1, "user", ""), (7, 2, "user", "w " * 50_000),
            (7, 1, "user", "short"), (-3, 1, "user", "below"), (-5, 1, "user", "zero"),
            (12, 5, None, None), (13, 5, "", "")]


def some_rows(seed, n, words):
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 else "bot", rng.choice(words))
            for c in range(n) for t in range(rng.randint(1, 12))]


@pytest.mark.parametrize("shared", [True, False])
def test_odd_conversations(spark, shared):
    rows = odd_rows()
    assert found(spark, rows, shared) == by_hand(rows, shared)


@pytest.mark.parametrize("local_nodes", [1, 7, trie.LOCAL_NODES])
def test_trie_equals_brute_force(spark, local_nodes):
    rows = some_rows(3, 40, ["a", "bb"]) if local_nodes == 7 else some_rows(5, 12, ["a", "b", "c"])
    assert found(spark, rows, local_nodes=local_nodes) == by_hand(rows)


def test_one_conversation_of_most_turns_and_many_copies(spark):
    rows = [(100, t, "user", f"t{t % 3}") for t in range(60)]
    rows += [(c, t, "user", f"t{t}") for c in range(200, 230) for t in range(2)]
    assert found(spark, rows, shared=False, local_nodes=9) == by_hand(rows, shared=False)


def test_no_conversations(spark):
    assert found(spark, []) == set()


def test_centroid_totals_of_chains_stars_and_random_trees():
    rng = random.Random(1)
    trees = [[-1, *range(199)], [-1] + [0] * 199, [-1, *[rng.randrange(i) for i in range(1, 300)]], []]
    for parent in trees:
        n = len(parent)
        value = [rng.randint(0, 9) for _ in range(n)]
        own = [rng.randint(1, 5) for _ in range(n)]
        weight, total = list(own), list(value)
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            total[parent[i]] += total[i]
        assert trie.centroid_totals(parent, weight, [value]) == [total]
