import random
import re

import pytest

from tributary.llm import components, jaccard


def slow(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return [(ids[k], len(sets[k]), low[find(k)]) for k in range(len(texts))]


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(300)]
    line = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = line(25)
    out = [None, "", " ", "one", "One", "a b c d", "A B C D", "a b c d e", "x " * 30, "x " * 31, "x y " * 9]
    for _ in range(25):
        base = line(r.randrange(8, 90)) + (passage if r.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 5)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            if r.random() < 0.3:
                copy += line(r.randrange(1, 12))
            out.append(r.choice([" ", "\n"]).join(copy))
            if r.random() < 0.2:
                base = copy
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(docs, seed):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(texts, ids=ids)).collect())
    want = sorted(slow(texts, ids))
    assert got == want and len({w[2] for w in want}) < len(want) - 20


def test_odd_tables(docs):
    assert jaccard.near_duplicates(docs(["x"]).where("false")).count() == 0
    got = jaccard.near_duplicates(docs([None, "", " "], ids=[3, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (3, 0, 3), (4, 0, 4)]
    got = jaccard.near_duplicates(docs(["a b c d e f", "a b c d e f", "A b c d e f"], ids=[7, 7, None])).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {7}


def test_components_of_a_chain_and_a_star(spark):
    r = random.Random(1)
    names = list(range(300))
    r.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(149)] + [(names[150], names[k]) for k in range(151, 300)]
    got = {x.id: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = [min(names[:150]), min(names[150:])]
    assert got == {n: low[k >= 150] for k, n in enumerate(names)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_entries_keep_every_shared_shingle(spark):
    r = random.Random(4)
    groups = []
    for g in range(3000):
        own = sorted(r.sample(range(1000, 40_000), r.randrange(6))) + ([7] if g % 3 else [])
        groups.append((g * 7919, sorted(set(own))))
    rows = [(g, bytearray(b"".join(x.to_bytes(5, "little") for x in p))) for g, p in groups]
    got = {(e.token, e.gid, e.place) for e in jaccard._entries(spark.createDataFrame(rows, "gid long, prefix binary").repartition(5)).collect()}
    often = {}
    for _, p in groups:
        for t in p:
            often[t] = often.get(t, 0) + 1
    assert got == {(t, g, k) for g, p in groups for k, t in enumerate(p) if often[t] > 1}
