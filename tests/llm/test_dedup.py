import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tributary.llm import repeats, substring_dedup, suffix, suffix_dedup


def slow_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, x in enumerate(data):
        for s in range(len(x) - length + 1):
            places[x[s : s + length]].append((d, s))
    gone = [np.zeros(len(x), bool) for x in data]
    for where in places.values():
        if len(where) > 1:
            for d, s in where:
                gone[d][s : s + length] = True
    return [(len(x), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), np.frombuffer(x, np.uint8)[~g].tobytes()) for x, g in zip(data, gone, strict=True)]


def slow_words(texts, ids, length):
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    words = [(t or "").encode().split() for t in texts]
    seen, out = set(), {}
    for k in order:
        w, gone = words[k], [False] * len(words[k])
        for s in range(len(w) - length + 1):
            x = tuple(w[s : s + length])
            if x in seen:
                gone[s : s + length] = [True] * length
            seen.add(x)
        out[k] = (len(w), sum(gone), b" ".join(y for y, g in zip(w, gone, strict=True) if not g))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgß") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passages = [line(r.randrange(20, 60)) for _ in range(4)]
    out = [None, "", " \n\t ", "x", "a" * 300, "a" * 120, "ab" * 200, "tie tie tie " * 40, "tie tie " * 30]
    for _ in range(n):
        parts = [line(r.randrange(0, 60))]
        if r.random() < 0.6:
            parts.append(r.choice(passages))
        if r.random() < 0.4:
            parts.append(r.choice(passages))
        out.append(r.choice([" ", "\n", "  "]).join([*parts, line(r.randrange(0, 30))]))
    for _ in range(n // 2):
        base = r.choice(out[9:]).split(" ")
        base[r.randrange(len(base))] = r.choice(vocab)
        out.append(" ".join(base))
    out += [out[12]] * 3 + [out[20]]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,hot,huge", [(1, 400, 900), (2, 3, 900), (3, 3, 6)])
def test_bytes_match_brute_force(docs, monkeypatch, seed, hot, huge):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HUGE", huge)
    monkeypatch.setattr(suffix_dedup, "GRAM", 12)
    texts = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(texts), length=50).collect()}
    want = slow_bytes(texts, 50)
    assert len(got) == len(texts) and sum(w[1] for w in want) > 1000
    for k, w in enumerate(want):
        assert got[k] == w, texts[k]


@pytest.mark.parametrize("seed,hot,huge", [(4, 400, 900), (5, 3, 900), (6, 3, 6)])
def test_words_match_brute_force(docs, monkeypatch, seed, hot, huge):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HUGE", huge)
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.remove_repeats(docs(texts, ids=ids), length=12).collect()}
    want = slow_words(texts, ids, 12)
    assert sum(w[1] for w in want.values()) > 300
    for k, w in want.items():
        assert got[ids[k]] == w, texts[k]


def test_full_lengths_and_long_texts(docs):
    r = random.Random(9)
    long = " ".join(str(r.randrange(10**6)) for _ in range(60_000))
    texts = [long, "lead " + long[100_000:140_000] + " tail", "q" * 50_000, "unlike anything else", None]
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs(texts), digest=True).collect()}
    for k, w in enumerate(slow_bytes(texts, 400)):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == w[:3]
        assert bytes(got[k].kept).decode() == hashlib.sha256(w[3]).hexdigest()
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(docs(texts), digest=True).collect()}
    for k, w in slow_words(texts, range(5), 20).items():
        assert (got[k].n_words, got[k].n_removed, bytes(got[k].kept).decode()) == (*w[:2], hashlib.sha256(w[2]).hexdigest())


def test_null_and_repeated_ids(docs):
    text = " ".join(map(str, range(300)))
    rows = substring_dedup.remove_repeats(docs([text, text, text, None], ids=[5, 5, None, None])).collect()
    assert sorted((x.doc_id or -1, x.n_words, x.n_removed) for x in rows) == [(-1, 0, 0), (-1, 300, 300), (5, 300, 0), (5, 300, 0)]
    rows = suffix_dedup.remove_repeats(docs([text, text], ids=[5, 5])).collect()
    assert [x.n_removed for x in rows] == [len(text)] * 2
    for f in (substring_dedup.remove_repeats, suffix_dedup.remove_repeats):
        assert f(docs(["x"]).where("false")).count() == 0
        assert f(docs([None, "", "a b"])).count() == 3


def test_corpus_order_is_the_order_of_suffixes():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(200))).encode() for _ in range(12)] + [b"", b"abab" * 60, b"z" * 300]
    parse = suffix.PrefixFreeParse(texts)
    assert len(parse.phrases) > 1
    rank = parse.order_ranks()
    tails = [texts[t][p - parse.starts[t] :] for p, t in enumerate(parse.text)]
    order = np.argsort(rank, kind="stable")
    assert [tails[i] for i in order] == sorted(tails)


def test_fm_index_counts():
    r = np.random.default_rng(2)
    s = np.append(r.integers(1, 6, 400), 0)
    fm = suffix.FmIndex(s, np.full(len(s), len(s)))
    starts = np.arange(397)
    matched, lo, hi = fm.statistics(s, starts, 1, 3)
    for k in starts:
        assert matched[k] == 3 and hi[k] - lo[k] == sum((s[i : i + 3] == s[k : k + 3]).all() for i in range(398))
    m, _, _ = fm.statistics(np.array([7, 1, 1]), np.array([0]), 1, 2)
    assert m[0] == 1
