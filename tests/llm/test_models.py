import random

import numpy as np
import pytest

from tributary.llm import quality, topk, toxicity
from tributary.llm.common import scratch


def test_gradient_matches_differences():
    net = toxicity.Network({"a": 1}, np.array([0.5], np.float32), 3)
    r = np.random.default_rng(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, real, y = r.standard_normal((3, 5, 16)), np.ones((3, 5), bool), np.array([0, 1, 1])
    real[0, 3:] = False
    _, g, _ = net.gradient(x, real, y)
    for k in ("W", "U", "b", "a", "o", "c"):
        for _ in range(3):
            at = tuple(int(r.integers(s)) for s in net.p[k].shape)
            old, step = net.p[k][at], 1e-4
            net.p[k][at] = old + step
            up = net.gradient(x, real, y)[0]
            net.p[k][at] = old - step
            down = net.gradient(x, real, y)[0]
            net.p[k][at] = old
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-3


def test_toxicity_learns_and_reads_whole_texts(docs, spark):
    r = random.Random(2)
    vocab = ["v%d" % k for k in range(120)]
    text = lambda n, bad: " ".join(["zounds" if bad and k == n - 2 else r.choice(vocab) for k in range(n)])
    texts = [text(r.randrange(5, 200), k % 3 == 0) for k in range(300)] + [text(3000, True), text(3000, False), None, ""]
    df = docs(texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    rows = {x.doc_id: x for x in toxicity.score_documents(df, net).collect()}
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 for x in rows.values())
    held = [x for x in rows.values() if x.held_out and x.doc_id < 300]
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.9
    assert rows[300].predicted == 1 and rows[301].predicted == 0
    kept = {x.doc_id for x in toxicity.reject_toxic(df, net).collect()}
    assert kept == {k for k, x in rows.items() if x.predicted == 0}
    assert toxicity.score_documents(df.where("false"), net).count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 71, 72, 73, 500):
        s = toxicity.window_starts(n)
        assert s[0] == 0 and (n <= 48 or s[-1] == n - 48) and (np.diff(s) <= 24).all()


def test_importance_weights_and_draw(docs, spark):
    r = random.Random(4)
    good, bad = ["g%d" % k for k in range(40)], ["b%d" % k for k in range(40)]
    texts = [" ".join(r.choice(good if k % 2 else bad) for _ in range(60)) for k in range(200)] + [None, "", "a"]
    target = spark.createDataFrame([(k,) for k in range(1, 60, 2)], "x long")
    rows = quality.resample(docs(texts), target, keep=0.5).collect()
    assert len(rows) == len(texts) and sum(x.selected for x in rows) == round(0.5 * len(texts))
    picked = [x.doc_id % 2 for x in rows if x.selected and x.doc_id < 200]
    assert np.mean(picked) > 0.9 and {x.log_weight for x in rows if x.doc_id in (200, 201)} == {0.0}
    again = quality.resample(docs(texts, parts=5), target, keep=0.5).collect()
    assert {x.doc_id for x in again if x.selected} == {x.doc_id for x in rows if x.selected}
    assert quality.resample(docs(["x"]).where("false"), target).count() == 0


def test_top_is_exact(spark):
    r = random.Random(6)
    values = [(k, float(r.choice([r.random(), 0.5]))) for k in range(3000)]
    df = spark.createDataFrame(values, "i long, s double")
    for k in (0, 1, 700, 2999, 3000, 4000):
        got = {x.i for x in quality.top(df, "s", ["i"], k).where("selected").collect()} if k else set()
        assert got == {i for i, _ in sorted(values, key=lambda v: (-v[1], v[0]))[:k]}


@pytest.mark.parametrize("dims,scale", [(3, 4.0), (16, 256.0)])
def test_search_matches_brute_force(spark, dims, scale):
    r = random.Random(dims)
    rows = [(i, [r.uniform(-1, 1) for _ in range(dims)]) for i in range(400)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, None), (403, [None] * dims), (404, [float("nan")] * dims), (405, [float("inf")] * dims), (None, rows[1][1]), (406, [0.5])]
    df = spark.createDataFrame(rows, "i long, v array<float>").repartition(5)
    index = topk.build(df, scratch(spark, "t"), "i", "v", scale)
    got = {}
    for x in topk.search(index, df.where("i % 20 = 0"), "i", "v", 5, scale).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    held = {i: np.floor(scale * np.float32(v).astype(np.float64)).astype(int) for i, v in rows if i is not None and v is not None and v[0] is not None and np.isfinite(v).all()}
    for q in [i for i in held if i % 20 == 0]:
        best = sorted(((-int(held[q] @ v), i) for i, v in held.items() if i != q and len(v) == len(held[q])))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in held if i % 20 == 0}


def test_toxicity_trains_on_whole_texts(docs, spark):
    r = random.Random(8)
    vocab = ["v%d" % k for k in range(120)]
    texts = [" ".join(["zounds" if k % 2 and w == 1590 else r.choice(vocab) for w in range(1600)]) for k in range(240)]
    texts += [" ".join([r.choice(vocab) for _ in range(40)] + ["zounds"] * (k % 2)) for k in range(20)]
    df = docs(texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    assert "zounds" in net.vocabulary
    rows = toxicity.score_documents(df, net).where("doc_id >= 240").collect()
    assert [x.predicted for x in sorted(rows, key=lambda x: x.doc_id)] == [k % 2 for k in range(20)]


def test_toxicity_sample_holds_two_thousand_of_each_kind(docs, spark):
    df = docs(["a%d" % k for k in range(4000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, toxic int")
    rows = toxicity.training_rows(df, labels, "doc_id", "text").select("i", "toxic").collect()
    assert {x.i for x in rows} == {k for k in range(4000) if not toxicity.held_out(str(k))}


def test_target_model_counts_every_good_row(docs, spark, monkeypatch):
    kept, real = [], quality.log_ratio
    monkeypatch.setattr(quality, "log_ratio", lambda counts: (kept.append(counts), real(counts))[1])
    df = docs(["a"] * 20_600)
    assert quality.resample(df, df.where("doc_id < 20500").select("doc_id")).count() == 20_600
    assert kept[0].sum(1).tolist() == [20_600, 20_500]


def test_search_is_exact_for_large_components(spark):
    rows = [(0, [2.0**45, 1.0, 0.0]), (1, [3.0, 1.0, 2.0]), (2, [2.0**50, -(2.0**20), 5.0]), (3, [-(2.0**35), 2.0**38, 7.0]), (4, [2.0**36, -(2.0**39), 1.0]), (5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    index = topk.build(df, scratch(spark, "t"), "i", "v", 1.0)
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    for q in (1, 3, 5):
        best = sorted((-dot(rows[q][1], v), i) for i, v in rows if i != q)
        fit = [(k + 1, i, -s) for k, (s, i) in enumerate(best[:2])]
        ask = topk.search(index, df.where(f"i = {q}"), "i", "v", 2, 1.0)
        if all(-(1 << 63) <= s < 1 << 63 for _, _, s in fit):
            assert [(x.rank, x.vec_id, x.score) for x in ask.orderBy("rank").collect()] == fit
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(index, df.where("i = 0"), "i", "v", 2, 1.0).collect()


def slow_logit(net, words):
    """The logit of one window, word by word, from the parameters alone."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    inputs = []
    for w in words:
        bare = w.lower().strip(toxicity._EDGES)
        ids, _ = toxicity.trigram_ids([bare])
        inputs.append(np.concatenate([p["word"][net.vocabulary.get(bare, 0)], p["char"][ids].mean(0)]))
    sides = []
    for d in (0, 1):
        state, states = np.zeros(h), []
        for x in inputs if d == 0 else inputs[::-1]:
            gates, y = x @ p["W"][d] + p["b"][d, 0], state @ p["U"][d]
            z, r = 1 / (1 + np.exp(-(gates[:h] + y[:h]))), 1 / (1 + np.exp(-(gates[h : 2 * h] + y[h : 2 * h])))
            c = np.tanh(gates[2 * h :] + r * y[2 * h :])
            state = z * state + (1 - z) * c
            states.append(state)
        sides.append(states if d == 0 else states[::-1])
    flat = np.concatenate(sides, axis=1)
    weight = np.exp(flat @ p["a"])
    return float((weight / weight.sum()) @ (flat @ p["o"]) + p["c"][0])


def noisy_network(seed):
    r = np.random.default_rng(seed)
    net = toxicity.Network({"v%d" % k: k + 1 for k in range(40)}, r.standard_normal(40).astype(np.float32), seed)
    for k, v in net.p.items():
        net.p[k] = (v + 0.4 * r.standard_normal(v.shape)).astype(np.float32)
    net.p["word"][0] = 0
    return net


def slow_score(net, text):
    words = (text or "").split()
    starts = [0] if len(words) <= toxicity.WINDOW else [*range(0, len(words) - toxicity.WINDOW, toxicity.STEP), len(words) - toxicity.WINDOW]
    # An empty window has neither states nor weights: what is left is the last term.
    return 1 / (1 + np.exp(-max(slow_logit(net, words[s : s + toxicity.WINDOW]) if words else float(net.p["c"][0]) for s in starts)))


def test_scores_match_a_word_by_word_network():
    net, r = noisy_network(3), random.Random(5)
    texts = [" ".join(r.choice(['"V%d!"', "v%d", "x%d"]) % r.randrange(60) for _ in range(n)) for n in (1, 2, 5, 47, 48, 49, 73, 130, 300)] + ["", " "]
    got = toxicity.Scorer(net).scores(texts)
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-4) and got.std() > 0.01


def test_scoring_and_training_share_a_forward_pass():
    net, r = noisy_network(4), np.random.default_rng(4)
    words = ["v%d" % k for k in range(60)]
    x = net.rows(words)
    index = r.integers(0, 60, (7, 12))
    real = np.arange(12) < r.integers(1, 13, 7)[:, None]
    logit = net.score(net.project(x), np.where(real, index, 0), real)
    for k in range(7):
        loss, _, _ = net.gradient(x[index[k : k + 1]], real[k : k + 1], np.array([1]))
        assert abs(loss - np.log1p(np.exp(-logit[k]))) < 1e-4


def test_log_weights_and_the_draw_are_recomputed(docs, spark):
    import pyarrow as pa

    r = random.Random(11)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 40))) for _ in range(80)] + [None, "", "A b"]
    ids = [*range(82), None]
    good = {k for k in range(82) if k % 3 == 0}
    grams = [quality.gram_buckets(pa.array([t or ""]))[0].tolist() for t in texts]
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in zip(ids, grams, strict=True):
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    assert [len(g) for g in grams[:2]] == [2 * len(t.split()) - 1 for t in texts[:2]] and grams[-1] == quality.gram_buckets(pa.array(["a B"]))[0].tolist()
    both = (raw + 1) / (raw.sum() + quality.BUCKETS)
    p, q = 0.999 * target / target.sum() + 0.001 * both, 0.999 * raw / raw.sum() + 0.001 * both
    want = {i: sum(np.log(p[g]) - np.log(q[g]) for g in gs) for i, gs in zip(ids, grams, strict=True)}
    rows = quality.resample(docs(texts, ids=ids), spark.createDataFrame([(k,) for k in good], "k long"), keep=0.4).collect()
    assert all(abs(x.log_weight - want[x.doc_id]) < 1e-6 for x in rows)
    noise = np.array([x.score - x.log_weight for x in rows])
    assert np.isfinite(noise).all() and abs(noise.mean() - 0.577) < 0.5
    best = sorted(rows, key=lambda x: -x.score)[: round(0.4 * len(rows))]
    assert {x.doc_id for x in rows if x.selected} == {x.doc_id for x in best}


def test_gumbel_noise_draws_in_proportion(docs, spark):
    """With two kinds of equal texts, the larger weights are drawn first about as often as the weights say."""
    rows = quality.resample(docs(["w"] * 4000), spark.createDataFrame([(0,)], "k long"), keep=0.25).collect()
    noise = np.array([x.score - x.log_weight for x in rows])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.var() - np.pi**2 / 6) < 0.2
    assert sum(x.selected for x in rows) == 1000
