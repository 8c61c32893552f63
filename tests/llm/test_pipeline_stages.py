"""Every stage in its pipeline form, and the whole, against slow versions."""

import hashlib
import random

import numpy as np
import pytest
from test_dedup import slow_words
from test_jaccard import slow
from test_models import slow_score

import corpus_pipeline
from tributary.llm import mixing, toxicity
from tributary.llm.common import scratch_paths
from tributary.llm.tokens import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts_of(seed):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = line(30)
    out = [None, "", " ", "one", "Grüße <|endoftext|> İ", "tie " * 60]
    for k in range(60):
        base = line(r.randrange(5, 80))
        if k % 4 == 0:
            base += " " + passage + " " + line(5)
        if k % 5 == 0:
            base += " zounds"
        out.append(base)
        if k % 3 == 0:
            out += [base] * r.randrange(3)
            words = base.split(" ")
            words[r.randrange(len(words))] = "edited"
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    texts = texts_of(1)
    rows = [(k, t, "en", [None, "a", "b", "é"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int("zounds" in (t or ""))) for k, t in enumerate(texts) if k % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def slow_toxicity(spark, rows, folder):
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema)
    net = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [x for x in rows if slow_score(net, x.text) < 0.5]


def slow_one_of_each(rows):
    low = {i: c for i, _, c in slow([x.text for x in rows], [x.doc_id for x in rows])}
    return [x for x in rows if low[x.doc_id] == x.doc_id]


def slow_cut(rows):
    cut = slow_words([x.text for x in rows], [x.doc_id for x in rows], 20)
    out = []
    for k, x in enumerate(rows):
        n, gone, kept = cut[k]
        if gone < n or not n:
            out.append(x if not gone else x.__class__(**(x.asDict() | {"text": kept.decode(), "n_chars": len(kept.decode())})))
    return out


def slow_mix(rows):
    size = lambda x: len((x.text or "").encode().split())
    names = sorted({x.source for x in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size(x) for x in rows if x.source == s) for s in names}
    target, budget, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        budget, free = budget - sum(2.0 * total[s] for s in full), free - full
    out = []
    for s in names:
        start = int(hashlib.md5(f"17:{'null' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 4294967296.0
        rate = target[s] / total[s] if total[s] else 0.0
        mine = sorted((x for x in rows if x.source == s), key=lambda x: (size(x), x.doc_id))
        for k, x in enumerate(mine, 1):
            out += [x] * (int(np.floor(start + rate * k)) - int(np.floor(start + rate * (k - 1))))
    return out


def slow_encode(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    out = []
    for x in rows:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((x.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_stages_match_slow_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    slow_stage = [lambda x: slow_toxicity(spark, x, tables), slow_one_of_each, slow_cut, slow_mix, slow_encode]
    sizes = [len(rows)]
    for (_, stage), expect in zip(corpus_pipeline.STAGES, slow_stage, strict=True):
        want = expect(rows)
        got = stage(spark, docs, tables).collect()
        key = lambda x: (x[0], x[1] or "") if expect is not slow_encode else tuple(x)  # noqa: E731, B023
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
        rows = want
        sizes.append(len(want))
        if expect is not slow_encode:
            docs = spark.createDataFrame(want, docs.schema)
            assert docs.columns == COLUMNS
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[1] > 0.7 * sizes[0]
    before = set(scratch_paths())
    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(tuple, whole)) == sorted(rows)
    assert len(set(scratch_paths()) - before) < 15


def test_stages_take_odd_rows(spark, tables):
    """Nulls in any column, repeated rows, columns with names that operators use, and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h int, _key string, row int"
    odd = [(None, None, None, None, None, 1, "k", None), (1, "a b", None, None, 3, 2, None, 5), (1, "a b", None, None, 3, 2, None, 5), (None, "", "en", "s", 0, 3, "k", 1), (2, "w " * 40, "en", "s", 80, 4, "k", 1)]
    df = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), tables).count() == 0, name
        out = stage(spark, df, tables)
        if name == "bpe":
            assert out.count() == len(odd)
            continue
        assert out.columns == df.columns and {tuple(x) for x in out.collect()} <= {tuple(x) for x in odd} | {(2, "w", "en", "s", 1, 4, "k", 1)}
    assert mixing.mix(df).count() == len(odd)


def test_places_of_null_and_repeated_ids(docs):
    """One source and size throughout: the copies of neighbours still differ by one at most and add up."""
    rows = mixing.mix(docs(["a b c"] * 300, ids=[None] * 150 + [7] * 150), cap=2.0, share=1.5).collect()
    assert sum(x.copies for x in rows) in (450, 451, 449) and {x.copies for x in rows} == {1, 2}
