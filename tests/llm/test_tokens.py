import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import bpe, token_output
from tributary.llm.common import scratch
from tributary.llm.tokens import LibraryIds, default_tokenizer

ODD = [
    None, "", " ", "Hello world", "don't WE'LL it's 123 4x5", "Grüße ÉCOLE naïve Å ΑΣ ΣΑΣ İstanbul", "áb  é", "\x1c\x1d mixed\x1ewords\x1f",
    " nbsp em　ideo", "<|endoftext|>x<|startoftext|> y <|endoftext", "日本語 テキスト 🙂🙂 ȩ́", "aaaa " * 50 + "aaaaaaaaaaaaaaaaaaaaaaa", "²½ Ⅷ x² '' ''s ’s",
    "supercalifragilistic" * 30, "́ lone mark", "!!!???...---", "\0\1\2", "word " * 5000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def noise(seed, n):
    r = random.Random(seed)
    letters = "aabbccddeeiillnnoorrsstthh'  \n\té.,!-_0123ß"
    return ["".join(r.choice(letters) for _ in range(r.randrange(400))) for _ in range(n)]


def test_trie_encoding_and_decoding_match_the_library(docs, library):
    texts = ODD + noise(1, 200)
    got = {r.doc_id: r for r in bpe.encode_documents(docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, text = expected(library, t)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, t
        assert got[i].decoded == text and got[i].n_tokens == len(ids)


def test_repeated_and_null_ids_keep_their_rows(docs, spark):
    got = bpe.encoding_digests(docs(["a b", "a b", "c"], ids=[1, 1, None])).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 1), (1, 2), (1, 2)]
    assert bpe.encoding_digests(docs(["x"]).where("false")).count() == 0


@pytest.mark.parametrize("length,batch", [(16, 4), (1024, 256)])
def test_sequences_round_trip(docs, library, spark, length, batch):
    texts = ODD + noise(2, 60)
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    manifest = token_output.write_sequences(docs([texts[i] for i in order], ids=order), scratch(spark, "t"), length=length, batch=batch)
    got = {r.doc_id: r for r in token_output.read_documents(manifest).collect()}
    at, stream = 0, []
    for i, t in enumerate(texts):
        ids = expected(library, t)[0] + [1]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
        stream += ids
    real = []
    for f in manifest.orderBy("part").collect():
        r = token_output.SequenceReader(f.path + ".arrow")
        n = -(-f.tokens // length)
        for k in range(n):
            ids, mask = r.sequence(k)
            assert len(ids) == len(mask) == length and (k == n - 1 or mask.all())
            real += ids[mask == 1].tolist()
    assert real == stream


def test_sequences_of_an_empty_table(docs, spark):
    m = token_output.write_sequences(docs(["x"]).where("false"), scratch(spark, "t"))
    assert token_output.read_documents(m).count() == 0


def test_mixing_counts(docs, spark):
    from tributary.llm import mixing

    r = random.Random(5)
    texts = [" ".join("w" * 1 for _ in range(r.randrange(1, 60))) for _ in range(900)] + [None, "", "  "]
    sources = [r.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    rows = mixing.mix(docs(texts, sources=sources)).collect()
    assert len(rows) == len(texts)
    total = sum(x.size for x in rows)
    by = {}
    for x in rows:
        assert 0 <= x.copies <= 2
        s = by.setdefault(x.source, [x.source_size, x.target, 0, 0])
        s[2] += x.size
        s[3] += x.copies * x.size
    assert abs(sum(s[1] for s in by.values()) - 1.5 * total) < 1e-6
    for size, target, mine, taken in by.values():
        assert size == mine and target <= 2 * size + 1e-9 and abs(taken - target) <= 120
    again = mixing.mix(docs(texts, sources=sources, parts=7)).collect()
    assert sorted((x.id, x.copies) for x in again) == sorted((x.id, x.copies) for x in rows)
    assert mixing.mix(docs(["x"]).where("false")).count() == 0


def test_one_source_and_no_words(docs):
    from tributary.llm import mixing

    assert {(x.target, x.copies) for x in mixing.mix(docs(["", None])).collect()} == {(0.0, 0)}
    one = mixing.mix(docs(["a b c"] * 4, ids=[1, 1, 2, None])).collect()
    assert sum(x.copies for x in one) == 6 and {x.target for x in one} == {18.0}


def test_unknown_tokenizer_files(docs, spark, library, tmp_path):
    """op4 encodes whole texts with a file of another shape; op8 refuses it."""
    import json

    from tokenizers import Tokenizer

    with open(default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"String": "o w"}, "content": "ow"}]}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    other, texts = Tokenizer.from_file(path), ["hello world", "o w o w", "", None, "a  b"]
    manifest = token_output.write_sequences(docs(texts), scratch(spark, "t"), tokenizer=path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.read_documents(manifest).collect()}
    for i, t in enumerate(texts):
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    with pytest.raises(ValueError, match="tokenizer file"):
        bpe.TrieBpe(path)


def test_long_words_take_time_in_proportion(library):
    import time

    r = random.Random(9)
    trie = bpe.TrieBpe(default_tokenizer())
    word = "".join(r.choice("abcdef") for _ in range(100_000))
    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        (ids,) = trie.words([word[:n]]).values()
        took.append(time.process_time() - began)
        assert ids == library.encode(word[:n], add_special_tokens=False).ids
    assert took[1] < 25 * max(took[0], 0.02)


def test_few_kept_chunks_keep_the_tables_small(library):
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(400)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    table, most, ids = bpe.trie_chunks(default_tokenizer(), 500), 0, []
    for b in bpe._codes([batch], table, bpe.CODES, False):
        most = max(most, len(table.now), len(table.old))
        ids += b.column("ids").to_pylist()
    assert most < 8_000
    assert ids == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Counted:
    """A tokenizer that counts what is asked of it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.tokenizer, name)


def as_library(library, texts):
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_distinct_chunks_share_calls_of_the_library(library):
    r = random.Random(11)
    texts = [" ".join("".join(r.choices("aeinrstAÉ.,7", k=8)) for _ in range(100)) for _ in range(50)]
    mine = LibraryIds(default_tokenizer())
    mine.tokenizer = Counted(library)
    assert mine.of(texts) == as_library(library, texts)
    assert mine.tokenizer.calls <= 10


def test_chunks_that_hold_the_mark(library, tmp_path):
    """Whatever ids the mark has and wherever it stands, a text has the ids of the library."""
    import json

    from tokenizers import Tokenizer

    marked = ["\x01", "a\x01 b \x01\x01", "\x01x \x01", "\x01<|endoftext|>\x01 y", "\u0301 \x01\u0301 h\u0331", "\x01\x01\x01 " * 2000]
    texts = [t or "" for t in ODD] + noise(5, 200) + marked
    assert LibraryIds(default_tokenizer()).of(texts) == as_library(library, texts)
    assert [LibraryIds(default_tokenizer()).of([t])[0] for t in texts] == as_library(library, texts)
    with open(default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    letter = "\u0101</w>"
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if letter not in m]
    made = {"".join(m) for m in spec["model"]["merges"]}
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if t != letter or t in made}
    for unknown in (None, "!</w>"):
        spec["model"]["unk_token"] = unknown
        path = str(tmp_path / "other.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
        other = Tokenizer.from_file(path)
        assert other.encode("\x01", add_special_tokens=False).ids != library.encode("\x01", add_special_tokens=False).ids
        assert LibraryIds(path).of(texts) == as_library(other, texts)
