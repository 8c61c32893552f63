"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a word's prefix is that of a shorter prefix and one more
token, and the pair of last tokens decides whether that is so: the pair is
legal exactly if no merge would ever join the two across their border. So one
token per trie node, the last of its prefix's encoding, is all the state that
a deeper node needs. Distinct words go into a trie, which is walked depth
first; a prefix that many words share is worked out once.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow, on_leaving, pieces, prepare, rows_of, text_of
from tributary.llm.tokens import ChunkTable, Splitter, chunks, default_tokenizer, packed


#: Chunks that a worker keeps in each of two generations with their ids and text, unless told otherwise, and pairs of tokens that it knows to be legal or not.
KEPT, PAIRS = 300_000, 500_000

#: Bytes of text that one look at the tables takes, at most and for each chunk kept: what a look needs is all in them at once, so few kept chunks ask for short looks.
PIECE, PIECE_A_CHUNK = 4 << 20, 32


class TrieBpe:
    """A vocabulary of merges, with an end-of-word suffix or without."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.splitter = Splitter(spec)
        self.names = {i: t for t, i in self.vocab.items()}
        self.names.update({i: t for t, i in self.splitter.special.items()})
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = self.vocab[a + b]
            self.merges[self.vocab[a], self.vocab[b]] = r
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (self.vocab[a], self.vocab[b]), r
        self.longest = max((len(t) for t in self.vocab if not t.startswith("<|")), default=1)
        self.legal: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at this border of the token while it grew, each with the rank of the merge that ended it."""
        known = self.edges[side]
        if token not in known:
            out, until, t = [], float("inf"), token
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.rank[t], self.parts[t][side]
            known[token] = out
        return known[token]

    def pair_is_legal(self, left: int, right: int) -> bool:
        """Whether left and right side by side stay two tokens."""
        key = left << 32 | right
        if (known := self.legal.get(key)) is None:
            merges = self.merges
            known = not any(
                (m := merges.get((a, b))) is not None and m < a_until and m <= b_until
                for a, a_until in self._edge(left, 1)
                for b, b_until in self._edge(right, 0)
            )
            if len(self.legal) > PAIRS:
                self.legal.clear()
            self.legal[key] = known
        return known

    def _last(self, word: str, n: int, states: list[tuple[int, int]], end: str) -> tuple[int, int]:
        """The last token of the encoding of word's first n letters (with end on the last), and how many letters it covers."""
        vocab = self.vocab
        for size in range(1, min(n, self.longest) + 1):
            token = vocab.get(word[n - size : n] + end)
            if token is not None and (size == n or self.pair_is_legal(states[n - size][0], token)):
                return token, size
        raise ValueError(f"no token ends at letter {n} of a word of {len(word)}")

    def words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, given as byte letters: one depth-first walk of their trie.

        Sorted order is the preorder of the trie, and the stack of states is the
        path from its root; only what two neighbours don't share is worked out.
        """
        out: dict[str, list[int]] = {}
        token_of, legal, longest = self.vocab.get, self.legal, self.longest
        states: list[tuple[int, int]] = [(-1, 0)]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word), len(states) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            inner = len(word) - 1 if self.suffix else len(word)
            for n in range(len(states), inner + 1):  # _last(word, n, states, ""), in place
                for size in range(1, min(n, longest) + 1):
                    token = token_of(word[n - size : n])
                    if token is not None:
                        if size == n:
                            break
                        left = states[n - size][0]
                        known = legal.get(left << 32 | token)
                        if known or known is None and self.pair_is_legal(left, token):
                            break
                else:
                    raise ValueError(f"no token ends at letter {n} of a word of {len(word)}")
                states.append((token, size))
            token, size = self._last(word, len(word), states, self.suffix) if self.suffix else states[len(word)]
            ids, at = [token], len(word) - size
            while at:
                token, size = states[at]
                ids.append(token)
                at -= size
            out[word] = ids[::-1]
            before = word
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in its file, a tokenizer's text is its tokens with a space between."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def trie_chunks(path: str, kept: int = KEPT) -> ChunkTable:
    """chunk -> (ids as little-endian unsigned 32-bit integers, their decoded text). A chunk of one word shares the word's."""
    bpe = TrieBpe(path)
    special = {i: (i.to_bytes(4, "little"), bpe.decode([i])) for i in bpe.splitter.special.values()}
    known: dict[str | int, tuple[bytes, str]] = dict(special)

    def fill(new: list[str]) -> Iterable[tuple[bytes, str]]:
        if len(known) > kept:
            known.clear()
            known.update(special)
        lists = bpe.splitter.many(new)
        words = bpe.words({p for x in lists for p in x}.difference(known))
        known.update(zip(words, zip(packed(list(words.values())), map(bpe.decode, words.values()), strict=True), strict=True))
        for x in lists:
            if len(x) == 1:
                yield known[x[0]]
            else:
                got = [known[p] for p in x]
                yield b"".join([g[0] for g in got]), " ".join([g[1] for g in got])

    return ChunkTable(fill, kept)


on_leaving("trie", trie_chunks.cache_clear)

CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _codes(batches: Iterable[pa.RecordBatch], table: ChunkTable, schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, min(PIECE, PIECE_A_CHUNK * table.kept)):
            lists = [chunks(t) for t in b.column("text").to_pylist()]
            known = table.of(lists)
            out: dict[str, list] = {"n_tokens": [], "a": [], "b": []}
            for x in lists:
                got = [known[c] for c in x]
                ids, text = b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])
                out["n_tokens"].append(len(ids) // 4)
                out["a"].append(hashlib.sha256(ids).hexdigest() if digest else ids)
                out["b"].append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            yield rows_of({"doc_id": b.column("doc_id"), "n_tokens": out["n_tokens"], schema.names[2]: out["a"], schema.names[3]: out["b"]}, schema)


def _encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, schema: pa.Schema, ddl: str, digest: bool, kept: int = KEPT) -> DataFrame:
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def encode(batches):
        return _codes(batches, trie_chunks(path, kept), schema, digest)

    return arrow(rows, "trie", encode, ddl)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian) and decoded, one row per input row.

    No shuffle. Null and empty texts have no ids and decode to the empty text.
    Ids may be null or repeat: rows are taken one by one. An empty table gives no
    rows. Columns other than the two named are not looked at.
    """
    return _encoded(docs, id_col, text_col, tokenizer, CODES, "doc_id long, n_tokens long, ids binary, decoded string", False)


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, kept: int = KEPT) -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of the ids and the decoded text. kept: chunks that workers keep, which costs memory and saves time."""
    return _encoded(docs, id_col, text_col, tokenizer, DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True, kept)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
