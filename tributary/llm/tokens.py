"""Text to ids, one white-space-separated chunk at a time.

The tokenizer's pre-tokenizer never lets a piece span white space, and white
space itself yields nothing, so the ids of a text are those of its chunks in a
row. Chunks repeat, so each worker keeps what it has encoded.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import regex

from tributary.llm.common import on_leaving

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters of Unicode's White_Space property; Python's split() also takes 1C to 1F.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = "\x1c\x1d\x1e\x1f"

#: Chunks that a worker keeps in each of its two generations, unless told otherwise.
KEPT = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str) -> list[str]:
    if any(c in text for c in _ODD):
        return [c for c in _SPACES.split(text) if c]
    return text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


#: The pattern of tokenizers whose pieces are letters, one digit, or marks; none of them holds white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pieces_in_chunks(spec: dict) -> bool:
    """Whether a tokenizer's file says that its text is NFC, lower case, white space as single spaces, and cut by PIECES into byte-level words.

    White space then yields nothing and divides a text into chunks that do not
    depend on each other. Of any other file nothing is assumed.
    """
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
    kind, *rest = [p.get("type") for p in pre.get("pretokenizers", [])] or [None]
    plain = kind == "Split" and rest == ["ByteLevel"] and pre["pretokenizers"][0] == split
    byte_level = plain and not pre["pretokenizers"][1].get("add_prefix_space") and not pre["pretokenizers"][1].get("use_regex")
    special = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    unbroken = not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
    return bool(byte_level and norm.get("normalizers") == [{"type": "NFC"}, spaces, {"type": "Lowercase"}] and special and unbroken and not spec.get("post_processor"))


class Splitter:
    """Chunks to words as a tokenizer's normalizer and pre-tokenizer give them. Files of any other shape are refused."""

    #: Chunks that one pass of the pattern takes.
    BLOCK = 4096

    def __init__(self, spec: dict):
        if not pieces_in_chunks(spec):
            raise ValueError("a tokenizer file whose normalizer or pre-tokenizer this encoder does not know")
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.piece = regex.compile(PIECES)
        self.piece_or_end = regex.compile(f"{PIECES}|\\n")

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def in_letters(self, piece: str) -> str:
        """The piece's bytes as letters; printable ASCII stands for itself."""
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))

    def one(self, chunk: str) -> list[str | int]:
        """Words as byte letters, and ids of special tokens that stand in the chunk."""
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += map(self.in_letters, self.piece.findall(self.normal(part)))
        return out

    def many(self, new: list[str]) -> list[list[str | int]]:
        """one() of each chunk. Chunks are normalized and split with a line end between, which no piece or composition crosses."""
        out: list[list[str | int]] = []
        for i in range(0, len(new), self.BLOCK):
            block = new[i : i + self.BLOCK]
            text = "\n".join(block)
            if any(s in text for s in self.special):
                out += map(self.one, block)
                continue
            text = self.normal(text)
            found = self.piece_or_end.findall(text)
            if not (text.isascii() and text.replace("\n", "").isprintable()):
                found = [p if p == "\n" else self.in_letters(p) for p in found]
            ends = [k for k, p in enumerate(found) if p == "\n"]
            out += [found[a:b] for a, b in zip([0, *[k + 1 for k in ends]], [*ends, len(found)], strict=True)]
        return out


def packed(lists: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    ends = (4 * np.cumsum([len(x) for x in lists])).tolist()
    raw = np.array([i for x in lists for i in x], "<u4").tobytes()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class ChunkTable:
    """chunk -> value, for those that a batch needs and most that earlier batches needed."""

    def __init__(self, fill: Callable[[list[str]], Iterable], kept: int = KEPT):
        self.fill, self.now, self.old, self.kept = fill, {}, {}, kept

    def of(self, lists: list[list[str]]) -> dict:
        """A table that has every chunk of the lists.

        What filling makes is many small lists without a cycle among them, so
        the collector of cycles is off meanwhile.
        """
        on = gc.isenabled()
        gc.disable()
        try:
            return self._of(lists)
        finally:
            if on:
                gc.enable()

    def _of(self, lists: list[list[str]]) -> dict:
        missing: set[str] = set()
        for x in lists:
            missing.update(filterfalse(self.now.__contains__, x))
        if self.now and len(self.now) + len(missing) > 2 * self.kept:
            self.old, self.now = self.now, {}
            missing.update(*lists)
        if missing and self.old:
            again = missing.intersection(self.old)
            self.now.update((c, self.old[c]) for c in again)
            missing -= again
        if missing:
            new = sorted(missing)
            self.now.update(zip(new, self.fill(new), strict=True))
        return self.now


class LibraryIds:
    """Ids of texts as little-endian unsigned 32-bit integers, all of them made by the tokenizers library's encode (without offsets where it takes many).

    Where the tokenizer's file shows that no piece reaches over white space, each
    distinct chunk is encoded once, many in one text, which costs less than a
    call a chunk; with any other file, each whole text.
    """

    #: Stands as a chunk of its own after each chunk of such a text, where its id ends the chunk's ids.
    MARK = "\x01"

    #: Chunks in a text, and texts in a call.
    BLOCK, CALL = 32, 32

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_chunk = pieces_in_chunks(json.load(f))
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.table = ChunkTable(self._fill)

    def _ids(self, text: str) -> bytes:
        return struct.pack(f"<{len(x)}I", *x) if (x := self.tokenizer.encode(text, add_special_tokens=False).ids) else b""

    def _fill(self, new: list[str]) -> Iterator[bytes]:
        for i in range(0, len(new), self.BLOCK * self.CALL):
            yield from self._together(new[i : i + self.BLOCK * self.CALL])

    def _together(self, part: list[str]) -> Iterable[bytes]:
        """Ids of chunks. Each mark gives its one id, so as many of these as chunks means that no chunk gives it; else each is encoded alone."""
        if len(self.mark) != 1:
            return map(self._ids, part)
        end = f" {self.MARK} "
        texts = [end.join([*part[i : i + self.BLOCK], ""]) for i in range(0, len(part), self.BLOCK)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x.ids for x in found), "<u4")
        ends = np.flatnonzero(flat == self.mark[0])
        if len(ends) != len(part):
            return map(self._ids, part)
        raw, ends = flat.tobytes(), 4 * ends
        return [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], ends.tolist(), strict=False)]

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [self._ids(t) for t in texts]
        lists = [chunks(t) for t in texts]
        get = self.table.of(lists).__getitem__
        return [b"".join(map(get, x)) for x in lists]


@functools.lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


on_leaving("library ids", library_ids.cache_clear)
