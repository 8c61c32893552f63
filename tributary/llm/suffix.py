"""Suffix orders in numpy: prefix doubling, prefix-free parsing, and an FM-index over a wavelet matrix."""

from __future__ import annotations

import numpy as np

from tributary.llm.hashing import between, grams, sums


def ranks(values: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first depth values; equal prefixes share a rank.

    ends[i] is where the text of position i ends; what lies beyond compares as
    nothing and before everything.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(values.max()).bit_length() + 1
    if bits > 31:
        values = np.unique(values, return_inverse=True)[1]
        bits = int(values.max()).bit_length() + 1
    # The first round takes as many values as fit into one integer.
    done = max(1, min(62 // bits, depth))
    rank = np.zeros(n, np.int64)
    for k in range(done):
        rank <<= bits
        rank[: n - k] += np.where(np.arange(k, n) < ends[: n - k], values[k:].astype(np.int64) + 1, 0)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
    at = np.arange(n)
    while done < depth:
        ahead = at + done
        second = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)], 0)
        joint = rank * (rank.max() + 1) + second
        order = np.argsort(joint)
        sorted_ = joint[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]]))
        if new.max() == rank.max():
            return new
        rank, done = new, 2 * done
    return rank


class PrefixFreeParse:
    """Texts as a dictionary of phrases and a parse.

    A stretch of W bytes whose rolling hash is 0 modulo EVERY is a trigger; a
    phrase runs from one trigger to the end of the next, so neighbours overlap
    by W bytes, and no phrase suffix longer than W is a proper prefix of
    another. Each distinct phrase is in the dictionary once. The order of the
    dictionary's suffixes, and below equal ones that of the parse's
    suffixes, make the order of all suffixes of all texts.
    """

    W, EVERY = 8, 24

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n, w = len(self.data), self.W
        self.text = np.repeat(np.arange(len(texts)), sizes)
        hit = np.flatnonzero(grams(self.data, w) % np.uint64(self.EVERY) == 0)
        hit = hit[(hit + w < self.ends[self.text[hit]]) & (hit > self.starts[self.text[hit]])] if len(hit) else hit
        filled = sizes > 0
        begin = np.sort(np.concatenate([self.starts[filled], hit]))
        self.begin = begin
        last = np.append(begin[1:], n)
        own_end = self.ends[self.text[begin]] if n else begin
        #: A phrase ends with the next trigger; the last one of a text with the text.
        self.end = np.where(last < own_end, np.minimum(last + w, own_end), own_end)
        self.final = last >= own_end
        raw = self.data.tobytes()
        known: dict[tuple[bytes, bool], int] = {}
        parse = np.empty(len(begin), np.int64)
        for k, (b, e, f) in enumerate(zip(begin.tolist(), self.end.tolist(), self.final.tolist(), strict=True)):
            parse[k] = known.setdefault((raw[b:e], f), len(known))
        self.parse, self.phrases = parse, list(known)

    def order_ranks(self, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the suffixes at these text positions (all, if none are named); ties only between wholly equal suffixes."""
        at = np.arange(len(self.data)) if at is None else at
        if not len(at):
            return np.zeros(0, np.int64)
        sizes = np.array([len(p) for p, _ in self.phrases], np.int64)
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(p for p, _ in self.phrases), np.uint8)
        by_suffix = ranks(flat, np.repeat(ends, sizes), int(sizes.max()))
        begins = ends - sizes
        order_of_phrase = by_suffix[begins[self.parse]] * 2 + np.array([f for _, f in self.phrases], np.int64)[self.parse]
        text_of_phrase = self.text[self.begin]
        phrase_end = np.searchsorted(text_of_phrase, text_of_phrase, side="right")
        below = ranks(order_of_phrase, phrase_end, int(np.bincount(text_of_phrase).max()))
        owner = np.searchsorted(self.begin, at, side="right") - 1
        first = by_suffix[begins[self.parse[owner]] + at - self.begin[owner]]
        return first * (int(below.max()) + 2) + np.where(self.final[owner], 0, np.append(below, 0)[owner + 1])

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, class): windows of length bytes in corpus order; neighbours with that long a common prefix share a class."""
        fits = [np.arange(s, max(s, e - length + 1)) for s, e in zip(self.starts, self.ends, strict=True)]
        at = np.concatenate(fits) if fits else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        order = at[np.argsort(self.order_ranks(at), kind="stable")]
        c = sums(self.data)
        h = between(c, order, order + length)
        return order, np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))


class WaveletMatrix:
    """Rank queries over a sequence of symbols: one bitmap with counts per bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        values = values.astype(np.uint64)
        for k in range(bits - 1, -1, -1):
            on = ((values >> np.uint64(k)) & np.uint64(1)).astype(bool)
            words = np.packbits(np.pad(on, (0, 64 - len(on) % 64)), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = len(on) - int(on.sum())
            self.levels.append((k, words, counts, zeros))
            values = np.concatenate([values[~on], values[on]])

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions end up when they follow their symbols' bits through all levels."""
        for k, words, counts, zeros in self.levels:
            w = at >> 6
            ones = counts[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before at."""
        return self.walk(symbols, at) - self.walk(symbols, np.zeros_like(at))

    def follow(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and where walk() takes them."""
        symbols = np.zeros(len(at), np.int64)
        for k, words, counts, zeros in self.levels:
            w, low = at >> 6, (at & 63).astype(np.uint64)
            bit = ((words[w] >> low) & np.uint64(1)).astype(np.int64)
            ones = counts[w] + np.bitwise_count(words[w] & ((np.uint64(1) << low) - np.uint64(1)))
            symbols |= bit << k
            at = np.where(bit, zeros + ones, at - ones)
        return symbols, at


class FmIndex:
    """A compressed full-text index of sequences of symbols (int64 from 1).

    It holds the transform as a wavelet matrix and every SAMPLEth position of
    each sequence; other positions are found by steps back to one of those.
    """

    SAMPLE = 4

    def __init__(self, sequences: np.ndarray, ends: np.ndarray):
        """sequences: all of them end to end, each followed by 0; ends[i]: where the sequence of position i ends, its 0 included.

        Suffixes are in full order, wholly equal ones as they stand: the symbols
        before them then come in the order of the suffixes that they begin.
        """
        n = len(sequences)
        suffixes = np.argsort(ranks(sequences, ends, int((ends - np.arange(n)).max(initial=1))), kind="stable")
        before = np.where(suffixes > 0, sequences[suffixes - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequences, minlength=int(sequences.max(initial=0)) + 1))])
        self.bwt = WaveletMatrix(before, max(1, int(sequences.max(initial=0)).bit_length()))
        every = np.arange(len(self.first) - 1)
        self.zero = self.bwt.walk(every, np.zeros_like(every))
        self.size = n
        start = np.maximum.accumulate(np.where(np.concatenate([[True], sequences[:-1] == 0]), np.arange(n), 0))
        kept = ((np.arange(n) - start) % self.SAMPLE == 0)[suffixes]
        self.kept, self.before = kept, np.cumsum(kept, dtype=np.int32)
        self.places = suffixes[kept].astype(np.int32)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequences where the suffixes of these rows start; none of them may start with 0."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            symbols, at = self.bwt.follow(rows[todo])
            rows[todo] = self.first[symbols] - self.zero[symbols] + at
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.places[self.before[rows] - 1] + steps

    def backward(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that have one more symbol in front."""
        known = symbols < len(self.first) - 1
        symbols, hi = np.where(known, symbols, 0), np.where(known, hi, lo)
        base = self.first[symbols] - self.zero[symbols]
        return base + self.bwt.walk(symbols, lo), base + self.bwt.walk(symbols, hi)

    def statistics(self, stream: np.ndarray, starts: np.ndarray, stride: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, capped at steps, of the patterns stream[s], stream[s + stride], ... of steps symbols.

        Returns how many of a pattern's last symbols occur in the index in a row,
        and the interval of that match (of the whole pattern where it is steps).
        """
        n = len(starts)
        lo, hi, matched = np.zeros(n, np.int64), np.full(n, self.size, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        for j in range(steps - 1, -1, -1):
            if j == steps - 1:  # the interval of one symbol needs no rank query
                s = np.minimum(stream[starts + j * stride], len(self.first) - 1)
                ends = np.append(self.first, self.first[-1])
                a, b = ends[s], ends[s + 1]
            else:
                a, b = self.backward(stream[starts[live] + j * stride], lo[live], hi[live])
            good = b > a
            live = live[good]
            lo[live], hi[live] = a[good], b[good]
            matched[live] += 1
            if not len(live):
                break
        return matched, lo, hi
