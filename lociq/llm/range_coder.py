"""Adaptive context-mixing range coder for blocks of token ids.

Each block is coded on its own from a fresh model, so blocks can be read alone. Many blocks advance in
lockstep ("lanes"): one numpy operation serves one id of every block, and each id narrows the range once.

Within a block an id is numbered by the order of its first appearance. Per id the model asks:

1. is it the guess, which is what the last two ids predict (order 2) or what the last id predicts (order 1), whichever is
   surer? The probability mixes, in the logistic domain, what both predictions' confidence has been worth in this block
   so far; these weights are trained as the block goes on;
2. else which it is, by the counts of the block (order 0), which are laid out anew each time the block has grown by an
   eighth, with an escape to the ids that are newer than this: one of them, or a new one.

The values of the new ids follow at the end, in digits of 16 bits, all equally likely (as many as the block's largest id needs).
The coder's state is held in doubles, but all its values are whole numbers below 2^53 (quotients are rounded down), so any two machines agree.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK = 4096  # ids in a block; also the most distinct ids
_WORD = 1 << 16
_LEAST, _TOP = 2.0**32, 2.0**48  # the range stays between them
_SLOTS = 4096  # contexts of two ids are hashed into so many slots
_SUREST = 7  # confidence goes from 0 (nothing predicted) to 7
_HEAD = struct.Struct("<4sHHI")  # magic, ids less one, digits of a new id, crc32 of the ids as uint32
_MAGIC = b"LCM3"

#: Probabilities of 16 bits by logit of 6 fractional bits, from -8 to 8.
_SQUASH = np.array([min(65500, max(32, round(65536 / (1 + math.exp(-x / 64))))) for x in range(-512, 513)], dtype=np.int64)
#: What a prediction is worth at first, as a logit of 14 fractional bits, by confidence and whether it is for the guess.
_START = np.array([round((math.log(sure) - 2 if mine else -2) * (1 << 13)) if sure else -(1 << 15) for sure in range(_SUREST + 1) for mine in (0, 1)])


class _Writer:
    """Range encoder for all lanes; a word may have 17 bits until carries are resolved at the end."""

    def __init__(self, lanes: int, room: int) -> None:
        self.low, self.range = np.zeros(lanes), np.full(lanes, _TOP)
        self.out, self.at = np.zeros((lanes, room), np.int32), np.arange(lanes) * room

    def narrow(self, lanes: slice | np.ndarray, below: np.ndarray, span: np.ndarray) -> None:
        low, at, out = self.low[lanes] + below, self.at[lanes], self.out.reshape(-1)
        short = span < _LEAST
        word = np.floor(low / _LEAST)
        out[at] = word  # with its carry; the next one takes its place if the lane does not move on
        self.low[lanes] = np.where(short, (low - word * _LEAST) * _WORD, low)
        self.range[lanes] = span * np.where(short, float(_WORD), 1.0)
        self.at[lanes] = at + short

    def sizes(self) -> np.ndarray:
        return self.at - np.arange(len(self.at)) * self.out.shape[1]

    def grow(self, more: int) -> None:
        if self.sizes().max() + more > self.out.shape[1]:
            sizes = self.sizes()
            self.out = np.pad(self.out, ((0, 0), (0, self.out.shape[1])))
            self.at = np.arange(len(sizes)) * self.out.shape[1] + sizes

    def words(self) -> list[bytes]:
        self.grow(3)
        lanes, sizes, low = np.arange(len(self.low)), self.sizes(), self.low.astype(np.int64)
        for word in (low >> 32, (low >> 16) & (_WORD - 1), low & (_WORD - 1)):
            self.out[lanes, sizes] = word
            sizes += 1
        over = self.out >> 16
        while over.any():
            self.out &= _WORD - 1
            self.out[:, :-1] += over[:, 1:]
            over = self.out >> 16
        return [row[:n].astype("<u2").tobytes() for row, n in zip(self.out, sizes, strict=True)]


class _Reader:
    def __init__(self, coded: list[bytes]) -> None:
        lanes, room = len(coded), max(len(x) // 2 for x in coded) + 4
        words = np.zeros((lanes, room), np.uint16)
        for row, x in zip(words, coded, strict=True):
            row[: len(x) // 2] = np.frombuffer(x, "<u2")
        self.code, self.range = words[:, :3] @ np.array([_LEAST, _WORD, 1]), np.full(lanes, _TOP)
        self.words, self.at = words.reshape(-1), np.arange(lanes) * room + 3

    def narrow(self, lanes: slice | np.ndarray, below: np.ndarray, span: np.ndarray) -> None:
        at, short = self.at[lanes], span < _LEAST
        times = np.where(short, float(_WORD), 1.0)
        self.code[lanes] = (self.code[lanes] - below) * times + self.words.take(at, mode="clip") * short
        self.range[lanes] = span * times
        self.at[lanes] = at + short

    def value(self, lanes: slice | np.ndarray, part: np.ndarray, kinds: np.ndarray | int) -> np.ndarray:
        return np.minimum(np.floor(self.code[lanes] / part), kinds - 1)


class _Model:
    """What each lane has learned, in flat tables with a stretch for each lane.

    A prediction is the id's number and three bits of confidence. ``ids`` holds the numbers of the block's ids, by place and lane.
    """

    def __init__(self, coder: _Writer | _Reader, ids: np.ndarray) -> None:
        lanes = ids.shape[1]
        self.coder, self.reading, self.ids = coder, isinstance(coder, _Reader), ids
        self.table = np.zeros(lanes * (BLOCK + 1 + _SLOTS), np.uint16)  # predictions of order 1, then of order 2
        self.base = np.array([[0], [lanes * (BLOCK + 1)]]) + np.arange(lanes) * np.array([[BLOCK + 1], [_SLOTS]])
        #: what each order's state is worth, as logits of 14 fractional bits
        self.worth = np.tile(_START, 2 * lanes)
        self.state_base = np.arange(2 * lanes).reshape(2, lanes) * len(_START)
        self.counts, self.seen = np.zeros((lanes, BLOCK), np.int16), np.ones(lanes, np.int64)
        self.counts[:, 0] = 1  # a block's first id is number 0
        self.context = np.full((2, lanes), [[BLOCK], [0]])  # the last id, and the slot of the last two
        self.until = 0  # so many ids are in the counts

    def lay_out(self, n: int, t: int, due: int) -> None:
        """Lay out the first ``n`` lanes' counts of their first ``t`` ids, until ``due`` are coded: the number each slot stands for,
        and each number's first slot. The escape has as many as numbers were seen once, and at least half as many as can be new."""
        lane, width = np.arange(n), int(self.seen[:n].max())
        if t:
            new = np.bincount((self.ids[self.until : t, :n] + lane * width).reshape(-1), minlength=n * width)
            self.counts[:n, :width] += new.reshape(n, width).astype(np.int16)
        counts = self.counts[:n, :width]
        self.until, self.escape, self.known = t, width, self.seen[:n].copy()
        if self.reading:
            self.slots = np.repeat(np.tile(np.arange(width, dtype=np.uint16), n), counts.reshape(-1))
        self.slot_base = lane * (t + 1)
        self.spare = 2 + np.maximum((counts == 1).sum(axis=1), (due - t) // 2)
        self.size = 1.0 + t + self.spare
        begins = np.zeros((n, width + 2), np.int16)
        np.cumsum(counts, axis=1, out=begins[:, 1:-1])
        begins[:, -1] = self.size
        self.begins, self.begins_base = begins.reshape(-1), lane * (width + 2)
        self.most = _WORD - 2 * self.size

    def trim(self, n: int) -> None:
        """Go on with the first ``n`` lanes."""
        for name in ("known", "slot_base", "spare", "size", "begins_base", "most"):
            setattr(self, name, getattr(self, name)[:n])

    def run(self, active: list[int]) -> None:
        """All steps; ``active``: how many of the lanes have an id at each of them."""
        due = 0
        for t, n in enumerate(active):
            if t == due:
                due = t + max(8, t >> 3)
                self.lay_out(n, t, due)
            elif n < len(self.size):
                self.trim(n)
            if not self.reading and t % 64 == 0:
                self.coder.grow(64 + 1)  # a word an id, and one that does not stay
            self.step(t, n)

    def step(self, t: int, n: int) -> None:
        """One id of each of the first ``n`` lanes."""
        lanes, coder = slice(n), self.coder
        at = self.base[:, :n] + self.context[:, :n]
        old = self.table.take(at)
        guesses, sure = old >> 3, old & _SUREST
        guess = np.where(sure[1] >= sure[0], guesses[1], guesses[0])
        states = self.state_base[:, :n] + (2 * sure + (guesses == guess))
        worth = self.worth.take(states)
        p = _SQUASH.take((worth[0] + worth[1] >> 8) + 512, mode="clip")
        span = coder.range[lanes]
        hits = np.floor(span / _WORD) * np.minimum(p, self.most)
        unit = np.floor((span - hits) / self.size)
        if self.reading:
            slot = (coder.code[lanes] - hits) / unit
            hit, newer = slot < 0, np.flatnonzero(slot >= self.until + 1)
            symbol = self.slots.take(self.slot_base + np.minimum(np.maximum(slot, 0), self.until).astype(np.int64))
        else:
            out = self.ids[t, :n]
            hit = out == guess
            newer = np.flatnonzero((out >= self.known) & ~hit)
            symbol = np.minimum(out, self.escape)
        begin = self.begins_base + symbol
        first = self.begins.take(begin)
        below, width = hits + unit * first, unit * (self.begins.take(begin + 1) - first)
        if self.reading:
            out = np.where(hit, guess, symbol)
        if len(newer):
            # The escape's part is dealt among the numbers that are not in the counts yet and the next one.
            known, seen, rest = self.known[newer], self.seen[newer], hits[newer] + unit[newer] * (self.until + 1)
            kinds = seen - known + 1
            part = np.floor(unit[newer] * self.spare[newer] / kinds)
            if self.reading:
                out[newer] = known + np.minimum(np.floor((coder.code[newer] - rest) / part), kinds - 1)
            ids = out[newer]
            below[newer], width[newer] = rest + part * (ids - known), part
            self.seen[newer] = seen + (ids == seen)
        coder.narrow(lanes, np.where(hit, 0, below), np.where(hit, hits, width))
        if self.reading:
            self.ids[t, :n] = out
        self.worth[states] = worth + ((np.where(hit, _WORD, 0) - p) >> 4)
        self.table[at] = np.where(guesses == out, old + (sure < _SUREST), out * 8 + 1)
        self.context[1, :n] = (self.context[0, :n] * 0x9E5 + out * 0x6D) & (_SLOTS - 1)
        self.context[0, :n] = out

    def name(self, names: np.ndarray, digits: np.ndarray) -> None:
        """Code the values of all numbers, each lane's in their order, the highest digit first."""
        coder = self.coder
        for number in range(int(self.seen.max())):
            for digit in (1, 0):
                lanes = np.flatnonzero((self.seen > number) & (digits > digit))
                if not len(lanes):
                    continue
                part = np.floor(coder.range[lanes] / _WORD)
                if self.reading:
                    value = coder.value(lanes, part, _WORD)
                    names[lanes, number] |= value.astype(np.uint32) << 16 * digit
                else:
                    coder.grow(3)
                    value = (names[lanes, number] >> 16 * digit) & (_WORD - 1)
                coder.narrow(lanes, part * value, part)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in the order of their first appearance, and the number of each id among them."""
    dense = ids if ids.max() < 1 << 20 else np.unique(ids, return_inverse=True)[1]
    place, first = np.arange(len(ids)), np.empty(int(dense.max()) + 1, np.int64)
    first[dense[::-1]] = place[::-1]
    at = first[dense]
    is_first = at == place
    return ids[is_first], (np.cumsum(is_first) - 1)[at]


def _order(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Lanes by falling length, and how many of them have an id at each step."""
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max()) + 1), side="right")
    return order, active.tolist()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of 1 to BLOCK ids (uint32 values) each; equal blocks give equal bytes."""
    if not blocks:
        return []
    order, active = _order(np.array([len(b) for b in blocks]))
    local, names, digits = np.zeros((len(blocks), len(active)), np.uint16), np.zeros((len(blocks), len(active)), np.uint32), np.ones(len(blocks), np.int64)
    heads = []
    for lane, i in enumerate(order):
        ids = np.asarray(blocks[i], np.uint32)
        own, local[lane, : len(ids)] = _numbered(ids)
        names[lane, : len(own)] = own
        digits[lane] = 1 + int(own.max() >= _WORD)
        heads.append(_HEAD.pack(_MAGIC, len(ids) - 1, digits[lane], zlib.crc32(ids.astype("<u4").tobytes())))
    writer = _Writer(len(blocks), len(active) + 8)
    model = _Model(writer, np.ascontiguousarray(local.T))
    model.run(active)
    model.name(names, digits)
    out: list[bytes] = [b""] * len(blocks)
    for i, head, words in zip(order, heads, writer.words(), strict=True):
        out[i] = head + words
    return out


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError if a block's checksum does not fit."""
    if not coded:
        return []
    heads = [_HEAD.unpack_from(x) for x in coded]
    if any(h[0] != _MAGIC for h in heads):
        raise ValueError("not a block of token ids")
    order, active = _order(np.array([h[1] + 1 for h in heads]))
    model = _Model(_Reader([coded[i][_HEAD.size :] for i in order]), np.zeros((len(active), len(coded)), np.uint16))
    model.run(active)
    names = np.zeros((len(coded), len(active)), np.uint32)
    model.name(names, np.array([heads[i][2] for i in order]))
    local = np.ascontiguousarray(model.ids.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for lane, i in enumerate(order):
        out[i] = names[lane, local[lane, : heads[i][1] + 1]]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][3]:
            raise ValueError("a block of token ids is damaged")
    return out
