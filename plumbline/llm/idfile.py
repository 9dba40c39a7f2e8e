"""Token ids in binary files, by an adaptive context-mixing range coder.

A file holds the documents of one shard in order: a header with every document's
name and length and the list of token ids that occur, then blocks of at most
``BLOCK`` ids. Each block starts from a fresh model, carries its own checksum and
can be read alone.

A block is cut into equal stretches, the lanes, which are coded side by side, a
step at a time, with one model for all. The model counts which ids have followed
the two ids before (order 2, contexts hashed to slots), the one before (order 1)
and none (order 0), each in proportion to its count. The three predictions share
the coder's interval by weights that are learned for each pair of confidences
(how often either context has been seen): the share of an order is how often it
was the highest one to know the id that came. Counts and weights take in what
has been coded when the block has doubled in length, at the same steps for
writer and reader, so neither is sent.

An order's followers are kept as the sorted list of what was seen: a place in a
context's part of the list *is* an id in proportion to its count, so the reader
needs no search.

The range coder works on 64-bit integers and puts out 32 bits whenever the range
falls below 2^32; carries are added to the words before at the end.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"PLID\x02"
BLOCK = 1 << 20
LANES = 2048
_SHORTEST = 256  # ids of a lane, unless the block is shorter
_FIRST = 2  # steps before the model is first used
_SLOT_BITS = 17
_SHARE_BITS = 12  # weights of the orders sum to 2 ** _SHARE_BITS
_SHARE = 1 << _SHARE_BITS
_LEAST = 32  # the least weight of an order that knows its context
_LEVELS = 24  # confidences: a count's bit length
_STATE = np.arange(_LEVELS * _LEVELS)
_PRIOR = 8  # what all confidences together have learned stands for so many ids of each
_CHUNK = 1 << 16  # ids looked up at once
_WORD = np.uint64(32)
_FULL = np.uint64(0xFFFFFFFF)
_BELOW = np.uint64(1 << 32)


def _levels(counts: np.ndarray) -> np.ndarray:
    """The bit length of each count."""
    return np.frexp(counts.astype(np.float64))[1]


def _lanes(n: int, most: int) -> tuple[int, int]:
    """Lanes and steps of a block of ``n`` ids."""
    lanes = max(1, min(most, n // _SHORTEST))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _renewals(steps: int) -> list[int]:
    """The steps at which the model takes in what has been coded."""
    at, out = _FIRST, [0]
    while at < steps:
        out.append(at)
        at *= 4
    return [*out, steps]


def _slot(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Slots of order-2 contexts, from int64 ids."""
    return ((before * 0x9E3779B1 + last * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - _SLOT_BITS)


class _Order:
    """What has followed each context: sorted keys, context << bits | id."""

    def __init__(self, contexts: int, bits: int) -> None:
        self.contexts, self.bits = contexts, bits
        self.wide = (contexts << bits) >> 31  # keys need more than 31 bits
        self.keys = np.empty(0, dtype=np.int64)
        self._index()

    def add(self, fresh: list[np.ndarray]) -> None:
        self.keys = np.concatenate((self.keys, *fresh))
        self.keys.sort()
        self._index()

    def _index(self) -> None:
        k = self.keys
        self.count = np.bincount(k >> self.bits, minlength=self.contexts).astype(np.int32)  # of each context
        self.start = np.cumsum(self.count, dtype=np.int32) - self.count
        first = np.ones(len(k), dtype=bool)
        np.not_equal(k[1:], k[:-1], out=first[1:])
        self.starts = np.flatnonzero(first).astype(np.int32)  # of each context's ids
        self.lens = np.diff(self.starts, append=np.int32(len(k)))
        self.known = k[first].astype(np.int64 if self.wide else np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``keys`` are known, and where."""
        if not len(self.known):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        keys = keys.astype(self.known.dtype)
        at = np.minimum(self.known.searchsorted(keys), len(self.known) - 1)
        hit = np.flatnonzero(self.known.take(at) == keys)
        return hit, at.take(hit)


class _Model:
    """Counts and weights of one block; ``vocab``: ids are below it."""

    def __init__(self, vocab: int) -> None:
        self.vocab = vocab
        self.bits = max(1, int(vocab).bit_length())
        self.one, self.two = _Order(vocab + 1, self.bits), _Order(1 << _SLOT_BITS, self.bits)
        self.zero = np.ones(vocab, dtype=np.int32)
        self.seen = np.zeros((_LEVELS * _LEVELS, 3))  # which order knew the id, by both confidences
        self.known = (_STATE >= _LEVELS) * 2 + (_STATE % _LEVELS > 0)  # which orders know their context at all
        self._settle()

    def _settle(self) -> None:
        self.zero_start = np.cumsum(self.zero, dtype=np.int32) - self.zero
        self.zero_total = int(self.zero.sum())
        alike = np.stack([np.bincount(self.known, weights=self.seen[:, k], minlength=4) for k in range(3)], axis=1) + 1
        share = self.seen + _PRIOR * (alike / alike.sum(axis=1, keepdims=True))[self.known]
        share /= share.sum(axis=1, keepdims=True)
        weight = np.floor(share * (_SHARE - 3 * _LEAST)).astype(np.int64) + _LEAST
        weight[self.known < 2, 0] = 0  # an order that doesn't know its context
        weight[self.known % 2 == 0, 1] = 0
        weight[:, 2] = _SHARE - weight[:, 0] - weight[:, 1]
        self.weight = weight.ravel().astype(np.uint64)
        self.offset = (np.cumsum(weight, axis=1) - weight).ravel().astype(np.uint64)
        self.level_one, self.level_two = 3 * _levels(self.one.count), 3 * _LEVELS * _levels(self.two.count)

    def choices(self, slot: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the weights for these contexts begin."""
        at = self.level_two.take(slot)
        at += self.level_one.take(last)
        return at

    def learn(self, picked: np.ndarray, ids: np.ndarray, one: list[np.ndarray], two: list[np.ndarray]) -> None:
        self.seen += picked.reshape(-1, 3)
        self.zero += np.bincount(ids, minlength=self.vocab).astype(np.int32)
        self.one.add(one)
        self.two.add(two)
        self._settle()


class _Lanes:
    """The range coder of all lanes; each has room for a word a step."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.room = steps + 1
        self.words = np.zeros(lanes * self.room, dtype=np.uint32)
        self.first = np.arange(lanes) * self.room
        self.place = self.first.copy()

    def step(self, offset: np.ndarray, weight: np.ndarray, start: np.ndarray, width: np.ndarray, total: np.ndarray) -> None:
        """Code one id in each lane: the share of its order, and its share within."""
        unit = self.span >> np.uint64(_SHARE_BITS)
        add = unit * offset
        unit *= weight
        unit //= total
        add += unit * start
        self._add(add)
        self.span = unit * width
        short = self.span < _BELOW
        self.words[self.place] = self.low >> _WORD  # written over unless it is kept
        self.place += short
        shift = short * _WORD
        self.low <<= shift
        self.span <<= shift

    def _add(self, number: np.ndarray | np.uint64) -> None:
        self.low += number
        over = np.flatnonzero(self.low < number)
        at = self.place[over] - 1
        while len(at):  # carry into the words before
            self.words[at] += np.uint32(1)
            at = at[self.words[at] == 0] - 1

    def close(self) -> bytes:
        """Lane after lane, how many words and then the words."""
        self._add(_FULL)  # the last word: some number of the range whose other bits are zero
        self.words[self.place] = self.low >> _WORD
        counts = self.place - self.first + 1
        words = self.words.reshape(-1, self.room)[np.arange(self.room) < counts[:, None]]
        head = zlib.compress(counts.astype("<u4").tobytes(), 6)
        return struct.pack("<I", len(head)) + head + words.astype("<u4").tobytes()


def encode_block(ids: np.ndarray, vocab: int, most_lanes: int = LANES) -> bytes:
    """The bytes of one block of ids, all below ``vocab``."""
    lanes, steps = _lanes(len(ids), most_lanes)
    lined = np.zeros(lanes * steps, dtype=np.int32)
    lined[: len(ids)] = ids
    grid = np.full((steps + 2) * lanes, vocab)
    grid[2 * lanes :].reshape(steps, lanes)[:] = lined.reshape(lanes, steps).T
    every, last, before = grid[2 * lanes :], grid[lanes:-lanes], grid[: -2 * lanes]
    m, coder = _Model(vocab), _Lanes(lanes, steps)
    at_once = max(1, _CHUNK // lanes) * lanes
    place_bits = int(max(_CHUNK, lanes)).bit_length()
    place_mask = (1 << place_bits) - 1
    marks = [s * lanes for s in _renewals(steps)]
    for begin, end in zip(marks[:-1], marks[1:], strict=True):
        picked = np.zeros(_LEVELS * _LEVELS * 3, dtype=np.int64)
        fresh_one, fresh_two = [], []
        for a in range(begin, end, at_once):
            b = min(end, a + at_once)
            own, prev = every[a:b], last[a:b]
            slot = _slot(before[a:b], prev)
            start, width, total = m.zero_start.take(own), m.zero.take(own), np.full(b - a, m.zero_total, dtype=np.int32)
            pick = np.full(b - a, 2)
            rest = np.arange(b - a)
            for n, (order, context, fresh) in enumerate(((m.two, slot, fresh_two), (m.one, prev, fresh_one))):
                if end < marks[-1]:
                    fresh.append((context << m.bits) | own)
                if len(order.keys):
                    keys = context.take(rest)
                    keys <<= m.bits
                    keys |= own.take(rest)
                    keys <<= place_bits
                    keys |= rest
                    keys.sort()  # in order, so that the search stays in cache
                    hit, found = order.find(keys >> place_bits)
                    at = keys.take(hit) & place_mask
                    in_context = context.take(at)
                    pick[at] = n
                    width[at] = order.lens.take(found)
                    start[at] = order.starts.take(found) - order.start.take(in_context)
                    total[at] = order.count.take(in_context)
                    rest = np.flatnonzero(pick == 2)
            choice = m.choices(slot, prev)
            choice += pick
            picked += np.bincount(choice, minlength=len(picked))
            shares = (m.offset.take(choice), m.weight.take(choice), start.astype(np.uint64), width.astype(np.uint64), total.astype(np.uint64))
            for i in range(0, b - a, lanes):
                coder.step(*(x[i : i + lanes] for x in shares))
        if end < marks[-1]:
            m.learn(picked, every[begin:end], fresh_one, fresh_two)
    return coder.close()


def decode_block(data: bytes, n: int, vocab: int, most_lanes: int = LANES) -> np.ndarray:
    """The ``n`` ids of a block that encode_block made."""
    lanes, steps = _lanes(n, most_lanes)
    (head,) = struct.unpack("<I", data[:4])
    counts = np.frombuffer(zlib.decompress(data[4 : 4 + head]), dtype="<u4").astype(np.int64)
    raw = np.frombuffer(data[4 + head :], dtype="<u4")
    if len(counts) != lanes or counts.sum() != len(raw):
        raise ValueError("a block's lanes are damaged")
    words = np.zeros(len(raw) + 2 * lanes, dtype=np.uint64)  # zeros after each lane
    words[np.arange(len(raw)) + np.repeat(2 * np.arange(lanes), counts)] = raw
    place = np.cumsum(counts + 2) - counts - 2
    code = (words.take(place) << _WORD) | words.take(place + 1)  # from the range's lower end
    place += 2
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    m = _Model(vocab)
    history = np.full((steps + 2, lanes), vocab, dtype=np.int64)
    slots, picks = np.empty((steps, lanes), dtype=np.int64), np.empty((steps, lanes), dtype=np.int64)
    marks = _renewals(steps)
    for begin, end in zip(marks[:-1], marks[1:], strict=True):
        # the entries of all three orders in one list: order 2, order 1, order 0
        two, one = len(m.two.keys), len(m.one.keys)
        start = np.concatenate((m.two.starts, two + m.one.starts, two + one + m.zero_start))
        width = np.concatenate((m.two.lens, m.one.lens, m.zero))
        entry = np.repeat(np.arange(len(start), dtype=np.int32), width)
        mask = (1 << m.bits) - 1
        ids = np.concatenate((m.two.known & mask, m.one.known & mask, np.arange(vocab))).astype(np.int32)
        one_start = m.one.start + two
        for i in range(begin, end):
            before, last = history[i], history[i + 1]
            slot = _slot(before, last)
            seen_two, seen_one = m.two.count.take(slot), m.one.count.take(last)
            choice = m.choices(slot, last)
            unit = span >> np.uint64(_SHARE_BITS)
            above_two = code >= unit * m.weight.take(choice)
            above_one = code >= unit * m.offset.take(choice + 2)
            choice += above_two
            choice += above_one & above_two
            code -= unit * m.offset.take(choice)
            unit *= m.weight.take(choice)
            base = np.where(above_two, np.where(above_one, two + one, one_start.take(last)), m.two.start.take(slot))
            total = np.where(above_two, np.where(above_one, m.zero_total, seen_one), seen_two)
            unit //= total.astype(np.uint64)
            at = entry.take(np.minimum((code // unit).astype(np.int64), total - 1) + base)
            code -= unit * (start.take(at) - base).astype(np.uint64)
            span = unit * width.take(at).astype(np.uint64)
            history[i + 2] = ids.take(at)
            slots[i], picks[i] = slot, choice
            short = span < _BELOW
            shift = short * _WORD
            code <<= shift
            span <<= shift
            code |= words.take(place, mode="clip") * short
            place += short
        if end < steps:
            own = history[begin + 2 : end + 2].ravel()
            m.learn(np.bincount(picks[begin:end].ravel(), minlength=_LEVELS * _LEVELS * 3), own, [(history[begin + 1 : end + 1].ravel() << m.bits) | own], [(slots[begin:end].ravel() << m.bits) | own])
    return history[2:].T.ravel()[:n]


@dataclass
class Shard:
    """What a file holds: document names (text or None), their lengths in ids, and all ids."""

    names: list[str | None]
    lengths: np.ndarray
    ids: np.ndarray


def write_shard(shard: Shard, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """The bytes of a file."""
    ids = np.asarray(shard.ids, dtype=np.int64)
    total = len(ids)
    used = np.flatnonzero(np.bincount(ids, minlength=1))  # the file's alphabet
    rank = np.zeros(len(used) and used[-1] + 1, dtype=np.int64)
    rank[used] = np.arange(len(used))
    names = [None if n is None else n.encode() for n in shard.names]
    sizes = np.array([-1 if n is None else len(n) for n in names], dtype="<i4")
    head = zlib.compress(b"".join((np.asarray(shard.lengths, dtype="<u4").tobytes(), used.astype("<u4").tobytes(), sizes.tobytes(), b"".join(n for n in names if n))), 6)
    fixed = struct.pack("<IQIIII", len(used), total, block, lanes, len(names), len(head))
    out = [MAGIC, fixed, struct.pack("<I", zlib.crc32(head, zlib.crc32(fixed))), head]
    for at in range(0, total, block):
        own = ids[at : at + block]
        data = encode_block(rank[own], len(used), lanes)
        out.append(struct.pack("<III", len(own), len(data), zlib.crc32(data)))
        out.append(data)
    return b"".join(out)


def read_shard(data: bytes) -> Shard:
    """The contents of a file; ValueError if a checksum doesn't hold."""
    at = len(MAGIC) + 32
    if data[: len(MAGIC)] != MAGIC or len(data) < at:
        raise ValueError("not an id file")
    used_count, total, block, lanes, docs, head_size, head_crc = struct.unpack("<IQIIIII", data[len(MAGIC) : at])
    head = data[at : at + head_size]
    if zlib.crc32(head, zlib.crc32(data[len(MAGIC) : at - 4])) != head_crc:
        raise ValueError("the header is damaged")
    head, at = zlib.decompress(head), at + head_size
    cuts = np.cumsum([4 * docs, 4 * used_count, 4 * docs]).tolist()
    used, sizes = np.frombuffer(head[cuts[0] : cuts[1]], dtype="<u4"), np.frombuffer(head[cuts[1] : cuts[2]], dtype="<i4").tolist()
    names: list[str | None] = []
    place = cuts[2]
    for size in sizes:
        names.append(None if size < 0 else head[place : place + size].decode())
        place += max(size, 0)
    ids, first, number = np.empty(total, dtype=np.uint32), 0, 0
    while at < len(data):
        try:
            size, n, crc = struct.unpack("<III", data[at : at + 12])
            coded = data[at + 12 : at + 12 + n]
            if not 0 < size <= min(block, total - first):
                raise ValueError(f"block {number} is damaged")
            if zlib.crc32(coded) != crc:
                raise ValueError(f"block {number} is damaged")
            own = used[decode_block(coded, size, used_count, lanes)]
        except (zlib.error, struct.error) as e:
            raise ValueError(f"block {number} is damaged") from e
        ids[first : first + size] = own
        at, first, number = at + 12 + n, first + size, number + 1
    if first != total:
        raise ValueError("blocks are missing")
    return Shard(names, np.frombuffer(head[: 4 * docs], dtype="<u4").astype(np.int64), ids)
