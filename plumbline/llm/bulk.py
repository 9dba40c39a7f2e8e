"""Cutting many texts into pre-tokens at once, and looking their ids up, with numpy.

The UTF-8 bytes of a batch of texts stand one after the other in one buffer. Every
byte gets the class of its character (space, letter, digit, other), pre-tokens
begin where the class changes or the tokenizer's pattern says so, and a
pre-token of up to 15 bytes *is* a 128-bit key (its bytes and its length), which is
looked up in a hash table of numpy arrays: exact, and all at once. A pre-token
that isn't in the table is split by the tokenizer and entered; longer ones are
split each time they are met.

Only for texts all of whose characters have a known class, see ``PLAIN``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
_TAIL = 5  # a byte inside a character, until its class is known
_MARK = 0xFF  # stands between texts; no byte of UTF-8
_LONGEST = 15
#: Characters whose class is known: below U+0370, and punctuation and signs from U+2000 to U+20CF.
_KNOWN = [*range(0x370), *range(0x2000, 0x20D0)]
PLAIN = re.compile(r"[\x00-ͯ -⃏]*")
# White space as the patterns of tokenizer files mean it, below U+20D0.
_SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
# What an apostrophe takes with it.
_ONE, _TWO = ["s", "t", "m", "d"], ["re", "ve", "ll"]


def _classes() -> np.ndarray:
    out = np.full(0x2100, OTHER, dtype=np.uint8)
    for c in _KNOWN:
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c in _SPACES else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    return out


_CLASS = _classes()
_FIRST_BYTE = np.full(256, _TAIL, dtype=np.uint8)
_FIRST_BYTE[:128] = _CLASS[:128]
_FIRST_BYTE[_MARK] = BREAK
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF] * 8, dtype=np.uint64)
_REST = np.array([0] * 9 + [(1 << 8 * n) - 1 for n in range(1, 8)], dtype=np.uint64)


def _char_classes(buf: np.ndarray) -> np.ndarray:
    """The class of every byte's character."""
    out = _FIRST_BYTE.take(buf)
    two = np.flatnonzero((buf >= 0xC2) & (buf < 0xE0))
    if len(two):
        own = _CLASS.take(((buf[two] & np.int16(0x1F)) << 6) | (buf[two + 1] & 0x3F))
        out[two] = out[two + 1] = own
    three = np.flatnonzero((buf >= 0xE0) & (buf < 0xF0))
    if len(three):
        own = _CLASS.take(((buf[three] & np.int16(0x0F)) << 12) | ((buf[three + 1] & np.int16(0x3F)) << 6) | (buf[three + 2] & 0x3F))
        out[three] = out[three + 1] = out[three + 2] = own
    return out


def cut(buf: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of a marked buffer begin and end.

    ``words``: white space is dropped and digits stand alone; else runs of digits
    stay together, a space goes with what follows it, and white space is kept.
    """
    kind = _char_classes(buf)
    begins = np.empty(len(buf), dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    if words:
        begins |= (kind == DIGIT) & ((buf & 0xC0) != 0x80)
    quote = np.flatnonzero((buf == ord("'")) & begins)
    if not words:
        quote = quote[buf[quote - 1] != ord(" ")]
    if len(quote):
        one, two = buf[quote + 1], buf[quote + 2]
        size = np.zeros(len(quote), dtype=np.int64)
        for s in _ONE:
            size[one == ord(s)] = 1
        for s in _TWO:
            size[(one == ord(s[0])) & (two == ord(s[1]))] = 2
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[quote + size + 1] = True
    start = np.flatnonzero(begins)
    own = kind.take(start)
    if words:
        keep = np.flatnonzero((own != SPACE) & (own != BREAK))
        return start.take(keep), start.take(keep + 1)  # the buffer ends with a mark, so there is a next one
    blank = np.flatnonzero(own == SPACE)
    if len(blank):
        first, stop = start[blank], start[blank + 1]
        inside = buf[stop] != _MARK
        lent = inside & (buf[stop - 1] == ord(" "))  # the last space goes with what follows
        start[blank[lent] + 1] -= 1
        last = stop - 1
        for _ in range(2):
            last -= (buf[last] & 0xC0) == 0x80
        apart = inside & ~lent & (last > first)  # the last character stands alone
        gone = blank[lent & (stop - 1 == first)]
        start, own = np.delete(start, gone), np.delete(own, gone)
        if apart.any():
            start = np.concatenate((start, last[apart]))
            own = np.concatenate((own, np.full(int(apart.sum()), SPACE, dtype=own.dtype)))
            order = np.argsort(start, kind="stable")
            start, own = start[order], own[order]
    keep = np.flatnonzero(own != BREAK)
    return start.take(keep), start.take(keep + 1)


def _roomy(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` entries, doubled if it must grow."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


class Table:
    """Pre-tokens of up to 15 bytes and their ids, in a hash table with open places."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self._clear(min(limit, 1 << 16))

    def _clear(self, room: int) -> None:
        self.bits = max(4, int(2 * room - 1).bit_length())
        self.low, self.high = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.uint64)  # a high of 0 is an open place
        self.row = np.zeros(1 << self.bits, dtype=np.int32)
        self.rows, self.held = 0, 0  # pre-tokens, and ids in the pool
        self.first, self.pool = np.zeros(1024, dtype=np.int64), np.empty(1024, dtype=np.uint32)  # with room to grow

    def __len__(self) -> int:
        return self.rows

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        place = self._place(low, high)
        found = self.row.take(place)
        left = np.flatnonzero((self.low.take(place) != low) | (self.high.take(place) != high))
        found[left] = -1
        place = place.take(left)
        while len(left):
            taken = np.flatnonzero(self.high.take(place))  # an open place ends the search
            left, place = left.take(taken), (place.take(taken) + 1) & ((1 << self.bits) - 1)
            same = (self.low.take(place) == low.take(left)) & (self.high.take(place) == high.take(left))
            found[left[same]] = self.row.take(place[same])
            left, place = left[~same], place[~same]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, ids: list[list[int]]) -> None:
        """Enter keys that aren't there, each once; starts over when there are too many."""
        if len(self) + len(low) > self.limit:
            self._clear(max(len(low), min(self.limit, 1 << 16)))
        elif 2 * (len(self) + len(low)) > 1 << self.bits:
            self._grow(len(self) + len(low))
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, rows = int(count.sum()), np.arange(self.rows, self.rows + len(ids), dtype=np.int32)
        self.pool = _roomy(self.pool, self.held + total)
        self.first = _roomy(self.first, self.rows + len(ids) + 1)
        self.pool[self.held : self.held + total] = np.fromiter((i for own in ids for i in own), dtype=np.uint32, count=total)
        np.cumsum(count, out=count)
        self.first[self.rows + 1 : self.rows + len(ids) + 1] = self.held + count
        self.rows, self.held = self.rows + len(ids), self.held + total
        self._enter(low, high, rows)

    def _grow(self, room: int) -> None:
        held = np.flatnonzero(self.high)
        low, high, row = self.low[held], self.high[held], self.row[held]
        kept = self.rows, self.held, self.first, self.pool
        self._clear(2 * room)
        self.rows, self.held, self.first, self.pool = kept
        self._enter(low, high, row)

    def _enter(self, low: np.ndarray, high: np.ndarray, row: np.ndarray) -> None:
        place = self._place(low, high)
        while len(place):
            open_ = np.flatnonzero(self.high.take(place) == 0)
            at, who = np.unique(place.take(open_), return_index=True)  # one each
            who = open_.take(who)
            self.low[at], self.high[at], self.row[at] = low[who], high[who], row[who]
            rest = np.ones(len(place), dtype=bool)
            rest[who] = False
            low, high, row, place = low[rest], high[rest], row[rest], place[rest]
            place = np.where(self.high.take(place) == 0, place, (place + 1) & ((1 << self.bits) - 1))


class Coder:
    """Ids of texts by way of one table; ``split`` gives the ids of a pre-token."""

    def __init__(self, words: bool, split: Callable[[str], list[int]], limit: int) -> None:
        self.words, self.split, self.table = words, split, Table(limit)

    def code(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text, of UTF-8 texts that are PLAIN."""
        mark = bytes([_MARK])
        raw = mark + mark.join(texts) + mark
        held = raw + mark * (24 - len(raw) % 8)
        buf = np.frombuffer(held, dtype=np.uint8)
        start, stop = cut(buf, self.words)
        size = stop - start
        long = np.flatnonzero(size > _LONGEST)
        size[long] = _LONGEST
        # the sixteen bytes from each start, whatever it is aligned to
        eight = np.frombuffer(held, dtype="<u8")
        at, shift = start >> 3, ((start & 7) << 3).astype(np.uint64)
        back = np.uint64(64) - shift
        here, after = eight.take(at), eight.take(at + 1)
        low = (here >> shift) | np.where(shift, after << back, 0)
        low &= _BYTES.take(size)
        high = (after >> shift) | np.where(shift, eight.take(at + 2, mode="clip") << back, 0)
        high &= _REST.take(size)
        high |= size.astype(np.uint64) << np.uint64(56)
        if len(long):
            row, short = np.empty(len(size), dtype=np.int32), np.ones(len(size), dtype=bool)
            short[long] = False
            row[short] = self._rows(low[short], high[short])
        else:
            row = self._rows(low, high)
        first, pool = self.table.first, self.table.pool
        if len(long):  # rows of their own, for now
            own = [self.split(held[a:b].decode()) for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
            rows, held = len(self.table), self.table.held
            row[long] = np.arange(rows, rows + len(long))
            first = np.concatenate((first[: rows + 1], held + np.cumsum([len(i) for i in own])))
            pool = np.concatenate((pool[:held], np.array([i for o in own for i in o], dtype=np.uint32)))
        begin = first.take(row)
        count = first.take(row + 1) - begin
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool.take(np.repeat(begin - (ends - count), count) + np.arange(total))
        # a text's pre-tokens are those that begin before its end
        text_end = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) + 1
        upto = np.concatenate(([0], ends))[np.searchsorted(start, text_end)]
        return ids, np.diff(upto, prepend=0)

    def _rows(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        row = self.table.find(low, high)
        new = np.flatnonzero(row < 0)
        if len(new):
            pairs = np.empty((len(new), 2), dtype="<u8")
            pairs[:, 0], pairs[:, 1] = low[new], high[new]
            _, which = np.unique(pairs.view("V16").ravel(), return_index=True)
            fresh = pairs[which]
            names = [r[: r[15]].decode() for r in map(bytes, fresh.view(np.uint8).reshape(-1, 16))]
            before = len(self.table)
            self.table.add(fresh[:, 0].copy(), fresh[:, 1].copy(), [self.split(n) for n in names])
            if len(self.table) < before + len(names):  # it started over
                return self._rows(low, high)
            row[new] = self.table.find(low[new], high[new])
        return row
