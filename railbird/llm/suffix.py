"""Suffix sorting of one shard by external induced sorting, with common prefixes up to a length.

The method: a suffix is of type S if it is smaller than its successor, else L; an S suffix
behind an L suffix is an LMS suffix.  The strings between LMS suffixes are named by rank
and the string of names is sorted by recursion, which orders the LMS suffixes.  From them
the L suffixes are induced by a scan in ascending order, then the S suffixes by a scan in
descending order: each suffix met hands its predecessor to the queue of that one's first
symbol.

A queue is a priority queue whose priority is the symbol, first in first out at equal ones; it
holds tuples of position and common prefix with the item before.  The common prefix of
two items is one more than the least common prefix met between their sources.  Queues
keep ``memory`` bytes and append the rest to a file per symbol; the sorted L suffixes are
kept in such files too.  Work runs in blocks of tuples.  The text, its types, the order of the
LMS suffixes and all of the recursion are in memory: a shard has to fit there several times
over, and at the default ``memory`` queues spill only above some 6.7 million items.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

ITEM = np.dtype([("pos", "<i8"), ("lcp", "<u2")])
BLOCK = 1 << 16
SEPARATOR, SENTINEL = 0xFE, 0
MEMORY = 64 << 20
_FAR = 0xFFFF


class DiskQueue:
    """Tuples by symbol, in order of arrival; beyond ``memory`` bytes they go to files."""

    def __init__(self, folder: str, name: str, symbols: int, memory: int = MEMORY):
        self.folder, self.name, self.memory, self.held = folder, name, memory, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.at = [0] * symbols

    def _path(self, symbol: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{symbol}")

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        items = np.empty(len(pos), ITEM)
        items["pos"], items["lcp"] = pos, lcp
        self.parts[symbol].append(items)
        self.held += items.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        for symbol, parts in enumerate(self.parts):
            if parts:
                with open(self._path(symbol), "ab") as f:
                    for p in parts:
                        p.tofile(f)
                self.parts[symbol] = []
        self.held = 0

    def _stored(self, symbol: int) -> np.ndarray:
        path = self._path(symbol)
        return np.memmap(path, ITEM, "r") if os.path.exists(path) else np.empty(0, ITEM)

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of what has arrived and was not yet popped; what arrives meanwhile comes next time."""
        stored, parts = self._stored(symbol), self.parts[symbol]
        self.parts[symbol] = []
        self.held -= sum(p.nbytes for p in parts)
        done, self.at[symbol] = self.at[symbol], len(stored)
        for i in range(done, len(stored), BLOCK):
            yield np.array(stored[i:i + BLOCK])
        if parts:
            items = np.concatenate(parts)
            for i in range(0, len(items), BLOCK):
                yield items[i:i + BLOCK]

    def backwards(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of all tuples of a symbol, last first; each ``lcp`` is then with the item before in this order."""
        stored = self._stored(symbol)
        items = [stored, *self.parts[symbol]]
        after = 0
        for part in reversed(items):
            for end in range(len(part), 0, -BLOCK):
                block = np.array(part[max(0, end - BLOCK):end])[::-1].copy()
                own = block["lcp"].copy()
                block["lcp"][1:] = own[:-1]
                block["lcp"][0] = after
                after = own[-1]
                yield block


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes.  The last symbol is a sentinel, smaller than all others."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    smaller = np.append(t[ends[:-1]] < t[ends[:-1] + 1], True)
    return np.repeat(smaller, np.diff(np.concatenate(([-1], ends))))


def lms_of(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def names(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, bool]:
    """The rank of each LMS string among all, and whether all differ.

    Symbols count with their type, so no string is the beginning of another.  Strings are compared
    in words of several symbols; only those still equal go on to the next word.
    """
    symbols = t.astype(np.int64) * 2 + is_s
    bits = int(symbols.max()).bit_length()
    per, n = 63 // bits, len(t)
    length = np.append(np.diff(lms) + 1, 1)
    rank, active, off = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(active):
        word = np.zeros(len(active), np.int64)
        for j in range(off, off + per):
            at = np.minimum(lms[active] + j, n - 1)
            word = word << bits | np.where(j < length[active], symbols[at], 0)
        order = np.lexsort((word, rank[active])) if off else np.argsort(word, kind="stable")
        r, w = rank[active][order], word[order]
        group = np.ones(len(order), bool)
        group[1:] = r[1:] != r[:-1]
        fresh = group.copy()
        fresh[1:] |= w[1:] != w[:-1]
        index = np.arange(len(order))
        first = np.maximum.accumulate(np.where(group, index, 0))
        start = np.maximum.accumulate(np.where(fresh, index, 0))
        rank[active[order]] = r + start - first
        off += per
        size = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        tied = active[order][np.repeat(size > 1, size)]
        active = tied[length[tied] > off]
    dense, inverse = np.unique(rank, return_inverse=True)
    return inverse, len(dense) == len(lms)


def _sorted_lms(t: np.ndarray, is_s: np.ndarray) -> np.ndarray:
    lms = lms_of(is_s)
    rank, distinct = names(t, is_s, lms)
    if distinct:
        out = np.empty_like(lms)
        out[rank] = lms
        return out
    return lms[suffix_order(rank)]


def suffix_order(t: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of numbers with a sentinel behind: the recursion."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    is_s = types(t)
    lms = _sorted_lms(t, is_s)
    ends = np.cumsum(np.bincount(t))
    text, s, order = t.tolist(), is_s.tolist(), [-1] * len(t)
    tail = ends.tolist()
    for p in lms[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        order[tail[c]] = p
    head = [0, *ends[:-1].tolist()]
    for i in range(len(text)):
        p = order[i] - 1
        if p >= 0 and not s[p]:
            c = text[p]
            order[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(text) - 1, 0, -1):
        p = order[i] - 1
        if p >= 0 and s[p]:
            c = text[p]
            tail[c] -= 1
            order[tail[c]] = p
    return np.array(order, np.int64)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """How far the suffixes at ``a`` and ``b`` agree, up to ``limit``; ``t`` has ``limit`` + 8 symbols behind its end."""
    words = np.ndarray((len(t) - 7,), "<u8", t.data, strides=(1,))
    out, active = np.full(len(a), limit, np.uint16), np.arange(len(a))
    for off in range(0, limit, 8):
        x = words[a[active] + off] ^ words[b[active] + off]
        ended = np.flatnonzero(x)
        bit = x[ended] & (~x[ended] + np.uint64(1))
        out[active[ended]] = np.minimum(off + np.log2(bit.astype(np.float64)).astype(np.int64) // 8, limit)
        active = active[x == 0]
        if not len(active):
            break
    return out


class _Mins:
    """Least values of ranges, by tables of doubling width."""

    def __init__(self, x: np.ndarray):
        self.levels, w = [x], 1
        while 2 * w <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-w], last[w:]))
            w *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo to hi, both included."""
        level = np.log2(hi - lo + 1).astype(np.int64)
        out = np.empty(len(lo), np.uint16)
        for k in np.unique(level):
            some = level == k
            table = self.levels[k]
            out[some] = np.minimum(table[lo[some]], table[hi[some] - (1 << int(k)) + 1])
        return out


class _Inducer:
    """Hands the predecessors of scanned suffixes to the queue, with common prefixes."""

    def __init__(self, t: np.ndarray, queue: DiskQueue, limit: int, symbols: int):
        self.t, self.queue, self.limit = t, queue, limit
        self.since = np.full(symbols, _FAR, np.int64)
        self.met = np.zeros(symbols, bool)

    def hand_on(self, block: np.ndarray, wanted: np.ndarray) -> None:
        pos, lcp, n = block["pos"], block["lcp"], len(block)
        chosen = np.flatnonzero(wanted)
        least = int(lcp.min())
        if not len(chosen):
            np.minimum(self.since, least, out=self.since)
            return
        symbol = self.t[pos[chosen] - 1]
        order = np.argsort(symbol, kind="stable")
        at, symbol = chosen[order], symbol[order]
        cut = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1))
        lo = np.empty(len(at), np.int64)
        lo[1:] = at[:-1] + 1
        lo[cut] = 0
        mins = _Mins(lcp)
        value = mins.of(lo, at).astype(np.int64)
        heads = symbol[cut]
        value[cut] = np.where(self.met[heads], np.minimum(value[cut], self.since[heads]), -1)
        value = np.minimum(value + 1, self.limit)
        np.minimum(self.since, least, out=self.since)
        ends = np.append(cut[1:], len(at))
        last = at[ends - 1] + 1
        rest = np.full(len(cut), _FAR, np.int64)
        more = last < n
        rest[more] = mins.of(last[more], np.full(int(more.sum()), n - 1))
        self.since[heads], self.met[heads] = rest, True
        for c, a, b in zip(heads.tolist(), cut.tolist(), ends.tolist(), strict=True):
            self.queue.push(c, pos[at[a:b]] - 1, value[a:b])


def joined(segments: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments (UTF-8) as one text: bytes plus one, a separator behind each, a sentinel last; and their starts."""
    lengths = np.array([len(s) + 1 for s in segments], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    # Byte 0xFD becomes the separator 0xFE; UTF-8 has neither.
    raw = np.frombuffer(b"\xfd".join(segments) + b"\xfd", np.uint8)
    t = np.zeros(len(raw) + 1 + limit + 8, np.uint8)
    t[:len(raw)] = raw + 1
    return t, starts


def repeated(segments: list[bytes], limit: int, folder: str, *, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """For each segment, which of its positions start a string of ``limit`` bytes that also starts elsewhere in the segments."""
    padded, starts = joined(segments, limit)
    n = int(starts[-1]) + 1
    t = padded[:n]
    found = np.zeros(n, bool)
    symbols = 256
    is_s = types(t)
    seeds = _sorted_lms(t, is_s)
    seed_lcp = np.zeros(len(seeds), np.uint16)
    seed_lcp[1:] = common_prefixes(padded, seeds[:-1], seeds[1:], limit)
    firsts = t[seeds]
    bounds = np.searchsorted(firsts, np.arange(symbols + 1))

    def seam(a: int, b: int) -> int:
        return int(common_prefixes(padded, np.array([a]), np.array([b]), limit)[0])

    larger, kept = DiskQueue(folder, "l", symbols, memory), DiskQueue(folder, "sorted", symbols, memory)
    up = _Inducer(t, larger, limit, symbols)
    for c in range(symbols):
        last, blocks = -1, 1
        while blocks:
            blocks = 0
            for block in larger.pop(c):
                blocks += 1
                pos = block["pos"]
                kept.push(c, pos, block["lcp"])
                up.hand_on(block, (pos > 0) & (t[pos - 1] >= c))
                last = int(pos[-1])
        for a in range(bounds[c], bounds[c + 1], BLOCK):
            b = min(a + BLOCK, bounds[c + 1])
            block = np.empty(b - a, ITEM)
            block["pos"], block["lcp"] = seeds[a:b], seed_lcp[a:b]
            if a == bounds[c]:
                block["lcp"][0] = seam(last, int(seeds[a])) if last >= 0 else 0
            up.hand_on(block, block["pos"] > 0)

    smaller = DiskQueue(folder, "s", symbols, memory)
    down = _Inducer(t, smaller, limit, symbols)

    def scan(block: np.ndarray, before: int, wanted: np.ndarray) -> int:
        pos = block["pos"]
        twins = np.flatnonzero(block["lcp"] >= limit)
        found[pos[twins]] = True
        found[pos[twins[twins > 0] - 1]] = True
        if len(twins) and twins[0] == 0:
            found[before] = True
        down.hand_on(block, wanted)
        return int(pos[-1])

    for c in range(symbols - 1, -1, -1):
        last, blocks = -1, 1
        while blocks:
            blocks = 0
            for block in smaller.pop(c):
                blocks += 1
                pos = block["pos"]
                last = scan(block, last, (pos > 0) & (t[pos - 1] <= c))
        first = True
        for block in kept.backwards(c):
            pos = block["pos"]
            if first:
                block["lcp"][0] = seam(last, int(pos[0])) if last >= 0 else 0
                first = False
            last = scan(block, last, (pos > 0) & (t[pos - 1] < c))

    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield found[a:max(a, b - limit)]
