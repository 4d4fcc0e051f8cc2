"""Run-length grammars of sequences by recompression, and longest common extensions on them.

Level 0 is the sequence.  A block level replaces every maximal block of one symbol by one symbol for
(symbol, length); a pair level splits the alphabet in left and right symbols and replaces every left symbol
that a right one follows by one symbol for the pair.  Equal surroundings are cut alike, so two
equal stretches differ in their parsing only near their ends.  Levels alternate until no two
symbols of a sequence stand side by side.

An extension query compares two places going up: where both stand at the edge of a parent it
climbs, else it steps over one symbol (or one block) first.  When the symbols differ it goes down again, stepping
over at most one symbol a level.  So a query takes a few steps a level, whatever the length of the
answer; all queries of a batch take them together.

Several sequences lie in one array, parted by negative symbols, which are all different and never
compressed.  Memory follows the array: levels shrink by about a quarter each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from railbird.llm.common import mixed64


@dataclass(frozen=True)
class Level:
    """The symbols of a level and how they make the next one: the parent of each, the first child of each parent."""

    symbols: np.ndarray
    up: np.ndarray
    first: np.ndarray
    blocks: bool


def _blocks(s: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Heads and symbols of the blocks of ``s``, and the next free symbol; None without a block of two."""
    heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    if len(heads) == len(s):
        return None
    lengths = np.diff(np.append(heads, len(s)))
    out = s[heads]
    long = np.flatnonzero(lengths > 1)
    _, name = np.unique(out[long] * np.int64(len(s) + 1) + lengths[long], return_inverse=True)
    out[long] = fresh + name
    return heads, out, fresh + int(name.max()) + 1


def _pairs(s: np.ndarray, fresh: int, salt: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Heads and symbols after replacing pairs of a left and a right symbol, and the next free symbol."""
    side = (mixed64(s.astype(np.uint64) * np.uint64(2) + np.uint64(salt)) & np.uint64(1)).astype(bool)
    inner = (s[1:] >= 0) & (s[:-1] >= 0)
    right, left = inner & side[1:] & ~side[:-1], inner & ~side[1:] & side[:-1]
    pair = np.flatnonzero(right if right.sum() >= left.sum() else left)
    keep = np.ones(len(s), bool)
    keep[pair + 1] = False
    heads = np.flatnonzero(keep)
    out = s.copy()
    if len(pair):
        _, name = np.unique(s[pair] * np.int64(fresh) + s[pair + 1], return_inverse=True)
        out[pair] = fresh + name
        fresh += int(name.max()) + 1
    return heads, out[heads], fresh


class Grammar:
    """The levels of ``symbols``, whose first and last are separators."""

    def __init__(self, symbols: np.ndarray) -> None:
        s, self.levels = symbols.astype(np.int64), []
        fresh, salt = max(0, int(s.max(initial=0))) + 1, 0
        while ((s[1:] >= 0) & (s[:-1] >= 0)).any():
            if found := _blocks(s, fresh):
                s, fresh = self._add(s, found, True)
            salt += 1
            s, fresh = self._add(s, _pairs(s, fresh, salt), False)
        self.top = s

    def _add(self, s: np.ndarray, found: tuple[np.ndarray, np.ndarray, int], blocks: bool) -> tuple[np.ndarray, int]:
        heads, out, fresh = found
        mark = np.zeros(len(s), np.int32)
        mark[heads] = 1
        self.levels.append(Level(s, np.cumsum(mark, dtype=np.int32) - 1, np.append(heads, len(s)).astype(np.int32), blocks))
        return out, fresh

    def extension(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from places i and j on (step 1) or back (step -1) are equal; i and j differ."""
        p, q = i.astype(np.int64), j.astype(np.int64)
        stop = np.full(len(p), len(self.levels))
        live = np.arange(len(p))
        for k, level in enumerate(self.levels):
            if not len(live):
                break
            a, b = p[live], q[live]
            same = level.symbols[a] == level.symbols[b]
            stop[live[~same]] = k
            live, a, b = live[same], a[same], b[same]
            inside = np.flatnonzero((level.up[a - step] == level.up[a]) | (level.up[b - step] == level.up[b]))
            x, y = a[inside], b[inside]
            if level.blocks:
                rest_x, rest_y = _rest(level, x, step), _rest(level, y, step)
                move = np.minimum(rest_x, rest_y)
                uneven = rest_x != rest_y
            else:
                move, uneven = np.ones(len(x), np.int64), np.zeros(len(x), bool)
            a[inside], b[inside] = x + step * move, y + step * move
            p[live], q[live] = a, b
            stop[live[inside[uneven]]] = k
            go = np.ones(len(live), bool)
            go[inside[uneven]] = False
            live, a, b = live[go], a[go], b[go]
            p[live], q[live] = level.up[a], level.up[b]
        for k in range(len(self.levels) - 1, -1, -1):
            level, below = self.levels[k], np.flatnonzero(stop > k)
            if not len(below):
                continue
            a, b = p[below], q[below]
            a, b = (level.first[a], level.first[b]) if step > 0 else (level.first[a + 1] - 1, level.first[b + 1] - 1)
            a, b = a.astype(np.int64), b.astype(np.int64)
            same = np.flatnonzero(level.symbols[a] == level.symbols[b])
            x, y = a[same], b[same]
            move = np.minimum(_rest(level, x, step), _rest(level, y, step)) if level.blocks else 1
            a[same], b[same] = x + step * move, y + step * move
            p[below], q[below] = a, b
        return (p - i) * step


def _rest(level: Level, at: np.ndarray, step: int) -> np.ndarray:
    """How many symbols of its block are left at a place, itself included."""
    parent = level.up[at]
    return (level.first[parent + 1] - at if step > 0 else at - level.first[parent] + 1).astype(np.int64)
