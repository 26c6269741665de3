"""Run-length grammar by recompression, and exact longest common extensions on it.

A level is the sequence of symbols left after a round; a phrase is the stretch of one level that is one symbol of
the next. Block rounds join maximal runs of one symbol, pair rounds join neighbours (left, right) of a split of the
alphabet. Both depend on the symbols at hand alone, so equal stretches are cut alike but for their ends: two equal
positions advance by one phrase at most before both stand at phrase ends or differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

ODD = 0x9E3779B97F4A7C15  # spreads symbol numbers over the bits of a word
MAX_ROUNDS = 120


@dataclass
class Level:
    symbols: np.ndarray
    first: np.ndarray | None = None  # where each symbol's phrase starts one level below, and the end
    blocks: bool = False             # a phrase below is a run of one symbol (else a pair or a single)
    up: np.ndarray | None = None     # phrase of each symbol, as a place one level above


def _named(keys: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Equal keys to equal new symbols, from `size` on."""
    codes, found = pd.factorize(keys)
    return codes + size, size + len(found)


class Grammar:
    """Levels over `symbols`, which start and end with separators that occur nowhere else in them."""

    def __init__(self, symbols: np.ndarray, size: int, enough: int):
        """`size`: number of symbols used; compression ends when at most `enough` are left."""
        self.levels = [Level(np.asarray(symbols, dtype=np.int64))]
        self.size = size
        for turn in range(MAX_ROUNDS):
            before = len(self.levels[-1].symbols)
            if before <= enough:
                break
            self._join_blocks()
            self._join_pairs(turn)

    def _add(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        below = self.levels[-1]
        n = len(below.symbols)
        head = np.zeros(n, dtype=np.int32)
        head[starts] = 1
        below.up = np.cumsum(head, dtype=np.int32) - 1
        self.levels.append(Level(symbols, np.append(starts, n), blocks))

    def _join_blocks(self) -> None:
        s = self.levels[-1].symbols
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) == len(s):
            return
        length = np.diff(np.append(starts, len(s)))
        out = s[starts]
        many = np.flatnonzero(length > 1)
        # Names and lengths are below 2**31: a task's texts are far smaller.
        out[many], self.size = _named(out[many] << 32 | length[many], self.size)
        self._add(starts, out, True)

    def _join_pairs(self, turn: int) -> None:
        s = self.levels[-1].symbols
        mixed = (s.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(ODD)
        right = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(ODD)) >> np.uint64(63) == 1
        heads = np.flatnonzero(~right[:-1] & right[1:])
        if not len(heads):
            return
        keep = np.ones(len(s), dtype=bool)
        keep[heads + 1] = False
        names, self.size = _named(s[heads] << 32 | s[heads + 1], self.size)
        joined = s.copy()
        joined[heads] = names
        starts = np.flatnonzero(keep)
        self._add(starts, joined[starts], False)

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """For each pair of places i < j the number of equal symbols from there on, or, with `back`, before them."""
        m, sign = (1, -1) if back else (0, 1)
        top = len(self.levels) - 1
        parked: list[list] = [[] for _ in self.levels]
        a, b, q = np.asarray(i), np.asarray(j), np.arange(len(i))
        for t, level in enumerate(self.levels):
            if not len(q):
                break
            s = level.symbols
            while True:
                same = s[a - m] == s[b - m]
                parked[t].append((a[~same], b[~same], q[~same]))
                a, b, q = a[same], b[same], q[same]
                if t < top or not len(q):
                    break
                a, b = a + sign, b + sign
            if t == top or not len(q):
                break
            first, up = self.levels[t + 1].first, level.up
            ends = (first[up[a]] == a) & (first[up[b]] == b)
            inside = np.flatnonzero(~ends)
            if len(inside):
                x, y = a[inside], b[inside]
                if back:
                    step = np.minimum(x - first[up[x - 1]], y - first[up[y - 1]])
                else:
                    step = np.minimum(first[up[x] + 1] - x, first[up[y] + 1] - y)
                a, b = a.copy(), b.copy()
                a[inside], b[inside] = x + sign * step, y + sign * step
                ends = (first[up[a]] == a) & (first[up[b]] == b)
                parked[t].append((a[~ends], b[~ends], q[~ends]))
                a, b, q = a[ends], b[ends], q[ends]
            a, b = up[a], up[b]
        return self._settled(parked, np.asarray(i), m, sign)

    def _settled(self, parked: list[list], i: np.ndarray, m: int, sign: int) -> np.ndarray:
        """From places whose next symbols differ down to the words that differ."""
        a = b = q = np.empty(0, dtype=np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            a, b, q = (np.concatenate([x, *[p[k] for p in parked[t]]]) for k, x in enumerate((a, b, q)))
            if t == 0 or not len(q):
                continue
            level, s = self.levels[t], self.levels[t - 1].symbols
            # Two phrases that differ share one symbol of a pair, or the shorter run, at most.
            if level.blocks:
                size = level.first
                step = np.minimum(size[a - m + 1] - size[a - m], size[b - m + 1] - size[b - m])
            else:
                step = np.ones(len(q), dtype=np.int64)
            a, b = level.first[a], level.first[b]
            step = step * (s[a - m] == s[b - m]) * sign
            a, b = a + step, b + step
        out = np.zeros(len(i), dtype=np.int64)
        out[q] = sign * (a - i[q])
        return out
