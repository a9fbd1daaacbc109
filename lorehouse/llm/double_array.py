"""A trie as two arrays, walked for many positions at once.

A state is a slot. The child of state ``s`` by letter ``c`` is slot ``base[s] + c``
if ``check`` of that slot is ``s``. Letters are numbers below ``letters``; the
states of the first level are the letters themselves.
"""

from __future__ import annotations

import numpy as np

#: Slots per edge, rounds of looking for a base, and slots looked at in a round.
ROOM, ROUNDS, LOOK = 3, 60, 1 << 18
_FREE, _TAKEN = -1, -2


class DoubleArray:
    """Letters 0 to letters - 1; each call of ``add`` appends one level."""

    def __init__(self, letters: int, edges: int) -> None:
        self.letters = letters
        self.size = letters + max(ROOM * edges, 2 * letters) + 1
        self.base = np.zeros(self.size + letters + 1, np.int32)
        self.check = np.full(self.size + letters + 1, _FREE, np.int32)
        self.check[:letters] = _TAKEN
        #: Edges whose parent found no base: (parent * letters + letter) sorted, and their slots.
        self.spilled_keys = np.empty(0, np.int64)
        self.spilled_slots = np.empty(0, np.int32)

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Add distinct edges of parents that have no children yet; parents with many children first, those with one last."""
        order = np.lexsort((codes, parents))
        parents, codes = parents[order].astype(np.int64), codes[order].astype(np.int64)
        heads = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(heads, len(parents)))
        rng = np.random.default_rng(len(parents))
        spilled = []
        for k in sorted(set(sizes[sizes > 1].tolist()), reverse=True):
            open_ = heads[sizes == k]
            for _ in range(ROUNDS):
                if not len(open_):
                    break
                open_ = self._place(parents, codes, open_, k, rng)
            spilled += [np.arange(h, h + k) for h in open_.tolist()]
        alone = heads[sizes == 1]
        free = self._free(len(alone))
        self.base[parents[alone]] = free - codes[alone]
        self.check[free] = parents[alone]
        if spilled:
            some = np.concatenate(spilled)
            free = self._free(len(some))
            self.check[free] = _TAKEN
            keys = np.concatenate((self.spilled_keys, parents[some] * self.letters + codes[some]))
            slots = np.concatenate((self.spilled_slots, free.astype(np.int32)))
            at = np.argsort(keys)
            self.spilled_keys, self.spilled_slots = keys[at], slots[at]

    def _free(self, n: int) -> np.ndarray:
        """Slots past the letters, so that no base is negative."""
        return np.flatnonzero(self.check[self.letters : self.size] == _FREE)[:n] + self.letters

    def _place(self, parents: np.ndarray, codes: np.ndarray, heads: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """Give as many parents of ``k`` children as possible a base; returns the others."""
        left = []
        step = max(1, LOOK // k)
        for at in range(0, len(heads), step):
            some = heads[at : at + step]
            own = codes[some[:, None] + np.arange(k)]
            lowest, highest = self.letters - own[:, 0], self.size - own[:, -1]
            if len(some) == 1:  # a large family: several bases at once
                base = rng.integers(lowest[0], highest[0], max(1, min(64, LOOK // k)))
                fits = np.flatnonzero((self.check[base[:, None] + own] == _FREE).all(1))
                if not len(fits):
                    left.append(some)
                    continue
                base = base[fits[:1]]
                good = np.ones(1, bool)
            else:
                base = (lowest + rng.random(len(some)) * (highest - lowest)).astype(np.int64)
                good = (self.check[base[:, None] + own] == _FREE).all(1)
                slots = (base[:, None] + own)[good].ravel()
                first = np.zeros(len(slots), bool)
                first[np.unique(slots, return_index=True)[1]] = True  # of two parents that want a slot the first has it
                good[np.flatnonzero(good)] = first.reshape(-1, k).all(1)
            slots = base[good][:, None] + own[good]
            owners = parents[some[good]]
            self.base[owners] = base[good]
            self.check[slots] = owners[:, None]
            left.append(some[~good])
        return np.concatenate(left) if left else heads[:0]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of every state by every letter; -1 where there is none, or state or letter is negative."""
        known = (states >= 0) & (codes >= 0)
        slots = self.base[states] + codes
        out = np.where(known & (self.check[slots] == states), slots, np.int32(-1))
        if len(self.spilled_keys):
            rest = np.flatnonzero(known & (out < 0))
            keys = states[rest].astype(np.int64) * self.letters + codes[rest]
            at = np.minimum(np.searchsorted(self.spilled_keys, keys), len(self.spilled_keys) - 1)
            hit = self.spilled_keys[at] == keys
            out[rest[hit]] = self.spilled_slots[at[hit]]
        return out

    def path(self, states: np.ndarray, length: int) -> list[np.ndarray]:
        """The letters that lead to states of level ``length``."""
        letters = []
        spilled_at = np.argsort(self.spilled_slots)
        for _ in range(length - 1):
            parents = self.check[states].astype(np.int64)
            codes = states - self.base[parents]
            odd = parents == _TAKEN
            if odd.any():
                keys = self.spilled_keys[spilled_at[np.searchsorted(self.spilled_slots[spilled_at], states[odd])]]
                parents[odd], codes[odd] = keys // self.letters, keys % self.letters
            letters.append(codes)
            states = parents
        return [states, *letters[::-1]]
