"""What the two byte-pair tokenizers share: a trie of tokens in arrays, and whether merges cross a border."""

from __future__ import annotations

import numpy as np

#: Slots of the table of pairs that were compared (eight bytes each); a new pair takes its slot.
PAIRS = 1 << 20


class Trie:
    """Tokens as a double array: the child of node n by a character of class c is node base[n] + c, if its parent is n."""

    def __init__(self, tokens: dict[str, int]) -> None:
        letters = sorted({c for p in tokens for c in p})
        number = {c: i for i, c in enumerate(letters, 1)}
        self.of_char = np.zeros(0x110000, np.int32)  # 0: a character of no token
        self.of_char[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        children: dict[str, list[int]] = {"": []}
        for p in {p[:i] for p in tokens for i in range(1, len(p) + 1)}:
            children.setdefault(p[:-1], []).append(number[p[-1]])
        size = 3 * sum(map(len, children.values())) + 4 * len(letters) + 64
        self.base, self.parent, self.token = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken, free, front, at = bytearray(size), 1, 1, {"": 0}
        taken[0] = 1
        base_of, parent_of = [], []
        for prefix in sorted(children, key=lambda p: (len(p), p)):
            own, n = sorted(children[prefix]), at[prefix]
            free = taken.index(0, free)
            if len(own) > 1:  # from where the last search ended: what it passed over is left to single children
                front = max(front, free)
                base = front - own[0]
                while base < 0 or any(taken[base + c] for c in own):
                    base += 1
                front = max(front, base + own[0] - 64)
            else:
                place = free
                while own and place < own[0]:
                    place = taken.index(0, place + 1)
                base = place - own[0] if own else 0
            base_of.append((n, base))
            for c in own:
                taken[base + c] = 1
                parent_of.append((base + c, n))
                at[prefix + letters[c - 1]] = base + c
        for place, of in ((self.base, base_of), (self.parent, parent_of)):
            if of:
                place[[x for x, _ in of]] = [x for _, x in of]
        for p, i in tokens.items():
            self.token[at[p]] = i

    def arcs(self, letters: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Composition with character classes of which ``left`` follow, the own one included, in the same unit: start, last
        place and token of each arc."""
        starts, node, n, out = np.arange(len(letters)), np.zeros(len(letters), np.int32), 0, []
        while len(starts):
            own = letters[starts + n]
            to = self.base[node] + own
            alive = (own > 0) & (self.parent[to] == node)
            starts, node = starts[alive], to[alive]
            token = self.token[node]
            ends = token >= 0
            out.append((starts[ends], starts[ends] + n, token[ends]))
            n += 1
            more = left[starts] > n
            starts, node = starts[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Borders:
    """Merges: pairs of tokens and when each is merged (smaller is earlier; of merges at one time the leftmost comes first).
    when: the time at which each token is made, below all others for single characters; halves: what it is made of."""

    def __init__(self, pairs: dict[tuple[int, int], float], when: np.ndarray, halves: np.ndarray) -> None:
        key = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(key)
        self.key, self.time = key[order], np.fromiter(pairs.values(), np.float64, len(pairs))[order]
        self.when, self.halves = when, halves
        self.compared = np.full(PAIRS, -1, np.int64)

    def crossed(self, a: np.ndarray, b: np.ndarray, after_first: bool = False) -> np.ndarray:
        """Whether merges would join token b to token a before it: their borders are followed back through the merges that
        made both, latest first, for one that would have come earlier. after_first: but for the merge of a and b whole."""
        x, y, rows = a.copy(), b.copy(), np.arange(len(a))
        until, ties = np.full(len(a), np.inf), np.zeros(len(a), bool)
        out, first = np.zeros(len(a), bool), after_first
        while len(rows):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            time = np.where(self.key[at] == key, self.time[at], np.inf)
            if first:
                until, first, hit = time, False, np.zeros(len(rows), bool)
            else:
                hit = (time < until) | ties & (time == until) & (time < np.inf)
            out[rows[hit]] = True
            left = self.when[x] > self.when[y]
            more = ~hit & (left | (self.when[y] >= 0))
            x, y, rows, left = x[more], y[more], rows[more], left[more]
            now = np.where(left, self.when[x], self.when[y])
            until, ties = (np.minimum(now, until[more]) if after_first else now), ~left
            x, y = np.where(left, self.halves[1, x], x), np.where(left, y, self.halves[0, y])
        return out

    def joins(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``crossed``, with a table of what was compared; nothing joins to what is no token (below 0)."""
        key = before << 24 | token
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (PAIRS - 1)
        held = self.compared[slot]
        new = np.flatnonzero((held >> 1 != key) & (before >= 0))
        if len(new):
            held[new] = key[new] << 1 | self.crossed(before[new], token[new])
            self.compared[slot[new]] = held[new]
        return (held & 1 == 1) & (before >= 0)
