"""Double-array tries over phrases of word hashes, built and walked in numpy.

A phrase's words become local ids (their ranks among the trie's words) and the ids become digits of base 256, so that
no node has more than 256 children.  ``base[s] + digit`` is the child's slot if ``check`` holds ``s`` there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A node with as many children gets a block of 256 slots of its own; the others share what is free.
DENSE = 16
ROOT = 0


@dataclass(frozen=True)
class Trie:
    """``words`` are the sorted hashes; ``accept`` holds the phrase's number at its last state, else -1."""

    words: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    phrases: int

    @property
    def digits(self) -> int:
        return digits_of(len(self.words))

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """The local id of each token, -1 where the trie has no such word."""
        if not len(self.words):
            return np.full(len(tokens), -1, dtype=np.int32)
        at = np.searchsorted(self.words, tokens)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == tokens, at, -1).astype(np.int32)

    def count(self, ids: np.ndarray, longest: int, counts: np.ndarray) -> None:
        """Add to ``counts`` how often each phrase stands in a text of local ids: all positions' states advance together."""
        ids = np.concatenate((ids, np.full(longest, -1, dtype=np.int32)))
        at = np.flatnonzero(ids >= 0)
        state = np.full(len(at), ROOT, dtype=np.int32)
        for k in range(longest):
            symbol = ids[at + k]
            alive = symbol >= 0
            at, state, symbol = at[alive], state[alive], symbol[alive]
            for digit in reversed(range(self.digits)):
                child = self.base[state] + ((symbol >> (8 * digit)) & 255)
                alive = self.check[child] == state
                at, state, symbol = at[alive], child[alive], symbol[alive]
            found = self.accept[state]
            counts += np.bincount(found[found >= 0], minlength=len(counts))


def digits_of(words: int) -> int:
    """Digits of base 256 that tell so many words apart."""
    return max(1, (max(1, words - 1).bit_length() + 7) // 8)


def build(tokens: np.ndarray, lengths: np.ndarray) -> Trie:
    """The trie of phrases, given as their words' hashes one after the other and their lengths."""
    words, ids = np.unique(tokens, return_inverse=True)
    digits = digits_of(len(words))
    first = np.cumsum(lengths) - lengths
    node = np.zeros(len(lengths), dtype=np.int64)  # the node that each phrase has reached
    parents, symbols, nodes = [], [], 1
    for depth in range(int(lengths.max(initial=0)) * digits):
        active = np.flatnonzero(lengths > depth // digits)
        symbol = ids[first[active] + depth // digits] >> (8 * (digits - 1 - depth % digits)) & 255
        pairs, inverse = np.unique(node[active] * 256 + symbol, return_inverse=True)
        parents.append(pairs >> 8)
        symbols.append(pairs & 255)
        node[active] = nodes + inverse
        nodes += len(pairs)
    none = np.zeros(0, dtype=np.int64)
    parent, symbol = np.concatenate([none, *parents]), np.concatenate([none, *symbols])
    bases, size = _place(parent, symbol, nodes)
    slot = np.zeros(nodes, dtype=np.int64)
    slot[1:] = bases[parent] + symbol
    base, check, accept = (np.full(size, fill, dtype=np.int32) for fill in (0, -1, -1))
    base[slot] = bases
    check[slot[1:]] = slot[parent]
    accept[slot[node]] = np.arange(len(lengths))
    return Trie(words, base, check, accept, len(lengths))


def _place(parent: np.ndarray, symbol: np.ndarray, nodes: int) -> tuple[np.ndarray, int]:
    """A base for every node such that no two children share a slot, and the number of slots.

    All nodes draw at once; those whose slots are free and not drawn by an earlier node keep them, the others draw
    again.  Large families go first.  No more than a third of the drawn slots is ever taken.
    """
    count = np.bincount(parent, minlength=nodes)
    start = np.concatenate(([0], np.cumsum(count)))
    child = symbol[np.argsort(parent, kind="stable")]
    base = np.zeros(nodes, dtype=np.int64)
    dense = np.flatnonzero(count >= DENSE)
    base[dense] = 256 * (1 + np.arange(len(dense)))
    size = 256 * (len(dense) + 3) + 3 * nodes
    used = np.zeros(size, dtype=bool)
    used[ROOT] = True
    used[np.repeat(base[dense], count[dense]) + _gather(child, start, dense)] = True
    claim = np.full(size, nodes, dtype=np.int64)
    draw = np.random.default_rng(1)
    for least in (8, 4, 2, 1):
        left = np.flatnonzero((count >= least) & (count < (least * 2 if least < 8 else DENSE)))
        while len(left):
            drawn = draw.integers(1, size - 256, len(left))
            owner = np.repeat(np.arange(len(left)), count[left])
            slots = drawn[owner] + _gather(child, start, left)
            np.minimum.at(claim, slots, owner)
            taken = used[slots] | (claim[slots] != owner)
            claim[slots] = nodes
            lost = np.bincount(owner, weights=taken, minlength=len(left)) > 0
            base[left[~lost]] = drawn[~lost]
            used[slots[~lost[owner]]] = True
            left = left[lost]
    return base, size


def _gather(values: np.ndarray, start: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The values of these groups, one group after the other."""
    lengths = start[groups + 1] - start[groups]
    ends = np.cumsum(lengths)
    return values[np.repeat(start[groups] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
