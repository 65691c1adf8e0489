"""Ordinal trees as balanced parentheses, with range min-max blocks over the excess."""

from __future__ import annotations

import numpy as np

#: Parentheses in a block.
BLOCK = 64
#: Nodes whose blocks are looked through at a time.
_AT_ONCE = 1 << 16


class Parentheses:
    """A tree given by the depths of its nodes in preorder; the first node is the root, of depth 0.

    Node ``j`` opens at bit ``2 j - depth[j]``. ``least`` is a complete binary tree over the blocks
    that holds the least excess of each block and of each pair of neighbours.
    """

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.n, self.open = n, 2 * np.arange(n) - depth
        self.bits = np.zeros(2 * n, np.int8)
        self.bits[self.open] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int32) - 1, dtype=np.int32)
        self.blocks = -(-2 * n // BLOCK)
        far = np.iinfo(np.int32).max
        padded = np.full(self.blocks * BLOCK, far, np.int32)
        padded[: 2 * n] = self.excess
        self._rows = padded.reshape(self.blocks, BLOCK)
        leaves = 1 << max(0, int(self.blocks - 1).bit_length())
        self.least = np.full(2 * leaves, far, np.int32)
        self.least[leaves : leaves + self.blocks] = self._rows.min(1)
        width = leaves // 2
        while width:
            self.least[width : 2 * width] = self.least[2 * width : 4 * width].reshape(width, 2).min(1)
            width //= 2
        self._leaves = leaves
        #: Number of pairs "()" that open before each bit.
        pair = np.zeros(2 * n, np.int64)
        pair[:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        self._leaf_rank = np.concatenate([[0], np.cumsum(pair)])

    def _first_below(self, block: np.ndarray, after: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """In each block the first place from ``after`` on whose excess is below the bound, or -1."""
        out = np.empty(len(block), np.int64)
        place = np.arange(BLOCK)
        for at in range(0, len(block), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            hit = (self._rows[block[part]] < bound[part, None]) & (place >= after[part, None])
            first = hit.argmax(1)
            out[part] = np.where(hit.any(1), block[part] * BLOCK + first, -1)
        return out

    def close(self) -> np.ndarray:
        """The bit that closes each node: the first after it with less excess than the node's own."""
        bound, block = self.excess[self.open], self.open // BLOCK
        found = self._first_below(block, self.open % BLOCK, bound)
        left = np.flatnonzero(found < 0)
        # Up the tree while no block to the right is low enough, then down to the first that is.
        node, low = block[left] + self._leaves, bound[left]
        climbing = np.ones(len(left), bool)
        while climbing.any():
            right = node[climbing] ^ 1
            go = (node[climbing] & 1 == 0) & (self.least[right] < low[climbing])
            node[climbing] = np.where(go, right, node[climbing] >> 1)
            climbing[np.flatnonzero(climbing)[go]] = False
        while len(node) and (inner := node < self._leaves).any():
            child = node[inner] * 2
            node[inner] = np.where(self.least[child] < low[inner], child, child + 1)
        found[left] = self._first_below(node - self._leaves, np.zeros(len(left), np.int64), low)
        return found

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node where its subtree ends in preorder, and how many leaves it has."""
        close = self.close()
        ends = np.arange(self.n) + (close - self.open + 1) // 2
        return ends, self._leaf_rank[close] - self._leaf_rank[self.open]


def subtree_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of a value over each subtree, from cumulative sums in preorder."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[ends] - upto[:-1]
