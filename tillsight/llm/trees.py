"""Search trees for best-fit placement."""

from __future__ import annotations


class BalancedTree:
    """An AVL tree of distinct comparable keys: insert, delete and the smallest key >= x,
    each in O(log n)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    # a node is [key, left, right, height]
    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def delete(self, key) -> None:
        self.root = self._delete(self.root, key)

    def ceiling(self, key):
        """The smallest key >= ``key``, or None."""
        node, best = self.root, None
        while node:
            if node[0] < key:
                node = node[2]
            else:
                best, node = node[0], node[1]
        return best

    def _insert(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._insert(node[side], key)
        return self._balance(node)

    def _delete(self, node, key):
        if key == node[0]:
            if node[1] is None or node[2] is None:
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._delete(node[2], least[0])
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._delete(node[side], key)
        return self._balance(node)

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _turn(self, node, up: int):
        """Rotate so that the child on side ``up`` takes the node's place."""
        child = node[up]
        node[up], child[3 - up] = child[3 - up], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def _balance(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        up = 1 if lean > 0 else 2
        if self._height(node[up][3 - up]) > self._height(node[up][up]):
            node[up] = self._turn(node[up], 3 - up)
        return self._turn(node, up)


class CapacityTree:
    """A segment tree over remaining capacities 0..limit; a leaf is set while some open
    window has that much room.  ``tightest(n)`` is the least set capacity >= n."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, present: bool) -> None:
        i = self.size + capacity
        self.any[i] = present
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = self.size + n
        if self.any[i]:
            return n
        while i > 1:  # up until a set subtree lies to the right
            if not i & 1 and self.any[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size
