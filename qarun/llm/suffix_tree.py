"""Suffix trees of number sequences, and common extensions by constant-time LCA."""

import numpy as np


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (numbers above 0); 0 is the end mark behind them.

    Node 0 is the root. Arrays hold a node's edge (``start``, ``end``) and children by symbol.
    Time and memory are linear in the sequence, some 500 bytes a symbol.
    """

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.start, self.end, self.child = _ukkonen([*symbols, 0])
        self._tour()

    def _tour(self) -> None:
        """Order the children, walk the tree, and prepare the lowest depth of any stretch of the walk."""
        size = len(self.start)
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        below = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)  # by node, then by symbol with the end mark first
        above = keys[order] >> 32
        first = np.searchsorted(above, np.arange(size + 1)).tolist()
        children = below[order].tolist()
        starts, ends, total = self.start, self.end, self.n + 1

        depth = [0] * size
        tour: list[int] = []
        seen = [0] * total  # where the walk meets the leaf of a suffix
        rank = [0] * total
        found = 0
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:  # back at an inner node
                tour.append(depth[~node])
                continue
            own = depth[node]
            low, high = first[node], first[node + 1]
            if low == high:
                suffix = total - own
                seen[suffix] = len(tour)
                rank[suffix] = found
                found += 1
                tour.append(own)
                continue
            tour.append(own)
            for place in range(high - 1, low - 1, -1):
                below_it = children[place]
                depth[below_it] = own + ends[below_it] - starts[below_it]
                stack.append(~node)
                stack.append(below_it)
        self.rank = rank
        self._first, self._children, self._depth = first, children, depth
        self._seen = np.array(seen, np.int64)
        level = np.array(tour, np.int32)
        self._lowest = [level]
        step = 1
        while 2 * step <= len(tour):
            level = np.minimum(level[:-step], level[step:])
            self._lowest.append(level)
            step *= 2

    def reversed_rank(self) -> list[int]:
        """Ranks of the suffixes if greater symbols come first; the end mark stays the smallest."""
        first, children, depth = self._first, self._children, self._depth
        starts, total = self.start, self.n + 1
        rank = [0] * total
        found = 0
        stack = [0]
        while stack:
            node = stack.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                rank[total - depth[node]] = found
                found += 1
                continue
            # The end mark, if it is there, is the first child.
            ended = starts[children[low]] == self.n
            stack.extend(children[low + ended : high])
            if ended:
                stack.append(children[low])
        return rank

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, pair by pair, a != b."""
        a, b = self._seen[a], self._seen[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            table = self._lowest[level]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(level)) + 1])
        return out


def _ukkonen(text: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Edge starts and ends by node, and children by ``node << 32 | symbol``.

    Symbols are added from left to right. ``node, edge, length`` is the place of the longest
    suffix that has no leaf yet; a leaf's edge grows to the end by itself.
    """
    total = len(text)
    start, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    node, edge, length, pending = 0, 0, 0, 0
    for at, symbol in enumerate(text):
        pending += 1
        waiting = 0
        while pending:
            if not length:
                edge = at
            key = node << 32 | text[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(at)
                end.append(total)
                link.append(0)
                if waiting:
                    link[waiting] = node
                waiting = node
            else:
                low = start[below]
                span = end[below] - low
                if length >= span:  # walk down
                    edge += span
                    length -= span
                    node = below
                    continue
                if text[low + length] == symbol:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                inner = len(start)
                child[key] = inner
                start += (low, at)
                end += (low + length, total)
                link += (0, 0)
                start[below] = low + length
                child[inner << 32 | text[low + length]] = below
                child[inner << 32 | symbol] = inner + 1
                if waiting:
                    link[waiting] = inner
                waiting = inner
            pending -= 1
            if not node and length:
                length -= 1
                edge = at - pending + 1
            elif node:
                node = link[node]
    return start, end, child
