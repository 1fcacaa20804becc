"""Deep-shallow sorting of byte strings.

Shallow: a multikey quicksort whose characters are words of eight bytes. Each level sorts, for all groups at
once, those strings that are still tied, until a shallow depth. Deep: what shares a longer prefix is ordered
by blind tries, one for each tied group. A blind trie keeps only branching depths and bytes; to insert a
string, it is led down blindly to some leaf, compared with that one string, and hung in where they part.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class BlindTrie:
    """Orders the strings of one group from byte ``start`` on."""

    def __init__(self, start: int):
        self.start = start
        self.root = None

    def insert(self, text: bytes, row: int) -> None:
        """Leaves are [text, rows]; inner nodes are (depth, {byte: child})."""
        if self.root is None:
            self.root = [text, [row]]
            return
        node, path = self.root, []
        while type(node) is tuple:
            path.append(node)
            depth, children = node
            node = children.get(text[depth]) or next(iter(children.values()))
        if node[0] == text:
            node[1].append(row)
            return
        other = node[0]
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        common = len(text) - (differ.bit_length() + 7) // 8
        above = None
        for node in path:
            if node[0] >= common:
                break
            above = node
        else:
            node = path[-1][1].get(text[path[-1][0]]) if path else self.root
        if type(node) is tuple and node[0] == common:
            node[1][text[common]] = [text, [row]]
            return
        if above is not None:
            node = above[1].get(text[above[0]])
        elif path:
            node = self.root
        fork = (common, {other[common]: node, text[common]: [text, [row]]})
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def rows(self) -> list[int]:
        """Rows in the order of their strings."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node is not None:
                out += node[1]
        return out


def runs(changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that begin where ``changes`` is true."""
    starts = np.flatnonzero(changes)
    return starts, np.append(starts[1:], len(changes))


def deep_shallow(strings: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (uint8, all of one width) within their groups, and each one's common prefix with the one before (-1: another group)."""
    n, width = strings.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    tied = np.append(True, groups[order][1:] != groups[order][:-1])  # where a tied run begins
    for level in range(min(shallow // 8, words.shape[1])):
        starts, ends = runs(tied)
        many = np.repeat(ends - starts > 1, ends - starts)
        at = np.flatnonzero(many)
        if not len(at):
            break
        run = np.repeat(np.arange(len(starts)), ends - starts)[at]
        key = words[order[at], level]
        again = np.lexsort((key, run))
        order[at] = order[at][again]
        key = key[again]
        tied[at[1:]] |= (run[1:] != run[:-1]) | (key[1:] != key[:-1])
    starts, ends = runs(tied)
    if shallow < width:
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            rows = order[a:b]
            block = strings[rows]
            if (block == block[0]).all():
                continue
            trie = BlindTrie(shallow)
            for row, text in zip(rows.tolist(), block, strict=True):
                trie.insert(text.tobytes(), row)
            order[a:b] = trie.rows()
    common = np.full(n, -1, np.int64)
    for a in range(1, n, 100_000):
        b = min(n, a + 100_000)
        differ = strings[order[a:b]] != strings[order[a - 1 : b - 1]]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[a:b] = np.where(groups[order[a:b]] == groups[order[a - 1 : b - 1]], found, -1)
    return order, common
