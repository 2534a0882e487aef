"""Deep-shallow sorting of byte strings: multikey quicksort, then blind tries for long common prefixes."""

from __future__ import annotations

WORD = 8  # bytes that the quicksort compares at once
SHALLOW = 32


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps only where its strings part; a search reads those bytes and compares once."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf is [-1, [numbers]], an inner node [depth, {byte: node}]

    def insert(self, k: int) -> None:
        s, strings = self.strings[k], self.strings
        if self.root is None:
            self.root = [-1, [k]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        leaf = strings[node[1][0]]
        shared = common(s, leaf)
        if shared == len(s) == len(leaf):
            node[1].append(k)
            return
        at, parent, edge = self.root, None, 0
        while 0 <= at[0] < shared:
            parent, edge = at, s[at[0]]
            at = at[1][edge]
        mine = s[shared] if shared < len(s) else -1
        if at[0] == shared:
            at[1][mine] = [-1, [k]]
            return
        other = leaf[shared] if shared < len(leaf) else -1
        new = [shared, {mine: [-1, [k]], other: at}]
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def order(self) -> list[int]:
        out, work = [], [self.root] if self.root else []
        while work:
            node = work.pop()
            if node[0] < 0:
                out += node[1]
            else:
                work += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of the strings; equal ones in the order given."""
    if len(strings) == 1:
        return [0]
    out: list[int] = []
    work: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while work:
        part, depth = work.pop()
        if len(part) == 1:
            out += part
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for k in part:
                trie.insert(k)
            out += trie.order()
        else:
            keys = [(w := strings[k][depth:depth + WORD], len(w)) for k in part]  # a string that ends comes first
            pivot = sorted(keys[:: max(1, len(keys) // 3)][:3])[min(1, len(keys) - 1)] if len(keys) > 2 else keys[0]
            less = [k for k, w in zip(part, keys) if w < pivot]
            same = [k for k, w in zip(part, keys) if w == pivot]
            more = [k for k, w in zip(part, keys) if w > pivot]
            work += [(p, d) for p, d in ((more, depth), (same, depth + WORD if pivot[1] == WORD else SHALLOW), (less, depth)) if p]
    return out


def neighbours(strings: list[bytes], order: list[int]) -> list[int]:
    """The common prefix of each string in the order with the one before it; 0 for the first."""
    return [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]
