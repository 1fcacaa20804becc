"""Token counts under a unigram model, with scores shared along a trie.

The distinct pre-tokens of some texts make a trie. A node stands for a prefix and has the forward score of its best
segmentation: the best over vocabulary entries that end there of the score of the node before the entry plus the
entry's own. It is computed once for all pre-tokens that share the prefix; a pre-token's terminal node holds its
number of tokens. The trie is built level by level for all pre-tokens at once: a level's nodes are the distinct pairs of
a node above and a byte, and entries that end at them are read backwards, byte by byte, along the vocabulary's own
trie of reversed entries. Long pre-tokens, which are few, go through a trie one after another. The vocabulary is a rank
file, and an entry's log probability follows Zipf's law on its rank: nothing is fitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._runtime import KEEP_ENCODED, Kept
from ._vocab import read_ranks
from .byte_bpe import _mapped

#: Nodes of a trie before it starts anew: some 100 MB.
NODES = 500_000
#: Bytes of a pre-token from which on it goes through a trie alone.
LONG = 48
#: Characters of texts whose pre-tokens are counted together.
TOGETHER = 1 << 20


def zipf(ranks: dict[bytes, int]) -> dict[bytes, float]:
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(rank + 1) - total for token, rank in ranks.items()}


class UnigramTrie:
    """Best segmentations. Of equal scores the one with fewer tokens counts, then the shorter last token."""

    def __init__(self, ranks: dict[bytes, int], nodes: int = NODES):
        #: Vocabulary entries have their score; other ends of entries have None, so a search can stop.
        self.entries: dict[bytes, float | None] = {}
        for token, score in zipf(ranks).items():
            for i in range(1, len(token)):
                self.entries.setdefault(token[i:], None)
            self.entries[token] = score
        self.limit = nodes
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.score, self.count = [0.0], [0]

    def insert(self, token: bytes) -> int:
        """The terminal node of a pre-token."""
        if len(self.score) > self.limit:
            self.clear()
        path, node = [0], 0
        for end, byte in enumerate(token, 1):
            child = self.children[node].get(byte)
            if child is None:
                child = self.children[node][byte] = len(self.score)
                best, count = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    entry = token[start:end]
                    if entry not in self.entries:
                        break
                    own = self.entries[entry]
                    if own is not None:
                        before = path[start]
                        score, n = self.score[before] + own, self.count[before] + 1
                        if score > best or score == best and n < count:
                            best, count = score, n
                self.children.append({})
                self.score.append(best)
                self.count.append(count)
            node = child
            path.append(node)
        return node

    def tokens(self, token: bytes) -> int:
        return self.count[self.insert(token)]


class ReversedVocabulary:
    """The trie of reversed entries as arrays: from a state and a byte to the next state, and the score of the entry that ends there."""

    def __init__(self, ranks: dict[bytes, int]):
        states: dict[tuple[int, int], int] = {}
        own = [math.nan]
        for token, score in zipf(ranks).items():
            state = 0
            for byte in reversed(token):
                found = states.get((state, byte))
                if found is None:
                    found = states[state, byte] = len(own)
                    own.append(math.nan)
                state = found
            own[state] = score
        keys = np.array([s << 8 | b for s, b in states], np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.own = keys[order], np.array(list(states.values()), np.int64)[order], np.array(own)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which go on, and their states."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return hit, self.next[at[hit]]


def level_counts(tokens: list[bytes], vocabulary: ReversedVocabulary) -> np.ndarray:
    """The number of tokens of each pre-token (none empty), by a trie that is built level by level."""
    size = np.array([len(t) for t in tokens], np.int64)
    order = np.argsort(-size, kind="stable")  # those that reach a level stand first
    data = np.frombuffer(b"".join(tokens[i] for i in order.tolist()), np.uint8).astype(np.int64)
    size = size[order]
    begin = np.cumsum(size) - size
    reach = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    nodes = [np.zeros(len(tokens), np.int64)]  # of each level, the node of each pre-token
    score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    out = np.zeros(len(tokens), np.int64)
    for depth, n in enumerate(reach.tolist(), 1):
        _, head, node = np.unique(nodes[-1][:n] << 8 | data[begin[:n] + depth - 1], return_index=True, return_inverse=True)
        best, least = np.full(len(head), -np.inf), np.zeros(len(head), np.int64)
        alive, state = np.arange(len(head)), np.zeros(len(head), np.int64)
        for length in range(1, depth + 1):
            hit, state = vocabulary.step(state, data[begin[head[alive]] + depth - length])
            alive = alive[hit]
            if not len(alive):
                break
            own = vocabulary.own[state]
            ends = ~np.isnan(own)
            at = alive[ends]
            before = nodes[depth - length][head[at]]
            total, number = score[depth - length][before] + own[ends], count[depth - length][before] + 1
            better = (total > best[at]) | (total == best[at]) & (number < least[at])
            best[at[better]], least[at[better]] = total[better], number[better]
        nodes.append(node)
        score.append(best)
        count.append(least)
        done = size[:n] == depth
        out[order[:n][done]] = least[node[done]]
    return out


class TokenCounter:
    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.trie = UnigramTrie(ranks)
        self.vocabulary = ReversedVocabulary(ranks)
        self.findall = regex.compile(pattern).findall
        self.known = Kept(None, KEEP_ENCODED)

    def counts(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Numbers of pre-tokens and of tokens of each text."""
        found = [self.findall(t) for t in texts]
        self.known.bound()
        fresh = list({t for x in found for t in x}.difference(self.known))
        raw = [t.encode() for t in fresh]
        short = [i for i, t in enumerate(raw) if len(t) < LONG]
        for i, n in zip(short, level_counts([raw[i] for i in short], self.vocabulary).tolist(), strict=True):
            self.known.put(fresh[i], n)
        for t, r in zip(fresh, raw, strict=True):
            if len(r) >= LONG:
                self.known.put(t, self.trie.tokens(r))
        known = self.known
        for x in found:
            yield len(x), sum(map(known.__getitem__, x))
        if len(self.trie.score) > 1:
            self.trie.clear()

    def __call__(self, text: str) -> tuple[int, int]:
        return next(self.counts([text]))


@lru_cache(maxsize=2)
def counter(ranks_path: str, pattern: str) -> TokenCounter:
    return TokenCounter(ranks_path, pattern)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens for every row of ``docs``.

    Null text counts as empty: three zeros. Ids may be null; repeated rows stay; other columns are ignored. A very
    long text is counted whole, by one task. An empty table gives no rows. The vocabulary has every single byte, so
    every text has a segmentation.
    """

    def count(texts: list[str]) -> Iterator[tuple[int, int, int]]:
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from told(waiting)
                waiting, size = [], 0
        yield from told(waiting)

    def told(texts: list[str]) -> Iterator[tuple[int, int, int]]:
        for text, numbers in zip(texts, counter(ranks_path, pattern).counts(texts), strict=True):
            yield len(text.encode()), *numbers

    return _mapped(docs, count, "n_bytes long, n_pretokens long, n_tokens long", id_col, text_col, together=1 << 10)
