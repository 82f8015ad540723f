"""A double-array trie over word sequences, built and walked with numpy."""

from __future__ import annotations

import io

import numpy as np

WINDOW = 64  # first free slots tried for a node with several children
SCATTERED = 192  # further slots tried all over the arrays before it is put behind all others


class _Slots:
    """Slots of the arrays, growing as nodes are placed; slot 0 is the root."""

    def __init__(self, size: int) -> None:
        self.check = np.full(size, -1, np.int32)
        self.low, self.end = 1, 1  # no free slot below ``low``; none used from ``end`` on
        self.draw = np.random.default_rng(29)
        self.check[0] = 0

    def room(self, size: int) -> None:
        if size > len(self.check):
            self.check = np.concatenate([self.check, np.full(max(size, 2 * len(self.check)) - len(self.check), -1, np.int32)])

    def several(self, codes: np.ndarray) -> int:
        """A base at which all of these codes fall on free slots."""
        span, steps = int(codes[-1] - codes[0]), codes - codes[0]
        self.room(self.end + span + 1)
        near = np.flatnonzero(self.check[self.low:self.low + 16 * WINDOW] < 0)[:WINDOW] + self.low
        self.low = int(near[0]) if len(near) else min(self.low + 16 * WINDOW, self.end)
        first = np.concatenate([near[near < self.end], np.sort(self.draw.integers(min(self.low, self.end - 1), self.end, SCATTERED))])
        fits = np.flatnonzero((self.check[first[:, None] + steps[None, :]] < 0).all(axis=1))
        if len(fits):
            return int(first[fits[0]] - codes[0])
        return int(self.end - codes[0])

    def put(self, slots: np.ndarray, parents: np.ndarray | int) -> None:
        self.check[slots] = parents
        self.end = max(self.end, int(slots.max()) + 1)


def build(phrases: list[tuple[str, tuple[int, ...]]]) -> bytes:
    """The trie of distinct (language, word hashes) as bytes; phrase i is accepted as number i.

    From a state s the word of code c leads to slot base[s] + c if check there names s.  Nodes with many
    children are placed first, into gaps where they fit; those with one child fill what is left.
    """
    langs = sorted({lang for lang, _ in phrases})
    vocab, uses = np.unique(np.array([h for _, words in phrases for h in words], np.int64), return_counts=True)
    code = np.empty(len(vocab), np.int32)  # frequent words get small codes, so that the children of a node lie close together
    code[np.argsort(-uses, kind="stable")] = np.arange(1, len(vocab) + 1)
    deep = max(len(words) for _, words in phrases)
    table = np.zeros((len(phrases), deep + 1), np.int64)  # codes from 1; the language comes first
    number = {lang: i + 1 for i, lang in enumerate(langs)}
    for i, (lang, words) in enumerate(phrases):
        table[i, 0] = number[lang]
        table[i, 1:len(words) + 1] = words
    sizes = np.array([len(words) for _, words in phrases])
    for d in range(deep):
        held = sizes > d
        table[held, d + 1] = code[np.searchsorted(vocab, table[held, d + 1])]
    slots = _Slots(4 * len(phrases) + 16)
    base = np.zeros(len(slots.check), np.int32)
    at = np.zeros(len(phrases), np.int64)  # the slot that each phrase has reached
    for d in range(deep + 1):
        going = np.flatnonzero(sizes >= d)
        edges, which = np.unique(np.stack([at[going], table[going, d]], axis=1), axis=0, return_inverse=True)
        starts = np.flatnonzero(np.r_[True, edges[1:, 0] != edges[:-1, 0]])
        counts = np.diff(np.r_[starts, len(edges)])
        reached = np.zeros(len(edges), np.int64)
        for k in np.argsort(-counts, kind="stable")[:int((counts > 1).sum())].tolist():
            rows = slice(int(starts[k]), int(starts[k] + counts[k]))
            first = slots.several(edges[rows, 1])
            reached[rows] = first + edges[rows, 1]
            slots.put(reached[rows], int(edges[starts[k], 0]))
        single = starts[counts == 1]
        if len(single):
            slots.room(slots.end + len(single))
            reached[single] = np.flatnonzero(slots.check < 0)[:len(single)]
            slots.put(reached[single], edges[single, 0])
        if len(base) < len(slots.check):
            base = np.concatenate([base, np.zeros(len(slots.check) - len(base), np.int32)])
        base[edges[:, 0]] = reached - edges[:, 1]
        at[going] = reached[which.reshape(-1)]
    accept = np.full(slots.end, -1, np.int32)
    accept[at] = np.arange(len(phrases))
    out = io.BytesIO()
    np.savez(out, langs=np.array(langs, dtype=object), starts=np.array([base[0] + number[lang] for lang in langs]), vocab=vocab, code=code,
             base=base[:slots.end], check=slots.check[:slots.end], accept=accept, phrases=len(phrases), deep=deep)
    return out.getvalue()


class Trie:
    """A built trie that counts its phrases in whole texts at once."""

    def __init__(self, data: bytes) -> None:
        held = np.load(io.BytesIO(data), allow_pickle=True)
        self.vocab, self.code, self.base, self.check, self.accept = (held[k] for k in ("vocab", "code", "base", "check", "accept"))
        self.starts = dict(zip(held["langs"].tolist(), held["starts"].tolist(), strict=True))
        self.phrases, self.deep = int(held["phrases"]), int(held["deep"])

    def count(self, lang: str, words: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``counts`` how often each phrase of the language lies in ``words`` (hashes; 0 is a break).

        All positions move together, one word a step; those without a transition fall out.
        """
        if lang not in self.starts or not len(words):
            return
        place = np.searchsorted(self.vocab, words)
        place[place == len(self.vocab)] = 0
        codes = np.where((self.vocab[place] == words) & (words != 0), self.code[place], 0)
        at = np.flatnonzero(codes)
        state = np.full(len(at), self.starts[lang], np.int64)
        for _ in range(self.deep):
            inside = at < len(codes)
            at, state = at[inside], state[inside]
            there = self.base[state] + codes[at]
            fine = (codes[at] > 0) & (there >= 0) & (there < len(self.check))
            fine[fine] = self.check[there[fine]] == state[fine]
            at, state = at[fine] + 1, there[fine]
            ends = self.accept[state]
            counts += np.bincount(ends[ends >= 0], minlength=self.phrases)
            if not len(at):
                return
