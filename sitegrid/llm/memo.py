"""Token ids of texts from those of their distinct words, which a worker remembers up to a bounded number.

A cut gives a text's words so that their ids, one word after the other, are the text's. What is remembered follows from the
vocabulary alone, so results don't depend on which tasks a worker ran before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator
from itertools import islice

import numpy as np

MEMO_WORDS = 400_000


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memo:
    """Words are numbered as they come; ids of word k are flat[start[k]:start[k + 1]]."""

    def __init__(self, cut: Callable[[str], list], ids_of: Callable[[list], list[np.ndarray]], size: int = MEMO_WORDS):
        self.cut, self.ids_of, self.size = cut, ids_of, size
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[Hashable, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.known, self.flat, self.start = 0, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        made = self.ids_of(list(islice(self.place, self.known, None)))
        if made:
            self.known += len(made)
            self.flat = np.concatenate([self.flat, *made]).astype(np.uint32)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in made], dtype=np.int64)])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if len(self.place) > self.size:
            self.clear()
        number, codes = self.place.__getitem__, []
        for t in texts:
            words = self.cut(t)
            codes.append(np.fromiter(map(number, words), np.int64, len(words)))
        self.learn()
        for c in codes:
            yield self.flat[spread(self.start[c], self.start[c + 1] - self.start[c])]


_KEPT: dict[Hashable, object] = {}  # of a worker, the last one asked for of each kind


def kept(kind: str, key: Hashable, make: Callable[[], object]) -> object:
    """What make() made for this kind and key, made once for each worker."""
    if _KEPT.get(kind, (None,))[0] != key:
        _KEPT[kind] = key, make()
    return _KEPT[kind][1]
