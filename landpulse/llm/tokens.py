"""Token ids of whole texts, word by word, with a cache of words.

The vocabulary never joins characters across white space, so a text's ids are those of its white-space-free chunks one
after another. Each process keeps the ids of the chunks it has met; only new chunks go through the tokenizer. The cache
has a fixed size and starts anew when it is full, which changes nothing but time.
"""

from __future__ import annotations

import numpy as np

from landpulse.llm.textbytes import Slice, range_hashes, words

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 1_500_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, name: str = VOCABULARY) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)]
        sizes = np.fromiter((len(x) for x in found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, place, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, sizes)))

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts one after another, and the number of ids of each text."""
        w = words(part)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(part), np.int64)
        keys, first, back = np.unique(range_hashes(part.data, w.start, w.end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            start, end = w.start[first[new]], w.end[first[new]]
            ids, sizes = self._encode([part.data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())])
            self._add(keys[new], ids, sizes)
            place = np.searchsorted(self.keys, keys)
        at, size = self.at[place], self.size[place]
        counts = size[back]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(at[back] - (ends - counts), counts) + np.arange(int(ends[-1]))]
        total = np.concatenate([[0], ends])
        return ids, total[w.first[1:]] - total[w.first[:-1]]


_OWN: dict[str, WordTokenizer] = {}


def worker_tokenizer(name: str = VOCABULARY) -> WordTokenizer:
    """The tokenizer of this process; workers are reused, so their caches grow warm."""
    if name not in _OWN:
        _OWN[name] = WordTokenizer(name)
    return _OWN[name]
