"""Token ids of a public vocabulary, by a cache of its pre-tokens.

Texts of ASCII and Latin-1 letters are split here as the vocabulary's own rules
split them, many texts at once; each piece is encoded once by its BPE model and
then looked up by a 64-bit hash of its bytes, and by 32 bits of another one and its
length, so pieces that share the first hash are told apart. Other texts are encoded word by word by the whole
tokenizer: its rules never look across white space.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from faultline.llm.words import SPACE, flat, hashes, runs

#: Bytes that take a text off the quick way: controls, the apostrophe, and all that lead other characters than x80 to xFF.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(9), *range(14, 32), 39, 127, *range(192, 195), *range(196, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters, 2 digits, 3 others; by lower-cased byte.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[SPACE] = 0
#: White space that Python splits at, but the vocabulary's rules don't.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: its own if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each span that has nothing to do with words.hashes, beside its length: sums of squares by place."""
    total = np.zeros(len(data) + 1, np.uint64)
    place = np.arange(len(data), dtype=np.uint64)
    spread = (data.astype(np.uint64) + np.uint64(257)) * np.uint64(0x9E3779B1)
    np.cumsum(spread ^ (spread >> np.uint64(15)), out=total[1:])
    first = total[ends] - total[starts]
    np.cumsum((spread ^ (spread >> np.uint64(13))) * place, out=total[1:])
    second = total[ends] - total[starts]
    # Places count from each span's start: the sum over them less the start times the plain sum.
    np.cumsum(spread ^ (spread >> np.uint64(13)), out=total[1:])
    second = second - (total[ends] - total[starts]) * starts.astype(np.uint64)
    return ((first * np.uint64(0xC2B2AE35)) ^ second) & np.uint64(0xFFFFFFFF) | (ends - starts).astype(np.uint64) << np.uint64(32)


def _firsts(h: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The first place of each different pair."""
    order = np.lexsort((mark, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (mark[order][1:] != mark[order][:-1])
    return order[new]


class WordTokenizer:
    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bpe, self.most, self.letters = self.whole.model, most, _byte_letters()
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Known pieces: an open table of places, and at each place a hash and a run of ids."""
        self.bits, self.known = 22, 0
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.marks, self.at = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64), np.zeros((1 << 12) + 1, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)

    def _encode(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _find(self, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The place of each hash and mark, -1 where they aren't known."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.place[slot]
        wrong = np.flatnonzero((out >= 0) & ((self.keys[out] != h) | (self.marks[out] != mark)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = got = self.place[slot[wrong]]
            wrong = wrong[(got >= 0) & ((self.keys[got] != h[wrong]) | (self.marks[got] != mark[wrong]))]
        return out

    def _learn(self, h: np.ndarray, mark: np.ndarray, pieces: list[bytes]) -> None:
        tokenize, letters, mask = self.bpe.tokenize, self.letters, (1 << self.bits) - 1
        ids = [[x.id for x in tokenize(p.decode("latin-1").translate(letters))] for p in pieces]
        n, m = self.known + len(h), self.at[self.known] + sum(map(len, ids))
        while len(self.keys) < n:
            self.keys, self.at = np.concatenate([self.keys, np.zeros_like(self.keys)]), np.concatenate([self.at, np.zeros_like(self.keys, np.int64)])
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
        while len(self.flat) < m:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.at[self.known] : m] = [x for each in ids for x in each]
        self.keys[self.known : n], self.marks[self.known : n] = h, mark
        self.at[self.known + 1 : n + 1] = self.at[self.known] + np.cumsum([len(x) for x in ids])
        place = self.place
        for k, slot in enumerate((h >> np.uint64(64 - self.bits)).astype(np.int64).tolist(), self.known):
            while place[slot] >= 0:
                slot = (slot + 1) & mask
            place[slot] = k
        self.known = n

    def _quick(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        low = _LOWER[data]
        low[1:][(data[:-1] == 0xC3) & (data[1:] < 0x9F)] += 32
        starts, ends = runs(_KIND[low], bounds, single=2)
        h, mark = hashes(low, starts, ends), marks(low, starts, ends)
        place = self._find(h, mark)
        if len(new := np.flatnonzero(place < 0)):
            first = _firsts(h[new], mark[new])
            if self.known + len(first) > self.most:
                self._forget()
                new = np.arange(len(h))
                first = _firsts(h, mark)
            raw, first = low.tobytes(), new[first]
            self._learn(h[first], mark[first], [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            place = self._find(h, mark)
        begin, size = self.at[place], self.at[place + 1] - self.at[place]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - to[:-1], size) + np.arange(to[-1])].tobytes()
        cuts = (to[np.searchsorted(starts, bounds)] * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _slow(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._encode(text)
        out, words = [], text.split()
        for at in range(0, len(words), 1 << 16):
            if len(self.words) > 100_000:
                self.words.clear()
            for w in words[at : at + (1 << 16)]:
                if (x := self.words.get(w)) is None:
                    x = self.words[w] = self._encode(w)
                out.append(x)
        return b"".join(out)

    def ids(self, column: pa.Array) -> list[bytes]:
        """Of each text, little-endian unsigned 32-bit ids; of a null, none."""
        data, bounds = flat(column)
        other = _OTHER[data]
        other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 60) & (data[1:] == 124)
        slow = np.unique(np.searchsorted(bounds, np.flatnonzero(other), "right") - 1).tolist()
        if not slow:
            return self._quick(data, bounds)
        keep = np.ones(len(column), bool)
        keep[slow] = False
        quick = column.filter(pa.array(keep))
        out = iter(self._quick(*flat(quick)) if len(quick) else [])
        return [next(out) if k else self._slow(column[i].as_py()) for i, k in enumerate(keep)]


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
