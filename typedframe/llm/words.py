"""Words and shingles of many texts at once, as arrays. Hashes only sort things into groups; numbers, one for each distinct word's bytes, decide."""

from __future__ import annotations

from hashlib import blake2b
from operator import itemgetter

import numpy as np

#: Bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Keys of the words' hash, and bytes from which on a word is hashed by itself.
WORD_KEY, SEED, LONG = b"typedframe words", np.uint64(0x9FB21C651E98DF25), 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Number of each distinct word (bytes), given out in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(words) < 2:
            return np.array([self[w] for w in words], np.int64)
        return np.array(itemgetter(*words)(self), np.int64)


def split(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, a blank after each; word starts and ends in them; number of words before each text (one more than texts)."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    begin = np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))])
    return data, starts, ends, np.searchsorted(starts, begin)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer; zeros behind the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(9, np.uint8)]), strides=(1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of the eight bytes at each place, the first ``left``."""
    spare = (np.maximum(8 - left, 0) << 3).astype(np.uint64)
    return lanes[at] << spare


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each slice, which may not be empty: eight bytes a step, mixed in between. It is no polynomial, so slices can't be made to collide by their pattern."""
    lanes, size = _lanes(data), ends - starts
    h, live = mix(size.astype(np.uint64) * MIX2 + SEED), np.arange(len(starts))
    for k in range(LONG // 8):
        h[live] = mix((h[live] ^ _lane(lanes, starts[live] + 8 * k, size[live] - 8 * k)) * MIX1 + SEED)
        live = live[size[live] > 8 * k + 8]
        if not len(live):
            break
    raw = data.data
    for i in live.tolist():
        h[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]], digest_size=8, key=WORD_KEY).digest(), "little")
    return h


def same_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the slices numbered ``a`` and ``b`` have equal bytes."""
    lanes, size = _lanes(data), ends - starts
    out = size[a] == size[b]
    live, raw = np.flatnonzero(out), data.data
    for k in range(LONG // 8):
        left = size[a[live]] - 8 * k
        same = _lane(lanes, starts[a[live]] + 8 * k, left) == _lane(lanes, starts[b[live]] + 8 * k, left)
        out[live[~same]] = False
        live = live[same & (left > 8)]
        if not len(live):
            break
    for i in live.tolist():
        out[i] = raw[starts[a[i]] : ends[a[i]]] == raw[starts[b[i]] : ends[b[i]]]
    return out


def listed(raws: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words in order, and how many come before each text (one more than texts)."""
    per_text = [r.split() for r in raws]  # bytes.split parts at 0x20 and 0x09-0x0D, nothing else
    before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, per_text), np.int64, len(raws)))])
    return [w for words in per_text for w in words], before


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, before = split(raws)
    return hash_slices(data, starts, ends), before


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k]
        out = mix(out + np.uint64(k + 1))
    return out


def exact_windows(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` consecutive numbers, equal for equal runs only."""
    if len(numbers) < n:
        return np.zeros(0, np.int64)
    own = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    base, code = int(own.max()) + 1, own
    for k in range(1, n):
        code = np.unique(code[: len(own) - k] * base + own[k:], return_inverse=True)[1].astype(np.int64)
    return code


def placed(before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the shingles of each text: its text, first word and number of words. With fewer than ``n`` words the whole sequence is one; a text without words has none."""
    counts = np.diff(before)
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), size)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return doc, before[:-1][doc] + inside, np.minimum(counts, n)[doc]


def shingle_sets(raws: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending; where each text's begin (one more than texts); the exact number of its distinct shingles, told apart by their words' bytes."""
    data, starts, ends, before = split(raws)
    word = hash_slices(data, starts, ends)
    doc, first, length = placed(before, n)
    out = np.zeros(len(doc), np.uint64)
    for k in range(n):
        has = slice(None) if not len(length) or int(length.min()) > k else length > k
        out[has] = mix(out[has] + word[first[has] + k] + np.uint64(k + 1))
    order = np.lexsort((out, doc))
    out, doc, first, length = out[order], doc[order], first[order], length[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    at = np.searchsorted(doc[new], np.arange(len(before)))
    sizes = np.diff(at)
    again = np.flatnonzero(~new)
    differ = np.zeros(len(again), bool)
    for k in range(n):
        has = length[again] > k
        differ[has] |= ~same_slices(data, starts, ends, first[again[has]] + k, first[again[has] - 1] + k)
    for i in np.unique(doc[again[differ]]).tolist():  # a hash stands for several shingles
        words = raws[i].split()
        sizes[i] = len(set(zip(*(words[k:] for k in range(n)))))
    return out[new], at, sizes


def similar(left: list[list[bytes]], right: list[list[bytes]], percent: int, n: int = 5) -> np.ndarray:
    """Whether each pair's shingle sets have 100 * intersection >= percent * union, both non-empty; shingles are compared by their words' bytes."""
    words = [w for text in left + right for w in text]
    before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, left + right), np.int64, 2 * len(left)))])
    number = Numbers().of(words)
    doc, first, length = placed(before, n)
    padded = np.concatenate([number, np.zeros(n, np.int64)]) + 1
    code = np.zeros(len(doc), np.int64)
    for k in range(n):  # words behind the end of a short text count as 0
        unit = np.where(length > k, padded[first + k], 0)
        code = np.unique(code * (len(number) + 2) + unit, return_inverse=True)[1].astype(np.int64)
    n_pairs, total = max(1, len(left)), int(code.max()) + 1 if len(code) else 1
    key = np.unique((doc % n_pairs * total + code) * 2 + doc // n_pairs)
    pair, side = key // 2 // total, key & 1
    both = np.bincount(pair[1:][key[1:] >> 1 == key[:-1] >> 1], minlength=len(left))
    sizes = np.stack([np.bincount(pair[side == s], minlength=len(left)) for s in (0, 1)])
    return (sizes.min(axis=0) > 0) & (100 * both >= percent * (sizes.sum(axis=0) - both))
