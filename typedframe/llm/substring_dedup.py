"""Removal of repeated word sequences by matching statistics over a compressed FM-index of each shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .exchange import CHUNK_BYTES, HOT_CHUNKS, HOT_ENTRIES, Anchors, Chunk, by_place, cover, find_anchors, repeated_intervals
from .words import Numbers, listed, split, windows, word_hashes

#: Words that anchor a window of 20.
GRAM_SHARE = 0.3


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code, by its share: within one bit of the entropy."""
    return np.maximum(1, np.ceil(np.log2(counts.sum() / np.maximum(counts, 1)))).astype(np.int64)


class WaveletTree:
    """Rank over a sequence of small integers, compressed to about its entropy: frequent symbols have short codes and leave the tree early.

    A level is one packed bitmap, the nodes side by side, with counts before each of its words; a symbol's way down is known from its code.
    """

    def __init__(self, values: np.ndarray, symbols: int):
        counts = np.bincount(values, minlength=symbols)
        self.length = np.where(counts > 0, code_lengths(counts), 0)
        depth = int(self.length.max()) if symbols else 0
        order = np.lexsort((np.arange(symbols), self.length))
        order = order[self.length[order] > 0]
        size = np.int64(1) << (depth - self.length[order])
        self.code = np.zeros(symbols, np.int64)
        self.code[order] = (np.cumsum(size) - size) >> (depth - self.length[order])
        self.levels = []
        for k in range(depth):
            values = values[self.length[values] > k]
            node = self.code[values] >> (self.length[values] - k)  # ascending: nodes lie side by side
            one = (self.code[values] >> (self.length[values] - k - 1)) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32)
            begin = np.searchsorted(node, np.where(self.length > k, self.code >> np.maximum(self.length - k, 0), 0)).astype(np.int32)
            ones = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((packed, before, begin, ones[begin].astype(np.int32)))
            # next level: in each node the zeros, then the ones
            cut = np.flatnonzero(np.diff(node, prepend=-1))
            first = np.repeat(cut, np.diff(np.append(cut, len(node))))
            last = np.repeat(np.append(cut[1:], len(node)), np.diff(np.append(cut, len(node))))
            ones_here, zeros_in = ones[:-1] - ones[first], (last - first) - (ones[last] - ones[first])
            to = first + np.where(one, zeros_in + ones_here, np.arange(len(node)) - first - ones_here)
            moved = np.empty_like(values)
            moved[to] = values
            values = moved

    def bits(self) -> int:
        return sum(64 * len(packed) for packed, *_ in self.levels)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of ``symbols`` lie before each place."""
        at, length, code = at.copy(), self.length[symbols], self.code[symbols]
        at[length == 0] = 0
        for k, (packed, before, begin, ones_at) in enumerate(self.levels):
            live = np.flatnonzero(length > k)
            if not len(live):
                break
            s = symbols[live]
            p = at[live] + begin[s]
            word = p >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))) - ones_at[s]
            at[live] = np.where((code[live] >> (length[live] - k - 1)) & 1 == 1, ones, at[live] - ones)
        return at


class FMIndex:
    """Compressed index of a text of integers from 1 on (0 ends a segment), right for patterns of up to ``depth`` symbols. Of the suffix array only the common prefixes of neighbours stay, a byte each."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        rank, h, ranks = text.astype(np.int64), 1, []
        while True:
            ranks.append((h, rank.astype(np.int32)))
            ahead = np.zeros(n, np.int64)
            if h < n:
                ahead[: n - h] = rank[h:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            step = np.diff(key[order], prepend=key[order[0]] - 1) > 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step) - 1
            h *= 2
            if h >= depth or step.all():
                break
        symbols = int(text.max()) + 1
        self.tree = WaveletTree(np.where(order > 0, text[order - 1], 0), symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        # common prefixes of neighbours by descending powers of two, as the ranks of the sort tell equal ones; at most 2 * h - 1 >= depth symbols
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n + 1, np.int64)
        for h, rank in [(h, rank), *reversed(ranks)] if len(ranks) else []:
            rank = np.append(rank, -1)
            same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (np.maximum(a, b) + h <= n)
            a[same] += h
            b[same] += h
            common[1:n][same] += h
        self.common = np.minimum(common, depth).astype(np.int8)
        self.common[[0, n]] = -1
        self.edges = [np.flatnonzero(self.common < k).astype(np.int32) for k in range(1, depth + 1)]
        group = np.cumsum(self.common[:n] < depth) - 1  # of suffixes that share ``depth`` symbols
        self.deep = self.edges[-1][group], self.edges[-1][group + 1]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with the symbol and go on as those of [low, high)."""
        both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.tile(self.first[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def widened(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share the first ``length`` symbols of those in [low, high)."""
        low, high = low.copy(), high.copy()
        for k in np.unique(length).tolist():
            own = length == k
            if k == 0:
                low[own], high[own] = 0, len(self.common) - 1
            elif k == self.depth:
                low[own], high[own] = self.deep[0][low[own]], self.deep[1][high[own] - 1]
            else:
                edges = self.edges[k - 1]
                low[own] = edges[np.searchsorted(edges, low[own], "right") - 1]
                high[own] = edges[np.searchsorted(edges, high[own])]
        return low, high


def matching_statistics(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of streams (``text[begin:end]``, all in lockstep from their ends): the length, up to the index's depth, of the longest string from there on that the indexed text holds more than
    once, and where its interval begins (equal for equal strings of that depth).

    A symbol to the left is a backward step. Where it leaves fewer than two suffixes, the string is shortened on the right to the next wider interval, and tried again. Each round
    is one step or one shortening of every stream.
    """
    length, start = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    at, stop = end - 1, begin
    low, high, size = np.zeros(len(begin), np.int64), np.full(len(begin), len(index.common) - 1), np.zeros(len(begin), np.int64)
    while True:
        going = at >= stop
        if not going.all():
            at, stop, low, high, size = at[going], stop[going], low[going], high[going], size[going]
        if not len(at):
            return length, start
        new_low, new_high = index.step(text[at], low, high)
        fits = new_high - new_low > 1
        low[fits], high[fits], size[fits] = new_low[fits], new_high[fits], size[fits] + 1
        less = np.flatnonzero(~fits & (size > 0))  # a symbol that the text has once at most matches nothing
        size[less] = np.maximum(index.common[low[less]], index.common[high[less]])
        size[size > index.depth] = index.depth
        wide = np.flatnonzero(fits & (size == index.depth))
        wide = np.concatenate([less, wide])
        low[wide], high[wide] = index.widened(low[wide], high[wide], size[wide])
        done = np.ones(len(at), bool)
        done[less] = False
        length[at[done]], start[at[done]] = size[done], low[done]
        at = at - done


def repeated_windows(text: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Those windows (numbers in ``starts``) that the text holds more than once, and the begin of each one's interval: its segments are streamed, and matching statistics reach the threshold there."""
    length, interval = matching_statistics(FMIndex(text, window), text, begin, end)
    found = np.flatnonzero(length[starts] == window)
    return found, interval[starts[found]]


def write_segments(segments: dict[bytes, list[tuple[int, int, int]]], order: list[bytes], doc_key: np.ndarray) -> bytes:
    """Distinct segments with the number of their windows, where they occur (doc, word) and the sort key of the first's document."""
    head = np.array([(len(s), segments[s][0][2], len(segments[s])) for s in order], np.int64).reshape(-1, 3)
    first = doc_key[[segments[s][0][0] for s in order]]
    places = np.array([(d, w) for s in order for d, w, _ in segments[s]], np.int32).reshape(-1, 2)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(order)).tobytes() + head.tobytes() + first.tobytes() + places.tobytes() + b"".join(order))


def read_segments(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 3 * n, 8).reshape(n, 3)
    first = np.frombuffer(body, np.int64, 3 * n, 8 + 24 * n).reshape(n, 3)
    m = int(head[:, 2].sum())
    places = np.frombuffer(body, np.int32, 2 * m, 8 + 48 * n).reshape(m, 2)
    at = 8 + 48 * n + 8 * m
    ends = (at + np.cumsum(head[:, 0])).tolist()
    return head, first, places, [body[a:b] for a, b in zip([at, *ends[:-1]], ends)]


def settle_shard(blobs: list[tuple[int, bytes]], window: int) -> list[tuple[int, np.ndarray]]:
    """Rows (doc, low, high) of repeated words for each chunk, from all segments of a shard.

    A window is removed if an equal one begins earlier. Of a segment's places all but the first have an earlier one; the first has if another
    segment's first place, shifted to that window, lies before.
    """
    parts = [(c, *read_segments(b)) for c, b in blobs]
    head = np.concatenate([p[1] for p in parts])
    first = np.concatenate([p[2] for p in parts])
    texts = [s for p in parts for s in p[4]]
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(s, len(number)) for s in texts])
    rep = np.zeros(len(number), np.int64)
    rep[of[::-1]] = np.arange(len(of))[::-1]
    places = np.concatenate([p[3] for p in parts]).astype(np.int64)
    at = np.cumsum(head[:, 2]) - head[:, 2]
    start = places[at, 1]
    # the first place of each distinct segment: by null id, id, hash of the text, number of the text in its chunk (equal ids and hashes share a chunk), word
    order = np.lexsort((start, places[at, 0], first[:, 2], first[:, 1], first[:, 0], of))
    lead = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    words, before = listed(list(number))
    n_words = np.diff(before)
    symbol = Numbers().of(words)  # by the words' bytes
    text = np.zeros(len(symbol) + len(n_words), np.int64)
    seg = np.repeat(np.arange(len(n_words)), n_words)
    text[np.arange(len(symbol)) + seg] = symbol + 1
    begin = before[:-1] + np.arange(len(n_words))
    n_windows = n_words - window + 1
    which = np.repeat(np.arange(len(n_words)), n_windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    found, group = repeated_windows(text, begin, begin + n_words, begin[which] + offset, window)
    late = np.zeros(len(which), bool)
    if len(found):
        owner = lead[which[found]]
        rank = np.lexsort((start[owner] + offset[found], places[at[owner], 0], first[owner, 2], first[owner, 1], first[owner, 0], group))
        late[found[rank]] = np.diff(group[rank], prepend=-1) == 0
    mask = np.zeros(len(n_words), np.int64)
    np.bitwise_or.at(mask, which[late], np.int64(1) << offset[late])
    whole = (np.int64(1) << n_windows) - 1
    per_place = np.repeat(np.arange(len(of)), head[:, 2])
    is_first = np.zeros(len(places), bool)
    is_first[at[lead]] = True
    bits = np.where(is_first, mask[of[per_place]], whole[of[per_place]])
    out, chunk = [], np.repeat(np.array([p[0] for p in parts]), [len(p[3]) for p in parts])
    for k in range(int(n_windows.max())):
        opens = ((bits >> k) & 1 == 1) & ((bits << 1 >> k) & 1 == 0)
        if opens.any():
            run = bits[opens] >> k
            length = np.log2((~run & (run + 1)).astype(np.float64)).astype(np.int64)
            out.append(np.stack([chunk[opens], places[opens, 0], places[opens, 1] + k, places[opens, 1] + k + length + window - 1], axis=1))
    if not out:
        return []
    rows = np.concatenate(out)
    return [(int(c), rows[rows[:, 0] == c, 1:]) for c in np.unique(rows[:, 0])]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining words), a row for each input row.

    Segments around anchors whose key recurs go to a shard by that key. A shard indexes its distinct segments in a compressed FM-index and streams them
    through it; matching statistics at the threshold tell the windows that recur, and what comes back are the intervals of words that an earlier window covers. Words are numbered by
    their bytes; only windows of hot keys (see ``exchange``) are told apart by 128 bits of BLAKE2b. ``window`` may be 2 to 60 words, else it is an error.

    A null or empty text has no words (kept_sha256 is that of the empty string). A very long text stays whole, in one chunk. Null ids come after all others. Rows that repeat an id follow each other by
    the hash of their text; the later ones lose what the earlier have. An empty table gives an empty result; other columns are ignored.
    """
    if not 2 <= window <= 60:
        raise ValueError(f"window must be from 2 to 60 words, not {window}")
    gram = max(1, int(window * GRAM_SHARE))

    def anchors(texts: list[bytes]) -> Anchors:
        words, before = word_hashes(texts)
        out = np.zeros(len(words), np.uint64)
        own = windows(words, gram)
        out[: len(own)] = own
        return find_anchors(out, before, gram, window, words)

    def encode(chunk: Chunk, a: Anchors, places: int) -> list[tuple[int, bytes]]:
        data, starts, ends, before = split(chunk.texts)
        raw, keys = data.tobytes(), chunk.keys()
        order, parts = by_place(a.key.astype(np.uint64), places)
        doc, low, n = a.doc[order].tolist(), a.low[order].tolist(), (a.high - a.low)[order].tolist()
        base = before[a.doc[order]]
        p0, p1 = starts[base + a.low[order]].tolist(), ends[base + a.high[order] + window - 1].tolist()
        out = []
        for place, p, q in parts:
            found: dict[bytes, list[tuple[int, int, int]]] = {}
            for i in sorted(range(p, q), key=lambda i: (doc[i], low[i])):
                found.setdefault(b" ".join(raw[p0[i] : p1[i]].split()) + b" ", []).append((doc[i], low[i], n[i]))
            out.append((place, write_segments(found, sorted(found), keys)))
        return out

    def contents(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> Iterator[bytes]:
        last = -1
        for d, s in zip(doc.tolist(), start.tolist()):  # in the order of texts
            if d != last:
                words, last = texts[d].split(), d
                joined = b" ".join(words) + b" "
                at = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))]).tolist()
            yield joined[at[s] : at[s + window]]

    def finish(chunk: Chunk, marks: np.ndarray) -> pa.Table:
        words = [t.split() for t in chunk.texts]
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        gone = cover(begin, marks) if len(marks) else np.zeros(int(begin[-1]), bool)
        removed, kept = [], []
        for w, p, q in zip(words, begin[:-1].tolist(), begin[1:].tolist()):
            own = gone[p:q]
            n = int(np.count_nonzero(own))
            removed.append(n)
            kept.append(b" ".join([w[i] for i in np.flatnonzero(~own).tolist()] if n else w))
        cols = {"doc_id": pa.array(chunk.ids, pa.int64()), "n_words": pa.array(map(len, words), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text
    return repeated_intervals(docs, id_col, text_col, window, anchors, encode, lambda blobs: settle_shard(blobs, window), contents, finish, ddl, True, chunk_bytes, hot_chunks, hot_entries)


#: The same result by grouping all windows of 20 words.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM w),
f AS (SELECT r, k, row_number() OVER (PARTITION BY array_to_string(ws[k:k + 19], ' ') ORDER BY doc_id, r, k) AS n FROM s),
c AS (SELECT DISTINCT r, unnest(range(k, k + 20)) AS i FROM f WHERE n > 1),
x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""
