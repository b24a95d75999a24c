"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .exchange import CHUNK_BYTES, HOT_CHUNKS, HOT_ENTRIES, Anchors, Chunk, by_place, cover, find_anchors, gram_hashes, repeated_intervals

#: Bytes that anchor a window: a third of it, so that about one place in 70 is an anchor.
GRAM_SHARE = 0.32


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes aren't compared again."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


#: An entry of a run: what it shares with the one before, right context, reversed left context, where it occurs (doc, place).
Entry = tuple[int, bytes, bytes, np.ndarray]


def write_run(entries: list[tuple[bytes, bytes, list[tuple[int, int]]]]) -> bytes:
    """A sorted run, front-coded: each context less what it shares with the one before. Entries are distinct."""
    n = len(entries)
    head, tails, places = np.zeros((n, 5), np.uint32), [], []
    before = (b"", b"")
    for i, (right, left, at) in enumerate(entries):
        r, s = common(before[0], right), common(before[1], left)
        head[i] = r, len(right) - r, s, len(left) - s, len(at)
        tails += [right[r:], left[s:]]
        places += at
        before = right, left
    body = np.uint32(n).tobytes() + head.tobytes() + np.array(places, np.uint32).tobytes() + b"".join(tails)
    return zstandard.ZstdCompressor(level=3).compress(body)


def read_run(blob: bytes) -> Iterator[Entry]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    head = np.frombuffer(body, np.uint32, 5 * n, 4).reshape(n, 5)
    total = int(head[:, 4].sum())
    places = np.frombuffer(body, np.uint32, 2 * total, 4 + 20 * n).reshape(total, 2)
    at, k, right, left = 4 + 20 * n + 8 * total, 0, b"", b""
    for r, rr, s, ss, m in head.tolist():
        right = right[:r] + body[at : at + rr]
        left = left[:s] + body[at + rr : at + rr + ss]
        at += rr + ss
        yield r, right, left, places[k : k + m]
        k += m


class LoserTree:
    """Merges front-coded runs. Each inner node keeps its loser and what that shares with the winner that beat it; when a run moves on, its
    next string's shared prefix with the last output is known from the run, and two strings are compared only behind equal known prefixes."""

    def __init__(self, runs: list[Iterator[Entry]]):
        self.runs = runs
        self.width = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[Entry | None] = [next(r, None) for r in runs] + [None] * (self.width - len(runs))
        self.loser, self.shared = [-1] * self.width, [0] * self.width
        self.winner, self.with_last = self._build(1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.width:
            return node - self.width, 0
        (a, _), (b, _) = self._build(2 * node), self._build(2 * node + 1)
        first, second, shared = self._play(a, b, 0)
        self.loser[node], self.shared[node] = second, shared
        return first, 0

    def _play(self, a: int, b: int, known: int) -> tuple[int, int, int]:
        """Winner, loser and their common prefix, ``known`` bytes of which are certain; an ended run loses."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a, 0) if x is None else (a, b, 0)
        h = common(x[1], y[1], known)
        less = len(x[1]) == h or len(y[1]) > h and x[1][h] < y[1][h]
        return (a, b, h) if less else (b, a, h)

    def __iter__(self) -> Iterator[tuple[int, int, Entry]]:
        """(shared prefix with the output before, run, entry)."""
        loser, shared, heads = self.loser, self.shared, self.heads
        while (head := heads[self.winner]) is not None:
            run = self.winner
            yield self.with_last, run, head
            heads[run] = now = next(self.runs[run], None)
            best, known = run, now[0] if now is not None else -1
            node = (run + self.width) >> 1
            while node:
                rival, h = loser[node], shared[node]
                if heads[rival] is None:
                    h = -1
                if h > known:  # the rival shares more with the last output, so it comes first
                    loser[node], shared[node], best, known = best, max(known, 0), rival, h
                elif h == known and h >= 0:
                    first, second, shared[node] = self._play(best, rival, h)
                    loser[node], best = second, first
                node >>= 1
            self.winner, self.with_last = best, max(known, 0)


def longest(rights: list[bytes], lefts: list[bytes], window: int) -> tuple[list[int], list[int]]:
    """For strings sorted by right context: the most that each shares to the left and to the right with others with which it shares ``window`` in all.

    A set of strings whose (reversed) left contexts share t is split by the byte behind t, and so on; in each, neighbours by
    right context share the most. Each string is in at most as many sets as its left context is long.
    """
    left, right = [0] * len(rights), [0] * len(rights)
    stack = [list(range(len(rights)))]
    while stack:
        own = stack.pop()
        texts = [lefts[i] for i in own]
        t = common(min(texts), max(texts))
        for i, j in zip(own, own[1:]):
            h = common(rights[i], rights[j])
            if t + h >= window:
                for x in (i, j):
                    left[x], right[x] = max(left[x], t), max(right[x], h)
        parts: dict[bytes, list[int]] = {}
        for i in own:
            if len(lefts[i]) > t:
                parts.setdefault(lefts[i][t : t + 1], []).append(i)
        stack += [p for p in parts.values() if len(p) > 1]
    return left, right


def merge_place(runs: list[tuple[int, bytes]], window: int, gram: int) -> list[tuple[int, np.ndarray]]:
    """From all runs of a place, rows (doc, low, high) of repeated bytes for each chunk."""
    marks: list[list[np.ndarray]] = [[] for _ in runs]

    def close(group: dict[tuple[bytes, bytes], list[tuple[int, np.ndarray]]]) -> None:
        pairs = list(group)
        left, right = longest([p[0] for p in pairs], [p[1] for p in pairs], window) if len(pairs) > 1 else ([0], [0])
        for (r, s), where, a, b in zip(pairs, group.values(), left, right):
            if sum(len(w) for _, w in where) > 1:
                a, b = len(s), len(r)
            if a + b >= window:
                for run, w in where:
                    at = w[:, 1].astype(np.int64)
                    marks[run].append(np.stack([w[:, 0].astype(np.int64), at - a, at + b], axis=1))

    group: dict[tuple[bytes, bytes], list[tuple[int, np.ndarray]]] = {}
    for shared, run, (_, right, left, where) in LoserTree([read_run(b) for _, b in runs]):
        if shared < gram and group:
            close(group)
            group = {}
        group.setdefault((right, left), []).append((run, where))
    if group:
        close(group)
    return [(c, np.concatenate(m)) for (c, _), m in zip(runs, marks) if m]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes), a row for each input row.

    Suffixes at anchors whose key recurs are sorted in each chunk, front-coded and exchanged; at its place each is merged with the others' by a loser tree,
    and neighbours in the order, with their left contexts, tell the longest repeated string around each anchor. Other suffixes can't begin
    or hold a repeated window's anchor, so they never move. Bytes decide, but for windows of hot keys (see ``exchange``), which are told apart by 128 bits of BLAKE2b.

    A null or empty text has no bytes (kept_sha256 is that of the empty string). A very long text stays whole, in one chunk. Rows that repeat an id are texts of their own: equal long ones remove each other. Null ids are
    allowed. An empty table gives an empty result; other columns are ignored.
    """
    gram = max(1, int(window * GRAM_SHARE))

    def anchors(texts: list[bytes]) -> Anchors:
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        return find_anchors(gram_hashes(data, gram), begin, gram, window, data)

    def encode(chunk: Chunk, a: Anchors, places: int) -> list[tuple[int, bytes]]:
        texts = chunk.texts
        order, parts = by_place(a.key.astype(np.uint64), places)
        doc, at, low, high = (x[order].tolist() for x in (a.doc, a.at, a.low, a.high))
        out = []
        for place, p, q in parts:
            entries: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
            for i in range(p, q):
                t = texts[doc[i]]
                entries.setdefault((t[at[i] : high[i] + window], t[low[i] : at[i]][::-1]), []).append((doc[i], at[i]))
            out.append((place, write_run([(r, s, entries[r, s]) for r, s in sorted(entries)])))
        return out

    def contents(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> Iterator[bytes]:
        return (texts[d][s : s + window] for d, s in zip(doc.tolist(), start.tolist()))

    def finish(chunk: Chunk, marks: np.ndarray) -> pa.Table:
        texts = chunk.texts
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        gone = cover(begin, marks) if len(marks) else np.zeros(int(begin[-1]), bool)
        removed, spans, kept = [], [], []
        for t, p, q in zip(texts, begin[:-1].tolist(), begin[1:].tolist()):
            own = gone[p:q]
            n = int(np.count_nonzero(own))
            removed.append(n)
            spans.append(int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if n else 0)
            kept.append(np.frombuffer(t, np.uint8)[~own].tobytes() if n else t)
        cols = {"doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return repeated_intervals(docs, id_col, text_col, window, anchors, encode, lambda runs: merge_place(runs, window, gram), contents, finish, ddl, False, chunk_bytes, hot_chunks, hot_entries)


#: The same result by grouping all strings of 200 bytes, as hexadecimal digits, cut from blocks of 512 places.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, i, substr(part, 1 + 2 * j, 400) AS win, 512 * i + j AS k FROM (SELECT r, i, substr(h, 1 + 1024 * i, 1422) AS part, least(n - 200 - 512 * i, 511) AS most FROM (SELECT r, h, n, unnest(range(0, (n - 200) // 512 + 1)) AS i FROM d WHERE n >= 200)), LATERAL (SELECT unnest(range(0, most + 1)) AS j)),
f AS (SELECT r, k, count(*) OVER (PARTITION BY md5_number(win)) AS c FROM b),
g AS (SELECT r, k, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM f WHERE c > 1),
e AS (SELECT r, min(k) AS low, max(k) + 200 AS high FROM g GROUP BY r, run),
o AS (SELECT r, low, high, max(high) OVER (PARTITION BY r ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
p AS (SELECT r, low, high, sum(CASE WHEN before IS NULL OR before < low THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY low) AS span FROM o),
q AS (SELECT r, span, min(low) AS low, max(high) AS high FROM p GROUP BY r, span),
z AS (SELECT r, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs, sum(high - low) AS gone FROM q GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(lows), 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN lows IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(lows) + 1), lambda x: substr(h, CAST(1 + 2 * (CASE WHEN x = 0 THEN 0 ELSE highs[x] END) AS BIGINT), CAST(2 * ((CASE WHEN x = len(lows) THEN n ELSE lows[x + 1] END) - (CASE WHEN x = 0 THEN 0 ELSE highs[x] END)) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""
