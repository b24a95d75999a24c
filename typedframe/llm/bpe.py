"""Byte-level BPE: boundaries by associative scans over codepoint classes, cached pair merging, exact decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .io import FORGET, map_batches, texts_of

#: Codepoint classes.
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols of the automaton: the classes, with white space told apart by what follows, and apostrophes before a contraction.
S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_LAST_BLANK, S_LAST_SPACE, S_SHORT, S_LONG, S_BEGIN = range(9)
#: States: what the open piece is. A joiner is the one blank that the next piece takes; OWED1/2: letters that a contraction still takes.
NONE, IN_L, IN_N, IN_O, JOINER, IN_SPACE, OWED1, OWED2 = range(8)
FAR = 1 << 30
#: White space in Unicode's sense. Fixed values.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    kind = np.array([*map(ord, map(itemgetter(0), map(unicodedata.category, map(chr, range(0x110000)))))], np.uint8)
    out = np.full(0x110000, OTHER, np.uint8)
    out[kind == ord("L")], out[kind == ord("N")] = LETTER, NUMBER
    out[list(WHITE)] = SPACE
    return out


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins at the symbol, both by state * 16 + symbol."""
    to, begins = np.zeros(128, np.uint8), np.zeros(128, bool)
    run = {S_LETTER: IN_L, S_NUMBER: IN_N, S_OTHER: IN_O, S_SHORT: IN_O, S_LONG: IN_O}
    for state in range(8):
        for sym in range(8):
            if state in (OWED1, OWED2):
                new, cut = (NONE if state == OWED1 else OWED1), False
            elif sym == S_INNER:
                new, cut = IN_SPACE, state != IN_SPACE
            elif sym in (S_LAST_BLANK, S_LAST_SPACE):
                new, cut = (JOINER if sym == S_LAST_BLANK else NONE), True
            elif state == JOINER or state == run[sym]:
                new, cut = run[sym], False
            else:
                new, cut = {S_SHORT: OWED1, S_LONG: OWED2}.get(sym, run[sym]), True
            to[state * 16 + sym], begins[state * 16 + sym] = new, cut
    return to, begins


def _symbols(cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Symbol of each codepoint; ``begins``: where texts begin, ascending."""
    kind = classes()[cp]
    n = len(cp)
    last = np.zeros(n, bool)  # last of its text
    last[begins[1:] - 1] = True
    last[-1] = True
    sym = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER], np.uint8)[kind]
    space = kind == SPACE
    before_text = np.zeros(n, bool)
    before_text[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    sym[before_text] = np.where(cp[before_text] == 0x20, S_LAST_BLANK, S_LAST_SPACE)
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        in1 = ~last[quote]
        in2 = in1 & ~np.concatenate([last, [True]])[quote + 1]
        of = lambda s: np.isin(one, [ord(c) for c in s])
        pair = lambda s: (one == ord(s[0])) & (two == ord(s[1]))
        sym[quote[in1 & of("stmd")]] = S_SHORT
        sym[quote[in2 & (pair("re") | pair("ve") | pair("ll"))]] = S_LONG
    return sym


def boundaries(cp: np.ndarray, begins: np.ndarray, width: int = 128) -> np.ndarray:
    """Where pieces begin, as sorted places in ``cp``.

    Each block's transition function (a state for each state it may begin in) is found for all blocks in lockstep; functions compose
    associatively, so an exclusive scan by doubling gives each block's first state; a second lockstep pass emits the boundaries.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    to, cuts = machine()
    rows = -(-n // width)
    sym = np.full(rows * width, S_INNER, np.uint8)
    sym[:n] = _symbols(cp, begins)
    grid = np.ascontiguousarray(sym.reshape(rows, width).T)
    fresh = np.zeros(rows * width, bool)
    fresh[begins] = True
    fresh_grid = np.ascontiguousarray(fresh.reshape(rows, width).T)
    any_fresh = fresh_grid.any(axis=1)
    fn = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for k in range(width):
        if any_fresh[k]:
            fn[:, fresh_grid[k]] = NONE
        np.take(to, (fn << 4) | grid[k], out=fn)
    scan, d = fn, 1
    while d < rows:  # inclusive: after it, column r is the composition of blocks 0..r
        scan = np.concatenate([scan[:, :d], np.take_along_axis(scan[:, d:], scan[:, :-d], axis=0)], axis=1)
        d *= 2
    state = np.concatenate([[np.uint8(NONE)], scan[NONE, :-1]])
    marks = np.zeros((width, rows), bool)
    for k in range(width):
        if any_fresh[k]:
            state[fresh_grid[k]] = NONE
        at = (state << 4) | grid[k]
        marks[k] = cuts[at] | fresh_grid[k]
        state = to[at]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Odd multipliers of the piece hash.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + 1024, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of an unsigned array, from prefix sums of one polynomial."""
    up, down = powers(len(values) + 1)
    x = (values.astype(np.uint64) + np.uint64(7)) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    x *= up[: len(x)]
    np.cumsum(x, out=x)
    total = np.concatenate([np.zeros(1, np.uint64), x])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(MIX)
    h ^= h >> np.uint64(32)
    return h * np.uint64(BASE)


class Encoder:
    """Hash of a piece -> its number; the ids of all pieces lie in one array. Forgets its pieces when there are too many.

    ``encode`` decodes what it made and compares it with the text, so a hash collision is found, and the texts are then encoded without the cache.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        self.ranks, self.most = load_ranks(path), most
        words = sorted(self.ranks, key=self.ranks.get)
        size = max(self.ranks.values()) + 1
        self.lens = np.zeros(size, np.int64)
        for w in words:
            self.lens[self.ranks[w]] = len(w)
        self.at = np.cumsum(self.lens) - self.lens
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(a << 20) | b: r for w, r in self.ranks.items() for i in range(1, len(w)) if (a := self.ranks.get(w[:i])) is not None and (b := self.ranks.get(w[i:])) is not None}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.forget()

    def forget(self) -> None:
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list[bytes] = []

    def settle(self) -> None:
        """Finds the ids of the pieces that were new, in lockstep for pieces of like length."""
        if not self.pending:
            return
        raws, self.pending = self.pending, []
        count, flat = np.ones(len(raws), np.int64), {}
        by_width: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if (r := self.ranks.get(raw)) is not None:
                flat[i] = [r]
            elif len(raw) <= 32:
                by_width.setdefault(-(-len(raw) // 4) * 4, []).append(i)
            else:
                flat[i] = self.merge(raw)
                count[i] = len(flat[i])
        done = []
        for width, rows in by_width.items():
            ids, n = self.merge_many([raws[i] for i in rows], width)
            count[rows] = n
            done.append((np.array(rows), ids, n))
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, ids, n in done:
            inside = np.arange(ids.shape[1]) < n[:, None]
            out[(first[rows][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        for i, x in flat.items():
            out[first[i] : first[i] + len(x)] = x
        self.ids = np.concatenate([self.ids, out])
        self.count = np.concatenate([self.count, count])
        self.first = np.cumsum(self.count) - self.count

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or FAR; an id of -1 has no pair."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], FAR)

    def merge_many(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (rows filled up with -1) and how many, of pieces of at most ``width`` bytes: one merge a row and round."""
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = self.of_byte[np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(-1, width)]
        ids[np.arange(width) >= n[:, None]] = -1
        ids = np.concatenate([ids, np.full((len(raws), 1), -1, np.int32)], axis=1)
        rank = np.full(ids.shape, FAR, np.int32)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live, out_ids = np.arange(len(raws)), ids.copy()
        cols = np.arange(width)
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            low = rank[row, at]
            going = low < FAR
            if not going.all():
                out_ids[live[~going]] = ids[~going]
                live, ids, rank, at, low = live[going], ids[going], rank[going], at[going], low[going]
                row = np.arange(len(live))
                if not len(live):
                    break
            n[live] -= 1
            source = cols + (cols > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            rank[:, :-1] = np.take_along_axis(rank, source, axis=1)
            ids[row, at] = low
            rank[row, at] = self._rank(low, ids[row, at + 1])
            has = at > 0
            rank[row[has], at[has] - 1] = self._rank(ids[row[has], at[has] - 1], low[has])
        return out_ids, n

    def merge(self, raw: bytes) -> list[int]:
        """Always the pair of the lowest rank, the leftmost of equals: by rescans if short, else by a heap."""
        get = self.ranks.get
        if len(raw) <= 40:
            parts = [raw[i : i + 1] for i in range(len(raw))]
            pair = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            while pair and (low := min(pair)) < 1 << 30:
                i = pair.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pair[i]
                if i:
                    pair[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
                if i < len(pair):
                    pair[i] = get(parts[i] + parts[i + 1], 1 << 30)
            return [self.ranks[p] for p in parts]
        n = len(raw)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if 0 <= end[i] < n else -1
            if end[i] < 0 or j < 0 or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                prev[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := get(raw[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more than texts)."""
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = boundaries(cp, np.unique(begin[:-1][begin[:-1] < len(cp)]))
        ends = np.append(starts[1:], len(cp))
        if len(self.known) > self.most:
            self.forget()
        ids, after = self._gather(self._look_up(joined, cp, starts, ends))
        if self.decode(ids)[0].tobytes() != joined.encode():
            self.forget()
            self.pending = [joined[a:b].encode() for a, b in zip(starts.tolist(), ends.tolist())]
            self.settle()
            ids, after = self._gather(np.arange(len(starts)))
            self.forget()
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, begin)]

    def _look_up(self, joined: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece; new ones are added. Python sees each distinct new piece once."""
        distinct, example, which = np.unique(slice_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == distinct[inside]
        number = np.empty(len(distinct), np.int64)
        number[old] = self.number[at[old]]
        if not old.all():
            fresh = np.flatnonzero(~old)
            number[fresh] = len(self.count) + np.arange(len(fresh))
            self.pending = [joined[a:b].encode() for a, b in zip(starts[example[fresh]].tolist(), ends[example[fresh]].tolist())]
            self.settle()
            self.known = np.insert(self.known, at[fresh], distinct[fresh])
            self.number = np.insert(self.number, at[fresh], number[fresh])
        return number[which]

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[which]
        after = np.cumsum(n)
        return self.ids[np.repeat(self.first[which] - (after - n), n) + np.arange(after[-1])], after

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin (one more than ids)."""
        n = self.lens[ids]
        after = np.cumsum(n)
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        return self.blob[np.repeat(self.at[ids] - (after - n), n) + np.arange(after[-1])], np.concatenate([[0], after])


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    out = Encoder(path)
    FORGET.append(out.forget)
    return out


def groups(texts: list[str], chars: int = 1 << 18):
    """Runs of texts of about so many characters; a longer text is one of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def bpe_round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, ids (array<int>), a row for each input row.

    A null or empty text has no tokens. Null ids and repeated rows pass through; an empty table gives an
    empty result; other columns are ignored. No shuffle; a worker holds 262,144 characters at a time, or one longer text, and a
    bounded cache of pieces.
    """

    def rows(batch: pa.RecordBatch) -> list:
        texts, enc = texts_of(batch, "text"), encoder(ranks_path)
        out: list[list] = [[], [], [], [], []]
        for a, b in groups(texts):
            ids, at = enc.encode(texts[a:b])
            raw, byte_at = enc.decode(ids)
            packed, raw, cut = ids.astype("<u4").tobytes(), raw.tobytes(), byte_at[at].tolist()
            for i, (p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                piece = raw[cut[i] : cut[i + 1]]
                for column, x in zip(out, (q - p, hashlib.sha256(packed[4 * p : 4 * q]).hexdigest(), hashlib.sha256(piece).hexdigest(), len(piece), packed[4 * p : 4 * q])):
                    column.append(x)
        return [batch.column("doc_id"), *out]

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("ids", pa.binary())])
    return map_batches(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, ids binary", arrow)
